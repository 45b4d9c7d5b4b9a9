"""Toxicity of whole texts: a weighted lexicon, matched by an Aho-Corasick automaton.

``learn`` makes a lexicon from labelled documents, ``score`` applies one to any table.

Folding. Text and lexicon are folded alike before they meet: lower case, accents removed,
look-alike letters of other scripts and digits or signs used as letters replaced (1, l and i are
one class), invisible characters removed, everything else that is no letter a space.

Learning. The labelled rows are a bounded sample (``MAX_TOXIC`` and ``MAX_CLEAN`` rows, by hash of
the id; the lexicon needs no more), near copies with the same label counted once. Near copies are
texts whose ``KEY_HASHES`` smallest shingle hashes are the same; a passage or line in common is not
enough, and of each group the row with the smallest id stays. Entries are word
beginnings and whole words that stand in toxic documents far more often than chance allows (G test
against ``MIN_G``), no entry below another; the weight is the smoothed log odds.

Scoring. Weights of all matches outside exception phrases are summed up and, beside the sum, set
against the length of the text; a logistic curve fitted on the same sample turns both into 0 to 1.

Nulls, ties, repeats: a null text is an empty one; its score is the curve's value without matches.
A document labelled twice is toxic if any label says so. Without labelled rows of both kinds the
lexicon is empty and every score is the smoothed share of toxic labels. Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .base import batch_of, stored

#: Labelled rows that are learnt from, at most.
MAX_TOXIC = 4000
MAX_CLEAN = 12_000
#: Entries of a lexicon, at most.
MAX_TERMS = 2000
#: Toxic documents that must hold an entry, and its least G statistic (p below 10**-6).
MIN_SUPPORT = 4
MIN_G = 25.0
#: Lengths of word beginnings.
PREFIXES = range(4, 9)
LONGEST_WORD = 24
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Smallest hashes of a text's five-word shingles that near copies have in common.
KEY_HASHES = 8
#: Pieces that the sample is counted in.
SAMPLE_PARTS = 48
#: Harmless phrases that hold words a lexicon may have.
EXCEPTIONS = (
    "trash can", "trash bin", "class clown", "clown fish", "idiot proof", "pond scum",
    "worthless check", "loser bracket",
)

# Letters that look like others, and signs used for letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ł": "l", "ø": "o",
    "đ": "d", "ɡ": "g", "ɑ": "a",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "|": "i", "l": "i",
}
_INVISIBLE = "­​‌‍⁠﻿"


class _Folding(dict):
    """``str.translate`` table, filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in _INVISIBLE or unicodedata.category(c) in ("Mn", "Cf"):
            out = ""
        else:
            plain = unicodedata.normalize("NFKD", c).lower()
            plain = "".join(x for x in plain if unicodedata.category(x) != "Mn")
            out = "".join(
                _ALIKE.get(x, x) if x in _ALIKE or x.isalpha() else " " for x in plain
            )
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """The folded text: words of letters, one or more spaces between them."""
    return (text or "").translate(_FOLDING)


def patterns_of(text: str | None) -> set[str]:
    """Word beginnings (``" begin"``) and whole words (``" word "``) of a text."""
    found: set[str] = set()
    for w in set(fold(text).split()):
        n = len(w)
        if 3 <= n <= LONGEST_WORD:
            found.add(f" {w} ")
        for k in PREFIXES:
            if k > n:
                break
            found.add(f" {w[:k]}")
    return found


def outside(found: list[tuple], spans: list[tuple[int, int]]) -> list[tuple]:
    """The entries of ``found`` whose place (their first item) lies in none of ``[from, to)``.

    One sweep over both in order: a place is covered if any span that begins up to it reaches
    beyond it.
    """
    spans = sorted(spans)
    kept, at, reach = [], 0, -1
    for f in sorted(found):
        while at < len(spans) and spans[at][0] <= f[0]:
            reach = max(reach, spans[at][1])
            at += 1
        if f[0] >= reach:
            kept.append(f)
    return kept


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the curve from weights to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: Sequence[str] = EXCEPTIONS
    #: Intercept, factor of log(1 + sum), factor of the sum per hundred words.
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _automaton: object = field(default=None, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p, w in self.weights.items():
                a.add_word(p, (len(p), w))
            for phrase in self.exceptions:
                p = f" {' '.join(fold(phrase).split())} "
                a.add_word(p, (len(p), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, text: str | None) -> tuple[int, list[tuple[int, str, float]]]:
        """Number of words, and ``(start, entry, weight)`` of the matches in the folded text."""
        words = fold(text).split()
        a = self.automaton()
        if not words or not len(a):
            return len(words), []
        plain = f" {' '.join(words)} "
        found, harmless = [], []
        for end, (n, w) in a.iter(plain):
            start = end - n + 1
            if w is None:
                harmless.append((start, end))
            else:
                found.append((start, plain[start : end + 1], w))
        if harmless:
            found = outside(found, harmless)
        return len(words), found

    def features(self, text: str | None) -> tuple[int, int, float]:
        """Words, matches, and the sum of their weights."""
        n, found = self.matches(text)
        return n, len(found), math.fsum(w for *_, w in found)

    def value(self, n_words: int, total: float) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(max(0.0, total)) + c * 100 * total / (n_words + 20)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def training_sample(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN
) -> DataFrame:
    """``(text, toxic)`` of labelled documents (``labels``: doc_id, toxic), near copies of one label
    once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(max_toxic).unionByName(
        known.where("toxic = 0").orderBy(*by_hash).limit(max_clean)
    )
    # At most max_toxic + max_clean pairs of numbers.
    chosen = F.broadcast(stored(chosen, "chosen"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    ids = rows.schema["doc_id"].dataType.simpleString()

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                w = fold(text).split()
                grams = {" ".join(g) for g in zip(*(w[i:] for i in range(5)))} or {" ".join(w)}
                least = sorted(xxhash.xxh3_64_intdigest(g) for g in grams)[:KEY_HASHES]
                keys.append(b"".join(h.to_bytes(8, "big") for h in least))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary())],
                names=["doc_id", "text", "toxic", "_key"],
            )

    keyed = rows.mapInArrow(with_key, f"doc_id {ids}, text string, toxic int, _key binary")
    first = F.min(F.struct("doc_id", F.xxhash64("text").alias("_hash"), "text")).alias("_first")
    kept = keyed.groupBy("_key", "toxic").agg(first)
    return stored(kept.select(F.col("_first.text").alias("text"), "toxic"), "sample")


def _count_patterns(sample: DataFrame) -> DataFrame:
    schema = pa.schema([("pattern", pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                seen[toxic].update(patterns_of(text))
        names = list(seen[1] | seen[0])
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield batch_of(
                schema, pattern=part, t=[seen[1][p] for p in part], c=[seen[0][p] for p in part]
            )

    return (
        sample.select("text", "toxic").repartition(SAMPLE_PARTS)
        .mapInArrow(run, "pattern string, t long, c long")
        .groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    )


def choose_terms(rows: list[tuple[str, int, int, float]], toxic: int, clean: int) -> dict:
    """Entries with weights out of ``(pattern, t, c, g)``: the strongest first, none below or
    above a chosen one; ties go to beginnings, then to the longer pattern."""
    chosen: dict[str, float] = {}
    above: set[str] = set()
    for p, t, c, _ in sorted(rows, key=lambda r: (-round(r[3], 6), r[0][-1] == " ", -len(r[0]), r[0])):
        w = p.strip()
        steps = [f" {w[:k]}" for k in range(1, len(w) + 1)] + [f" {w} "]
        if p in above or any(s in chosen for s in steps):
            continue
        chosen[p] = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log(
            (c + 0.5) / (clean - c + 0.5)
        )
        above.update(s for s in steps if len(s) < len(p) or s == p)
    return {p: w for p, w in chosen.items() if w > 0}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    max_terms: int = MAX_TERMS,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from documents and their labels (``doc_id``, ``toxic`` 0 or 1)."""
    sample = training_sample(docs, labels, max_toxic, max_clean)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon(exceptions=tuple(exceptions))
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        lexicon.curve = (math.log(share / (1 - share)), 0.0, 0.0)
        return lexicon
    t, c, n = F.col("t"), F.col("c"), toxic + clean

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (
        part(t, (t + c) * (toxic / n)) + part(c, (t + c) * (clean / n))
        + part(toxic - t, (n - t - c) * (toxic / n)) + part(clean - c, (n - t - c) * (clean / n))
    )
    strong = (
        _count_patterns(sample).where(t >= MIN_SUPPORT).withColumn("g", g)
        .where((F.col("g") >= MIN_G) & (t * clean > c * toxic))
        .orderBy(F.desc("g"), "pattern").limit(5 * max_terms)
    )
    terms = choose_terms([tuple(r) for r in strong.collect()], toxic, clean)
    lexicon.weights = dict(list(terms.items())[:max_terms])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.float64()), batch.column(1)],
                names=["n", "total", "toxic"],
            )

    # At most max_toxic + max_clean rows of three numbers.
    rows = sample.select("text", "toxic").mapInArrow(measure, "n long, total double, toxic int")
    rows = np.array([tuple(r) for r in rows.orderBy("n", "total", "toxic").collect()], dtype=float)
    x = np.column_stack([np.log1p(np.maximum(rows[:, 1], 0)), 100 * rows[:, 1] / (rows[:, 0] + 20)])
    lexicon.curve = _fit(x, rows[:, 2])
    return lexicon


def score(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_words, n_matches, score)`` for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([lexicon.value(n, s) for n, _, s in rows], pa.float64())],
                names=["doc_id", "n_words", "n_matches", "score"],
            )

    return slim.mapInArrow(run, f"doc_id {ids}, n_words long, n_matches long, score double")


def clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at):
                n, _, total = lexicon.features(text.as_py())
                keep.append(lexicon.value(n, total) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
