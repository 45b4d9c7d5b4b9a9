"""Document fingerprints: homomorphic multiset hashes of a text's paragraphs.

A paragraph (a line) is hashed to a wide vector, and the fingerprint of a text is the sum of its
paragraphs' vectors modulo 2**48 in every word. Sums don't depend on the order, so texts with the
same paragraphs in any order have equal fingerprints, and a paragraph is inserted or deleted by
adding or subtracting its vector (``insert``, ``delete``) without the rest of the text.

A vector has 53 words of 48 bits:

* word 0: the number of features of the paragraph (its word pairs, the last word standing alone);
* words 1 to 4: four hashes of the paragraph, each from another state. Their sums tell texts apart;
* words 5 to 52: one counter each, 48 in all. Of a feature's hash 48 bits are taken, and each adds
  to one counter, so the counters show how alike two texts are (``likeness``): the cosine of the
  counters around their mean, which is near 0 for texts that share no features. A counter has a
  word of its own, so no text that fits a string is long enough to overflow it.

DataFrame functions only. A null text is an empty one, which is one empty paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import global_row_number
from .base import stored

WORD_MASK = (1 << 48) - 1
IDENTITY_WORDS = 4
COUNTER_WORDS = 48
WORDS = 1 + IDENTITY_WORDS + COUNTER_WORDS


def _paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _features(text: Column) -> Column:
    """Hashes of the word pairs of each paragraph; its last word has no second one."""
    words = F.transform(
        _paragraphs(text),
        lambda p: F.filter(F.split(p, "[ \\t\\r\\f\\x0B]+", -1), lambda w: w != ""),
    )
    return F.flatten(
        F.transform(
            words,
            lambda w: F.zip_with(
                w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b)
            ),
        )
    )


def _identity(text: Column) -> list[Column]:
    return [_hash_sum(_paragraphs(text), seed) for seed in range(IDENTITY_WORDS)]


def vector(text: Column) -> Column:
    """The fingerprint of a text as an array of ``WORDS`` numbers below 2**48.

    For single texts, such as a paragraph to insert; ``fingerprints`` has the same for a table,
    with less work for each word.
    """
    pairs = _features(text)
    return F.concat(F.array(F.size(pairs).cast("long"), *_identity(text)), _counters(pairs))


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``keys`` with the fingerprints of some text columns (``texts``: text column -> name).

    Features become rows and are summed up by ``keys`` (which tell the texts apart) right where
    they are read; a row for each key, text and task is shuffled. Rows with equal keys must have
    equal texts: they are counted, and come back once with ``n_rows``.
    """
    columns = list(texts)
    # A null feature leads each text: texts without words stay, and the nulls count the rows.
    tagged = F.concat(
        *[
            F.transform(
                F.concat(F.array(F.lit(None).cast("long")), _features(F.col(c))),
                _tagged(i),
            )
            for i, c in enumerate(columns)
        ]
    )
    identity = [F.array(*_identity(F.col(c))).alias(f"_id{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys, *identity, tagged.alias("_tagged"))
    chosen = F.lit(None).cast("array<long>")
    for i in range(len(columns)):
        chosen = F.when(F.col("_f.text") == i, F.col(f"_id{i}")).otherwise(chosen)
    # Numbers only, so that the sums stay in one compiled loop.
    spread = rows.select(
        *keys, *[f"_id{i}" for i in range(len(columns))], F.explode("_tagged").alias("_f")
    ).select(
        *keys, F.col("_f.text").alias("_text"), F.col("_f.h").alias("_h"),
        *[
            F.when(F.col("_f.h").isNull(), F.element_at(chosen, k + 1)).alias(f"_i{k}")
            for k in range(IDENTITY_WORDS)
        ],
    )
    sums = [F.count("_h").alias("_n"), (F.count("*") - F.count("_h")).alias("n_rows")]
    sums += [F.max(f"_i{k}").alias(f"_i{k}") for k in range(IDENTITY_WORDS)]
    sums += [
        F.sum(F.shiftright("_h", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"_c{k}")
        for k in range(COUNTER_WORDS)
    ]
    summed = spread.groupBy(*keys, "_text").agg(*sums)
    words = [F.expr("_n div n_rows")] + [F.col(f"_i{k}") for k in range(IDENTITY_WORDS)]
    words += [
        F.expr(f"(coalesce(_c{k}, 0L) div n_rows) & {WORD_MASK}L") for k in range(COUNTER_WORDS)
    ]
    by_text = summed.select(*keys, "_text", "n_rows", F.array(*words).alias("_fp"))
    # One row for each key and text is left: they meet in one row for each key.
    return by_text.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        *[
            F.max(F.when(F.col("_text") == i, F.col("_fp"))).alias(name)
            for i, name in enumerate(texts.values())
        ],
    )


def _tagged(i: int):
    return lambda h: F.struct(F.lit(i).alias("text"), h.alias("h"))


def _hash_sum(paragraphs: Column, seed: int) -> Column:
    def add(total, paragraph):
        # The seed comes first: the paragraph itself is hashed from the state that it leaves.
        one = F.xxhash64(F.lit(seed), paragraph).bitwiseAND(F.lit(WORD_MASK))
        return (total + one).bitwiseAND(F.lit(WORD_MASK))

    return F.aggregate(paragraphs, F.lit(0).cast("long"), add)


def _counters(pairs: Column) -> Column:
    """The bits of all hashes, counted in one counter a word."""

    def add(s, h):
        fields = []
        for k in range(COUNTER_WORDS):
            one = F.shiftright(h, k).bitwiseAND(F.lit(1).cast("long"))
            fields.append((s[f"c{k}"] + one).bitwiseAND(F.lit(WORD_MASK)).alias(f"c{k}"))
        return F.struct(*fields)

    start = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(COUNTER_WORDS)])
    return F.aggregate(
        pairs, start, add, lambda s: F.array(*[s[f"c{k}"] for k in range(COUNTER_WORDS)])
    )


def insert(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return F.zip_with(fingerprint, other, lambda a, b: (a + b).bitwiseAND(F.lit(WORD_MASK)))


def delete(fingerprint: Column, other: Column) -> Column:
    """The fingerprint without the other text's paragraphs."""
    return F.zip_with(fingerprint, other, lambda a, b: (a - b).bitwiseAND(F.lit(WORD_MASK)))


def _centred(fingerprint: Column) -> Column:
    """Twice each counter less the number of features, as an array of 48 numbers."""
    n = F.element_at(fingerprint, 1)
    counters = F.slice(fingerprint, 2 + IDENTITY_WORDS, COUNTER_WORDS)
    return F.transform(counters, lambda w: (2 * w - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1; 1 for equal ones."""

    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v
        )

    x, y = _centred(a), _centred(b)
    norms = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def as_text(fingerprint: Column) -> Column:
    """The words as hexadecimal digits, twelve each."""
    return F.array_join(
        F.transform(fingerprint, lambda w: F.lower(F.lpad(F.hex(w), 12, "0"))), ""
    )


#: Stands for a null id, so that joins are plain equalities and keep their partitioning.
_LOWEST = -(1 << 63)


def following(docs: DataFrame) -> DataFrame:
    """``(id, next_id, need)``: the next smaller id of each id of ``docs`` (doc, text), after the
    smallest the largest, and half the length of the id's longest text."""
    ids = docs.groupBy(F.col("doc").alias("id")).agg(
        F.max(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 2)).cast("int").alias("need")
    )
    placed = stored(global_row_number(ids, [F.col("id").desc()], "rn"), "placed")
    last = placed.agg(F.max("rn")).first()[0]
    after = placed.select(F.col("id").alias("next_id"), F.col("rn").alias("_rn"))
    return stored(
        placed.withColumn(
            "_rn", F.when(F.col("rn") == F.lit(last), F.lit(1)).otherwise(F.col("rn") + 1)
        )
        .join(after, "_rn").select("id", "next_id", "need"),
        "following",
    )


def edited(docs: DataFrame, after: DataFrame) -> DataFrame:
    """``docs`` (doc, text) with ``edited``: the last half of each text replaced by as much of
    the beginning of the next document (of several rows with that id, the smallest text's)."""
    heads = docs.join(after, F.col("doc") == F.col("next_id")).groupBy(F.col("id").alias("_for")).agg(
        F.min(F.coalesce(F.col("text").substr(F.lit(1), F.col("need")), F.lit(""))).alias("_head")
    )
    half = F.floor(F.length("text") / 2).cast("int")
    return (
        docs.join(heads, F.col("doc") == F.col("_for"), "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .select(
            "doc", "text",
            F.concat(
                F.col("text").substr(F.lit(1), F.length("text") - half),
                F.coalesce("_head", F.lit("")).substr(F.lit(1), half),
            ).alias("edited"),
        )
    )


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp)`` for every row: fingerprints of
    the text, of its edited text, and of the next document.

    Ids are integers; null comes before all others, and the lowest 64-bit number reads as null.
    """
    docs = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"),
        F.col(text_col).alias("text"),
    )
    after = following(docs)
    rows = edited(docs, after).select(
        "doc", F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.col("edited"), 256)).alias("_sha"), F.xxhash64("text").alias("_hash"),
        "text", "edited",
    )
    keys = ["doc", "n_chars", "_sha", "_hash"]
    both = stored(fingerprints(rows, keys, {"text": "fp", "edited": "edited_fp"}), "vectors")
    # Of several rows with the next id, any one serves; the choice is the same each time.
    first = both.groupBy(F.col("doc").alias("next_id")).agg(
        F.min(F.struct("_hash", "fp")).alias("_first")
    )
    nexts = after.join(first, "next_id").select(
        F.col("id").alias("doc"), F.col("_first.fp").alias("next_fp")
    )
    # Rows that are wholly equal were counted as one.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
    return both.join(nexts, "doc", "left").select(
        F.when(F.col("doc") != _LOWEST, F.col("doc")).alias("doc_id"), "n_chars",
        F.lower(F.hex("_sha")).alias("edited_sha256"), "fp", "edited_fp", "next_fp",
        copies.alias("_copy"),
    ).drop("_copy")
