"""Periodic runs, byte-level BPE and fill-in-the-middle against brute force, a rank library and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetframe.llm import bytebpe, infill, periodic, queries

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# ------------------------------------------------------------------ periodic runs


def brute_runs(w, least):
    """Every stretch of every period; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((start, length, p) for (start, length), p in found.items())


def kept_words(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def some_words(rng):
    """Few words, so that runs begin and end everywhere, overlap and contain each other."""
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 110))]
    kind = rng.randrange(5)
    if kind == 0 and w:
        a = rng.randrange(len(w))
        p = 1 + rng.randrange(max(1, (len(w) - a) // 3 + 1))
        w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
    elif kind == 1:
        unit = (w[: rng.randint(1, 9)] or [0]) * rng.randint(1, 6) + [7] * rng.randint(0, 2)
        w = (unit * rng.randint(1, 7))[:200]
    elif kind == 2:
        w = fibonacci(rng.randint(0, 250))
    elif kind == 3:
        w = [bin(i).count("1") & 1 for i in range(rng.randint(0, 250))]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    total = 0
    for _ in range(250):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        first = np.cumsum([0] + [len(t) for t in texts])
        words = np.array([x for t in texts for x in t], dtype=np.int64)
        least = rng.choice([24, 24, 3, 7, 13, 48])
        want = [brute_runs(t, least) for t in texts]
        assert periodic.find_runs(words, first, least) == want
        total += sum(map(len, want))
    assert total > 500


@pytest.mark.parametrize("words", [
    np.zeros(300_000, dtype=np.int64), np.tile(np.arange(60_000), 5),
    np.tile(np.append(np.tile(np.arange(40), 50), 99), 40),
])
def test_long_runs_take_linear_work(words):
    """One run of a whole long text, and runs inside the periods of another one."""
    found = periodic.find_runs(words, np.array([0, len(words)]))[0]
    outer = max(found, key=lambda r: r[1])
    assert outer[:2] == (0, len(words))
    assert all(words[a : a + n - p].tolist() == words[a + p : a + n].tolist() for a, n, p in found)


def test_wavelet_tree_answers_ranges():
    rng = np.random.default_rng(3)
    values = rng.permutation(517)
    tree = periodic.WaveletTree(values)
    lo = rng.integers(0, 517, 400)
    hi = np.minimum(517, lo + rng.integers(0, 60, 400))
    x = rng.integers(0, 1100, 400)
    want = [min((v for v in values[a:b].tolist() if v >= c), default=-1) for a, b, c in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x, -1).tolist() == want


def test_blocks_know_all_their_places():
    rng = random.Random(4)
    texts = [some_words(rng) for _ in range(30)]
    first = np.cumsum([0] + [len(t) for t in texts])
    words = np.array([x for t in texts for x in t], dtype=np.int64)
    sa, blocks = periodic.repeated_blocks(words, first, 4)
    assert sorted(sa.tolist()) == list(range(len(words))) and blocks
    for width, (s, lo, hi) in blocks.items():
        for start, a, b in zip(s.tolist(), lo.tolist(), hi.tolist()):
            t = int(np.searchsorted(first, start, side="right")) - 1
            same = [i for i in range(first[t], first[t + 1] - width + 1)
                    if (words[i : i + width] == words[start : start + width]).all()]
            assert sorted(sa[a:b].tolist()) == same and len(same) > 1


def test_strongest_is_exact():
    a, b = (0, 3 * 10**9 + 1, 10**9), (5, 3 * (10**9 - 1) + 1, 10**9 - 1)
    assert periodic.strongest([a, b]) == b and periodic.strongest([]) is None
    assert periodic.strongest([(9, 30, 10), (4, 60, 20), (4, 30, 10)]) == (4, 30, 10)


def changed_words(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_periodic_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    hit = 0
    for doc_id, text in rows:
        w = changed_words(doc_id, text)
        if len(w) > 3000 and zlib.crc32(str(doc_id).encode()) % 10:
            continue  # too slow for the brute force; the periodic ones are all compared
        runs = brute_runs(w, 24)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[doc_id]
        hit += bool(runs)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{p}\n" for a, n, p in runs))
        assert r.collapsed_sha256 == sha(b" ".join(kept_words(w, runs)))
    assert hit > 5


def test_periodic_edges(edges, empty, spark):
    got = sorted((r.asDict(recursive=True) for r in periodic.detect(edges).collect()), key=str)
    assert len(got) == edges.count()
    for r in got:
        assert r["runs"] == ([{"start": 0, "length": 30_000, "period": 1}] if r["doc_id"] == 7 else [])
    assert [r["text"] for r in got if r["doc_id"] == 7] == ["word"]
    assert [r["text"] for r in got if r["doc_id"] == 8] == ["ünïcode ÀÉ 中文 😀 a b c"]
    assert periodic.detect(empty).count() == 0 and periodic.detect(empty).columns == [
        "doc_id", "n_words", "runs", "strongest", "text"]
    both = spark.createDataFrame([(None, None), (None, "a " * 60)], "doc_id long, text string")
    assert {tuple(r) for r in queries.with_repeats(both).collect()} == {(None, ""), (None, " ".join("a" * 60))}


# ------------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def rank_library():
    import public_tokenizers as public
    import tiktoken

    ranks = bytebpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, public.PATTERN, library


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_ids_equal_the_rank_library(rank_library, monkeypatch):
    ranks, pattern, library = rank_library
    codec = bytebpe.Codec(bytebpe.model(ranks), pattern)
    monkeypatch.setattr(bytebpe, "STRIP", 7)
    monkeypatch.setattr(bytebpe, "GROUP", 3)
    monkeypatch.setattr(bytebpe, "CACHE", 300)
    rng = random.Random(12)
    pool = [chr(x) for x in [*range(0x250), *range(0x2000, 0x2070), 0x4E2D, 0x1F600, 0x3000, 0x661, 0x301]]
    pool += [" ", " ", "\n", "'s", "'re", " the", " und", "ing", bytebpe._NO_BYTE, "▁", "<unk>", "<|endoftext|>"] * 40
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 50)))
        ids = codec.encode(text)
        assert ids == packed(library.encode_ordinary(text)) and codec.decode(ids) == text.encode()


def test_every_token_is_its_own_merge(rank_library):
    """The model alone, without the look-up of whole pre-tokens, knows every token."""
    ranks, pattern, _ = rank_library
    codec = bytebpe.Codec(bytebpe.model(ranks), pattern)
    for token, rank in list(ranks.items())[::7]:
        assert codec._model.encode(token.decode("latin-1").translate(codec._letters)) == [rank]
        assert codec._bytes[rank] == token


def test_whole_tokens_come_before_merges():
    """A token that no merges lead to is taken where it is a whole pre-token, as the rank rules say."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    codec = bytebpe.Codec(bytebpe.model(ranks), r"\S+|\s+")
    library = tiktoken.Encoding("o", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcdab abcd", "xabcd"):
        assert codec.encode(text) == packed(library.encode_ordinary(text))


def test_models_are_checked():
    with pytest.raises(ValueError, match="every byte"):
        bytebpe.model({b"a": 0})
    with pytest.raises(ValueError, match="consecutive"):
        bytebpe.model({bytes([b]): 2 * b for b in range(256)})


def test_bpe_query(spark, rank_library):
    _, _, library = rank_library
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_byte_bpe"](spark, SF).collect()}
    assert got == {
        i: (len(ids := library.encode_ordinary(t)), sha(packed(ids)), sha(t)) for i, t in rows
    }


def test_bpe_edges(edges, empty, rank_library):
    ranks, pattern, library = rank_library
    clashing = edges.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    done = bytebpe.decode(bytebpe.encode(clashing, ranks, pattern), ranks, pattern)
    rows = done.collect()
    assert len(rows) == edges.count() and set(edges.columns) <= set(done.columns)
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4
        assert bytes(r.ids) == packed(library.encode_ordinary(r.text or ""))
    assert bytebpe.encode(empty, ranks, pattern).count() == 0
    nulls = done.select(F.lit(None).cast("binary").alias("ids")).limit(1)
    assert bytes(bytebpe.decode(nulls, ranks, pattern).first().decoded) == b""


# ------------------------------------------------------------------ fill in the middle


def brute_infill(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_infill_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(infill, "STRIP", 50)
    rng = random.Random(13)
    pool = ["\n", "\n", "a", "ü😀", "<", "<P", "<S", "M>", "P>", " b", "\r", "<M>"]
    rows = [
        (rng.choice([None, *range(60)]), "".join(rng.choice(pool[: rng.choice([11, 12])]) for _ in range(rng.choice([0, 1, 3, 30]))))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate, spm in ((100, 50), (60, 20), (0, 50)):
        done = infill.restore(infill.transform(df, rate=rate, spm_rate=spm)).collect()
        got = sorted((tuple(r[c] for c in COLUMNS) for r in done), key=repr)
        assert got == sorted((brute_infill(i, t, rate, spm) for i, t in rows), key=repr)
        assert all(r.restored == r.text for r in done)


def test_infill_edges(edges, empty):
    clashing = edges.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("output", F.lit(2.5))
    done = infill.restore(infill.transform(clashing))
    rows = done.collect()
    assert set(edges.columns) <= set(done.columns) and len(rows) == edges.count()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute_infill(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert infill.restore(infill.transform(empty)).count() == 0


def test_restoring_needs_only_output_and_form():
    output = pa.array(["<P>a\n<S>c<M>b\n", "<S>c<P>a\n<M>b\n", "as it is", "", "<P><S><M>", "<S><P><M>x"])
    form = pa.array(["psm", "spm", "plain", "plain", "psm", "spm"])
    assert infill.restored(output, form).to_pylist() == ["a\nb\nc", "a\nb\nc", "as it is", "", "", "x"]


def test_infill_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_fill_in_middle"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op13_fill_in_middle"](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {r.form for r in got.collect()} >= {"psm", "spm"}
