"""Line, passage, near-duplicate and benchmark operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vetframe.llm import bloom, decontamination, lines, simhash, substrings, wordhash
from vetframe.llm.bktree import BKTree
from vetframe.llm.components import connected_components


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ lines


def brute_lines(rows, least):
    keys = lambda t: [
        re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r")) for line in (t or "").split("\n")
    ]
    where = {}
    for i, t in rows:
        for k in set(keys(t)):
            where.setdefault(k, set()).add(i)
    shared = {k for k, ids in where.items() if k and len(ids) >= least}
    out = []
    for i, t in rows:
        kept = [line for line, k in zip((t or "").split("\n"), keys(t)) if k not in shared]
        out.append((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    return Counter(out)


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect())


@pytest.mark.parametrize("bits", [1 << 16, 1 << 8])
def test_lines_equal_brute_force(documents, edges, bits):
    """A filter that is far too small lets more through and changes nothing."""
    both = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    bits = max(bits, bloom.MIN_BITS) if bits > 1 << 8 else bits
    assert as_counter(lines.drop_shared_lines(both, 3, max_bits=bits)) == brute_lines(rows_of(both), 3)


def test_first_occurrence_stays(spark):
    df = spark.createDataFrame([(2, "B \nx"), (1, "q\nb\nb"), (3, "b\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_shared_lines(df, 2, keep_first=True).collect()}
    assert got == {1: "q\nb", 2: "x", 3: "y"}


def test_lines_keep_columns_and_empty_tables(edges, empty):
    out = lines.drop_shared_lines(edges, 2)
    assert set(edges.columns) <= set(out.columns) and out.count() == edges.count()
    assert lines.drop_shared_lines(empty).count() == 0


# ------------------------------------------------------------------ passages


def brute_passages(rows, window):
    """Kept texts; of rows that share an id the earlier start decides, each loses its own words."""
    def words(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())

    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            at = (i is not None, i or 0, s)
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, at), at)
    gone = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i is not None, i or 0, s):
                gone.setdefault((i, t), set()).update(range(s, s + window))
    out = []
    for i, t in rows:
        w = words(t)
        dropped = gone.get((i, t), set())
        kept = [x for k, x in enumerate(w) if k not in dropped]
        out.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return Counter(out)


def passages(df, **options):
    got = substrings.deduplicate(df, **options)
    return Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect())


def test_passages_equal_brute_force(documents, edges):
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    assert passages(df) == brute_passages(rows_of(df), 20)


def test_passages_of_random_words(spark):
    """Few words and short windows: repeats begin and end everywhere, also inside a document."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for bits in (1 << 16, 1 << 8):
        assert passages(df, window=8, anchor=3, max_bits=bits) == brute_passages(rows, 8)


def test_texts_of_one_id_lose_their_own_words_only(spark):
    known = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(1, known), (2, known), (2, other), (2, other), (None, "x"), (None, known + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages(df.where("doc_id IS NOT NULL").repartition(4))
    assert got == brute_passages(rows[:4], 20)
    assert got[(2, 60, 0, other)] == 2 and got[(2, 60, 60, "")] == 1
    assert passages(df) == brute_passages(rows, 20)


def test_first_and_repeated_windows_of_shuffled_rows(spark):
    """Repeats are found whether they meet in one Arrow batch or in several, of 3 rows each."""
    rng = random.Random(8)
    shared = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(4)]
    rows = [
        (i % 70, f"head{i} " + " ".join(rng.sample(shared, 2)) + f" mid{i} " + rng.choice(shared))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "text")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = passages(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == passages(df) == brute_passages(rows, 20)


def test_factors_name_their_reference(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, "before " + text + " after"), (3, "no repeat")]
    got = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].factors == [] and got[3].factors == []
    assert [tuple(f) for f in got[2].factors] == [(1, 50, 1, 0)]
    assert got[2].kept == "before after"


def test_parse_splits_where_the_reference_ends():
    s = np.array([0, 1, 2, 3, 9])
    ref = np.array([5, 5, 6, 6, 5])
    at = np.array([7, 8, 0, 1, 2])
    assert substrings.parse(s, ref, at, 4).tolist() == [[0, 5, 5, 7], [2, 5, 6, 0], [9, 4, 5, 2]]


def test_window_anchors_are_the_leftmost_smallest():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    low = np.uint64(substrings.STRIP - 1)
    for span in (1, 2, 7, 15):
        want = [i + int(np.argmin(grams[i : i + span] & ~low)) for i in range(len(grams) - span + 1)]
        assert substrings.window_anchors(grams, span).tolist() == want


def test_hashes_depend_on_content_only():
    data = np.frombuffer(b"one two  one\ttwo three", dtype=np.uint8)
    h = wordhash.word_hashes(data, *wordhash.spans(data, wordhash.NOT_SPACE))
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    runs = wordhash.run_hashes(h, 2)
    assert runs[0] == runs[2] and runs[0] != runs[1]
    spans = wordhash.span_hashes(h, np.array([0, 2, 0]), np.array([2, 4, 4]))
    assert spans[0] == spans[1] != spans[2]


def test_passages_of_empty_table(empty):
    assert substrings.deduplicate(empty).count() == 0


# ------------------------------------------------------------------ near duplicates


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_groups(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, prints[k], least.get(root(k))) for k, (i, _) in enumerate(rows))


def test_groups_equal_brute_force(documents, edges):
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    got = simhash.near_duplicates(df)
    found = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect())
    assert found == brute_groups(rows_of(df))


def test_links_reach_all_within_the_radius(spark):
    """Chains of fingerprints two bits apart, across every block of bits."""
    rng = random.Random(1)
    prints = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(6):
            prints.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                f ^= 1 << b
    prints = sorted(prints)
    df = spark.createDataFrame([(k, None, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)],
                               "doc_id long, text_hash long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.groups(df).collect()}
    parent = {k: k for k in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = got[i], got[j]
                assert a == b
                parent[i] = min(parent[i], parent[j])
    assert len(set(got.values())) == len({min(k for k in got if got[k] == c) for c in set(got.values())})


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        for radius in (0, 1, 3):
            want = sorted(v for v in values if (v ^ q).bit_count() <= radius)
            assert sorted(tree.values[i] for i in tree.within(q, radius)) == want


def test_one_row_of_each_group_stays(edges, empty):
    kept = simhash.deduplicate(edges)
    assert kept.columns == edges.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    # Empty texts, whatever their ids, are one group; so are the two rows of id 6, and 4 with 5.
    assert texts[(1, None)] == 1 and texts[(2, "")] == texts[(3, " \t\n \n")] == texts[(9, "\n\n\n")] == 0
    assert texts[(4, "x")] == 1 and texts[(5, "x")] == 0
    assert texts[(6, "same text here, line one\nline two")] == 1 and texts[(None, "a null id")] == 1
    assert simhash.deduplicate(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 160)]
    df = spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 160)} == {100}


# ------------------------------------------------------------------ benchmark passages

WORDS = [f"word{i}" for i in range(400)]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_matches_equal_brute_force(spark):
    """All windows of all documents against all items by exact similarity."""
    rng = random.Random(3)
    items = [(k, passage(rng, rng.choice([3, 5, 8, 20, 30]))) for k in range(25)]
    docs = []
    for k in range(60):
        words = passage(rng, rng.randint(0, 60)).split()
        item = rng.choice(items)[1].split()
        if k % 3 == 0:
            words += item
        if k % 3 == 1:  # one word changed
            changed = list(item)
            changed[rng.randrange(len(item))] = "changed"
            words = words[:10] + changed + words[10:]
        docs.append((k, " ".join(words).title()))
    items += [(90, None), (91, " . ")]
    got = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()

    def grams(words, k):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    want = {}
    for d, text in docs:
        words = re.findall(r"\w+", text.lower())
        for i, t in items:
            own = re.findall(r"\w+", (t or "").lower())
            if not own:
                continue
            k, n = min(5, len(own)), min(len(own), len(words))
            for s in range(len(words) - n + 1):
                x = decontamination.similarity(grams(words[s : s + n], k), grams(own, k))
                if x >= 0.8 and x > want.get((d, i), (0, 0))[0]:
                    want[d, i] = (x, s)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got}
    assert {k: (round(x, 9), s) for k, (x, s) in found.items()} == {
        k: (round(x, 9), s) for k, (x, s) in want.items()
    }
    assert len(want) >= 15


def test_items_cut_by_all_that_the_similarity_allows_are_found(monkeypatch):
    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    cuts = [(50, 5), (100, 10), (200, 21)]
    items = [(k, draw(cuts[k % 3][0])) for k in range(1500)]
    index = decontamination.Items(items, 5, decontamination.RADIUS)
    found = {}
    for k, words in items:
        size, cut = cuts[k % 3]
        doc = np.concatenate([draw(30), words[: size - cut], draw(cut), draw(30)])
        got = decontamination._matches(doc, index, 5, 0.8)
        shared = size - cut - 4
        assert shared / (2 * (size - 4) - shared) >= 0.8
        # The first window that holds all that is left.
        found[k] = k in got and got[k][1] == 30 - cut and round(got[k][0], 9) == round(shared / (2 * (size - 4) - shared), 9)
    assert sum(found.values()) == len(items)
    # Items that share passages, and few pairs at a time: as an exact comparison of all windows.
    part = draw(40)
    items = [(k, np.concatenate([part[: 30 + k % 9], draw(10 - k % 9)])) for k in range(40)]
    doc = np.concatenate([draw(5), part, part[:37], draw(7)] * 3)
    monkeypatch.setattr(decontamination, "PAIRS", 100)
    index = decontamination.Items(items, 5, decontamination.RADIUS)
    grams = wordhash.run_hashes(doc, 5)
    want = {}
    for n, (_, w) in enumerate(items):
        scores = [decontamination.similarity(Counter(grams[s : s + 36].tolist()), index.counts[n]) for s in range(len(doc) - 39)]
        if max(scores) >= 0.8:
            want[n] = (max(scores), scores.index(max(scores)), 40)
    assert decontamination._matches(doc, index, 5, 0.8) == want and len(want) > 10


def test_tables_hold_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(4)
    items = [(k, rng.integers(0, 1 << 63, 12, dtype=np.uint64)) for k in range(300)]
    index = decontamination.Items(items, 5, 15)
    for k in range(50):
        f = int(index.prints[k])
        for b in rng.choice(64, rng.integers(0, 16), replace=False).tolist():
            f ^= 1 << b
        want = [n for n in range(300) if (int(index.prints[n]) ^ f).bit_count() <= 15]
        assert index.near(f).tolist() == want and k in want


def test_two_flipped_bits_in_a_byte_reach_a_radius_of_23():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for radius in (0, 7, 8, 23):
        tables = decontamination.Tables(prints, radius)
        asked = prints[:40].copy()
        for k in range(40):
            for b in rng.choice(64, rng.integers(0, radius + 1), replace=False).tolist():
                asked[k] ^= np.uint64(1 << b)
        want = np.nonzero(np.bitwise_count(prints ^ asked[:, None]) <= radius)
        got = tables.within(asked)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
        assert {(k, k) for k in range(40)} <= set(zip(*(g.tolist() for g in got)))


def test_window_prints_equal_prints_of_each_window(monkeypatch):
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    starts = np.sort(rng.choice(800, 90, replace=False))
    want = [int(decontamination.packed(decontamination.signs(words[s : s + 60]).sum(axis=0, keepdims=True))[0]) for s in starts]
    for strip in (7, 1 << 14):
        monkeypatch.setattr(decontamination, "STRIP", strip)
        for chosen in (slice(None), slice(None, None, 9)):
            assert decontamination.window_prints(words, starts[chosen], 60).tolist() == want[chosen]


def test_simhash_finds_the_pairs_and_loses_few(spark, documents, monkeypatch):
    """Cut items whose words repeat as in prose; the exact search says what there is to find."""
    rng = np.random.default_rng(12)
    vocabulary = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    draw = lambda n: vocabulary[(4000 * rng.random(n) ** 3).astype(int)]
    items = [(k, draw((12, 30, 50, 100)[k % 4])) for k in range(400)]
    near, exact = (decontamination.Items(items, 5, r) for r in (decontamination.RADIUS, None))
    n_exact = n_near = 0
    for k, words in items:
        cut = (len(words) - 4) // 9
        doc = np.concatenate([draw(30), words[: len(words) - cut], draw(cut + 30)])
        all_of = decontamination._matches(doc, exact, 5, 0.8)
        found = decontamination._matches(doc, near, 5, 0.8)
        assert set(found) <= set(all_of)
        n_exact += len(all_of)
        n_near += len(found)
    assert n_exact >= 400 and n_near >= 0.995 * n_exact
    # On the table nothing is lost; without the tables nothing is found.
    table = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontamination.matches(documents, table, radius=None).collect()))
    assert want and sorted(map(tuple, decontamination.matches(documents, table).collect())) == want
    monkeypatch.setattr(decontamination.Tables, "within", lambda self, f: (np.zeros(0, dtype=int),) * 2)
    assert not decontamination._matches(items[0][1], near, 5, 0.8)


def test_clean_keeps_rows_and_columns(spark, edges, empty):
    items = spark.createDataFrame([(1, "line one line two same text"), (2, None)], "item_id long, text string")
    kept = decontamination.clean(edges, items)
    assert kept.columns == edges.columns and kept.count() == edges.count()
    exact = spark.createDataFrame([(1, "Same text here line one line two")], "item_id long, text string")
    assert decontamination.clean(edges, exact).count() == edges.count() - 2
    assert decontamination.clean(empty, exact).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matches(edges, none).count() == 0
    assert decontamination.clean(edges, none).count() == edges.count()


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.matches(documents, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontamination.matches(documents, items).collect())) == whole
    assert len({r[0] for r in whole}) == documents.join(items.withColumnRenamed("text", "t"), F.contains("text", "t")).select("doc_id").distinct().count()
