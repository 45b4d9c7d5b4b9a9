"""Chunks, cleaning, retrieval and verdicts against plain Python on small inputs."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vetframe.operators import retrieval, text, verdicts


def _texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def test_white_space_of_any_script(spark):
    values = ["a\u00a0b\u3000c", "\u2003 x \u00a0", "\u3000"]
    df = _texts(spark, values).orderBy("id")
    got = df.select(text.words(F.col("text")), text.strip(F.col("text"))).collect()
    assert [r[0] for r in got] == [v.split() for v in values]
    assert [r[1] for r in got] == [v.strip() for v in values]


def test_word_chunks_cover_whole_texts(spark):
    rng = random.Random(4)
    values = [" ".join(f"word{rng.randint(0, 99)}" for _ in range(n)) for n in (0, 1, 20, 450, 451, 950, 2300)]
    got = {(r.id, r.pos): r.text for r in text.word_chunks(_texts(spark, values + [" \n "]), ["id"]).collect()}
    expected = {}
    for i, value in enumerate(values):
        tokens = value.split()
        for pos, start in enumerate(range(0, len(tokens), 450)):
            piece = " ".join(tokens[start : start + 500])
            if len(piece) > 50:
                expected[(i, pos)] = piece
    assert got == expected


def test_paragraph_chunks_pack_and_cut(spark):
    def para(n):
        return " ".join(["w"] * n)

    values = [
        "\n\n".join([para(3), para(4), para(5)]),      # 7 fit, 5 start a new buffer
        "\n\n\n".join([para(6), para(25), para(2)]),   # the long one is cut by itself
        para(12), para(11), "", "\n\n \n\n",
    ]
    rows = text.paragraph_chunks(_texts(spark, values), ["id"], target=10, minimum=3).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.id, []).append(len(r.text.split()))
    assert sizes == {0: [7, 5], 1: [6, 10, 10, 5], 2: [10], 3: [11]}


def test_paragraph_chunks_equal_plain_packing(spark):
    """Random paragraphs over many blocks, and a text of 100,000 of them."""
    rng = random.Random(2)
    counts = [[rng.choice((1, 2, 3, 5, 8, 13, 30)) for _ in range(n)] for n in (1, 255, 256, 257, 900)]
    counts.append([rng.choice((1, 4, 7)) for _ in range(100_000)])

    def plain(sizes, target=10, minimum=3):
        out, held = [], 0
        for n in sizes:
            if n >= 12:
                out += [held] + [min(target, n - i) for i in range(0, n, target)]
                held = 0
            elif held + n <= target:
                held += n
            else:
                out.append(held)
                held = n
        return [n for n in out + [held] if n >= minimum]

    values = ["\n\n".join(" ".join(["w"] * n) for n in sizes) for sizes in counts]
    rows = text.paragraph_chunks(_texts(spark, values), ["id"], target=10, minimum=3)
    got = {}
    for r in rows.orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(len(r.text.split()))
    assert got == {i: plain(sizes) for i, sizes in enumerate(counts) if plain(sizes)}


def test_cleaning_removes_words_inside_words(spark):
    df = _texts(spark, ["Excited <b>x</b> [a](http://u.v) see www.x.y\n\n\n  end", None, "No content found in response"])
    got = [r[0] for r in df.orderBy("id").select(text.clean_content(F.col("text"))).collect()]
    assert got == ["Exd x [a]() see \n end".replace("[a]()", "a"), "", ""]


def test_statements_and_the_optional_limit(spark):
    long = "The sample contains " + "x" * 120
    df = _texts(spark, ["Short. " + long + "! No verb here my dear friend? " + "Nothing told by my old mentor."])
    rows = text.statements(df, ["id"]).orderBy("sentence_number").collect()
    assert [r.is_testable for r in rows] == [1, 0, 0]
    assert rows[0].optimized_assertion == long[:100] + "..." and rows[1].sentence_number == 2
    assert text.statements(df, ["id"], per_text=1).count() == 1


def test_document_listing(spark):
    listing = "1. A - B - http://x\n\n 2. C - ftp://y\n3.D - https://z \nplain"
    df = spark.createDataFrame([(1, listing), (2, None)], "id long, relevant_docs string")
    got = [(r.title, r.url) for r in text.document_entries(df, ["id"]).orderBy("pos").collect()]
    assert got == [("A - B", "http://x"), ("D", "https://z")]


def _brute_scores(chunks, queries, stop, max_terms):
    def terms(value):
        words = [w for w in re.findall(r"\w\w+", value.lower()) if w not in stop]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    counted = {k: terms(v) for k, v in chunks.items()}
    total, seen = Counter(), Counter()
    for c in counted.values():
        total.update(c)
        seen.update(c.keys())
    kept = sorted(total, key=lambda t: (-total[t], t))[:max_terms]
    idf = {t: math.log((1 + len(chunks)) / (1 + seen[t])) + 1 for t in kept}

    def vector(c):
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / norm for t, x in raw.items()}

    vectors = {k: vector(c) for k, c in counted.items()}
    out = {}
    for q, value in queries.items():
        v = vector(terms(value))
        ranked = sorted(
            ((-round(sum(x * d.get(t, 0.0) for t, x in v.items()), 6), k) for k, d in vectors.items())
        )[:3]
        out[q] = [(k, -s) for s, k in ranked if -s > 0.1]
    return out


def test_retrieval_equals_brute_force_with_a_hot_term(spark):
    rng = random.Random(11)
    vocabulary = [f"term{i}" for i in range(60)]
    chunks = {f"c{i:03d}": " ".join(["common"] * 2 + rng.sample(vocabulary, 6) + ["the"]) for i in range(80)}
    chunks["empty"] = "a . !"
    queries = {i: " ".join(rng.sample(vocabulary, 3) + ["common"]) for i in range(12)}
    queries[99] = "unheard of things"
    c = spark.createDataFrame(
        [(k, v, f"title {k}", f"u/{k}", k[:2]) for k, v in chunks.items()],
        "chunk_id string, text string, source_title string, source_url string, doc_id string",
    )
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    index = retrieval.build_index(c, max_terms=50, stop_words=["the"])
    expected = _brute_scores(chunks, queries, {"the"}, 50)
    for broadcast_rows in (1_000_000, 3):
        got = {i: [] for i in queries}
        found = retrieval.retrieve(q, index, stop_words=["the"], broadcast_rows=broadcast_rows)
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.chunk_id, r.similarity))
        assert got == expected
    sourced = retrieval.retrieve_with_sources(q, index, stop_words=["the"])
    fallback = sourced.filter("query_id = 99").collect()
    assert len(fallback) == 1 and fallback[0].text == retrieval.NOTHING_FOUND
    best = retrieval.evidence_documents(q, index, stop_words=["the"])
    assert best.groupBy("query_id").count().filter("count > 2").count() == 0


def test_pruning_scores_few_pairs_and_loses_none(spark):
    """Every chunk holds common words; the rare ones of a query decide."""
    rng = random.Random(12)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(150)]
    chunks = {f"c{i:03d}": " ".join(rng.sample(common, 8) + rng.sample(rare, 5)) for i in range(300)}
    queries = {i: " ".join(rng.sample(common, 4) + rng.sample(rare, 3)) for i in range(30)}
    c = spark.createDataFrame(list(chunks.items()), "chunk_id string, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    index = retrieval.build_index(c, max_terms=400, stop_words=[])
    got = {i: [] for i in queries}
    for r in retrieval.retrieve(q, index, stop_words=[]).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.similarity))
    assert got == _brute_scores(chunks, queries, set(), 400)
    found, weak = retrieval.candidates(retrieval.query_weights(q, index.terms, []), index)
    assert found.count() < len(chunks) * len(queries) / 8 and weak.count() > 0
    assert found.select("query_id", "chunk_id").distinct().count() == found.count()
    # Without a number of results only the least similarity prunes.
    every = retrieval.similarities(retrieval.query_weights(q, index.terms, []), index, None, 0.0)
    assert every.filter("similarity > 0").count() > found.count()


def test_only_pairs_of_frequent_words_are_counted_and_none_is_lost(spark):
    """The last place of the vocabulary is tied between words and pairs."""
    texts = ["a1 b1 c1 d1"] * 4 + ["a1 b1 x1", "d1 c1 y1", "z1 a1", "b1 c1"]
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    total = Counter()
    for t in texts:
        words = t.split()
        total.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    for size in range(1, len(total) + 2):
        expected = sorted(total.items(), key=lambda t: (-t[1], t[0]))[:size]
        got = retrieval.frequent_terms(df, "text", size, []).collect() if size in (3, 5, 20) else None
        assert got is None or sorted((r.term, r.corpus_frequency) for r in got) == sorted(expected)
    index = retrieval.build_index(df, stop_words=[])
    assert index.computed and not index.stored().computed  # no postings are stored unless asked for


def test_index_survives_a_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "beta delta")], "chunk_id string, text string")
    index = retrieval.build_index(c, stop_words=[])
    index.save(str(tmp_path / "index"))
    again = retrieval.Index.load(spark, str(tmp_path / "index"))
    key = ["chunk_id", "term"]
    assert again.postings.orderBy(key).collect() == index.postings.orderBy(key).collect()


def test_published_verdict_figures(spark):
    rows = [("Correct",)] * 76 + [("Flagged for Review",)] * 14 + [("Incorrect",)] * 4
    df = spark.createDataFrame(rows, "verdict string")
    legacy = verdicts.evaluate_verdicts(df, legacy=True).first()
    assert (legacy.n, legacy.tp, legacy.fn) == (94, 80, 14)
    assert [round(legacy[c], 4) for c in ("accuracy", "precision", "recall", "f1", "coverage", "abstain_rate")] == [
        0.8511, 1.0, 0.8511, 0.9195, 0.8511, 0.1489,
    ]
    assert legacy.covered == 80 and legacy.covered_accuracy == 1.0
    strict = verdicts.evaluate_verdicts(df).first()
    assert (strict.tp, round(strict.negative_rate, 4)) == (76, round(4 / 94, 4))


def test_batch_answers(spark):
    st = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (2, 1), (3, 1)], "batch_id long, batch_index int")
    answers = spark.createDataFrame(
        [
            (0, 'x [{"index": "1", "final_verdict": "Correct", "reasoning": " ok ", "citations": "no"},'
                ' {"index": 2, "final_verdict": "Maybe"}, {"final_verdict": "Correct"}] y'),
            (1, '{"index": 1, "final_verdict": "Correct"}'),
            (2, '[{"index": 1, "final_verdict": "Incorrect", "citations": ["u"]}, 5]'),
        ],
        "batch_id long, response string",
    )
    got = {(r.batch_id, r.batch_index): (r.verdict, r.analysis, r.citations) for r in verdicts.batch_verdicts(st, answers).collect()}
    review = verdicts.REVIEW
    assert got[(0, 1)] == ("Correct", "ok", []) and got[(0, 2)] == (review, "", [])
    assert got[(0, 3)] == (review, "", []) and got[(1, 1)] == (review, verdicts.UNREADABLE, [])
    assert got[(2, 1)] == ("Incorrect", "", ["u"]) and got[(3, 1)][0] == review


def test_json_repairs(spark):
    broken = (
        "[\n{sentence_number: 1, \"original_statement\": \"s\",\n"
        "\"optimized_assertion\": \"he said \"hi\" twice\",\nis_testable: True,\n}\n{sentence_number: 2,\n// note\n"
        "\"original_statement\": None, is_testable: False,}\n"
    )
    df = spark.createDataFrame([(broken,), ("nothing",), ('[{"sentence_number": 3}]',)], "a string")
    rows = [r[0] for r in df.select(verdicts.parse_statements(F.col("a"))).collect()]
    assert [s.sentence_number for s in rows[0]] == [1, 2] and rows[0][0].is_testable is True
    assert rows[0][0].optimized_assertion == 'he said "hi" twice'
    assert rows[1] is None and rows[2][0].sentence_number == 3


def test_batches_are_numbered_over_the_whole_table(spark):
    df = spark.range(23).select((F.col("id") % 3).alias("doc"), "id").repartition(6)
    rows = verdicts.assign_batches(df, ["doc", "id"]).orderBy("doc", "id").collect()
    assert [(r.batch_id, r.batch_index) for r in rows] == [(i // 5, i % 5 + 1) for i in range(23)]
