"""Toxicity, urls, licenses, personal data, fingerprints, packing and the pipeline."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vetframe.llm import fingerprint, licenses, packing, pii, queries, toxicity, urls

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ toxicity


def test_folding():
    assert toxicity.fold("ЅсυМ 1D10T! m\u00ado\u200bron").split() == toxicity.fold("scum idiot moron").split()
    assert toxicity.fold("Ärger, déjà") == toxicity.fold("arger  deja")
    assert toxicity.fold(None) == ""


def lexicon():
    return toxicity.Lexicon({p: w for p, w in ((f" {toxicity.fold('scum')}", 2.0), (f" {toxicity.fold('trash')} ", 1.0))},
                            curve=(-3.0, 2.0, 0.1))


def test_matches_and_exceptions():
    found = lexicon()
    assert found.features("Scummy people throw trash") == (4, 2, 3.0)
    assert found.features("the trash can, the TR4SH CAN") == (6, 0, 0)
    assert found.features("trashed") == (1, 0, 0)  # a whole word only
    assert found.features("pond scum") == (2, 0, 0) and found.features("") == (0, 0, 0)


def test_long_texts_need_more():
    found = lexicon()
    n, _, total = found.features("scum scum")
    assert found.value(n, total) > found.value(5000, total) > found.value(5000, 0.0)


def test_score_edges(edges, empty):
    got = toxicity.score(edges, lexicon())
    assert got.count() == edges.count() and got.where("score IS NULL").count() == 0
    assert toxicity.score(empty, lexicon()).count() == 0
    assert toxicity.clean(edges, lexicon()).columns == edges.columns


def test_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(edges, none).weights == {}
    one = spark.createDataFrame([(4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.learn(edges, one)
    assert found.weights == {} and 0 < found.value(10, 0.0) < 0.7


def test_sample_keeps_texts_that_share_a_passage(spark):
    passage = " ".join(f"shared{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))
    own = lambda k: " ".join(f"own{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(100))
    docs = [(k, f"{passage} {own(k)}") for k in range(40)]
    docs += [(100, "The same words in two cases here"), (101, "the SAME words in two cases here"), (102, "the same words in two cases here")]
    labels = [(k, k % 2) for k in range(40)] + [(100, 0), (101, 0), (102, 1)]
    got = toxicity.training_sample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    ).collect()
    assert Counter(map(tuple, got)) == Counter((t, dict(labels)[i]) for i, t in docs if i != 101)


def test_terms_are_no_parts_of_each_other():
    rows = [(" scum", 50, 0, 90.0), (" scu", 50, 0, 90.0), (" scum ", 50, 0, 90.0), (" mor", 30, 9, 40.0), (" moron", 30, 0, 60.0)]
    assert set(toxicity.choose_terms(rows, 100, 100)) == {" scum", " moron"}


def test_exceptions_take_out_the_matches_they_cover():
    rng = np.random.default_rng(3)
    for _ in range(200):
        found = [(int(p), "x", 1.0) for p in rng.integers(0, 40, 12)]
        spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 40, 5), rng.integers(0, 9, 5))]
        want = [f for f in sorted(found) if not any(a <= f[0] < b for a, b in spans)]
        assert toxicity.outside(found, spans) == want


def test_many_exceptions_in_a_long_text():
    found = lexicon()
    text = "trash bag trash can " * 50_000
    started = time.monotonic()
    assert found.features(text) == (200_000, 50_000, 50_000.0)
    assert time.monotonic() - started < 20


def test_scores_equal_plain_search(documents, edges):
    """Every place of every folded text is tried with every entry and exception."""
    known = lexicon()
    known.curve = (-3.0, 1.5, 0.1)
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    texts = [r.text for r in df.collect()] + ["scum trash can trash", "pond scum scum"]
    phrases = [f" {' '.join(toxicity.fold(e).split())} " for e in known.exceptions]
    for text in texts:
        words = toxicity.fold(text).split()
        plain = f" {' '.join(words)} "
        starts = lambda p: [i for i in range(len(plain)) if words and plain.startswith(p, i)]
        spans = [(i, i + len(p) - 1) for p in phrases if p.strip()[:5] in plain for i in starts(p)]
        hits = [
            (i, w) for p, w in known.weights.items() if p.strip() in plain for i in starts(p)
            if not any(a <= i < b for a, b in spans)
        ]
        assert known.features(text) == (len(words), len(hits), sum(w for _, w in hits))
    scored = toxicity.score(df, known).collect()
    assert len(scored) == df.count()


@pytest.fixture(scope="module")
def held_out(spark):
    sf = SF.replace("0.001", "0.1")
    scores = queries.QUERIES["op2_toxicity"](spark, sf)
    return scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()


def test_held_out_documents(held_out):
    toxic = [r for r in held_out if r.toxic == 1]
    clean = [r for r in held_out if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    pairs = [(t.score > c.score) + 0.5 * (t.score == c.score) for t in toxic for c in clean[::5]]
    assert sum(pairs) / len(pairs) > 0.95


# ------------------------------------------------------------------ urls


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = (None, None)
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = (rule, kind)
    return host, path, *best


URLS = [
    "http://a.example.org/es/1", "http://org/", "http://org", "HTTP://A.B.Example.ORG/en/12?x=/es/", None, "",
    "no scheme/com/de/", "http://com/de/", "http://x.com/de/5#/fr/", "http://xcom/de/", "s://://?#", "http://h/" + "a/" * 40,
    "http://example.org/en/1", "http://example.org/EN/1", "x://y://example.org/",
]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    df = df.withColumn("host", F.lit(1)).withColumn("segments", F.lit(2)).withColumn("n", F.lit(3))
    got = Counter((r.page_id, r.host, r.path, r.rule) for r in urls.judge(df, queries.URL_RULES).collect())
    want = Counter((k, *brute_rule(u, queries.URL_RULES)[:3]) for k, u in [*enumerate(URLS), (0, URLS[0])])
    assert got == want


def test_pages_have_rule_verdicts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.QUERIES["op3_url_filter"](spark, SF).collect()}
    assert len(got) == pages.count()
    for p, u in [(r.page_id, r.url) for r in pages.collect()]:
        host, path, rule, verdict = brute_rule(u, queries.URL_RULES)
        r = got[p]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_templates_generalise_and_judge(spark):
    rows = []
    for k in range(60):
        rows += [("h", f"/bad/{k}", 1), ("h", f"/good/{k}", 0), ("h", f"/user{k}/x", None)]
    rows += [("h", "/bad/new", None), ("h", "/good/new", None), ("other", "/bad/1", None)]
    paths = urls.templates(spark.createDataFrame(rows, "host string, path string, bad int"))
    steps = {(r.host, "/".join(r.segments)): r.steps for r in paths.collect()}
    assert steps["h", "bad/new"] == ["bad", "*"] and steps["h", "user7/x"] == ["*", "x"]
    purity = {(r.host, "/".join(r.steps)): r.purity for r in urls.purities(paths).collect()}
    assert purity["h", "bad/*"] > urls.PURITY > purity["h", "*/x"] > purity["h", "good/*"]
    assert 0.3 < purity["other", ""] < urls.PURITY


def test_similar_branches_merge(spark):
    rows = [("h", f"/{name}/{k}", int(k < bad)) for name, bad in (("a", 20), ("b", 21), ("c", 39)) for k in range(40)]
    places = urls.purities(urls.templates(spark.createDataFrame(rows, "host string, path string, bad int")))
    branch = {r.steps[0]: r.branch for r in places.where(F.size("steps") == 1).collect()}
    assert branch["a"] == branch["b"] != branch["c"]


def test_few_blocked_rows_do_not_condemn_other_sections(spark):
    sizes = {"fr": 30, "de": 9, "en": 20, "es": 5}
    rows = [f"http://a.example.com/{name}/{k}" for name, n in sizes.items() for k in range(n)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), queries.URL_RULES).collect()
    verdicts = {name: {r.verdict for r in got if r.path.startswith(f"/{name}/")} for name in sizes}
    assert verdicts == {"fr": {"allow"}, "de": {"block"}, "en": {"allow"}, "es": {"allow"}}


def test_bad_section_among_many_and_deep_sections(spark):
    rows = [("h", f"/s{s}/{k}", int(s == 17) if k < 20 else None) for s in range(30) for k in range(25)]
    deep = "/1/2/3/4/5/6/7/8/9"
    rows += [("d", f"{deep}/{name}/{k}", bad if k else None) for name, bad in (("bad", 1), ("good", 0)) for k in range(20)]
    paths = urls.templates(spark.createDataFrame(rows, "host string, path string, bad int"))
    judged = paths.join(urls.purities(paths), ["host", "steps"]).collect()
    assert len(judged) == len(rows)
    blocked = {(r.host, "/".join(r.segments[:-1])) for r in judged if r.purity >= urls.PURITY}
    assert blocked == {("h", "s17"), ("d", f"{deep[1:]}/bad")}


def test_urls_of_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


# ------------------------------------------------------------------ licenses


def longest_common(template, words):
    """Most equal words of any alignment, by plain dynamic programming."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(max(row[j + 1], new[j], row[j] + (t == w)))
        row = new
    return row[-1]


def test_alignment_equals_plain_alignment():
    rng = random.Random(6)
    for _ in range(200):
        template = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
        words = [rng.randrange(5) for _ in range(rng.randint(0, 9))]
        equal, first, last = licenses.align(template, words, 0, band=10)
        assert equal == longest_common(template, words)
        if equal:
            assert longest_common(template, words[first : last + 1]) == equal


def test_notices_and_spans(spark):
    mit = licenses.TEMPLATES["MIT-permission"]
    edited = mit.replace("free of charge", "at no charge").replace("merge, ", "")
    texts = [
        (1, f"Before é. {mit} After"), (2, f"x {edited} y"), (3, " ".join(mit.split()[:20])),
        (4, "Licensed   under\nCC by-NC 4.0!"), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0. " * 3),
    ]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    one = got[1][0]
    assert (one.license, one.coverage) == ("MIT-permission", 1.0)
    assert texts[0][1][one.start : one.end] == mit
    assert 0.8 <= got[2][0].coverage < 1 and 3 not in got and 5 not in got and 6 not in got
    assert [r.license for r in got[4]] == ["CC-BY-NC-4.0"] and len(got[7]) == 3


def test_one_edit_at_each_place_equals_plain_alignment():
    """A word changed, left out or come in, at each place of each template of 16 words at most."""
    templates = licenses.TEMPLATES | {"four": "all rights reserved here", "six": "use at your own risk only"}
    index = licenses.Index(templates)
    n_found = 0
    for name, text in templates.items():
        words = text.lower().replace(",", "").split()
        if len(words) > 16:
            continue
        t = index.names.index(name)
        for i in range(len(words)):
            for edited in (["other"], [], ["other", words[i]]):
                changed = licenses.hashes(" ".join(["x", "y", *words[:i], *edited, *words[i + 1 :], "z"]))
                equal = longest_common(index.words[t].tolist(), changed.tolist())
                got = [(r[0], r[2]) for r in licenses.notices(changed, index)]
                if equal >= licenses.COVERAGE * len(index.words[t]):
                    n_found += 1
                    # Another template may cover as many words.
                    assert (t, equal) in got or any(n >= equal for _, n in got), (name, i, edited)
                else:
                    assert t not in [r[0] for r in got]
    assert n_found > 150


def test_winnowed_templates_keep_every_notice(monkeypatch):
    """Words changed as densely as the coverage allows, evenly and at random, in long templates."""
    rng = random.Random(8)
    templates = {str(n): " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (20, 48, 90, 140, 400)}
    index = licenses.Index(templates)
    shapes = dict(zip(index.names, index.shapes))
    assert shapes == {"20": (2, 1), "48": (2, 2), "90": (2, 2), "140": (3, 2), "400": (3, 2)}
    for t, name in enumerate(index.names):
        gram, window = index.shapes[t]
        n_grams, held = int(name) - gram + 1, sum(len(p) for k, p in index.places.items() if k[1] == index.shapes[t] and p[0][0] == t)
        assert held == n_grams if window == 1 else held < 0.8 * n_grams, name
    for t, (name, text) in enumerate(templates.items()):
        n = int(name)
        edits = n - -(-n * 4 // 5)
        for trial in range(30):
            words = text.split()
            places = [int((i + 0.5) * n / edits) for i in range(edits)] if trial == 0 else rng.sample(range(n), edits)
            for i in places:
                words[i] = f"x{rng.randrange(10**6)}"
            noise = [f"n{rng.randrange(10**6)}" for _ in range(trial)]
            got = licenses.notices(licenses.hashes(" ".join(noise + words + noise)), index)
            assert [(r[0], r[2]) for r in got] == [(t, n - edits)], (name, trial)
    whole = licenses.hashes(templates["400"])
    assert len(licenses.notices(whole, index)) == 1
    monkeypatch.setattr(licenses, "winnow", lambda grams, window: np.zeros(0, dtype=np.int64))
    assert licenses.notices(whole, index) == []


def test_winnowing_takes_the_last_smallest_hash_of_each_window():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 5, 60):
        grams = rng.integers(0, 6, n).astype(np.uint64)
        for window in (1, 2, 4):
            want = set()
            for lo in range(max(1, n - window + 1)) if n else ():
                part = grams[lo : lo + window].tolist()
                want.add(lo + max(i for i, g in enumerate(part) if g == min(part)))
            assert licenses.winnow(grams, window).tolist() == sorted(want)


def test_notices_of_the_table(spark, documents, edges, empty):
    got = {(r.doc_id, r.license) for r in licenses.scan(documents).collect()}
    names = ("MIT", "CC-BY-NC-4.0", "Apache-2.0", "GPL-3.0")
    want = {(i, n) for n in names for i, t in rows_of(documents) if licenses.TEMPLATES[n] in t}
    assert want and want <= got
    assert licenses.scan(edges).count() == 0 and licenses.scan(empty).count() == 0


# ------------------------------------------------------------------ personal data


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def text_of(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


TRICKY = [
    "a@b.c_x@d.e a.b@c@d.e.f. g@h. .x@y-z.co.uk, @a.b é@x.y q%+-@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.4 1..2.3.4 9.9.9.9999",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111111 - 4111111111111111",
    "+1 (269) 555-3296 4111111111111111 x +44 20 7946 0958. ++1 234 567 890 +1234567 +1 2 3 4 5 6 7 8 9 (",
    "\ue000 4111\ue0001111 1111 1111 1111 \ue000@\ue000.x a\ue000b@c.d", "1 " * 40, "😀 me@ex.org 😀 10.0.0.1", "-" * 50 + "1@2.3" + "." * 9,
    "call 555 123-4567 or (212) 555 1234, order 1234 5678 9012 3456",
]


def test_base_spans_equal_brute_force(spark, documents, edges):
    rng = random.Random(8)
    noise = ["".join(rng.choice("1234 +-.@ab()\n4") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(TRICKY + noise)], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text")).unionByName(extra)
    found = pii.detect(df).select("doc_id", pii.as_text(F.col("base")), pii.as_text(F.col("spans"))).collect()
    assert Counter((r[0], r[1]) for r in found) == Counter((i, text_of(brute_base(t))) for i, t in rows_of(df))
    for _, base, spans in found:  # base spans stay
        assert set(base.split(",")) <= set(spans.split(",")) or not base


def test_long_runs_do_not_break_the_matcher(spark):
    texts = ["a" * 50_000, "a@" + "b." * 20_000, "1 " * 30_000, "1." * 30_000, "+1" + " " * 30_000, "a@b.c" * 5000, "." * 50_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.detect(df).select("doc_id", pii.as_text(F.col("base"))).collect()}
    assert got == {k: text_of(brute_base(t)) for k, t in enumerate(texts) if k != 0} | {0: ""}


def test_numbers_in_a_row_are_added(spark):
    """The rule drops a phone number that a card number follows; the candidates bring both back."""
    rows = [(k, f"lorem +1 (2{k % 90 + 10}) 555-32{k % 90 + 10} ipsum") for k in range(60)]
    rows += [(100, "dolor +1 (269) 555-3296 4111111111111111 sit"), (101, "serial 1234567890123 x")]
    got = {r[0]: r[1] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", pii.as_text(F.col("spans"))).collect()}
    assert got[100] == "card:24:40,phone:6:23" and got[101] == ""


def test_labelers_that_agree_are_trusted():
    counts = [(0, "1,1,1,1,1", "a", 50), (0, "-1,-1,-1,0,-1", "b", 50), (0, "1,1,1,-1,1", "a", 5), (0, "-1,-1,-1,1,-1", "b", 5)]
    model = pii.estimate(counts)
    good, poor = model.reliability[0, "check"]["1"], model.reliability[0, "cue"]["1"]
    assert good[0] > 0.9 > 0.2 > good[1] and poor[0] - poor[1] < good[0] - good[1]


def test_personal_data_of_empty_table(empty):
    assert pii.detect(empty).count() == 0


# ------------------------------------------------------------------ fingerprints


def brute_edited(rows):
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None] * any(i is None for i, _ in rows)
    out = []
    for i, t in rows:
        t = t or ""
        after = ids[(ids.index(i) + 1) % len(ids)]
        half = len(t) // 2
        # Of several rows with the next id, the smallest text's beginning.
        need = max(len(x or "") // 2 for k, x in rows if k == i)
        head = min((x or "")[:need] for k, x in rows if k == after)
        new = t[: len(t) - half] + head[:half]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return Counter(out)


def test_edited_texts_equal_brute_force(documents, edges):
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100_000))
    got = fingerprint.compare(df)
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == brute_edited(rows_of(df))


def vectors(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r[0] for r in df.orderBy("k").select(fingerprint.vector(F.col("text"))).collect()]


def test_sums_do_not_depend_on_order(spark):
    a, b, c, d = vectors(spark, "x y\nz\nw w", "w w\nx y\nz", "x y\nz\nw", "x y\nz\nw w\nw w")
    assert a == b and a != c and a != d and all(0 <= w < 1 << 48 for w in a)


def test_every_identity_word_hashes_the_paragraph_itself(spark):
    seeds = spark.range(1).select(*[F.xxhash64(F.lit(k)) for k in range(fingerprint.IDENTITY_WORDS)]).first()
    lines = ["one two", "", "drei Wörter hier"]
    want = [
        sum(xxhash.xxh64_intdigest(t.encode(), seed=s % (1 << 64)) for t in lines) & fingerprint.WORD_MASK for s in seeds
    ]
    assert vectors(spark, "\n".join(lines))[0][1 : 1 + fingerprint.IDENTITY_WORDS] == want


def test_insert_and_delete(spark):
    whole, part, line = vectors(spark, "one two\nthree\nfour five", "one two\nfour five", "three")
    df = spark.createDataFrame([(whole, part, line)], "w array<long>, p array<long>, l array<long>")
    got = df.select(fingerprint.insert(F.col("p"), F.col("l")), fingerprint.delete(F.col("w"), F.col("l"))).first()
    assert got[0] == whole and got[1] == part


def test_equal_texts_and_likeness(spark, documents):
    got = queries.QUERIES["op9_fingerprints"](spark, SF).collect()
    texts = dict(rows_of(documents))
    by_print = defaultdict(set)
    for r in got:
        by_print[r.fingerprint].add("\n".join(sorted(texts[r.doc_id].split("\n"))))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_print.values()) and len(by_print) == len({"\n".join(sorted(t.split("\n"))) for t in texts.values()})
    long_ones = [r for r in got if r.n_chars > 400]
    better = sum(r.near_edited > r.near_next for r in long_ones)
    assert better >= 0.95 * len(long_ones)


def test_likeness_of_long_texts(spark):
    """Counters beyond 16 bits: unlike texts stay apart, a text with few changes stays near."""
    rng = random.Random(12)
    some, other = ([f"w{rng.randrange(10**6)}" for _ in range(160_000)] for _ in range(2))
    changed = [w if k % 100 else "changed" for k, w in enumerate(some)]
    texts = [" ".join(t) for t in (some, other, changed, some[:20_000])] + ["one more line\n" * 70_000, "some other words\n" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.fp for r in fingerprint.fingerprints(df, ["k"], {"text": "fp"}).collect()}
    single = df.where("k = 4").select(fingerprint.vector(F.col("text"))).first()[0]
    assert got[4] == single and max(single[5:]) == 210_000
    pairs = spark.createDataFrame([(got[a], got[b]) for a, b in ((0, 1), (0, 2), (0, 3), (4, 5))], "a array<long>, b array<long>")
    unlike, near, part, lines = (r[0] for r in pairs.select(fingerprint.likeness(F.col("a"), F.col("b"))).collect())
    assert unlike < 0.5 and near > 0.9 and 0.1 < part < 0.7 and lines < 0.9


def test_fingerprints_of_edges(spark, edges, empty):
    assert fingerprint.compare(edges).count() == edges.count()
    assert fingerprint.compare(empty).count() == 0


# ------------------------------------------------------------------ packing


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_ids_equal_the_tokenizers(model):
    rng = random.Random(9)
    alphabet = "aZéÉßüÑñ.,;:?!'\"0123 \t\n’“Σσς İı ŉ中文字カ\u0301\u00a0<|endoftext|>$%&*x-_/@~«»¿¡×÷²ªº\u2003K"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", " ", "it's We'LL", "a<|endoftext|>b", "<|startoftext|>"]
    known = packing.WordTokenizer(queries.vocabulary())
    for t, ids in zip(texts, known.many(texts)):
        assert ids.tolist() == model.encode(t or "", add_special_tokens=False).ids, t


def check_plan(rows, capacity):
    """Every sequence is gapless from 0 and holds at most ``capacity`` tokens."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_of_documents(spark, documents, edges, model):
    df = documents.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    got = packing.pack(df, queries.vocabulary()).collect()
    want = Counter()
    for i, t in rows_of(df):
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = check_plan(got, 4096)
    assert n <= -(-sum(r.length for r in got) // 4096) * 1.05 + 1


def test_rounds_of_shards(spark):
    rng = random.Random(10)
    rows = [(k, 0, 0, rng.choice([1, 3, 50, 90, 100, 100]), 0) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.plan(pieces, capacity=100, shard_rows=200).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(3000))
    total = sum(r.length for r in got)
    assert check_plan(got, 100) <= total / 100 * 1.06 + 1


def test_lengths_that_never_fill_a_sequence(spark):
    pieces = spark.createDataFrame([(k, 0, 0, 60, 0) for k in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.plan(pieces, capacity=100, shard_rows=100).collect()
    assert check_plan(got, 100) == 500 == len(got)


def test_emptier_sequences_are_packed_again_among_nearly_full_ones(spark):
    pieces = spark.createDataFrame([(k, 0, 0, 32, 0) for k in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.plan(pieces, capacity=100, shard_rows=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(3000))
    assert check_plan(got, 100) <= 1010  # at best 1000; the rule itself leaves a few open in the last shard


def test_placement_keeps_the_sum_of_squares_small():
    lengths = np.array([60, 40, 60, 40, 50, 50, 100, 30, 30, 40])
    bins, offsets, fill = packing.place(lengths, 100)
    assert sorted(fill.tolist()) == [100] * 5 and len(bins) == len(offsets) == 10


def test_sequences_hold_the_ids(spark, documents):
    small = documents.limit(20)
    planned = packing.plan(packing.tokenize(small, queries.vocabulary(), capacity=256), capacity=256)
    held = {r.sequence_id: r for r in packing.sequences(planned).collect()}
    for r in planned.collect():
        assert held[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert len(held[r.sequence_id].ids) == 4 * held[r.sequence_id].n_tokens


def test_packing_of_empty_table(empty):
    assert packing.pack(empty, queries.vocabulary()).count() == 0


# ------------------------------------------------------------------ the pipeline


def test_pipeline_equals_its_stages_by_hand(spark, model):
    """Line, near-duplicate, benchmark and packing stages by brute force on what toxicity leaves."""
    from test_texts import brute_groups, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    step = corpus_pipeline.line_stage(spark, kept, SF)
    assert step.columns == docs.columns and step.where("n_chars <> length(text)").count() == 0
    rows = [(i, t) for i, _, _, t in brute_lines(rows_of(kept), 10)]
    assert Counter(rows) == Counter(rows_of(step))
    stays = {i for i, _, c in brute_groups(rows) if i == c}
    near = corpus_pipeline.near_dedup_stage(spark, step, SF)
    rows = [(i, t) for i, t in rows if i in stays]
    assert Counter(rows) == Counter(rows_of(near)) and near.columns == docs.columns
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontamination_stage(spark, near, SF)
    rows = [(i, t) for i, t in rows if not any(b in plain(t) for b in items)]
    assert Counter(rows) == Counter(rows_of(clean)) and clean.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    check_plan(packed, 4096)


def test_stages_on_edges(spark, edges, empty):
    docs = edges.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for table in (docs, docs.limit(0)):
        step = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, SF)
            assert step.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, step, SF).collect()


def test_table_fingerprints_equal_single_ones(spark, documents, edges):
    """Sums over rows of features give what the expression gives for one text."""
    df = documents.select("doc_id", "text").unionByName(edges.where("doc_id <> 6").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    df = df.withColumn("other", F.reverse("text"))
    got = {r.doc_id: (r.fp, r.fp2, r.n_rows) for r in fingerprint.fingerprints(df, ["doc_id"], {"text": "fp", "other": "fp2"}).collect()}
    want = {r[0]: (r[1], r[2], 1) for r in df.select("doc_id", fingerprint.vector(F.col("text")), fingerprint.vector(F.col("other"))).collect()}
    assert got == want
