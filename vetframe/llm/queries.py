"""The registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import (
    bytebpe, decontamination, fingerprint, infill, licenses, lines, packing, periodic, pii, simhash,
    substrings, toxicity, urls,
)
from .base import find_package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        def run(spark, sf_dir):
            find_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- 1: lines

LINES_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
    SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM shared)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM shared)), ''))
           AS kept_sha256
FROM k GROUP BY doc_id
"""


@query("op1_line_dedup", LINES_SQL)
def line_dedup(spark, sf_dir):
    kept = lines.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


# ---------------------------------------------------------------- 2: toxicity


def _fold_of():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


@query("op2_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels").where(_fold_of() != 1))
    return toxicity.score(docs, lexicon).select(
        "doc_id", (_fold_of() == 1).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_matches",
    )


# ---------------------------------------------------------------- 3: urls

URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)


@query("op3_url_filter")
def url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


# ---------------------------------------------------------------- 4: license notices


@query("op4_license_scan")
def license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 5: passages


PASSAGES_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 20], ' ')) AS k
    FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 19, 0))) AS s FROM w)
), again AS (
    SELECT doc_id, s FROM (
        SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM s
    ) WHERE r > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again
), words AS (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w
), kept AS (
    SELECT words.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
        string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS t
    FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i
    GROUP BY words.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@query("op5_substring_dedup", PASSAGES_SQL)
def substring_dedup(spark, sf_dir):
    return substrings.deduplicate(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


# ---------------------------------------------------------------- 6: SimHash


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- 7: personal data


@query("op7_personal_data")
def personal_data(spark, sf_dir):
    found = pii.detect(_table(spark, sf_dir, "documents"))

    def number(kind):
        at = pii.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == at)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in pii.KINDS],
        F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


# ---------------------------------------------------------------- 8: benchmark passages


@query("op8_decontamination")
def benchmark_passages(spark, sf_dir):
    return decontamination.matches(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


# ---------------------------------------------------------------- 9: fingerprints


@query("op9_fingerprints")
def fingerprints(spark, sf_dir):
    found = fingerprint.compare(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint.as_text(F.col("fp")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


# ---------------------------------------------------------------- 10: packing


@query("op10_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


# ---------------------------------------------------------------- 11: periodic runs

#: White space of the word pattern is all other characters.
WORD = r"[^\x20\x09-\x0D]+"


def with_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: the words of one document in ten, by its id, go on periodically from some word.

    A null id has the checksum of an empty one.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0)
    # The columns below are null for all other documents.
    picked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, found).alias("words"))
    n, a, p, g, words = (F.col(c) for c in ("n", "a", "p", "g", "words"))
    measured = picked.select(
        "*", F.when(F.col("h") % 10 == 0, F.size(words)).alias("n"), F.floor(F.col("h") / 10).alias("g")
    )
    measured = measured.withColumn("a", F.when(n > 0, (g % n).cast("int")).when(n == 0, 0))
    measured = measured.withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")
    return measured.select("doc_id", F.when(n.isNull(), F.col("text")).otherwise(repeated).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periodic.detect(with_repeats(_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(periodic.as_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


# ---------------------------------------------------------------- 12: byte-level BPE


@query("op12_byte_bpe")
def byte_bpe(spark, sf_dir):
    import public_tokenizers

    ranks, pattern = bytebpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bytebpe.encode(docs, ranks, pattern).drop("text")
    return bytebpe.decode(encoded, ranks, pattern).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


# ---------------------------------------------------------------- 13: fill in the middle

INFILL_SQL = r"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
    FROM documents
), h AS (
    SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
           ('0x' || d[25:32])::BIGINT AS h4
    FROM u
), parts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
             THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), cut AS (
    SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS prefix,
           coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle,
           coalesce(array_to_string(units[b + 1 : n], ''), '') AS suffix
    FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query("op13_fill_in_middle", INFILL_SQL)
def fill_in_middle(spark, sf_dir):
    moved = infill.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return infill.restore(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(F.col("restored"), 256).alias("restored_sha256"),
    )
