"""Queries on texts: chunking, cleaning, statements, retrieval, model answers and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, text, verdicts
from ..operators.stopwords import ENGLISH
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(e):
    return f"regexp_replace({e}, '^{text.WHITE_CLASS}+|{text.WHITE_CLASS}+$', '', 'g')"


def _digest(e):
    return f"md5({e})"


# ---------------------------------------------------------------- chunks


def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents")


_CHUNKS = f"""w AS (SELECT doc_id, source, string_split_regex({_strip('text')}, '{text.WHITE_CLASS}+') AS ws FROM documents
    WHERE {_strip('text')} <> ''),
chunks AS (SELECT * FROM (SELECT doc_id, source, CAST((i - 1) // 450 AS INTEGER) AS pos,
    array_to_string(ws[i:i + 499], ' ') AS text
  FROM (SELECT doc_id, source, ws, unnest(range(1, len(ws) + 1, 450)) AS i FROM w))
  WHERE length(text) > 50)"""


def _chunks(spark, sf_dir):
    return text.word_chunks(_documents(spark, sf_dir), ["doc_id"], keep=["source"])


@query(
    "word_chunks",
    f"WITH {_CHUNKS} SELECT doc_id, pos, CAST(length(text) AS INTEGER) AS chars,"
    f" {_digest('text')} AS digest FROM chunks",
)
def word_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select(
        "doc_id", "pos", F.length("text").alias("chars"), F.md5("text").alias("digest")
    )


# One step of the recursion for each paragraph of a text: where its chunk began, and the words so
# far (none after a paragraph that is cut by itself).
_PACKING = f"""WITH RECURSIVE
raw AS (SELECT doc_id, unnest(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{{2,}}'),
    lambda p: list_filter(string_split_regex(p, '{text.WHITE_CLASS}+'), lambda w: w <> ''))) AS ws,
  generate_subscripts(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{{2,}}'), 1) AS k
  FROM documents),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, len(ws) AS n, ws FROM raw WHERE len(ws) > 0),
walk AS (
  SELECT doc_id, i, i AS s, n, CASE WHEN n >= {text.PARAGRAPH_TARGET * text.PARAGRAPH_SLACK} THEN NULL ELSE n END AS held
  FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN p.n < {text.PARAGRAPH_TARGET * text.PARAGRAPH_SLACK} AND held + p.n <= {text.PARAGRAPH_TARGET}
      THEN s ELSE p.i END, p.n,
    CASE WHEN p.n >= {text.PARAGRAPH_TARGET * text.PARAGRAPH_SLACK} THEN NULL
      WHEN held + p.n <= {text.PARAGRAPH_TARGET} THEN held + p.n ELSE p.n END
  FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.i = walk.i + 1),
packed AS (SELECT doc_id, s, bool_or(held IS NULL) AS cut, flatten(list(ws ORDER BY i)) AS ws
  FROM walk JOIN p USING (doc_id, i) GROUP BY doc_id, s),
pieces AS (SELECT doc_id, s, a, ws[a + 1 : a + size] AS ws FROM (SELECT doc_id, s, ws,
    CASE WHEN cut THEN {text.PARAGRAPH_TARGET} ELSE len(ws) END AS size,
    unnest(range(0, len(ws), CASE WHEN cut THEN {text.PARAGRAPH_TARGET} ELSE len(ws) END)) AS a FROM packed)),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, a) - 1 AS INTEGER) AS pos,
    len(ws) AS words, array_to_string(ws, ' ') AS text FROM pieces WHERE len(ws) >= {text.PARAGRAPH_MIN})"""


@query(
    "paragraph_chunks",
    f"{_PACKING} SELECT doc_id, pos, CAST(words AS INTEGER) AS words, {_digest('text')} AS digest FROM chunks",
)
def paragraph_chunks(spark, sf_dir):
    spaced = _documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return text.paragraph_chunks(spaced, ["doc_id"]).select(
        "doc_id", "pos", F.size(F.split("text", " ")).alias("words"), F.md5("text").alias("digest")
    )


# ---------------------------------------------------------------- cleaning

_FURNITURE_SQL = (
    r"!\[Image[^\]]*\]\([^)]*\)", r"https?://[^\s\)]+", r"www\.[^\s\)]+", r"<[^>]+>",
    r"Skip to main content",
    r"NCBI Homepage.*?MyNCBI Homepage.*?Main Content.*?Main Navigation",
    r"\[Log in\].*?Log out.*?", r"References.*?", r"Copyright.*?Bookshelf ID:.*?",
    r"View on publisher site.*?Download PDF.*?Add to Collections.*?Cite.*?Permalink.*?",
    r"Back to Top.*?", r"Follow NCBI.*?", r"Add to Collections.*?", r"Cite.*?",
)


def _clean_sql(e):
    for p in _FURNITURE_SQL:
        e = f"regexp_replace({e}, {_q('(?is)' + p)}, '', 'g')"
    e = f"regexp_replace({e}, {_q(r'\[([^\]]*)\]\([^)]*\)')}, '\\1', 'g')"
    e = f"regexp_replace({e}, '\\n+', chr(10), 'g')"
    e = f"regexp_replace({e}, ' +', ' ', 'g')"
    e = f"regexp_replace({e}, '\\n\\s*\\n', chr(10) || chr(10), 'g')"
    e = f"regexp_replace({e}, '(?m)^\\s*$\\n', '', 'g')"
    return _strip(e)


@query(
    "clean_content",
    f"SELECT page_id, CAST(length(t) AS INTEGER) AS chars, {_digest('t')} AS digest"
    f" FROM (SELECT page_id, {_clean_sql('html')} AS t FROM pages)",
)
def clean_content(spark, sf_dir):
    return (
        V.table(spark, sf_dir, "pages")
        .select("page_id", text.clean_content(F.col("html")).alias("t"))
        .select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))
    )


_RAW = """CASE page_id % 5 WHEN 0 THEN 'No content available' WHEN 1 THEN NULL ELSE html END"""


def _raw_pages(spark, sf_dir):
    k = F.col("page_id") % 5
    raw = F.when(k == 0, "No content available").when(k != 1, F.col("html"))
    return V.table(spark, sf_dir, "pages").select("page_id", raw.alias("raw_content"))


@query(
    "knowledge_base",
    f"""SELECT page_id, {_digest('t')} AS digest FROM (SELECT page_id, {_clean_sql('raw')} AS t
FROM (SELECT page_id, {_RAW} AS raw FROM pages) WHERE raw IS NOT NULL
  AND raw NOT IN ('No content available', 'No URLs found to extract content from')) WHERE t <> ''""",
)
def knowledge_base(spark, sf_dir):
    return text.knowledge_base(_raw_pages(spark, sf_dir), ["page_id"]).select(
        "page_id", F.md5("text").alias("digest")
    )


# Search results put together from the pages: two listed documents, two or three segments.
def _search_results(spark, sf_dir):
    n = F.col("page_id").cast("string")
    listing = F.concat(
        F.lit("1. Page - "), n, F.lit(" - "), F.col("url"), F.lit("\n\n2. Broken line\n3. Second - "),
        F.col("url"), F.lit("#b\n4. Other - ftp://x\n"),
    )
    mark = F.lit(text.SEGMENT_MARK)
    raw = F.when(
        F.col("page_id") % 2 == 0, F.concat("html", mark, F.lit("tail "), n, mark, F.lit("more"))
    ).otherwise(F.col("html"))
    return V.table(spark, sf_dir, "pages").select(
        "page_id", listing.alias("relevant_docs"), raw.alias("raw_content")
    )


@query(
    "document_entries",
    """SELECT page_id, CAST(0 AS INTEGER) AS pos, 'Page - ' || page_id AS title, url FROM pages
UNION ALL SELECT page_id, 1, 'Second', url || '#b' FROM pages""",
)
def document_entries(spark, sf_dir):
    return text.document_entries(_search_results(spark, sf_dir), ["page_id"])


@query(
    "knowledge_blocks",
    f"""SELECT page_id, CAST(0 AS INTEGER) AS pos, {_digest(_clean_sql('html'))} AS digest,
  'Page - ' || page_id AS source_title, url AS source_url FROM pages
UNION ALL SELECT page_id, 1, {_digest("'tail ' || page_id")}, 'Second', url || '#b' FROM pages
  WHERE page_id % 2 = 0""",
)
def knowledge_blocks(spark, sf_dir):
    blocks = text.knowledge_blocks(_search_results(spark, sf_dir), ["page_id"])
    return blocks.select(
        "page_id", "pos", F.md5("text").alias("digest"), "source_title", "source_url"
    )


@query(
    "format_documents",
    """SELECT page_id, '1. Page ' || page_id || ' - ' || url || chr(10) || '2. No title - No URL' AS listing
FROM pages""",
)
def format_documents(spark, sf_dir):
    none = F.lit(None).cast("string")
    documents = F.array(
        F.struct(
            F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
            F.col("url").alias("url"),
        ),
        F.struct(none.alias("title"), none.alias("url")),
    )
    return V.table(spark, sf_dir, "pages").select(
        "page_id", text.format_documents(documents).alias("listing")
    )


# ---------------------------------------------------------------- statements

_KEYWORDS = "|".join(text.TESTABLE_WORDS)


def _statements_sql(source, key):
    return f"""st AS (SELECT {key}, CAST(i AS INTEGER) AS sentence_number, s AS original_statement,
    CAST(regexp_matches(lower(s), '{_KEYWORDS}') AS INTEGER) AS is_testable,
    CASE WHEN length(s) > 100 THEN substring(s, 1, 100) || '...' ELSE s END AS optimized_assertion
  FROM (SELECT {key}, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (
    SELECT {key}, list_filter(list_transform(string_split_regex(text, '[.!?]+'),
      lambda x: {_strip('x')}), lambda x: length(x) > 20) AS ss FROM {source})))"""


@query(
    "statements",
    f"WITH {_statements_sql('documents', 'doc_id')} SELECT doc_id, sentence_number, is_testable,"
    f" {_digest('original_statement')} AS statement, {_digest('optimized_assertion')} AS assertion FROM st",
)
def statements(spark, sf_dir):
    return text.statements(_documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "sentence_number", "is_testable",
        F.md5("original_statement").alias("statement"),
        F.md5("optimized_assertion").alias("assertion"),
    )


@query(
    "testable_statements",
    f"WITH {_statements_sql('conversations', 'conv_id, turn')} SELECT conv_id, turn,"
    " original_statement AS statement, optimized_assertion AS assertion FROM st WHERE is_testable = 1",
)
def testable_statements(spark, sf_dir):
    key = ["conv_id", "turn"]
    found = text.statements(V.table(spark, sf_dir, "conversations"), key)
    return text.testable_statements(found, key)


# ---------------------------------------------------------------- index and retrieval

_STOP = ", ".join(_q(w) for w in ENGLISH)


def _terms_sql(source, key):
    """(key, term, tf) with neighbouring pairs, from a relation (key, text)."""
    return f"""SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(ws, list_transform(range(1, len(ws)),
      lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
    FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
      lambda t: t NOT IN ({_STOP})) AS ws FROM {source})) GROUP BY ALL"""


_INDEX = f"""c AS (SELECT CAST(doc_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS chunk_id, doc_id, source, text
  FROM chunks),
tf AS MATERIALIZED ({_terms_sql('c', 'chunk_id')}),
terms AS MATERIALIZED (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_frequency,
    CAST(count(*) AS BIGINT) AS chunk_frequency,
    ln((1 + (SELECT count(*) FROM c)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM tf GROUP BY term ORDER BY 2 DESC, term LIMIT 5000),
postings AS MATERIALIZED (SELECT chunk_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)) AS weight
  FROM (SELECT chunk_id, tf.term, tf * idf AS x FROM tf JOIN terms ON tf.term = terms.term))"""
_INDEX_CTES = f"WITH {_CHUNKS}, {_INDEX}"


def _index(spark, sf_dir):
    key = F.concat_ws("-", "doc_id", "pos")
    chunks = _chunks(spark, sf_dir).select(
        key.alias("chunk_id"), "doc_id", "text", F.col("source").alias("source_title"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"),
    )
    return retrieval.build_index(chunks)


@query(
    "index_terms",
    _INDEX_CTES + " SELECT term, corpus_frequency, chunk_frequency, round(idf, 6) AS idf FROM terms",
)
def index_terms(spark, sf_dir):
    return V.rounded(_index(spark, sf_dir).terms)


@query("index_postings", _INDEX_CTES + " SELECT chunk_id, term, round(weight, 6) AS weight FROM postings")
def index_postings(spark, sf_dir):
    return V.rounded(_index(spark, sf_dir).postings)


def _questions(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_SCORED = f"""qt AS ({_terms_sql('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')}),
qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS weight
  FROM (SELECT query_id, qt.term, tf * idf AS x FROM qt JOIN terms ON qt.term = terms.term)),
scored AS (SELECT query_id, chunk_id, round(sum(qw.weight * postings.weight), 6) AS similarity
  FROM qw JOIN postings ON qw.term = postings.term GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)
  AS INTEGER) AS rank FROM scored),
found AS (SELECT query_id, rank, chunk_id, similarity FROM ranked WHERE rank <= 3 AND similarity > 0.1)"""


@query("retrieve", f"{_INDEX_CTES}, {_SCORED} SELECT * FROM found")
def retrieve(spark, sf_dir):
    return retrieval.retrieve(_questions(spark, sf_dir), _index(spark, sf_dir))


@query(
    "retrieve_with_sources",
    f"""{_INDEX_CTES}, {_SCORED} SELECT item_id AS query_id, coalesce(rank, 1) AS rank, f.chunk_id,
  md5(coalesce(c.text, 'No relevant information found in knowledge base.')) AS digest,
  c.source AS source_title, 'doc:' || c.doc_id AS source_url, similarity
FROM benchmark LEFT JOIN found f ON item_id = query_id LEFT JOIN c ON f.chunk_id = c.chunk_id""",
)
def retrieve_with_sources(spark, sf_dir):
    found = retrieval.retrieve_with_sources(_questions(spark, sf_dir), _index(spark, sf_dir))
    return found.withColumn("digest", F.md5("text")).drop("text")


@query(
    "evidence_documents",
    f"""{_INDEX_CTES}, {_SCORED}, best AS (SELECT query_id, doc_id, max(similarity) AS similarity
  FROM scored JOIN c ON scored.chunk_id = c.chunk_id WHERE similarity > 0.1 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id)
  AS INTEGER) AS rank, doc_id, similarity FROM best) SELECT * FROM r WHERE rank <= 2""",
)
def evidence_documents(spark, sf_dir):
    return retrieval.evidence_documents(_questions(spark, sf_dir), _index(spark, sf_dir))


# ---------------------------------------------------------------- answers and verdicts


@query(
    "batches",
    """SELECT conv_id, turn, CAST((r - 1) // 5 AS BIGINT) AS batch_id, CAST((r - 1) % 5 + 1 AS INTEGER)
  AS batch_index FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS r
  FROM conversations)""",
)
def batches(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return verdicts.assign_batches(turns, ["conv_id", "turn"])


# Every conversation is a batch whose statements are its turns; the answer to it is put together
# from the turns: fenced, plain, broken or wrapped in text, with a repeated and an unknown entry.
def _answers(spark, sf_dir):
    turn = F.col("turn").cast("string")
    verdict = F.when(F.col("turn") % 4 == 0, "Correct").when(F.col("turn") % 4 == 1, "Incorrect")
    verdict = verdict.when(F.col("turn") % 4 == 2, "Perhaps").otherwise("Flagged for Review")
    entry = F.concat(
        F.lit('{"index": '), (F.col("turn") + 1).cast("string"), F.lit(', "final_verdict": "'), verdict,
        F.lit('", "reasoning": " r'), turn, F.lit(' ", "citations": ["c'), turn, F.lit('"]}'),
    )
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda s: s["e"]), ", ")
    body = F.concat(F.lit("["), entries, F.lit(', {"index": 1, "final_verdict": "Incorrect"}]'))
    kind = F.col("conv_id") % 4
    fence = F.lit("```")
    answer = (
        F.when(kind == 0, F.concat(fence, F.lit("json\n"), "body", F.lit("\n"), fence))
        .when(kind == 1, F.col("body"))
        .when(kind == 2, F.concat(F.lit("Here you are: "), "body", F.lit(" Done.")))
        .otherwise(F.regexp_replace("body", "\\}\\]$", "]"))
    )
    return (
        V.table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(body.alias("body"))
        .select(F.col("conv_id").alias("batch_id"), answer.alias("response"))
    )


def _batched(spark, sf_dir):
    return V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"), (F.col("turn") + 1).cast("int").alias("batch_index")
    )


_VERDICTS = """v AS (SELECT conv_id AS batch_id, CAST(turn + 1 AS INTEGER) AS batch_index,
    CASE WHEN conv_id % 4 = 3 THEN 'Flagged for Review' WHEN turn = 0 THEN 'Incorrect'
      WHEN turn % 4 = 0 THEN 'Correct' WHEN turn % 4 = 1 THEN 'Incorrect'
      ELSE 'Flagged for Review' END AS verdict,
    CASE WHEN conv_id % 4 = 3 THEN 'Failed to parse JSON batch response.' WHEN turn = 0 THEN ''
      ELSE 'r' || turn END AS analysis,
    CASE WHEN conv_id % 4 = 3 OR turn = 0 THEN '' ELSE 'c' || turn END AS citations
  FROM conversations)"""


def _verdicts(spark, sf_dir):
    return verdicts.batch_verdicts(_batched(spark, sf_dir), _answers(spark, sf_dir))


@query("batch_verdicts", f"WITH {_VERDICTS} SELECT * FROM v")
def batch_verdicts(spark, sf_dir):
    found = _verdicts(spark, sf_dir)
    return found.withColumn("citations", F.array_join("citations", "|"))


@query(
    "verdict_summary",
    f"""WITH {_VERDICTS} SELECT batch_id, verdict, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1, 2
UNION ALL SELECT NULL, verdict, CAST(count(*) AS BIGINT) FROM v GROUP BY 2""",
)
def verdict_summary(spark, sf_dir):
    return verdicts.verdict_summary(_verdicts(spark, sf_dir))


# Verdict texts of many wordings, one per event.
_WORDINGS = (
    "Correct", "Incorrect", "Flagged for Review", "Supported by evidence", "Refuted", "not sure",
    "Contradicted by source", "yes", "no", "1", "0", "", "Unknown", "nothing",
)
_WORDING_SQL = "[" + ", ".join(_q(w) for w in _WORDINGS) + "][CAST(event_id % 14 + 1 AS INTEGER)]"


def _worded(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in _WORDINGS])
    return V.table(spark, sf_dir, "events").select(
        "event_type",
        F.get(words, (F.col("event_id") % 14).cast("int")).alias("verdict"),
        (F.col("user_id") % 3 != 0).cast("int").alias("truth"),
    )


_MAPPED = f"""m AS (SELECT event_type, verdict, CAST(user_id % 3 <> 0 AS INTEGER) AS truth,
    CASE WHEN verdict IN ('Flagged for Review', 'not sure', 'Unknown') THEN 'abstain'
      WHEN verdict IN ('Incorrect', 'Refuted', 'Contradicted by source', 'no', '0') THEN 'negative'
      WHEN verdict IN ('Correct', 'Supported by evidence', 'yes', '1') THEN 'positive'
      ELSE 'unmapped' END AS mapped,
    CASE WHEN verdict IN ('Correct', 'Incorrect', 'Supported by evidence', 'yes', '1') THEN 'positive'
      WHEN verdict IN ('Refuted', 'not sure', 'Contradicted by source', 'no', '0', 'Unknown', 'nothing')
        THEN 'negative'
      WHEN verdict = 'Flagged for Review' THEN 'abstain' ELSE 'unmapped' END AS legacy
  FROM (SELECT *, {_WORDING_SQL} AS verdict FROM events))"""


@query(
    "map_verdicts",
    f"WITH {_MAPPED} SELECT verdict, mapped, legacy, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL",
)
def map_verdicts(spark, sf_dir):
    v = F.col("verdict")
    return (
        _worded(spark, sf_dir)
        .select(
            "verdict",
            verdicts.map_verdict(v).alias("mapped"),
            verdicts.map_verdict(v, legacy=True).alias("legacy"),
        )
        .groupBy("verdict", "mapped", "legacy")
        .agg(F.count("*").alias("n"))
    )


def _evaluation_sql(column, truth, by=None):
    p, t = f"{column} = 'positive'", f"{truth}"
    keys = f"{by}, " if by else ""

    def c(condition):
        return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"

    sums = f"""e AS (SELECT {keys}CAST(count(*) AS BIGINT) AS n, {c(f'{p} AND {t}')} AS tp,
    {c(f'NOT {p} AND {t}')} AS fn, {c(f'{p} AND NOT {t}')} AS fp, {c(f'NOT {p} AND NOT {t}')} AS tn,
    {c(f"{column} = 'abstain'")} AS ab, {c(f"{column} = 'negative'")} AS ne,
    {c(f"{column} = 'unmapped'")} AS un,
    {c(f"{column} <> 'abstain' AND NOT {p} AND {t}")} AS cfn,
    {c(f"{column} <> 'abstain' AND NOT {p} AND NOT {t}")} AS ctn FROM m GROUP BY ALL)"""

    def d(a, b):
        return f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"

    return f"""WITH {_MAPPED}, {sums} SELECT {keys}n, tp, fn, fp, tn, {d('tp + tn', 'n')} AS accuracy,
  {d('tp', 'tp + fp')} AS precision, {d('tp', 'tp + fn')} AS recall,
  {d('2 * tp', '2 * tp + fp + fn')} AS f1, {d('n - ab', 'n')} AS coverage, {d('ab', 'n')} AS abstain_rate,
  {d('ne', 'n')} AS negative_rate, {d('un', 'n')} AS unmapped_rate, n - ab AS covered,
  {d('tp + ctn', 'n - ab')} AS covered_accuracy, {d('tp', 'tp + fp')} AS covered_precision,
  {d('tp', 'tp + cfn')} AS covered_recall, {d('2 * tp', '2 * tp + fp + cfn')} AS covered_f1 FROM e"""


@query("evaluate_verdicts", _evaluation_sql("mapped", "truth = 1", "event_type"))
def evaluate_verdicts(spark, sf_dir):
    return V.rounded(
        verdicts.evaluate_verdicts(_worded(spark, sf_dir), truth="truth", by=["event_type"])
    )


@query("evaluate_verdicts_legacy", _evaluation_sql("legacy", "true"))
def evaluate_verdicts_legacy(spark, sf_dir):
    return V.rounded(verdicts.evaluate_verdicts(_worded(spark, sf_dir), legacy=True))


# Answers holding extracted statements: valid, fenced, with common mistakes, or unreadable.
def _extractions(spark, sf_dir):
    n = F.col("event_id").cast("string")
    good = F.concat(
        F.lit('[{"sentence_number": '), n, F.lit(', "original_statement": "s'), n,
        F.lit('", "is_testable": true, "optimized_assertion": "a'), n, F.lit('"}]'),
    )
    flawed = F.concat(
        F.lit("```json\n[{sentence_number: "), n, F.lit(", 'original_statement': 's"), n,
        F.lit("', 'is_testable': True, 'optimized_assertion': 'a"), n, F.lit("',}\n]\n```"),
    )
    kind = F.col("event_id") % 4
    answer = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 2, flawed)
        .otherwise(F.lit("I cannot {answer: that"))
    )
    return V.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))


@query(
    "parse_statements",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(event_id AS INTEGER) END AS sentence_number,
  CASE WHEN event_id % 4 < 3 THEN 's' || event_id END AS original_statement,
  CASE WHEN event_id % 4 < 3 THEN 1 END AS is_testable,
  CASE WHEN event_id % 4 < 3 THEN 'a' || event_id END AS optimized_assertion FROM events""",
)
def parse_statements(spark, sf_dir):
    parsed = _extractions(spark, sf_dir).select(
        "event_id", verdicts.parse_statements(F.col("answer")).alias("found")
    )
    s = F.get("found", F.lit(0))
    return parsed.select(
        "event_id",
        s["sentence_number"].alias("sentence_number"),
        s["original_statement"].alias("original_statement"),
        s["is_testable"].cast("int").alias("is_testable"),
        s["optimized_assertion"].alias("optimized_assertion"),
    )


@query(
    "json_object_text",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE 'none' END AS body FROM events",
)
def json_object_text(spark, sf_dir):
    kind, fence = F.col("event_id") % 3, F.lit("```")
    answer = (
        F.when(kind == 0, F.concat(fence, F.lit("json\n"), "props", F.lit("\n"), fence))
        .when(kind == 1, F.concat(F.lit("Result: "), "props", F.lit(" ok")))
        .otherwise("none")
    )
    return V.table(spark, sf_dir, "events").select(
        "event_id", verdicts.json_object_text(answer).alias("body")
    )
