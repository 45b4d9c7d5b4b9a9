"""Parsing of model answers, batching of statements, verdict tallies and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, let, quoted, ratio
from ..functions.ordering import global_row_number
from .text import strip

# Verdict names, batch size, messages, and the shapes JSON is dug out by.
CORRECT, INCORRECT, REVIEW = "Correct", "Incorrect", "Flagged for Review"
VERDICTS = (CORRECT, INCORRECT, REVIEW)
BATCH_SIZE = 5
UNREADABLE = "Failed to parse JSON batch response."
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
OBJECT_FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
ARRAY_BLOCK = r"(?s)(\[\s*\{.*\}\s*\])"
OBJECT_BLOCK = r"(?s)(\{.*\})"
# Words that map a verdict; a trailing * stands for any ending.
POSITIVE_WORDS = ("correct", "supported", "true", "yes", "verified", "1")
NEGATIVE_WORDS = ("incorrect", "refuted", "false", "no", "contradict*", "wrong", "0")
ABSTAIN_WORDS = (
    "flagged", "review", "not enough", "insufficient", "unknown", "unclear",
    "cannot determine", "not sure", "maybe", "needs review",
)
STATEMENT_SCHEMA = (
    "array<struct<sentence_number: int, original_statement: string, is_testable: boolean,"
    " optimized_assertion: string>>"
)


def _first_match(text: Column, *patterns: str) -> Column:
    """The first pattern's group that matches, else the text itself."""
    out = text
    for pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(out)
    return out


def json_array_text(answer: Column) -> Column:
    """The JSON array in an answer: inside a code fence, else the widest ``[{…}]``, else all."""
    return _first_match(answer, FENCE, ARRAY_BLOCK)


def batch_array_text(answer: Column) -> Column:
    """The JSON array of a batch answer: the fenced part, or all of it, if that is an array;
    else the widest ``[{…}]`` inside."""

    def array_in(t):
        whole = t.startswith("[") & t.endswith("]")
        return F.when(whole, t).otherwise(_first_match(t, ARRAY_BLOCK))

    return let(strip(_first_match(strip(answer), FENCE)), array_in)


def json_object_text(answer: Column) -> Column:
    """The JSON object in an answer: inside a code fence, else the widest ``{…}``, else all."""
    return _first_match(answer, OBJECT_FENCE, OBJECT_BLOCK)


def _requote_line(line: Column) -> Column:
    """Escape stray quotes inside the value of a ``"key": "value"`` line."""
    mark = '": "'
    at = F.locate(mark, line)
    rest = F.substring(line, at + len(mark), F.length(line))
    quotes = F.length(line) - F.length(F.translate(line, '"', ""))
    ends = line.endswith('",') | line.endswith('"')
    broken = (at > 0) & (quotes > 4) & ends
    tail = F.when(line.endswith('",'), F.lit('",')).otherwise(F.lit('"'))
    value = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
    head = F.substring(line, F.lit(1), at + len(mark) - 1)
    fixed = F.concat(head, F.replace(value, F.lit('"'), F.lit('\\"')), tail)
    return F.when(broken, fixed).otherwise(line)


def repair_json(text: Column) -> Column:
    """Mend what models get wrong in JSON arrays: commas, quotes, names, literals, comments."""
    out = strip(text)
    out = F.regexp_replace(out, r"\}\s*\n\s*\{", "},\n{")
    out = F.regexp_replace(out, r",\s*\]", "]")
    out = F.regexp_replace(out, r",\s*\}", "}")
    out = F.translate(out, "'", '"')
    out = F.regexp_replace(out, r"(\s*)([a-zA-Z_][\p{L}\p{N}_]*)(\s*):", '$1"$2"$3:')
    out = F.array_join(F.transform(F.split(out, "\n"), _requote_line), "\n")
    out = F.regexp_replace(out, r"\bTrue\b", "true")
    out = F.regexp_replace(out, r"\bFalse\b", "false")
    out = F.regexp_replace(out, r"\bNone\b", "null")
    lines = F.filter(
        F.transform(F.split(out, "\n"), strip),
        lambda l: (l != "") & ~l.startswith("//") & ~l.startswith("#"),
    )

    def bracketed(t):
        return F.concat(
            F.when(t.startswith("["), "").otherwise("["), t,
            F.when(t.endswith("]"), "").otherwise("]"),
        )

    out = let(F.array_join(lines, "\n"), bracketed)
    return F.when(text.isNull() | (text == ""), "[]").otherwise(out)


def parse_statements(answer: Column) -> Column:
    """Statements from a model answer as ``array<struct>``; NULL when it cannot be read.

    An answer that is already valid is taken as it is; otherwise it is repaired first.
    """

    def read(t):
        return F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, STATEMENT_SCHEMA))

    def read_or_mend(t):
        return F.coalesce(read(t), let(repair_json(t), read))

    return let(json_array_text(answer), read_or_mend)


def assign_batches(
    df: DataFrame, order_by: Sequence[str], size: int = BATCH_SIZE
) -> DataFrame:
    """Add ``batch_id`` (from 0) and ``batch_index`` (from 1) in the order of the given columns.

    Batches run over the whole table, so rows are numbered globally; see ``global_row_number``.
    """
    numbered = global_row_number(df, [F.col(c) for c in order_by], "_row")
    return numbered.select(
        *[quoted(c) for c in df.columns],
        F.floor((F.col("_row") - 1) / size).cast("long").alias("batch_id"),
        (F.pmod(F.col("_row") - 1, F.lit(size)) + 1).cast("int").alias("batch_index"),
    )


def answer_entries(answers: DataFrame, answer: str = "response") -> DataFrame:
    """``(batch_id, entry_index, final_verdict, reasoning, citations)`` of the readable answers.

    Of several entries with the same index the last one counts. Entries of one answer are compared
    inside the answer, so the shuffle only carries one entry per index.
    """
    body = batch_array_text(F.col(answer))
    parsed = answers.select("batch_id", F.try_parse_json(body).alias("_json"))
    elements = F.try_variant_get("_json", "$", "array<variant>")

    def field(name, kind):
        return F.try_variant_get(F.col("_e"), f"$.{name}", kind)

    entries = parsed.select("batch_id", F.posexplode(elements).alias("_at", "_e")).select(
        "batch_id",
        "_at",
        field("index", "int").alias("entry_index"),
        field("final_verdict", "string").alias("final_verdict"),
        field("reasoning", "string").alias("reasoning"),
        field("citations", "array<string>").alias("citations"),
    )
    value = F.struct("final_verdict", "reasoning", "citations")
    return (
        entries.filter("entry_index is not null")
        .groupBy("batch_id", "entry_index")
        .agg(F.max_by(value, "_at").alias("_v"))
        .select("batch_id", "entry_index", "_v.*")
    )


def readable_answers(answers: DataFrame, answer: str = "response") -> DataFrame:
    """``(batch_id, readable)``: 1 where the answer holds a JSON array."""
    body = batch_array_text(F.col(answer))
    array = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    return answers.select("batch_id", array.isNotNull().cast("int").alias("readable"))


def batch_verdicts(
    statements: DataFrame, answers: DataFrame, answer: str = "response"
) -> DataFrame:
    """The statements with verdict, analysis and citations from the answers of their batch.

    ``statements`` carries ``batch_id`` and ``batch_index``. A missing or unknown verdict is
    flagged for review, and so is every statement of an unreadable answer.
    """
    entries = answer_entries(answers, answer).withColumnRenamed("entry_index", "batch_index")
    joined = statements.join(readable_answers(answers, answer), "batch_id", "left").join(
        entries, ["batch_id", "batch_index"], "left"
    )
    known = F.col("final_verdict").isin(*VERDICTS)
    readable = F.coalesce(F.col("readable"), F.lit(0)) == 1
    return joined.select(
        *[quoted(c) for c in statements.columns],
        F.when(readable & known, F.col("final_verdict")).otherwise(REVIEW).alias("verdict"),
        F.when(readable, strip(F.coalesce("reasoning", F.lit(""))))
        .otherwise(UNREADABLE)
        .alias("analysis"),
        F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
    )


def verdict_summary(verdicts: DataFrame, verdict: str = "verdict") -> DataFrame:
    """``(batch_id, verdict, n)`` per batch, and in total where ``batch_id`` is NULL."""
    both = F.array(F.col("batch_id").cast("long"), F.lit(None).cast("long"))
    return (
        verdicts.select(F.explode(both).alias("batch_id"), quoted(verdict).alias("verdict"))
        .groupBy("batch_id", "verdict")
        .agg(F.count("*").alias("n"))
    )


def _words_pattern(words: Sequence[str]) -> str:
    parts = [w[:-1] + "[a-z]*" if w.endswith("*") else w for w in words]
    return r"\b(" + "|".join(parts) + r")\b"


def _contains_pattern(words: Sequence[str]) -> str:
    return "|".join(w.rstrip("*") for w in words)


def map_verdict(verdict: Column, legacy: bool = False) -> Column:
    """positive, negative, abstain or unmapped.

    Whole words decide, and doubt comes first: abstain, negative, positive. ``legacy`` looks for
    the words anywhere, positive first, which reads "incorrect" as positive; it is what the
    published figures were made with.
    """
    text = F.lower(verdict.cast("string"))
    if legacy:
        order = (("positive", POSITIVE_WORDS), ("negative", NEGATIVE_WORDS), ("abstain", ABSTAIN_WORDS))
        make = _contains_pattern
    else:
        order = (("abstain", ABSTAIN_WORDS), ("negative", NEGATIVE_WORDS), ("positive", POSITIVE_WORDS))
        make = _words_pattern
    out = F.lit("unmapped")
    for name, words in reversed(order):
        out = F.when(text.rlike(make(words)), name).otherwise(out)
    return F.when(text.isNull(), "unmapped").otherwise(out)


def evaluate_verdicts(
    verdicts: DataFrame, verdict: str = "verdict", truth: str | None = None, legacy: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and rates, strict and without the abstained statements.

    Strictly, everything but a positive verdict is a negative prediction. ``truth`` names a 0/1
    column; without it every statement is taken to be true.
    """
    mapped = verdicts.withColumn("_m", map_verdict(quoted(verdict), legacy)).withColumn(
        "_t", F.lit(True) if truth is None else quoted(truth) == 1
    )
    m, t = F.col("_m"), F.col("_t")
    positive = m == "positive"
    covered = m != "abstain"
    sums = mapped.groupBy(*by).agg(
        F.count("*").alias("n"),
        count_where(positive & t).alias("tp"),
        count_where(~positive & t).alias("fn"),
        count_where(positive & ~t).alias("fp"),
        count_where(~positive & ~t).alias("tn"),
        count_where(m == "abstain").alias("abstained"),
        count_where(m == "negative").alias("negatives"),
        count_where(m == "unmapped").alias("unmapped"),
        count_where(covered & ~positive & t).alias("covered_fn"),
        count_where(covered & ~positive & ~t).alias("covered_tn"),
    )
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    cfn, ctn = F.col("covered_fn"), F.col("covered_tn")
    return sums.select(
        *by,
        "n", "tp", "fn", "fp", "tn",
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(n - F.col("abstained"), n).alias("coverage"),
        ratio(F.col("abstained"), n).alias("abstain_rate"),
        ratio(F.col("negatives"), n).alias("negative_rate"),
        ratio(F.col("unmapped"), n).alias("unmapped_rate"),
        (n - F.col("abstained")).alias("covered"),
        ratio(tp + ctn, n - F.col("abstained")).alias("covered_accuracy"),
        ratio(tp, tp + fp).alias("covered_precision"),
        ratio(tp, tp + cfn).alias("covered_recall"),
        ratio(2 * tp, 2 * tp + fp + cfn).alias("covered_f1"),
    )


