"""Views the queries share, as DataFrames and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round the double columns, so that the order of a sum does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), special.get(n, places)).alias(n)
            if t in ("double", "float")
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def r6(expression: str, places: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {places})"


def union_all(parts) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- predictions


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_quantity") / 50.0
    return li.select(
        *LINE_KEY,
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("y_pred"),
        F.col("l_linestatus").alias("a1"),
        F.year("l_shipdate").cast("string").alias("a2"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("a3"),
        "l_quantity", "l_discount", "l_tax", "l_returnflag",
    )


PREDS = """preds AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
    l_quantity / 50e0 AS score,
    CAST(l_quantity / 50e0 >= 5e-1 AS INTEGER) AS y_pred,
    l_linestatus AS a1, CAST(year(l_shipdate) AS VARCHAR) AS a2,
    CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS a3,
    l_quantity, l_discount, l_tax, l_returnflag
  FROM lineitem)"""


def preds_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").drop("text")
    score = F.least(F.col("n_chars") / 4000.0, F.lit(1.0))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("y_true"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("y_pred"),
        "lang",
        "source",
    )


PREDS_DOCS = """preds_docs AS (
  SELECT d.doc_id, quality AS y_true, least(n_chars / 4000e0, 1e0) AS score,
    CAST(least(n_chars / 4000e0, 1e0) >= 5e-1 AS INTEGER) AS y_pred, lang, source
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# ---------------------------------------------------------------- a table with defects


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.when(line != 7, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_suppkey") == 0, price * 10).otherwise(price).alias("l_extendedprice"),
        F.when(line != 3, F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(line != 5, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        F.lit("same").alias("fixed"),
    )


DIRTY = """dirty AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity,
    CASE WHEN l_suppkey = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount,
    l_tax,
    CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag,
    l_linestatus, 'same' AS fixed
  FROM lineitem)"""

DIRTY_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "fixed",
]
DIRTY_NUMBERS = DIRTY_COLUMNS[:8]
DIRTY_TEXT = DIRTY_COLUMNS[8:]


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("term"),
        "c_mktsegment",
    )


BALANCES = """balances AS (
  SELECT c_custkey, c_acctbal AS balance, c_nationkey AS term, c_mktsegment FROM customer)"""


# ---------------------------------------------------------------- strings of many kinds


def strs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    cust, price = F.col("o_custkey").cast("string"), F.col("o_totalprice")
    sign = F.when(k % 4 == 0, ".").otherwise("@")
    shape = F.when(k % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(
        k % 3 == 1, F.date_format(day, "yyyy-MM-dd")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("user"), cust, sign, F.lit("mail.com")).alias("email"),
        F.when(k % 10 == 3, "2023-02-30").otherwise(F.date_format(day, "yyyy-MM-dd")).alias(
            "date_iso"
        ),
        shape.otherwise(F.date_format(day, "yyyy/MM/dd")).alias("date_mixed"),
        F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("price"),
        F.concat((k % 100).cast("string"), F.lit(".5%")).alias("share"),
        F.when(k % 2 == 0, "yes").otherwise("No").alias("flag"),
        F.concat(F.lit("https://shop.example.com/o/"), k.cast("string"), F.lit("?p=1")).alias(
            "link"
        ),
        (k % 1000).cast("string").alias("code"),
        F.when(k % 5 < 2, F.concat(F.lit("+1555"), F.lpad(cust, 7, "0")))
        .otherwise(F.concat(F.lit("call "), cust))
        .alias("phone"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), k.cast("string")).alias("note"),
        F.when(k % 8 == 0, F.lit(None)).otherwise((k + 10000).cast("string")).alias("whole"),
        F.concat((k + 10000).cast("string"), F.lit(".125")).alias("fraction"),
        F.lit(None).cast("string").alias("nothing"),
        (k % 160 - 3).cast("double").alias("age"),
        ((k % 230) / 2.0).alias("score"),
        ((k % 210) / 2.0).alias("percent_done"),
    )


STRS = """strs AS (
  SELECT o_orderkey,
    'user' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN '.' ELSE '@' END
      || 'mail.com' AS email,
    CASE WHEN o_orderkey % 10 = 3 THEN '2023-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END
      AS date_iso,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE strftime(o_orderdate, '%Y/%m/%d') END AS date_mixed,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
    '$' || format('{:,.2f}', o_totalprice) AS price,
    CAST(o_orderkey % 100 AS VARCHAR) || '.5%' AS share,
    CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'No' END AS flag,
    'https://shop.example.com/o/' || CAST(o_orderkey AS VARCHAR) || '?p=1' AS link,
    CAST(o_orderkey % 1000 AS VARCHAR) AS code,
    CASE WHEN o_orderkey % 5 < 2 THEN '+1555' || lpad(CAST(o_custkey AS VARCHAR), 7, '0')
      ELSE 'call ' || CAST(o_custkey AS VARCHAR) END AS phone,
    o_orderstatus AS status,
    o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS note,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey + 10000 AS VARCHAR) END AS whole,
    CAST(o_orderkey + 10000 AS VARCHAR) || '.125' AS fraction,
    CAST(NULL AS VARCHAR) AS nothing,
    CAST(o_orderkey % 160 - 3 AS DOUBLE) AS age,
    (o_orderkey % 230) / 2e0 AS score,
    (o_orderkey % 210) / 2e0 AS percent_done
  FROM orders)"""

STR_COLUMNS = [
    "email", "date_iso", "date_mixed", "stamp", "price", "share", "flag", "link", "code",
    "phone", "status", "note", "whole", "fraction", "nothing",
]


# ---------------------------------------------------------------- groups and benchmark


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two attributes; the segment of every ninth is unknown."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("segment"),
        F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")).alias("area"),
        F.when(F.col("c_acctbal") < 0, "overdrawn").otherwise("funded").alias("standing"),
    )


PEOPLE = """people AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment,
    'R' || CAST(c_nationkey % 5 AS VARCHAR) AS area,
    CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE 'funded' END AS standing
  FROM customer)"""

PEOPLE_ATTRIBUTES = ["segment", "area", "standing"]

#: Expected shares; one expected group does not occur, and one observed group is not listed.
BENCHMARK = {
    "segment": {
        "AUTOMOBILE": 0.35, "BUILDING": 0.20, "FURNITURE": 0.15, "MACHINERY": 0.12,
        "AEROSPACE": 0.18,
    },
    "standing": {"funded": 0.7, "overdrawn": 0.3},
}

BENCH = "bench(attribute, grp, expected_share) AS (VALUES " + ", ".join(
    f"('{a}', '{g}', CAST({p!r} AS DOUBLE))" for a, gs in BENCHMARK.items() for g, p in gs.items()
) + ")"

PEOPLE_COUNTS = (
    "counts AS ("
    + union_all(
        f"SELECT '{a}' AS attribute, {a} AS grp, CAST(count(*) AS BIGINT) AS n FROM people GROUP BY ALL"
        for a in PEOPLE_ATTRIBUTES
    )
    + ")"
)
SHARES = """shares AS (
  SELECT attribute, grp, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY attribute) AS share
  FROM counts WHERE grp IS NOT NULL)"""
