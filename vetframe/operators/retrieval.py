"""TF-IDF index over text chunks and batch retrieval of evidence.

The index is four tables: ``chunks``, ``postings (chunk_id, term, weight)``, ``terms (term,
chunk_frequency, idf)`` and ``bounds (term, max_weight)``. Tokens are spread by chunk, so counting terms,
weighting and normalising a chunk all happen where its text already is.

A query batch is matched by term, and exactly, without scoring every chunk that shares a term. A term
adds at most its query weight times its largest weight to a similarity. Sums over the two strongest
terms of a query give a similarity that its k-th best chunk reaches for certain. A query's weakest terms, as
long as all of them together stay below that, can't bring a chunk among the best by themselves: their
postings, the longest ones, are not read for candidates. Of the others' sums, only those that could
still get there are completed with the weak terms.

A batch that meets each posting only a few times needs none of this: it is scored where the texts are cut, chunk
by chunk, and postings are neither stored nor shuffled. An index is stored only if it is read more than once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import let
from ..functions.ordering import broadcast_if_small, lookup, settle
from .stopwords import ENGLISH

# Vocabulary size, results per query, smallest similarity, the answer without any.
MAX_TERMS, TOP_K, MIN_SIMILARITY, TOP_DOCUMENTS = 5000, 3, 0.1, 2
NOTHING_FOUND = "No relevant information found in knowledge base."
#: A word is two or more letters, digits or underscores of any script.
TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Query terms up to this many are broadcast; larger batches are joined by salted shuffle.
BROADCAST_ROWS = 1_000_000
#: Postings of a term that meet the queries in one task.
SALT_ROWS = 100_000
#: Strongest terms of a query whose sums say what its best chunks reach at least.
SEED_TERMS = 2
#: More than rounding can move a similarity.
ROUNDING = 1e-6
#: Characters of the texts whose terms are counted in one task.
TASK_CHARS = 4_000_000
#: A batch that meets a posting at most so many times on average is scored in one pass over the texts.
ONE_PASS = 64


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    bounds: DataFrame
    #: Are postings computed from the texts at each reading? They are then placed by chunk.
    computed: bool = False

    def stored(self) -> Index:
        """The same with postings that can be read again."""
        if not self.computed:
            return self
        postings = settle(self.postings)
        return Index(self.chunks, postings, self.terms, _bounds(postings))

    def save(self, path: str) -> None:
        """Write the tables under a folder; postings by term, so that a query batch skips those of others."""
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        by_term = self.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term")
        by_term.write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        bounds = self.bounds
        if self.computed:
            bounds = _bounds(self.postings.sparkSession.read.parquet(f"{path}/postings"))
        bounds.write.mode("overwrite").parquet(f"{path}/bounds")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(
            *[spark.read.parquet(f"{path}/{t}") for t in ("chunks", "postings", "terms", "bounds")]
        )


def _bounds(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.max("weight").alias("max_weight"))


def index_terms(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-cased words in order, without the stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN))
    return F.filter(tokens, lambda t: ~t.isin(*stop_words)) if stop_words else tokens


def _with_pairs(words: Column) -> Column:
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(F.array(F.lit(None).cast("string")), words, pairs)


def term_counts(
    df: DataFrame, key: str, text: str = "text", stop_words: Sequence[str] = ENGLISH,
    terms: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """``(key, term, tf)`` with single words and neighbouring pairs; of the given ``terms`` only, if any.

    Without ``terms`` every text also has one row with a NULL term, so that texts without terms are still counted.

    The text is shuffled by key before it is exploded into terms, several times its size; counting
    and all later work per key then needs no further shuffle. ``parts`` bounds what a task counts.
    """
    placed = df.select(key, text)
    placed = placed.repartition(parts, F.col(key)) if parts else placed.repartition(key)
    tokens = placed.select(key, index_terms(F.col(text), stop_words).alias("_w"))
    exploded = tokens.select(key, F.explode(let(F.col("_w"), _with_pairs)).alias("term"))
    if terms is not None:
        exploded = exploded.join(broadcast_if_small(terms.select("term")), "term", "left_semi")
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"))


def frequent_terms(
    df: DataFrame, text: str = "text", max_terms: int = MAX_TERMS, stop_words: Sequence[str] = ENGLISH
) -> DataFrame:
    """``(term, corpus_frequency)`` of the most frequent terms, at most ``max_terms`` rows.

    A pair is no more frequent than either of its words. Words are counted first; pairs with a word that is
    rarer than the last of the ``max_terms`` most frequent words can't be among the terms and are not counted.
    """
    tokens = df.select(index_terms(F.col(text), stop_words).alias("_w"))
    frequency = F.count("*").alias("corpus_frequency")
    by_frequency = [F.col("corpus_frequency").desc(), F.col("term")]
    words = settle(tokens.select(F.explode("_w").alias("term")).groupBy("term").agg(frequency))
    best = words.orderBy(*by_frequency).limit(max_terms)
    reached = best.agg(
        F.when(F.count("*") == max_terms, F.min("corpus_frequency")).alias("least")
    ).first()["least"] or 1
    able = words.filter(F.col("corpus_frequency") >= reached)
    neighbours = F.zip_with(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))),
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("_a"), b.alias("_b")),
    )
    pairs = tokens.select(F.inline(neighbours))
    if reached > 1:
        known = broadcast_if_small(able.select("term"))
        for side in ("_a", "_b"):
            pairs = pairs.join(known.withColumnRenamed("term", side), side, "left_semi")
    pairs = pairs.groupBy(F.concat("_a", F.lit(" "), "_b").alias("term")).agg(frequency)
    return settle(able.unionByName(pairs).orderBy(*by_frequency).limit(max_terms))


def vocabulary(counts: DataFrame, frequent: DataFrame, chunks: int) -> DataFrame:
    """The frequent terms with chunk frequency and smoothed idf, from the counts ``(key, term, tf)``."""
    found = counts.groupBy("term").agg(F.count("*").alias("chunk_frequency"))
    return frequent.join(found, "term").select(
        "term",
        "corpus_frequency",
        "chunk_frequency",
        (F.ln((1 + F.lit(chunks)) / (1 + F.col("chunk_frequency")).cast("double")) + 1).alias("idf"),
    )


def weighted(counts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """``(key, term, weight)``: tf·idf over the vocabulary, scaled to unit length per key."""
    raw = counts.join(broadcast_if_small(terms.select("term", "idf")), "term").select(
        key, "term", (F.col("tf") * F.col("idf")).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("weight"))


def build_index(
    chunks: DataFrame, max_terms: int = MAX_TERMS, stop_words: Sequence[str] = ENGLISH
) -> Index:
    """Index chunks ``(chunk_id, text, …)``.

    The vocabulary, at most ``max_terms`` rows, is found first and broadcast; only its terms are then counted
    by chunk, in as many tasks as the texts are long. The chunks are settled, so that they are cut once;
    counts and postings are several times as large and are computed from them when they are read.
    """
    chunks = settle(chunks)
    texts = chunks.select("chunk_id", "text").filter("text IS NOT NULL")
    total = texts.select("chunk_id").distinct().count()
    length = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    frequent = frequent_terms(texts, "text", max_terms, stop_words)
    parts = 1 + length // TASK_CHARS
    counts = term_counts(texts, "chunk_id", "text", stop_words, frequent, parts)
    terms = settle(vocabulary(counts, frequent, total))
    postings = weighted(counts, "chunk_id", terms)
    return Index(chunks, postings, terms, _bounds(postings), computed=True)


def query_weights(
    queries: DataFrame, terms: DataFrame, stop_words: Sequence[str] = ENGLISH
) -> DataFrame:
    """``(query_id, term, weight)`` of queries ``(query_id, text)`` in the index's vocabulary."""
    return weighted(term_counts(queries, "query_id", "text", stop_words), "query_id", terms)


def _by_term(
    weights: DataFrame, postings: DataFrame, broadcast_rows: int = BROADCAST_ROWS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Postings joined with ``weights (term, …)`` of a query batch.

    The size of the query side is counted before it is broadcast. A larger batch is joined by
    (term, salt): a term has a salt for every ``salt_rows`` of its postings, so one that occurs in
    most chunks is spread over as many tasks as it needs, and a rare one is not copied.
    """
    if weights.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return postings.join(F.broadcast(weights), "term")
    sizes = lookup(
        postings.groupBy("term").agg(
            F.ceil(F.count("*") / F.lit(salt_rows)).cast("long").alias("_salts")
        )
    )
    salted = postings.join(sizes, "term").select(
        *postings.columns, F.pmod(F.xxhash64("chunk_id"), F.col("_salts")).alias("_salt")
    )
    copies = weights.join(sizes, "term").select(
        *weights.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt")
    )
    return salted.join(copies, ["term", "_salt"])


def _partial(
    weights: DataFrame, postings: DataFrame, broadcast_rows: int, keep: Sequence[str] = ()
) -> DataFrame:
    """``(query_id, chunk_id, keep…, _sum)``: sums over the given terms of the queries."""
    joined = _by_term(weights, postings, broadcast_rows)
    return joined.groupBy("query_id", "chunk_id", *keep).agg(F.sum(F.col("weight") * F.col("_qw")).alias("_sum"))


def _reached(sums: DataFrame, top_k: int) -> DataFrame:
    """``(query_id, _reached)``: what ``top_k`` chunks of a query have at least, if so many are known."""
    by_sum = Window.partitionBy("query_id").orderBy(F.col("_sum").desc())
    best = sums.withColumn("_n", F.row_number().over(by_sum)).filter(F.col("_n") <= top_k)
    return best.groupBy("query_id").agg(F.when(F.count("*") == top_k, F.min("_sum")).alias("_reached"))


def candidates(
    weights: DataFrame,
    index: Index,
    top_k: int | None = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The combinations of query and chunk that can be among the results, with the sum over the strong
    terms (``query_id, chunk_id, _sum``), and the weak terms ``(query_id, term, _qw)`` that are still to be added.

    All others have at most ``min_similarity``, or less than ``top_k`` chunks of the query reach.
    """
    at_most = F.col("_qw") * F.col("max_weight")
    bounded = weights.select("query_id", "term", F.col("weight").alias("_qw")).join(
        broadcast_if_small(index.bounds), "term"
    )
    strongest = Window.partitionBy("query_id").orderBy(at_most.desc(), "term")
    ranked = settle(
        bounded.select(
            "query_id", "term", "_qw", F.row_number().over(strongest).alias("_place"),
            # What this term and all weaker ones can add.
            F.sum(at_most).over(strongest.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
        )
    )
    needed = F.lit(min_similarity)
    if top_k is not None:
        seeds = ranked.filter(F.col("_place") <= SEED_TERMS).select("query_id", "term", "_qw")
        reached = _reached(_partial(seeds, index.postings, broadcast_rows), top_k)
        ranked = settle(ranked.join(reached, "query_id", "left"))
        needed = F.greatest(needed, F.coalesce("_reached", F.lit(0.0)))
    # Similarities are rounded to six digits before they are compared.
    weak = F.col("_rest") < needed - ROUNDING
    split = ranked.select("query_id", "term", "_qw", weak.alias("_weak"), "_rest", needed.alias("_needed"))
    beyond = split.filter("_weak").groupBy("query_id").agg(F.max("_rest").alias("_beyond"))
    strong = split.filter("NOT _weak").join(beyond, "query_id", "left").select(
        "query_id", "term", "_qw", "_needed", F.coalesce("_beyond", F.lit(0.0)).alias("_beyond")
    )
    found = _partial(settle(strong), index.postings, broadcast_rows, ["_needed", "_beyond"])
    needed = F.col("_needed")
    if top_k is not None:  # the sums over all strong terms say more than those of the strongest
        found = settle(found.filter(F.col("_sum") >= F.col("_needed") - F.col("_beyond") - ROUNDING))
        found = found.join(_reached(found, top_k), "query_id", "left")
        needed = F.greatest(needed, F.coalesce("_reached", F.lit(0.0)))
    kept = found.filter(F.col("_sum") >= needed - F.col("_beyond") - ROUNDING)
    return kept.select("query_id", "chunk_id", "_sum"), split.filter("_weak").select("query_id", "term", "_qw")


def _meets_few(weights: DataFrame, terms: DataFrame) -> bool:
    """Does the batch meet a posting at most ``ONE_PASS`` times on average?"""
    asked = weights.join(broadcast_if_small(terms), "term").agg(F.sum("chunk_frequency")).first()[0] or 0
    return asked <= ONE_PASS * (terms.agg(F.sum("chunk_frequency")).first()[0] or 0)


def similarities(
    weights: DataFrame,
    index: Index,
    top_k: int | None = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(query_id, chunk_id, similarity)`` of the combinations that can be among the results.

    A batch of few meetings is scored in one pass. Otherwise candidates are stored; their chunks' postings are read once more for the weak terms of the queries.
    """
    weights = settle(weights)
    if weights.limit(broadcast_rows + 1).count() <= broadcast_rows and _meets_few(weights, index.terms):
        query_side = F.broadcast(weights.select("query_id", "term", F.col("weight").alias("_qw")))
        sums = index.postings.join(query_side, "term").groupBy("query_id", "chunk_id").agg(
            F.round(F.sum(F.col("weight") * F.col("_qw")), 6).alias("similarity")
        )
        return sums.filter(F.col("similarity") > min_similarity)
    index = index.stored()
    found, weak = candidates(weights, index, top_k, min_similarity, broadcast_rows)
    found, weak = settle(found), settle(weak)
    pairs = found.select("query_id", "chunk_id")
    if pairs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        terms = broadcast_if_small(weak.select("term").distinct())
        met = (
            index.postings.join(terms, "term", "left_semi")
            .join(F.broadcast(pairs), "chunk_id")
            .join(broadcast_if_small(weak, broadcast_rows), ["query_id", "term"])
        )
    else:  # by term first: a chunk's candidates times all its weak terms would be many more rows
        met = _by_term(weak, index.postings, broadcast_rows).join(pairs, ["query_id", "chunk_id"])
    rest = met.select("query_id", "chunk_id", (F.col("weight") * F.col("_qw")).alias("_sum"))
    return found.unionByName(rest).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("_sum"), 6).alias("similarity")
    )


def retrieve(
    queries: DataFrame,
    index: Index,
    top_k: int = TOP_K,
    min_similarity: float = MIN_SIMILARITY,
    stop_words: Sequence[str] = ENGLISH,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(query_id, rank, chunk_id, similarity)``: the best chunks of every query in a batch."""
    weights = query_weights(queries, index.terms, stop_words)
    scored = similarities(weights, index, top_k, min_similarity, broadcast_rows)
    by_similarity = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(by_similarity))
        .filter(F.col("rank") <= top_k)
        .filter(F.col("similarity") > min_similarity)
        .select("query_id", "rank", "chunk_id", "similarity")
    )


def retrieve_with_sources(
    queries: DataFrame, index: Index, top_k: int = TOP_K, **options
) -> DataFrame:
    """Retrieved chunks with text, title and address; one fallback row for a query without any."""
    found = lookup(retrieve(queries, index, top_k, **options))
    sources = index.chunks.select("chunk_id", "text", "source_title", "source_url")
    located = sources.join(found, "chunk_id")
    return (
        queries.select("query_id")
        .join(located, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("rank", F.lit(1)).alias("rank"),
            "chunk_id",
            F.coalesce("text", F.lit(NOTHING_FOUND)).alias("text"),
            "source_title",
            "source_url",
            "similarity",
        )
    )


def evidence_documents(
    statements: DataFrame,
    index: Index,
    top: int = TOP_DOCUMENTS,
    min_similarity: float = MIN_SIMILARITY,
    stop_words: Sequence[str] = ENGLISH,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(query_id, rank, doc_id, similarity)``: the best distinct documents per statement.

    A document counts with its best chunk. ``chunks`` must carry ``doc_id``.
    """
    weights = query_weights(statements, index.terms, stop_words)
    scored = similarities(weights, index, None, min_similarity, broadcast_rows)
    documents = index.chunks.select("chunk_id", "doc_id")
    best = (
        scored.filter(F.col("similarity") > min_similarity)
        .join(documents, "chunk_id")
        .groupBy("query_id", "doc_id")
        .agg(F.max("similarity").alias("similarity"))
    )
    by_similarity = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "doc_id")
    return (
        best.withColumn("rank", F.row_number().over(by_similarity))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "doc_id", "similarity")
    )
