"""Chunking, cleaning and statement extraction as column expressions over a text table."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import let

# Chunk sizes, statement limits and the words that make a statement testable.
CHUNK_WORDS, CHUNK_OVERLAP, CHUNK_MIN_CHARS = 500, 50, 50
PARAGRAPH_TARGET, PARAGRAPH_MIN, PARAGRAPH_SLACK = 512, 120, 1.2
#: Paragraphs whose chunk borders are gathered together.
PARAGRAPH_BLOCK = 256
_BORDERS = "array<struct<first:int,end:int,long:boolean>>"
STATEMENT_MIN_CHARS, ASSERTION_CHARS, STATEMENTS_PER_TEXT = 20, 100, 50
TESTABLE_WORDS = (
    "is", "are", "was", "were", "has", "have", "had",
    "contains", "consists", "includes", "comprises",
    "found", "discovered", "identified", "observed",
    "shows", "demonstrates", "indicates", "suggests",
    "causes", "leads", "results", "produces",
    "percentage", "percent", "number", "amount",
    "size", "diameter", "length", "width", "height",
)
# Page furniture to remove, ignoring case, the dot matching line ends.
FURNITURE = (
    r"!\[Image[^\]]*\]\([^)]*\)",
    r"https?://[^\s\)]+",
    r"www\.[^\s\)]+",
    r"<[^>]+>",
    r"Skip to main content",
    r"NCBI Homepage.*?MyNCBI Homepage.*?Main Content.*?Main Navigation",
    r"\[Log in\].*?Log out.*?",
    r"References.*?",
    r"Copyright.*?Bookshelf ID:.*?",
    r"View on publisher site.*?Download PDF.*?Add to Collections.*?Cite.*?Permalink.*?",
    r"Back to Top.*?",
    r"Follow NCBI.*?",
    r"Add to Collections.*?",
    r"Cite.*?",
)
# Texts that stand for "nothing was found".
EMPTY_CONTENT = ("No content found in response", "No content found in extracted result")
EMPTY_RAW = ("No content available", "No URLs found to extract content from")
SEGMENT_MARK = "\n\n---\n\n"


# Fixed value: white space of any script, as inclusive ranges of code points.
WHITE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
_WHITE = "".join(chr(c) for a, b in WHITE_RANGES for c in range(a, b + 1))
#: A character class for the same.
WHITE_CLASS = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in WHITE_RANGES) + "]"


def strip(c: Column) -> Column:
    """Remove white space of any script, line ends included, from both ends."""
    return F.trim(c, F.lit(_WHITE))


def words(text: Column) -> Column:
    """The words of a text; none for a blank one."""
    # One blank for each white space first: texts are then split at a plain character.
    blanks = F.translate(text, _WHITE, " " * len(_WHITE))
    return F.filter(F.split(blanks, " +"), lambda w: w != "")


def word_chunks(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    size: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(key…, keep…, pos, text)``: overlapping windows of words, short ones dropped.

    A text is cut inside its own row, so chunks come without a shuffle.
    """
    stride = size - overlap

    def pieces(w):
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(stride))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
        return F.when(F.size(w) > 0, cut)

    return (
        df.select(
            *key, *keep, F.posexplode(let(words(F.col(text)), pieces)).alias("pos", "text")
        )
        .filter(F.length("text") > CHUNK_MIN_CHARS)
    )


def paragraph_chunks_of(
    text: Column, target: int = PARAGRAPH_TARGET, minimum: int = PARAGRAPH_MIN
) -> Column:
    """Chunks of about ``target`` words that respect paragraphs, as an array of texts.

    Paragraphs are packed greedily; one that is much longer than the target is cut by itself.
    Pieces under ``minimum`` words are dropped.

    The packing only carries numbers: the chunk's first paragraph and its words so far. Borders are
    gathered in blocks of ``PARAGRAPH_BLOCK`` paragraphs, so that no long array is copied at each
    step, and the words are put together once the borders are known.
    """
    paragraphs = F.filter(
        F.transform(F.split(text, r"\n{2,}"), lambda p: words(p)), lambda w: F.size(w) > 0
    )
    none = F.array().cast(_BORDERS)

    def border(first, end, long):
        return F.struct(first.alias("first"), end.alias("end"), F.lit(long).alias("long"))

    def state(cuts, first, held):
        return F.struct(cuts.alias("cuts"), first.alias("first"), held.alias("held"))

    def step(at, p):
        cuts, held = at["cuts"], at["held"]
        closed = F.when(
            held > 0, F.array_append(cuts, border(at["first"], p["i"], False))
        ).otherwise(cuts)
        alone = F.array_append(closed, border(p["i"], p["i"] + 1, True))
        return (
            F.when(
                p["n"] >= F.lit(target * PARAGRAPH_SLACK),
                state(alone, p["i"] + 1, F.lit(0)),
            )
            .when(
                held + p["n"] <= target, state(cuts, at["first"], held + p["n"])
            )
            .otherwise(state(closed, p["i"], p["n"]))
        )

    def part(values, first, end):
        """Elements one by one: ``slice`` would copy the whole array each time."""
        return F.transform(F.sequence(first, end - 1), lambda i: F.get(values, i))

    def borders(sizes):
        # The state is copied at each step, so a block's steps don't see the earlier borders.
        def block(at, lo):
            within = F.aggregate(
                part(sizes, lo, F.least(lo + PARAGRAPH_BLOCK, F.size(sizes))),
                state(none, at["first"], at["held"]), step,
            )
            return let(
                within, lambda s: state(F.concat(at["cuts"], s["cuts"]), s["first"], s["held"])
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(PARAGRAPH_BLOCK)),
            state(none, F.lit(0), F.lit(0)), block,
            lambda s: F.when(
                s["held"] > 0,
                F.array_append(s["cuts"], border(s["first"], F.size(sizes), False)),
            ).otherwise(s["cuts"]),
        )

    def piece(w):
        whole = F.array(F.array_join(w, " "))
        return F.when(F.size(w) >= minimum, whole).otherwise(F.array().cast("array<string>"))

    def pieces(packed, c):
        held = F.flatten(part(packed, c["first"], c["end"]))
        starts = lambda w: F.sequence(F.lit(0), F.size(w) - 1, F.lit(target))
        return let(
            held,
            lambda w: F.when(
                c["long"],
                F.flatten(
                    F.transform(
                        starts(w),
                        lambda i: let(part(w, i, F.least(i + target, F.size(w))), piece),
                    )
                ),
            ).otherwise(piece(w)),
        )

    def chunks(packed):
        sizes = F.transform(
            packed, lambda w, i: F.struct(i.alias("i"), F.size(w).alias("n"))
        )
        cut = F.flatten(F.transform(let(sizes, borders), lambda c: pieces(packed, c)))
        return F.when(F.size(packed) > 0, cut)

    return let(paragraphs, chunks)


def paragraph_chunks(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    target: int = PARAGRAPH_TARGET,
    minimum: int = PARAGRAPH_MIN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(key…, keep…, pos, text)``: paragraph-aware chunks, one row each."""
    pieces = paragraph_chunks_of(F.col(text), target, minimum)
    return df.select(*key, *keep, F.posexplode(pieces).alias("pos", "text"))


def clean_content(text: Column) -> Column:
    """Remove page furniture, unwrap links and squeeze white space; NULL and sentinels give ''."""
    out = text
    for pattern in FURNITURE:
        out = F.regexp_replace(out, "(?is)" + pattern, "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"\n+", "\n")
    out = F.regexp_replace(out, " +", " ")
    out = F.regexp_replace(out, r"\n\s*\n", "\n\n")
    out = F.regexp_replace(out, r"(?md)^\s*$\n", "")
    return F.when(text.isNull() | text.isin(*EMPTY_CONTENT), "").otherwise(strip(out))


def knowledge_base(df: DataFrame, key: Sequence[str], raw: str = "raw_content") -> DataFrame:
    """``(key…, text)`` of the documents that hold usable content, cleaned.

    The rows stay a table; they are never joined into one string.
    """
    usable = F.col(raw).isNotNull() & ~F.col(raw).isin(*EMPTY_RAW)
    return (
        df.filter(usable).select(*key, clean_content(F.col(raw)).alias("text")).filter("text <> ''")
    )


def document_entries_of(listing: Column) -> Column:
    """``array<struct<title, url>>`` from lines like ``1. Title - http…``.

    The last `` - `` of a line separates title and address; lines without a web address drop out.
    """
    lines = F.transform(
        F.split(listing, r"\r\n|\r|\n"),
        lambda line: F.regexp_replace(strip(line), r"^[0-9]+\.\s*", ""),
    )

    def entry(line):
        title = F.regexp_extract(line, r"(?s)^(.*) - (.*)$", 1)
        url = strip(F.regexp_extract(line, r"(?s)^(.*) - (.*)$", 2))
        name = strip(title)
        return F.struct(
            F.when(name == "", "Untitled").otherwise(name).alias("title"), url.alias("url")
        )

    return F.filter(F.transform(lines, entry), lambda e: e["url"].startswith("http"))


def document_entries(df: DataFrame, key: Sequence[str], listing: str = "relevant_docs") -> DataFrame:
    """``(key…, pos, title, url)``: the listed documents, one row each."""
    return df.select(
        *key, F.posexplode(document_entries_of(F.col(listing))).alias("pos", "_e")
    ).select(*key, "pos", "_e.title", "_e.url")


def knowledge_blocks(
    df: DataFrame,
    key: Sequence[str],
    listing: str = "relevant_docs",
    raw: str = "raw_content",
) -> DataFrame:
    """``(key…, pos, text, source_title, source_url)``.

    The segments of the raw content are matched by position with the listed documents, up to the
    shorter of the two, and cleaned.
    """
    segments = F.split(F.col(raw), SEGMENT_MARK)
    entries = document_entries_of(F.col(listing))
    usable = (
        F.col(raw).isNotNull()
        & (F.col(raw) != "")
        & ~F.col(raw).isin(*EMPTY_RAW)
        & F.col(listing).isNotNull()
    )
    zipped = (
        df.filter(usable)
        .select(*key, segments.alias("_s"), entries.alias("_d"))
        .select(*key, F.posexplode(F.arrays_zip("_s", "_d")).alias("pos", "_z"), F.size("_s").alias("_ns"), F.size("_d").alias("_nd"))
        .filter(F.col("pos") < F.least("_ns", "_nd"))
    )
    return zipped.select(
        *key,
        "pos",
        clean_content(F.col("_z._s")).alias("text"),
        F.col("_z._d.title").alias("source_title"),
        F.col("_z._d.url").alias("source_url"),
    ).filter("text <> ''")


def format_documents(documents: Column) -> Column:
    """Numbered ``n. title - address`` lines from ``array<struct<title, url>>``."""
    return F.array_join(
        F.transform(
            documents,
            lambda d, i: F.concat(
                (i + 1).cast("string"), F.lit(". "), F.coalesce(d["title"], F.lit("No title")),
                F.lit(" - "), F.coalesce(d["url"], F.lit("No URL")),
            ),
        ),
        "\n",
    )


def statements(
    df: DataFrame,
    key: Sequence[str],
    text: str = "text",
    per_text: int | None = None,
) -> DataFrame:
    """``(key…, sentence_number, original_statement, is_testable, optimized_assertion)``.

    A sentence counts from more than 20 characters, and is testable if it mentions one of the
    keywords anywhere. All sentences of a text are kept; ``per_text`` keeps its first so many
    (``STATEMENTS_PER_TEXT`` is the customary number).
    """
    sentences = F.filter(
        F.transform(F.split(F.col(text), "[.!?]+"), strip),
        lambda s: F.length(s) > STATEMENT_MIN_CHARS,
    )
    if per_text is not None:
        sentences = F.slice(sentences, 1, per_text)
    s = F.col("original_statement")
    lowered = F.lower(s)
    testable = reduce(lambda a, b: a | b, [lowered.contains(w) for w in TESTABLE_WORDS])
    return df.select(*key, F.posexplode(sentences).alias("_at", "original_statement")).select(
        *key,
        (F.col("_at") + 1).alias("sentence_number"),
        "original_statement",
        testable.cast("int").alias("is_testable"),
        F.when(
            F.length(s) > ASSERTION_CHARS,
            F.concat(F.substring(s, 1, ASSERTION_CHARS), F.lit("...")),
        )
        .otherwise(s)
        .alias("optimized_assertion"),
    )


def testable_statements(extracted: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key…, statement, assertion)`` of the testable statements."""
    return extracted.filter("is_testable = 1").select(
        *key,
        F.col("original_statement").alias("statement"),
        F.col("optimized_assertion").alias("assertion"),
    )


def title_from_file(name: Column) -> Column:
    """Title of a chapter: its file name without folder and ending, underscores as spaces."""
    base = F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.translate(F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), "_", " ")
