"""Near-duplicate documents by SimHash and BK-trees.

``fingerprints`` gives every whole text a 64-bit SimHash of its word shingles, ``groups`` links
fingerprints that differ in at most ``radius`` bits and returns the group of every document.

How links are found. Equal fingerprints are one node first, so copies cost nothing more. Two
fingerprints within ``radius`` bits agree on at least ``BLOCKS - radius`` of ``BLOCKS`` blocks of
bits; for every choice of that many blocks, fingerprints that agree on them form a shard. A shard
is a BK-tree, and every one of its fingerprints is looked up in it, following only the edges within
the radius. All fingerprints of a shard share 42 bits or more (radius 2), so a shard has at most
2**22 of them, whatever the corpus holds. Trees are sent to no one: together they grow with the
corpus and could not be broadcast within any bound. Each shard reports its connected groups as
links to one member, so a dense shard yields a link for each member, not for each pair; the
groups of all shards are then joined as connected components.

Nulls, ties, repeats: a null text is an empty one (fingerprint zero); texts with fewer words than
a shingle are one shingle; a bit set in exactly half of the shingles is 0; rows with the same id
are rows of their own with that id; null ids are never the smallest id of a group that has others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .base import batch_of, null_safe, stored, utf8
from .bktree import BKTree, Sets
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
#: Blocks beyond the radius, which all have to agree.
AGREEING = 4
#: Shingles whose bits are counted at a time.
STRIP = 1 << 16


def simhash(text: str | None, words_of_shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = utf8(text).lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = words_of_shingle
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(b" ".join(words), seed)
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, STRIP):
        part = words[lo : lo + STRIP + k - 1]
        hashes = np.array(
            [digest(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(k)))],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint of each row as a signed 64-bit number, and a
    hash of the text that tells rows with the same id apart."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    ids = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.as_py(), shingle_words) for t in batch.column(1)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), fp], names=["doc_id", "text_hash", "fp"]
            )

    return slim.mapInArrow(run, f"doc_id {ids}, text_hash long, fp long")


def block_masks(radius: int, agreeing: int = AGREEING) -> list[int]:
    """Masks of which any two fingerprints within the radius agree on at least one."""
    blocks = radius + agreeing
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, agreeing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links from each member of a shard to one member of its group, by way of a BK-tree."""
    tree, sets = BKTree(), Sets()
    for value in members:
        near = tree.within(value, radius)
        at = tree.add(value)
        sets.grow(at + 1)
        for other in near:
            sets.join(at, other)
    roots = (sets.root(i) for i in range(len(tree.values)))
    return [(tree.values[r], tree.values[i]) for i, r in enumerate(roots) if r != i]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: fingerprints of the same group; the links of all shards connect each group.

    ``distinct`` (fp) must hold every fingerprint once.
    """
    shards = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("shard"),
                    F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"),
                )
                for i, m in enumerate(block_masks(radius))
            ]
        )
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            shard, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.flatnonzero((shard[1:] != shard[:-1]) | (value[1:] != value[:-1])) + 1
            starts = [0, *new.tolist(), len(fp)]
            found: list[tuple[int, int]] = []
            for lo, hi in zip(starts, starts[1:]):
                if lo == hi:
                    continue
                if (shard[lo], value[lo]) != key:
                    if len(members) > 1:
                        found += shard_links(members, radius)
                    key, members = (shard[lo], value[lo]), []
                members += fp[lo:hi].view(np.uint64).tolist()
            yield _edges(found)
        if len(members) > 1:
            yield _edges(shard_links(members, radius))

    def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
        return batch_of(schema, a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))

    return (
        distinct.select(shards.alias("_s"), "fp")
        .select("_s.shard", "_s.value", "fp")
        .repartition("shard", "value")
        .sortWithinPartitions("shard", "value", "fp")
        .mapInArrow(run, "a long, b long")
    )


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, text_hash, fp) with ``group``, the smallest fingerprint of the group,
    and ``component_id``, the smallest doc_id that links lead to."""
    prints = stored(prints.select("doc_id", "text_hash", "fp"), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    members = connected_components(links(nodes.select("fp"), radius))
    # Only nodes with links are in `members`; the others are groups of their own.
    of_group = (
        members.join(nodes, members["node"] == nodes["fp"])
        .groupBy("component")
        .agg(F.min("first").alias("_least"))
    )
    least = members.join(of_group, "component").select(
        F.col("node").alias("fp"), "component", "_least"
    )
    smallest = nodes.join(least, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("group"),
        F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("_least"))
        .alias("component_id"),
    )
    # Stored, so that the join has two plain sides, and a fingerprint of very many copies is cut
    # into several tasks.
    smallest = stored(smallest, "smallest")
    return prints.join(smallest, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, fp, group, component_id)`` for every row of the table."""
    return groups(fingerprints(docs, shingle_words, id_col, text_col), radius)


def deduplicate(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """The table with one row of each group: the one with the smallest id (of several rows with
    that id, the smallest text hash). All columns stay."""
    chosen = (
        near_duplicates(docs, shingle_words, radius)
        .groupBy("group")
        .agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "text_hash")).alias("_row"))
        .select(F.col("_row.doc_id").alias("_id"), F.col("_row.text_hash").alias("_hash"))
    )
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = hashed.join(
        chosen, null_safe(hashed, chosen, {"doc_id": "_id", "_text_hash": "_hash"}), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
