"""Exact deduplication by deterministic block naming.

Every text (UTF-8 bytes) is cut into fixed-size blocks.  Equal blocks get
one integer name: the distinct blocks are sorted, and a block's name is its
place in that order.  Adjacent names are then paired, the distinct pairs are
sorted and named in the same way, and so on until each document is one name.
A name at level L stands for exactly one sequence of blocks, so (level, name)
is an identity without collisions, and equal texts are those that share it.

The order that gives names is that of a pair of hashes: the hashes spread
blocks over the cluster, the full content decides equality.  ``distinct (hash,
block)`` is pre-aggregated and compares whole blocks, so content moves once
and every hash is proven to stand for one block; if one does not, the blocks are
hashed again with another seed.  From there on only integers are exchanged.
Hot names (a third of all rows alike) are pre-aggregated in the distinct steps,
and in the joins both sides are read from files, so adaptive execution splits
them.  The number of levels is log2 of the longest document's blocks.

Defined cases: null text equals empty text (one empty block); equal doc_ids
in a group are ordered by row number, so exactly one row of every group is
kept; a null doc_id counts as smaller than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, text_of, written

BLOCK_BYTES = 4096
HASH_BITS = (64,)                # of each half, by attempt; the last holds for all further ones
NO_NAME = -1                     # the missing right half of the last pair


def _block(data: Column, i: Column, size: int) -> Column:
    return F.substring(data, i * size + 1, F.lit(size))


def _hash(block: Column, attempt: int, bits: tuple[int, ...]) -> Column:
    n = bits[min(attempt, len(bits) - 1)]
    halves = [F.xxhash64(F.lit(2 * attempt + k), block) for k in (0, 1)]
    return F.struct(*[F.shiftrightunsigned(h, 64 - n).alias(c) for h, c in zip(halves, "uv")])


def name_keys(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct ``cols`` in sorted order with their place as ``name`` (places
    grow with the order and may leave gaps between partitions)."""
    d = keys.select(*cols).distinct()
    ranked = (d.repartitionByRange(*cols).sortWithinPartitions(*cols)
               .withColumn("name", F.monotonically_increasing_id()))
    return written(ranked, name)


def level_zero(docs: DataFrame, size: int, bits: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks): rows(rid, doc_id, text_sha256, n, hs) one a document, and
    blocks(rid, n, pos, name) one a block."""
    src = docs.select("doc_id", text_of().cast("binary").alias("data")).withColumn(
        "n", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int"))
    idx = F.sequence(F.lit(0), F.col("n") - 1)
    blocks = src.select(F.explode(F.transform(idx, lambda i: _block(F.col("data"), i, size))).alias("block"))
    attempt = 0
    while True:
        distinct = blocks.select(_hash(F.col("block"), attempt, bits).alias("h"), "block").distinct()
        hashes = written(distinct.groupBy("h").agg(F.count("*").alias("c")), "block-hashes")
        if hashes.where(F.col("c") > 1).isEmpty():
            break
        attempt += 1
    # the row number is drawn once and fixed by writing
    rows = written(src.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("data", 256).alias("text_sha256"), "n",
        F.transform(idx, lambda i: _hash(_block(F.col("data"), i, size), attempt, bits)).alias("hs")), "rows")
    names = name_keys(hashes, ["h"], "block-names")
    at = rows.select("rid", "n", F.posexplode("hs").alias("pos", "h"))
    return rows, at.join(names, "h").select("rid", "n", "pos", "name")


def identities(docs: DataFrame, size: int = BLOCK_BYTES, bits: tuple[int, ...] = HASH_BITS) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): one row a document; documents
    are equal when they share (level, name)."""
    rows, blocks = level_zero(docs, size, bits)
    longest = rows.agg(F.max("n")).first()[0] or 1
    blocks = written(blocks, "names-0")
    done = blocks.where(F.col("n") == 1).select("rid", F.lit(0).alias("level"), "name")
    level, width = 0, longest
    while width > 1:
        level, width = level + 1, (width + 1) // 2
        halves = (blocks.where(F.col("n") > 1)
                        .groupBy("rid", "n", F.shiftright("pos", 1).alias("pos"))
                        .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                             F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("b")))
        halves = written(halves.withColumn("n", F.shiftright(F.col("n") + 1, 1)), f"pairs-{level}")
        names = name_keys(halves, ["a", "b"], f"pair-names-{level}")
        blocks = written(halves.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"names-{level}")
        done = done.unionByName(blocks.where(F.col("n") == 1).select("rid", F.lit(level).alias("level"), "name"))
    return rows.select("rid", "doc_id", "text_sha256").join(done, "rid")


def dedup_classes(docs: DataFrame, size: int = BLOCK_BYTES, bits: tuple[int, ...] = HASH_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    ids = written(identities(docs, size, bits), "identities")
    classes = written(ids.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size")), "classes")
    return ids.join(classes, ["level", "name"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts (the largest doc_id).
    Of rows that repeat both doc_id and text (null as empty) the greatest by
    their columns stays."""
    kept = written(dedup_classes(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "kept")
    # kept texts are distinct, so the text's digest finds its row; rows that
    # repeat both doc_id and text are the only ones it finds twice
    return one_of_each(docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"])
                                 & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == kept["_sha"]), "left_semi"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
