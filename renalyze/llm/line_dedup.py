"""Line deduplication: lines found in many documents are dropped.

Native DataFrame plan: explode the normalised lines to (document key,
position, line hash), count distinct documents per hash, keep the hashes at
or over the threshold, join them back to the positions, and rebuild every
document from its own lines without the dropped positions.

Only hashes and positions are exchanged by line key; the text moves once, to
meet its document's dropped positions.  The count is pre-aggregated before
both shuffles, so a line in a third of all documents costs one row a task; in
the join that marks positions both sides are read from files, so adaptive
execution splits a hot line's partition.

Defined cases: null or empty text is one empty line; an empty key (blank line)
is never dropped; a document is a distinct (doc_id, text) pair, so a repeated
row counts once and every copy of it gets the same result; null doc_ids are
allowed.  Line keys are compared by two 64-bit hashes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, row_key, text_of, written

MIN_DOCS = 10
MIN_CHARS = 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Both ends stripped of ASCII white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def line_rows(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, pos, h1, h2): every line whose key has at least MIN_CHARS code points."""
    lines = (docs.select(*row_key(), F.posexplode(lines_of(text_of())).alias("pos", "line"))
                 .select("_k1", "_k2", "pos", line_key(F.col("line")).alias("key")))
    return (lines.where(F.length("key") >= MIN_CHARS)
                 .select("_k1", "_k2", "pos", F.xxhash64("key").alias("h1"),
                         F.xxhash64(F.lit(1), F.reverse("key")).alias("h2")))


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_k1, _k2, dropped): the positions each document loses."""
    rows = written(line_rows(docs), "lines")
    common = (rows.groupBy("h1", "h2").agg(F.countDistinct("_k1", "_k2").alias("n"))
                  .where(F.col("n") >= min_docs).select("h1", "h2"))
    common = written(common, "common-lines")
    return (rows.join(common, ["h1", "h2"], "left_semi")
                .groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("dropped")))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added (columns
    of those names in the input are replaced)."""
    add = ["n_lines", "n_dropped", "kept_text", "_k1", "_k2", "dropped"]
    base = docs.drop(*[c for c in docs.columns if c in add])
    hits = dropped_positions(base, min_docs)
    lines = lines_of(text_of())
    keyed = base.withColumns(dict(zip(("_k1", "_k2"), row_key())))
    out = keyed.join(hits, ["_k1", "_k2"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept_text = F.when(F.col("dropped").isNull(), text_of()).otherwise(
        F.array_join(F.transform(kept, lambda p: F.element_at(F.col("_lines"), p + 1)), "\n"))
    return (out.withColumn("_lines", lines)
               .withColumns({"n_lines": F.size("_lines").cast("long"),
                             "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
                             "kept_text": kept_text})
               .select(*base.columns, "n_lines", "n_dropped", "kept_text"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    d = dedup_lines(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1
  GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""
