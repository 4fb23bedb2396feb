"""Ranked lexical search over every document: pair-bound MaxScore.

The index is cut into blocks of documents (one Arrow batch each, bounded in
rows and bytes): for every term of a block the list of its documents and
counts, and for the block its doc_ids and lengths.  Building it shuffles
nothing.  For a set of queries, each query's terms are ordered by weight and
neighbours in that order form pairs; for every pair and block the intersection
list (documents holding both) is stored with its joint maximum impact.

A query visits a block's documents by MaxScore.  The bound of a pair is its
joint maximum, or the larger of its two terms' maxima where the pair never
meets, which is at most (mostly well under) the sum of the two.  Pairs whose
summed bounds stay under the score to beat are not essential: they bring no
candidates.  Candidates from the other pairs' lists are dropped when their
score and what is still open for them (the joint maximum if they are in a
pair's list, else the larger single one) cannot reach that score; the pairs left are then added
strongest first, dropping candidates after each.  Nothing that could rank is
skipped, so results equal those of scoring every document.

The score to beat comes from a first wave of blocks (one in SEED_BLOCKS), where
each query's k-th best score is a lower bound for the whole; in the second
wave it also rises from block to block within a shard of blocks.  Groups are
(batch of queries, shard of blocks), both bounded; each returns at most k rows
a query.

Defined cases: a null or term-free text is in no list (and not in N); each row
of the queries is a query of its own, so repeated or null item_ids are
answered row by row; a query without known terms has no rows; equal scores rank
by ascending doc_id, null last; repeated rows of the documents are documents
of their own; an empty table on either side gives no rows; further columns
are ignored, only doc_id and text, or item_id and text, are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .ranking import ranked

TOP_K = 50
QUERY_BATCH = 256                # queries answered together in one group
SHARD_BLOCKS = 8                 # blocks searched one after another in one group
SEED_BLOCKS = 16                 # one block in so many is searched first

# term characters are digits, letters and all above ASCII; A-Z becomes lower case
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_BYTES = bytes.maketrans(_OTHER + string.ascii_uppercase.encode(), b" " * len(_OTHER) + string.ascii_lowercase.encode())

INDEX = ("block long, term string, df int, words long, docs binary, tfs binary, doc_ids array<long>")


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text number, term) of every term in a column of texts, in order."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = bytes(memoryview(data)[offsets[0]:offsets[-1]]).translate(_BYTES) if data is not None and len(texts) else b""
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - (offsets[0] if len(offsets) else 0)),
                                                                  pa.py_buffer(data)])
    parts = pc.ascii_split_whitespace(clean)
    counts = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten()
    rows = np.repeat(np.arange(len(texts)), counts)
    there = pc.greater(pc.binary_length(flat), 0)
    return rows[there.to_numpy(zero_copy_only=False)], flat.filter(there).dictionary_encode()


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column whose entries are the bytes of ``values`` between ``bounds``."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                 [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)),
                                  pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _index_block(block: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    rows, terms = terms_of(texts)
    n = len(ids)
    codes = terms.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(codes * n + rows, return_counts=True)
    code, doc = key // n, key % n
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
    bounds = np.r_[starts, len(code)]
    lengths = np.bincount(rows, minlength=n)
    m = len(starts)
    own = [pa.array([block] * (m + 1), pa.int64()),
           pa.concat_arrays([terms.dictionary.cast(pa.string()).take(pa.array(code[starts])), pa.array([None], pa.string())]),
           pa.array(np.r_[np.diff(bounds), np.count_nonzero(lengths)].astype(np.int32)),
           pa.array(np.r_[np.add.reduceat(tf, starts) if m else [], lengths.sum()].astype(np.int64)),
           pa.concat_arrays([_lists(doc.astype("<u2"), bounds), pa.array([None], pa.binary())]),
           pa.concat_arrays([_lists(tf.astype("<u4"), bounds), pa.array([lengths.astype("<u4").tobytes()], pa.binary())]),
           pa.concat_arrays([pa.nulls(m, pa.list_(pa.int64())), pa.array([ids.to_pylist()], pa.list_(pa.int64()))])]
    return pa.RecordBatch.from_arrays(own, names=["block", "term", "df", "words", "docs", "tfs", "doc_ids"])


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of all rows.  A row with a term: the block's documents
    that hold it (places in the block) and their counts; a row without: the
    block's doc_ids, with their lengths in ``tfs`` and the number of documents
    with terms in ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            for start in range(0, b.num_rows, 1 << 16):            # places are 16-bit
                part = b.slice(start, 1 << 16)
                yield _index_block((TaskContext.get().partitionId() << 32) + k, part.column(0), part.column(1))
                k += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, INDEX), "lexical-index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, item_id, term): the distinct terms of every query row, written."""
    rows = written(queries.select("item_id", "text").withColumn("qid", F.monotonically_increasing_id()), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms = terms_of(b.column("text"))
            t = pa.table({"at": at, "term": terms.cast(pa.string())}).group_by(["at", "term"]).aggregate([])
            yield pa.RecordBatch.from_arrays([b.column("qid").take(t["at"].combine_chunks()), t["term"].combine_chunks()],
                                             names=["qid", "term"])

    terms = rows.mapInArrow(run, "qid long, term string")
    placed = ranked(rows.select("qid", "item_id"), [], [F.col("qid").asc()], "query-order").select(
        "qid", "item_id", F.expr(f"pos div {QUERY_BATCH}").alias("batch"), (F.col("pos") % QUERY_BATCH).cast("int").alias("slot"))
    return written(terms.join(placed, "qid"), "query-terms")


def weighted(index: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(``terms`` with weight ``w`` and ``place`` in the query's order, N, L); unknown terms are left out."""
    r = index.where("term IS NULL").agg(F.sum("df"), F.sum("words")).first()
    n_docs, n_words = int(r[0] or 0), int(r[1] or 0)
    known = index.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
    w = known.groupBy("term").agg(F.sum("df").alias("all_df")).select(
        "term", F.floor(1000.0 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("all_df") + 1))).alias("w"))
    order = Window.partitionBy("qid").orderBy("w", "term")
    out = terms.join(w, "term").withColumn("place", F.row_number().over(order) - 1)
    return written(out, "query-weights"), n_docs, n_words


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of the queries' terms for every batch of queries, with each
    block's own row: (batch, block, term, w, slots, docs, tfs, doc_ids), written."""
    slots = terms.groupBy("batch", "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("slot", "place")).alias("slots"))
    lists = index.where("term IS NOT NULL").join(slots, "term").select("batch", "block", "term", "w", "slots", "docs", "tfs", "doc_ids")
    last = terms.agg(F.max("batch")).first()[0]
    batches = F.array().cast("array<long>") if last is None else F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
    own = index.where("term IS NULL").select(
        F.explode(batches).alias("batch"), "block", "term", F.lit(None).cast("long").alias("w"),
        F.lit(None).cast("array<struct<slot:int,place:int>>").alias("slots"), "docs", "tfs", "doc_ids")
    return written(lists.unionByName(own), "postings")


class _Block:
    """One block of one batch: every term's documents and impacts, every query's terms."""

    def __init__(self, rows: list[dict], n_docs: int, n_words: int):
        own = next(r for r in rows if r["term"] is None)
        self.ids = own["doc_ids"]
        lengths = np.frombuffer(own["tfs"], "<u4").astype(np.int64)
        m = 50 + 50 * lengths * n_docs // max(n_words, 1)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.most: dict[str, int] = {}
        queries: dict[int, list[tuple[int, str]]] = {}
        for r in rows:
            if r["term"] is None:
                continue
            docs, tf = np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["tfs"], "<u4").astype(np.int64)
            impact = r["w"] * (1000000000 * tf // (1000 * tf + 20 * m[docs]))
            self.lists[r["term"]], self.most[r["term"]] = (docs, impact), int(impact.max())
            for s in r["slots"]:
                queries.setdefault(s["slot"], []).append((s["place"], r["term"]))
        # neighbours (2k, 2k + 1) in a query's order form a pair
        self.queries = {slot: [[t for p, t in sorted(terms) if p // 2 == k] for k in sorted({p // 2 for p, _ in terms})]
                        for slot, terms in queries.items()}

    def both(self, first: str, second: str) -> tuple[np.ndarray, int]:
        """Documents with both terms, and their largest joint impact."""
        impact = np.full(len(self.ids), -1, np.int64)
        impact[self.lists[first][0]] = self.lists[first][1]
        docs, other = self.lists[second]
        there = impact[docs] >= 0
        docs = docs[there]
        return docs, int((impact[docs] + other[there]).max()) if len(docs) else 0


PAIRS = "batch long, block long, first string, second string, docs binary, joint long"


def pair_lists(lists: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The intersection list and joint maximum impact of every query pair that meets in a block, written."""
    def run(t: pa.Table) -> pa.Table:
        block = _Block(t.to_pylist(), n_docs, n_words)
        pairs = sorted({tuple(p) for q in block.queries.values() for p in q if len(p) == 2})
        met = [(a, b, *block.both(a, b)) for a, b in pairs]
        met = [x for x in met if len(x[2])]
        return pa.table({"batch": pa.array([t["batch"][0].as_py()] * len(met), pa.int64()),
                         "block": pa.array([t["block"][0].as_py()] * len(met), pa.int64()),
                         "first": pa.array([x[0] for x in met], pa.string()), "second": pa.array([x[1] for x in met], pa.string()),
                         "docs": pa.array([x[2].tobytes() for x in met], pa.binary()), "joint": pa.array([x[3] for x in met], pa.int64())})

    return written(lists.groupBy("batch", "block").applyInArrow(run, PAIRS), "pair-lists")


def search_block(block: _Block, slot: int, joint: dict, beat: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the block's documents that score at least ``beat`` (and above 0) for a query."""
    n = len(block.ids)
    pairs = block.queries[slot]
    single = np.array([max(block.most[t] for t in p) for p in pairs], np.int64)
    bound = np.array([max(s, joint.get(tuple(p), (None, 0))[1]) for p, s in zip(pairs, single)], np.int64)
    order = np.argsort(bound, kind="stable")
    below = np.cumsum(bound[order])                              # bound of the weakest pairs together
    nothing = np.zeros(0, np.int64)
    if below[-1] < beat or below[-1] == 0:
        return nothing, nothing
    essential = int(np.searchsorted(below, beat, "left"))        # pairs before it cannot reach it by themselves
    score = np.zeros(n, np.int64)

    def add(k: int, into: np.ndarray) -> None:
        for t in pairs[k]:
            docs, impact = block.lists[t]
            into[docs] += impact

    for k in order[essential:]:
        add(k, score)
    docs = np.flatnonzero(score)
    if essential:
        # what is open for a document: a pair's joint maximum only where it holds both terms
        still = np.full(n, single[order[:essential]].sum(), np.int64)
        for k in order[:essential]:
            met = joint.get(tuple(pairs[k]))
            if met and met[1] > single[k]:
                still[met[0]] += met[1] - single[k]
        docs = docs[score[docs] + still[docs] >= beat]
    for j in range(essential - 1, -1, -1):
        if not len(docs):
            break
        more = np.zeros(n, np.int64)
        add(order[j], more)
        score[docs] += more[docs]
        left = below[j - 1] if j else 0
        docs = docs[score[docs] + left >= beat]
    docs = docs[(score[docs] >= beat) & (score[docs] > 0)]
    return docs, score[docs]


FOUND = "batch long, slot int, doc_id long, score long"
_LAST = np.iinfo(np.int64).max


def _best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.lexsort((ids, ~known, -scores))[:k]
    return ids[at], known[at], scores[at]


def search_groups(rows: DataFrame, n_docs: int, n_words: int, k: int) -> DataFrame:
    """FOUND rows: each shard's ``k`` best documents a query; ``rows`` are
    postings and pair lists with a ``shard``, and the scores to beat on the blocks' own rows."""
    def run(t: pa.Table) -> pa.Table:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        floors: dict[int, int] = {}
        t = t.sort_by("block")
        numbers = t["block"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True])
        for a, b in zip(cuts, cuts[1:]):
            rows = t.slice(a, b - a).to_pylist()
            block = _Block([r for r in rows if r["second"] is None], n_docs, n_words)
            joint = {(r["term"], r["second"]): (np.frombuffer(r["docs"], "<u2"), r["joint"]) for r in rows if r["second"] is not None}
            for r in rows:
                if r["floors"] is not None:
                    floors.update((f["slot"], f["beat"]) for f in r["floors"])
            known = np.array([i is not None for i in block.ids])
            ids = np.array([_LAST if i is None else i for i in block.ids], np.int64)
            for slot in block.queries:
                had = best.get(slot)
                beat = floors.get(slot, 0)
                if had is not None and len(had[2]) == k:
                    beat = max(beat, int(had[2][-1]))
                docs, scores = search_block(block, slot, joint, beat)
                if len(docs):
                    new = (ids[docs], known[docs], scores)
                    best[slot] = _best(*(new if had is None else (np.r_[x, y] for x, y in zip(had, new))), k)
        batch = t["batch"][0].as_py()
        out = [(batch, slot, int(i) if w else None, int(s)) for slot, (ii, ww, ss) in best.items() for i, w, s in zip(ii, ww, ss)]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({"batch": pa.array(cols[0], pa.int64()), "slot": pa.array(cols[1], pa.int32()),
                         "doc_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.int64())})

    return rows.groupBy("batch", "shard").applyInArrow(run, FOUND)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, shard_blocks: int = SHARD_BLOCKS,
           seed_blocks: int = SEED_BLOCKS) -> DataFrame:
    """item_id, rank, doc_id, score: each query's ``k`` best documents."""
    index = build_index(docs)
    asked = query_terms(queries)
    terms, n_docs, n_words = weighted(index, asked)
    lists = postings(index, terms)
    pairs = pair_lists(lists, n_docs, n_words)
    n_blocks = index.where("term IS NULL").count()
    first = F.pmod(F.xxhash64(F.lit(1), "block"), F.lit(seed_blocks)) == 0
    shard = F.pmod(F.xxhash64(F.lit(2), "block"), F.lit(max(1, -(-n_blocks // shard_blocks))))
    none = F.lit(None)
    floor_type = "array<struct<slot:int,beat:long>>"
    both = (lists.withColumns({"second": none.cast("string"), "joint": none.cast("long")})
                 .unionByName(pairs.withColumnRenamed("first", "term"), allowMissingColumns=True)
                 .withColumns({"shard": shard, "early": first}))
    by_score = Window.partitionBy("batch", "slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    early = written(search_groups(both.where("early").withColumn("floors", none.cast(floor_type)), n_docs, n_words, k), "early-hits")
    beat = (early.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
                 .groupBy("batch").agg(F.collect_list(F.struct("slot", F.col("score").alias("beat"))).alias("floors")))
    # only the blocks' own rows meet the scores to beat: a join of all rows would leave them partitioned by batch alone
    later = both.where("NOT early")
    rows = (later.where("term IS NULL").join(beat, "batch", "left")
                 .unionByName(later.where("term IS NOT NULL").withColumn("floors", none.cast(floor_type))))
    late = search_groups(rows, n_docs, n_words, k)
    hits = early.unionByName(late).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    items = asked.select("batch", "slot", "item_id").distinct()
    return hits.join(items, ["batch", "slot"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM counts CROSS JOIN totals GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) CROSS JOIN totals
  GROUP BY item_id, doc_id),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
