"""Merkle manifest of a dataset: a tree of SHA-256 midstates.

Each row is a leaf; the leaves of a lang, in doc_id order, form a tree whose
root is the lang's subroot, and the subroots, in lang order, form the tree of
the dataset's root.  A parent is the hash of its children's hex digests.  A
hex digest is exactly one SHA-256 block, so the hash state before each child
slot is eight words: every parent retains a copy of those states.  To see what
a changed child does to its parent, folding resumes the state kept before its
slot with the replacement and the right siblings only.

Trees are built in chunks of FANOUT ** DEPTH consecutive nodes: one task group
builds a chunk's DEPTH levels and writes, for each of its nodes, the path to
the chunk's root (one record a level: slot, size of the run, state before the
slot, siblings).  The chunks' roots are the nodes of the next tier, so N leaves
need log(N) / log(chunk) rounds, and no group is larger than a chunk however
many rows a lang has.  Paths of higher tiers are joined downwards by chunk
number and appended.  Texts are hashed where they are read and never shuffled.

Defined cases: a null field counts as ``-`` and an empty one as ``0:``; a null
lang is a group of its own, the first; null doc_ids come first, rows of one
doc_id are ordered by leaf; repeated rows are leaves of their own; an empty
table has no rows; further columns are ignored, and none of the names used
within can clash, since only the five named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .ranking import ranked, same

FANOUT = 2
DEPTH = 12                       # levels of a chunk
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 7
DIGEST = 32                      # bytes of a digest, and of a hash state
HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), "u1").reshape(256, 2)


# --- SHA-256 over many messages at once, with states that can be kept -------

def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** 3 <= x else (lo, mid - 1)
    return lo


# the standard's constants: fractions of the roots of the first primes
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (m, 8) after one more block (m, 16) of words each."""
    w = [blocks[:, t].astype(np.uint32) for t in range(16)]
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3)))
                 + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (states[:, k].copy() for k in range(8))
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def absorb(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hex text (one block) of a digest (m, 32) each."""
    return compress(states, HEX[digests].reshape(len(digests), 64).view(">u4"))


def finish(states: np.ndarray, n_children: int) -> np.ndarray:
    """Digests (m, 32) of messages that end here, after ``n_children`` blocks."""
    pad = np.zeros((1, 16), np.uint32)
    pad[0, 0], pad[0, 15] = 0x80000000, n_children * 64 * 8
    return compress(states, np.broadcast_to(pad, (len(states), 16))).astype(">u4").view("u1").reshape(-1, DIGEST)


# --- one chunk ---------------------------------------------------------------

def levels_of(n: int, fanout: int = FANOUT, depth: int = DEPTH) -> int:
    """Levels that a chunk of a tree of ``n`` nodes has."""
    k = 0
    while n > 1 and k < depth:
        n, k = -(-n // fanout), k + 1
    return k


def record_bytes(fanout: int = FANOUT) -> int:
    return 2 + DIGEST * fanout


def build_chunk(digests: np.ndarray, levels: int, fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray]:
    """(paths (n, levels, record), root (32,)) of ``n`` consecutive nodes.

    A record is: slot, size of the run, the state kept before the slot, and
    the siblings left to right (zeros where the run is short).
    """
    n = len(digests)
    paths = np.zeros((n, levels, record_bytes(fanout)), "u1")
    nodes, at = digests, np.arange(n)
    for level in range(levels):
        count = -(-len(nodes) // fanout)
        kept = np.zeros((fanout, count, 8), np.uint32)          # the states before each slot
        state = np.broadcast_to(START, (count, 8)).copy()
        for slot in range(fanout):
            kept[slot] = state
            child = nodes[slot::fanout]
            state[:len(child)] = absorb(state[:len(child)], child)
        last = len(nodes) - (count - 1) * fanout
        parents = np.concatenate([finish(state[:-1], fanout), finish(state[-1:], last)])
        parent, slot = at // fanout, at % fanout
        size = np.where(parent == count - 1, last, fanout)
        rec = paths[:, level]
        rec[:, 0], rec[:, 1] = slot, size
        rec[:, 2:2 + DIGEST] = kept[slot, parent].astype(">u4").view("u1").reshape(n, DIGEST)
        for k in range(fanout - 1):
            sibling = parent * fanout + k + (k >= slot)
            there = k < size - 1
            rec[there, 2 + DIGEST * (k + 1):2 + DIGEST * (k + 2)] = nodes[sibling[there]]
        nodes, at = parents, parent
    return paths, nodes[0]


def fold(digests: np.ndarray, paths: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """Roots (m, 32) that the digests (m, 32) give along their paths (m, levels, record)."""
    cur = digests
    for level in range(paths.shape[1]):
        rec = paths[:, level]
        slot, size = rec[:, 0].astype(int), rec[:, 1].astype(int)
        state = np.ascontiguousarray(rec[:, 2:2 + DIGEST]).view(">u4").astype(np.uint32)
        state = absorb(state, cur)
        for k in range(fanout - 1):
            right = (k >= slot) & (k < size - 1)
            if right.any():
                state[right] = absorb(state[right], rec[right, 2 + DIGEST * (k + 1):2 + DIGEST * (k + 2)])
        out = np.empty_like(cur)
        for s in np.unique(size):
            out[size == s] = finish(state[size == s], int(s))
        cur = out
    return cur


def siblings(path: np.ndarray, fanout: int = FANOUT) -> list[str]:
    """Hex digests of the siblings on a path (levels, record), from the leaf up, left to right."""
    return [rec[2 + DIGEST * (k + 1):2 + DIGEST * (k + 2)].tobytes().hex()
            for rec in path for k in range(int(rec[1]) - 1)]


# --- Spark -------------------------------------------------------------------

def field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(**changed: Column) -> Column:
    """Binary digest of a row's fields; ``changed`` replaces some."""
    parts = [field(changed.get(c, F.col(c))) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows (m, width) of bytes as a binary column."""
    m, width = rows.shape
    if m * width >= 2 ** 31:
        raise ValueError("chunk too large for one Arrow column")
    offsets = (np.arange(m + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _digests(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "u1").reshape(-1, DIGEST)


def _tier(nodes: DataFrame, keys: list[str], fanout: int, depth: int) -> DataFrame:
    """Every node with its ``path`` to the root (``top``) of its ``chunk``."""
    width = fanout ** depth
    schema = T.StructType(nodes.schema.fields + [T.StructField("chunk", T.LongType()), T.StructField("path", T.BinaryType()),
                                                T.StructField("top", T.BinaryType())])

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        paths, top = build_chunk(_digests(t["digest"]), levels_of(t["n"][0].as_py(), fanout, depth), fanout)
        flat = paths.reshape(len(paths), -1)
        return (t.append_column("path", _binary(flat))
                 .append_column("top", pa.array([top.tobytes()] * len(t), pa.binary())))

    chunked = nodes.withColumn("chunk", F.expr(f"pos div {width}"))
    return chunked.groupBy(*keys, "chunk").applyInArrow(build, schema)


def _tiers(nodes: DataFrame, keys: list[str], fanout: int, depth: int, name: str) -> list[DataFrame]:
    """Tiers of the trees named by ``keys``, leaves first, each a written table."""
    width = fanout ** depth
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = []
    while True:
        out.append(written(_tier(nodes, keys, fanout, depth), f"{name}-{len(out)}"))
        if most <= width:
            return out
        most = -(-most // width)
        nodes = out[-1].where(F.col("pos") % width == 0).select(
            *keys, F.col("chunk").alias("pos"), F.col("top").alias("digest"), F.ceil(F.col("n") / width).alias("n"))


def _below(lower: DataFrame, upper: DataFrame, on: dict[str, str], more: list[str]) -> DataFrame:
    """Rows of ``lower`` with the paths of the ``upper`` rows they lead to appended."""
    up = upper.select(*[F.col(c).alias(f"_u_{c}") for c in on.values()], F.col("path").alias("_path"), *more)
    both = lower.join(up, same(lower, up, {a: f"_u_{b}" for a, b in on.items()}))
    return both.select(*[c for c in lower.columns if c != "path"], *more, F.concat("path", "_path").alias("path"))


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, replaced: Column | None = None) -> DataFrame:
    """doc_id, lang, digest (leaf), replaced, subroot, root, path of every row
    (digests and path in binary); ``replaced`` is a digest to fold in place of
    the leaf's, computed from the row's fields (by default the leaf's own)."""
    leaf = leaf_digest()
    rows = written(docs.select("doc_id", "lang", leaf.alias("digest"),
                               (leaf if replaced is None else replaced).alias("replaced")), "leaves")
    leaves = ranked(rows, ["lang"], [F.col("doc_id").asc(), F.col("digest").asc(), F.col("replaced").asc()], "leaf-order")
    tiers = _tiers(leaves, ["lang"], fanout, depth, "leaf-tier")
    subroots = written(tiers[-1].where("pos = 0").select("lang", F.col("top").alias("digest")), "subroots")
    crown = _tiers(ranked(subroots, [], [F.col("lang").asc()], "subroot-order").withColumn("tree", F.lit(0)),
                   ["tree"], fanout, depth, "crown-tier")
    up = crown[-1].withColumnRenamed("top", "root")
    for t in reversed(crown[:-1]):
        up = _below(t.drop("top"), up, {"tree": "tree", "chunk": "pos"}, ["root"])
    up = _below(tiers[-1].drop("top"), up.withColumnRenamed("digest", "subroot"), {"lang": "lang"}, ["subroot", "root"])
    for t in reversed(tiers[:-1]):
        up = _below(t.drop("top"), up, {"lang": "lang", "chunk": "pos"}, ["subroot", "root"])
    return up.select("doc_id", "lang", "digest", "replaced", "subroot", "root", "path")


def folded(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Manifest rows with ``folded_root`` (binary), from ``replaced`` and the path
    alone, and ``proof_sha256`` (hash of the path's siblings) in place of the path."""
    width = record_bytes(fanout)
    keep = [c for c in rows.columns if c != "path"]
    schema = rows.select(*keep).schema.add("folded_root", "binary").add("proof_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("path").to_pylist()
            depths = np.array([len(p) // width for p in blobs], int)
            start = _digests(b.column("replaced"))
            roots = np.empty_like(start)
            proofs = [""] * len(blobs)
            for d in np.unique(depths):
                at = np.flatnonzero(depths == d)
                paths = np.frombuffer(b"".join(blobs[i] for i in at), "u1").reshape(len(at), d, width)
                roots[at] = fold(start[at], paths, fanout)
                for i, p in zip(at, paths):
                    proofs[i] = hashlib.sha256("".join(siblings(p, fanout)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [_binary(roots), pa.array(proofs, pa.string())], names=[*keep, "folded_root", "proof_sha256"])

    return rows.mapInArrow(run, schema)


def merkle_digest(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and the root folded after n_chars grew by one
    where TAMPER_MODULUS divides crc32 of the doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0, F.lit(False))
    tampered = F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars") + 1)).otherwise(leaf_digest())
    rows = folded(manifest(docs, replaced=tampered))
    text = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root", "folded_root")}
    return rows.select("doc_id", text["digest"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
                       "proof_sha256", text["folded_root"].alias("folded_root"),
                       (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS crc
  FROM documents),
parts AS (
  SELECT doc_id, lang,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS size,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS larger,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT p.doc_id, p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY p.doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY p.lang) AS n, sha256(head || size || tail) AS leaf,
         sha256(head || CASE WHEN crc % 7 = 0 THEN larger ELSE size END || tail) AS replaced
  FROM parts p JOIN crc USING (doc_id)),
nodes AS (
  SELECT lang, 0 AS lvl, pos AS idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
subroots AS (
  SELECT lang, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, place AS idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM crown WHERE n > 1 GROUP BY lvl, idx // 2, n),
top AS (SELECT h AS root, lvl AS height FROM crown WHERE n = 1),
steps AS (
  SELECT l.doc_id, s.lvl AS step, s.h AS sibling, s.idx < (l.pos >> s.lvl) AS before
  FROM leaves l JOIN nodes s ON l.lang IS NOT DISTINCT FROM s.lang AND s.idx = xor(l.pos >> s.lvl, 1)
  UNION ALL
  SELECT l.doc_id, r.depth + c.lvl, c.h, c.idx < (r.place >> c.lvl)
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  JOIN crown c ON c.idx = xor(r.place >> c.lvl, 1)),
fold AS (
  SELECT l.doc_id, 0 AS step, r.depth + t.height AS total, l.replaced AS h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN top t
  UNION ALL
  SELECT f.doc_id, f.step + 1, f.total,
         sha256(CASE WHEN s.before THEN s.sibling ELSE '' END || f.h || CASE WHEN s.before THEN '' ELSE coalesce(s.sibling, '') END)
  FROM fold f LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step WHERE f.step < f.total),
proofs AS (SELECT doc_id, string_agg(sibling, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id)
SELECT l.doc_id, l.leaf, r.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.h AS folded_root, f.h = t.root AS verified
FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang CROSS JOIN top t
JOIN fold f ON f.doc_id = l.doc_id AND f.step = f.total
LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""
