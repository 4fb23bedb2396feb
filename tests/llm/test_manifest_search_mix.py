"""The Merkle manifest, ranked lexical search and source mixing against brute
force on small fixtures: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing column names."""

import hashlib
import random
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from renalyze.llm import lexical, merkle, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(rng, n, most):
    return " ".join(f"w{min(rng.randrange(most), rng.randrange(most))}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    langs, sources = ["en", "en", "en", "de", "é", None], ["a", "a", "a", "B", "é", None]
    texts = [None, "", " ", "same words", "Same  words!", words(rng, 6000, 50), "日本 naïve Ünder_score x2"]
    texts += [words(rng, rng.randint(1, 60), 40) for _ in range(60)]
    out = [(k, t, rng.choice(langs), rng.choice(sources), None if k % 9 == 0 else len(t or "")) for k, t in enumerate(texts)]
    out += [(900, None, "fr", "none", 5), (901, "", "fr", "none", None)]
    again = [out[5], out[5], out[12], out[12], out[12]]
    return out + again + [(None, "no id w1 w2", None, None, 3), (None, "no id w1 w2", None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest -------------------------------------------------------

def leaf(i, t, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def climb(nodes, fanout):
    """(root, siblings of every node with their side, level by level)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // fanout * fanout:p // fanout * fanout + fanout]
            proofs[k].append((run[:p % fanout], run[p % fanout + 1:]))
        level = [sha("".join(level[a:a + fanout])) for a in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], proofs


def plain_manifest(rows, fanout=2):
    trees = {}
    for i, t, lang, source, n in rows:
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        own = leaf(i, t, lang, source, n)
        trees.setdefault(lang, []).append((i is not None, i, own, leaf(i, t, lang, source, n + 1) if hit else own))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {x: climb([r[2] for r in sorted(trees[x], key=lambda r: (r[0], r[1] or 0, r[2]))], fanout) for x in langs}
    root, crown = climb([grown[x][0] for x in langs], fanout)
    out = []
    for k, x in enumerate(langs):
        for r, proof in zip(sorted(trees[x], key=lambda r: (r[0], r[1] or 0, r[2])), grown[x][1]):
            h = r[3]
            for left, right in proof + crown[k]:
                h = sha("".join([*left, h, *right]))
            siblings = "".join("".join(left + right) for left, right in proof + crown[k])
            out.append((r[1], r[2], grown[x][0], root, sha(siblings), h, h == root))
    return out


def test_states_resume_the_standard_hash():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 256, (5, 3, 32), dtype=np.uint8)
    state = np.broadcast_to(merkle.START, (5, 8))
    for k in range(3):
        state = merkle.absorb(state, d[:, k])
        got = merkle.finish(state, k + 1)
        for row, g in zip(d, got):
            assert g.tobytes().hex() == sha(row[:k + 1].tobytes().hex())


@pytest.mark.parametrize("n,fanout,depth", [(1, 2, 4), (2, 2, 4), (7, 2, 4), (16, 2, 4), (10, 3, 3), (27, 3, 3)])
def test_chunk_paths(n, fanout, depth):
    d = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    levels = merkle.levels_of(n, fanout, depth)
    paths, top = merkle.build_chunk(d, levels, fanout)
    root, proofs = climb([x.tobytes().hex() for x in d], fanout)
    assert top.tobytes().hex() == root
    assert (merkle.fold(d, paths, fanout) == top).all()
    for p, want in zip(paths, proofs):
        assert merkle.siblings(p, fanout) == [s for left, right in want for s in left + right]


@pytest.mark.parametrize("fanout,depth", [(2, 12), (2, 1), (2, 2), (3, 1)])
def test_manifest(docs, rows, fanout, depth):
    if (fanout, depth) == (2, 12):
        got = merkle.merkle_digest(docs)
    else:
        hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
        changed = F.when(hit, merkle.leaf_digest(n_chars=F.col("n_chars") + 1)).otherwise(merkle.leaf_digest())
        r = merkle.folded(merkle.manifest(docs, fanout, depth, changed), fanout)
        got = r.select("doc_id", *[F.lower(F.hex(c)) for c in ("digest", "subroot", "root")], "proof_sha256",
                       F.lower(F.hex("folded_root")), F.col("folded_root") == F.col("root"))
    want = plain_manifest(rows, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_manifest_edge_tables(spark, docs, empty):
    assert merkle.merkle_digest(empty).count() == 0
    one = [(4, "x", None, "s", 1)]
    assert [tuple(r) for r in merkle.merkle_digest(spark.createDataFrame(one, SCHEMA)).collect()] == plain_manifest(one)
    more = docs
    for c in ("path", "pos", "n", "chunk", "digest", "top", "root", "replaced", "tree"):
        more = more.withColumn(c, F.lit("clash"))
    assert sorted(merkle.merkle_digest(more).collect(), key=str) == sorted(merkle.merkle_digest(docs).collect(), key=str)


# --- ranked lexical search --------------------------------------------------

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
QUERIES = [(1, "w1 w2 W3 w1"), (2, "same words"), (3, None), (4, "!!"), (5, "unknownterm"), (6, "日本 ünder NAÏVE Ünder score x2"),
           (7, " ".join(f"w{k}" for k in range(40))), (8, "w3"), (2, "w5 w6"), (None, "w7 w8 w30"), (9, "w39 w38 unknown w0")]


def plain_search(rows, queries, k):
    texts = [TERM.findall((t or "").translate(LOWER)) for _, t, *_ in rows]
    n_docs, n_words = sum(map(bool, texts)), sum(map(len, texts))
    counts = [Counter(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, q in queries:
        hits = []
        for (i, *_), c, t in zip(rows, counts, texts):
            m = 50 + 50 * len(t) * n_docs // max(n_words, 1)
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m))
                    for x in set(TERM.findall((q or "").translate(LOWER))) if x in c)
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return out


@pytest.mark.parametrize("k,batch,shard,seed", [(50, 2000, 8, 16), (5, 4, 3, 4), (3, 2, 100, 2), (7, 5, 1, 1)])
def test_search(spark, docs, rows, k, batch, shard, seed):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))      # blocks of so many documents
    try:
        queries = spark.createDataFrame(QUERIES, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
        got = lexical.search(docs.withColumn("term", F.lit(0)), queries, k, shard, seed).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(tuple, got), key=str) == sorted(plain_search(rows, QUERIES, k), key=str)


def test_search_edge_tables(spark, docs, empty):
    queries = spark.createDataFrame(QUERIES, "item_id bigint, text string")
    assert lexical.search(empty, queries).count() == 0
    assert lexical.search(docs, queries.limit(0)).count() == 0
    assert lexical.search(docs, queries.where("item_id in (3, 4, 5)")).count() == 0


def test_terms():
    import pyarrow as pa
    texts = ["", None, "a", "A_b c--d\x7fÉe\n", " \t", "x" * 70000 + " y", "ſK K"]
    at, terms = lexical.terms_of(pa.array(["zz", *texts]).slice(1))
    got = [[] for _ in texts]
    for i, t in zip(at, terms.to_pylist()):
        got[i].append(t)
    assert got == [TERM.findall((t or "").translate(LOWER)) for t in texts]


def test_pair_bounds_skip_only_what_cannot_rank():
    rng = np.random.default_rng(3)
    n, terms = 200, [f"t{k}" for k in range(9)]
    rows = [{"term": None, "doc_ids": list(range(n)), "tfs": rng.integers(5, 300, n).astype("<u4").tobytes()}]
    for k, t in enumerate(terms):
        docs = np.flatnonzero(rng.random(n) < 0.05 + 0.08 * k).astype("<u2")
        rows.append({"term": t, "w": 900 - 100 * k, "docs": docs.tobytes(), "slots": [{"slot": 0, "place": k}],
                     "tfs": rng.integers(1, 6, len(docs)).astype("<u4").tobytes()})
    block = lexical._Block(rows, 1000, 100000)
    pairs = block.queries[0]
    joint = {tuple(p): block.both(*p) for p in pairs if len(p) == 2}
    score = np.zeros(n, np.int64)
    for t in terms:
        score[block.lists[t][0]] += block.lists[t][1]
    assert any(j < block.most[a] + block.most[b] for (a, b), (_, j) in joint.items())
    for beat in [0, 1, *np.sort(score)[[20, 100, 180, 198, 199]], score.max() + 1]:
        docs, got = lexical.search_block(block, 0, joint, int(beat))
        want = np.flatnonzero((score >= beat) & (score > 0))
        assert docs.tolist() == want.tolist() and got.tolist() == score[want].tolist()


# --- mixing -------------------------------------------------------------------

def plain_targets(size, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, held, target = share * sum(size.values()), set(), {}
    while len(held) < len(order):
        free = [s for s in order if s not in held]
        target.update({s: left * w[s] / sum(w[x] for x in free) for s in free})
        over = [s for s in free if target[s] > most * size[s]]
        if not over:
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= target[s]
            held.add(s)
    return target


def size_of(t):
    return len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("group", [2, 5, 64])
def test_mix(docs, rows, group):
    got = mixing.mix(docs, group=group).collect()
    assert sorted((str(r.doc_id), r.size, r.source) for r in got) == sorted((str(i), size_of(t), s) for i, t, _, s, _ in rows) \
        if all(r[3] is not None for r in rows) else len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += size_of(t)
    want = plain_targets(size)
    assert size["none"] == 0 and want["none"] == 0
    for s in size:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size[s]}
        assert all(r.target == pytest.approx(want[s]) for r in own)
        assert all(r.copies in ((0,) if size[s] == 0 else (floor(want[s] / size[s]), -(-want[s] // size[s]))) for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= max(r.size for r in own)
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))


def test_mix_is_the_same_on_any_partitioning(docs):
    a, b = (sorted(mixing.mix_digest(docs.repartition(k)).collect(), key=str) for k in (1, 7))
    assert a == b


def test_mix_edge_tables(spark, docs, empty):
    assert mixing.mix_digest(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 1), (2, "", None, None, 1)], SCHEMA)
    assert sorted(map(tuple, mixing.mix_digest(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    more = docs
    for c in ("size", "p", "rid", "hash", "target", "pos", "n", "key", "whole"):
        more = more.withColumn(c, F.lit("clash"))
    assert sorted(mixing.mix_digest(more).collect(), key=str) == sorted(mixing.mix_digest(docs).collect(), key=str)


def test_rounding_keeps_mass_and_expectation(spark):
    rng = random.Random(5)
    size = [rng.choice([1, 3, 10, 200]) for _ in range(40)]
    items = spark.createDataFrame([("s", k, 40, k, n, 0.3, k * 7 + 1) for k, n in enumerate(size)],
                                  "source string, pos long, n long, rid long, size long, p double, key long").cache()
    runs = 60
    taken = Counter()
    for seed in range(runs):
        out = mixing.rounded(items, 8, seed).collect()
        assert sorted(r.rid for r in out) == list(range(40)) and all(r.p in (0.0, 1.0) for r in out)
        assert abs(sum(size[r.rid] * r.p for r in out) - 0.3 * sum(size)) <= max(size)
        taken.update({r.rid: int(r.p) for r in out})
    assert abs(sum(taken.values()) / (40 * runs) - 0.3) < 0.04
    assert all(taken[k] / runs < 0.6 for k in range(40))
    items.unpersist()


def test_mix_stays_native(docs):
    plan = mixing.mix_digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))
