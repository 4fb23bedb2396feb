"""The corpus pipeline's stages and hand-over against plain Python, with null
ids, null beside empty texts, repeated rows that differ elsewhere, and an empty table."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from renalyze.llm import bpe, common, exact_dedup, merkle, near_dedup, packing, substring_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark):
    rng = random.Random(6)
    d = tempfile.mkdtemp(prefix="renalyze-pipe-")
    passage, base = words(rng, 60), words(rng, 200).split()
    texts = [words(rng, rng.randint(5, 90)) for _ in range(40)]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 20) for _ in range(3)]
    texts += [" ".join(base), " ".join(base[:90] + ["other"] + base[91:]), "copy of this", "copy of this"]
    texts += [f"clean {k} words " + words(rng, 8) for k in range(60)]
    bad = [f"zurk blatt {words(rng, 6)} zurk vrell" for _ in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + bad)]
    rows += [(1, texts[1], "de", "s", 7), (1, texts[1], "de", "t", 8), (500, None, "en", "s", 0), (500, "", "en", "s", 0),
             (None, "a row without id", None, None, None), (None, "a row without id", None, "x", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    n = len(texts)
    spark.createDataFrame([(k, 1, int(k >= n)) for k in range(n + len(bad))], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_copies_stage(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    got = as_rows(exact_dedup.drop_copies(docs))
    best = {}
    for r in docs.collect():
        key = r.text or ""
        order = (r.doc_id is not None, r.doc_id or 0, [(x is not None, x if x is not None else 0) for x in r])
        if key not in best or order > best[key][0]:
            best[key] = (order, tuple(r))
    assert got == sorted((v for _, v in best.values()), key=str)


def test_near_copies_stage(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    digest = near_dedup.near_digest(docs).collect()
    kept = near_dedup.drop_near_copies(docs).collect()
    assert sum(r.kept for r in digest) == len(kept) == len({r.class_id if r.class_id is not None else ("none", r.class_size) for r in digest})
    ids = [r.doc_id for r in kept]
    # each class keeps its smallest id; null and empty are one text; rows of one id and text are one
    assert ids.count(1) == 1 and ids.count(500) == 1 and ids.count(None) == 1
    assert 43 in ids and 44 not in ids and 45 in ids and 46 not in ids
    assert set(range(43)) <= set(ids)


def test_toxic_stage(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    left = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert left.columns == docs.columns
    kept, rows = as_rows(left), as_rows(docs)
    assert set(kept) <= set(rows)
    toxic = [r for r in rows if "zurk" in (r[1] or "")]
    assert len(set(toxic) & set(kept)) <= 2 and len(set(rows) - set(toxic) - set(kept)) <= 2


def test_passages_stage(spark, sf_dir):
    docs = exact_dedup.drop_copies(common.documents(spark, sf_dir)).where("doc_id IS NOT NULL")
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, sf_dir).collect()}
    first = {}
    rows = sorted((r.doc_id, (r.text or "").split()) for r in docs.collect())
    for i, w in rows:
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p:p + 13]), i)
    for i, w in rows:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p:p + 13])] < i for q in range(p, p + 13)}
        text = got[i].text or ""
        assert text.split() == [x for q, x in enumerate(w) if q not in gone] and got[i].n_chars == len(text)


def test_whole_pipeline(spark, sf_dir):
    """``run`` is its stages one after another, and its pieces are the tokens of what they kept."""
    from tokenizers import Tokenizer
    docs = common.documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == SCHEMA_COLUMNS
    kept = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    t = Tokenizer.from_file(bpe.vocabulary_path())
    import zlib
    assert {p.doc_id for p in pieces if p.doc_id is not None} == set(kept)
    for p in pieces:
        if p.doc_id is not None:
            ids = t.encode(kept[p.doc_id], add_special_tokens=False).ids + [1]
            own = np.array(ids[p.start:p.start + p.length], "<u4")
            assert p.doc_tokens == len(ids) and len(own) == p.length and p.ids_crc32 == zlib.crc32(own.tobytes())
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p.offset, p.length) for p in pieces if p.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("n", [2, 18, 300])
def test_components_of_a_chain_take_few_rounds(spark, n, monkeypatch):
    written, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append(name) or written(df, name))
    order = list(range(n))
    random.Random(n).shuffle(order)
    for ids in (list(range(n)), order):
        names.clear()
        got = near_dedup.contracted(spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint"), "chain")
        assert {r.node: r.root for r in got.collect()} == dict.fromkeys(range(n), 0)
        assert sum("jump" in x for x in names) <= 2 * n.bit_length() + 4


def test_rows_that_repeat_id_and_text_keep_one(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "x", "c"), (2, "x", "d"), (None, "y", "e"), (None, "y", "e")],
                                 "doc_id bigint, text string, lang string")
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        assert as_rows(drop(docs)) == sorted([(1, "", "b"), (2, "x", "d"), (None, "y", "e")], key=str)
    assert sum(r.kept for r in near_dedup.near_digest(docs).collect()) == 3


def test_fingerprint_digest_apart_from_the_module(spark):
    """The digest and likeness by plain loops."""
    from renalyze.llm import fingerprint as fp

    def plain(text):
        data, counts = text.encode(), [0] * fp.BUCKETS
        for j, k, salt in fp.TRIPLETS:
            for i in range(len(data) - k):
                h = (data[i] * 0x9E3779B1 + data[i + j] * 0x85EBCA77 + data[i + k] * 0xC2B2AE3D + (salt * 0x27D4EB2F & 0xFFFFFFFF)) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                counts[h >> 22] += 1
        q = [sorted(counts)[fp.BUCKETS * k // 4] for k in (1, 2, 3)]
        return [sum(c > x for x in q) for c in counts]

    rng = random.Random(1)
    texts = [words(rng, n) for n in (3, 40, 400)] + ["é日本 " * 30]
    for t in texts:
        assert fp.digest(t)[3:].tolist() == plain(t)
    a, b = fp.digest(texts[1]), fp.digest(texts[2])
    away = sum(abs(int(x) - int(y)) + (fp.CORNER if abs(int(x) - int(y)) == 3 else 0) for x, y in zip(a[3:], b[3:]))
    head = fp.HEADER_WEIGHT * sum(abs(int(x) - int(y)) for x, y in zip(a[:3], b[:3]))
    assert fp.likeness(a, b) == pytest.approx(1 - (away + head) / fp.MOST)
    rows = [(k % 7, t, "l") for k, t in enumerate(texts * 6)] + [(None, "no id", "l"), (None, None, "l")]
    got = fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(fp.digest(e)),
                     round(fp.likeness(fp.digest(t), fp.digest(e)), 9), round(fp.likeness(fp.digest(t), fp.digest(following)), 9)))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=str) \
        == sorted(want, key=str)
