"""The training-data operators against brute force on small fixtures: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from renalyze.llm import (bpe, exact_dedup, fingerprint, langid, line_dedup, near_dedup, packing, quality,
                          substring_dedup, toxicity)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, most=400):
    return " ".join(f"w{rng.randrange(most)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage, line = words(rng, 40), "One  Common line"
    texts = [None, "", " ", "\n\n", "a", words(rng, 9000), "é ñ 日本 <|endoftext|> don't  x\t\ny" * 3]
    texts += [words(rng, rng.randint(3, 200)) for _ in range(12)]
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 20) for _ in range(4)]
    texts += [f"{words(rng, 8)}\n {line} \n{words(rng, 5)}" for _ in range(12)]
    base = words(rng, 300, 10**6).split()
    texts += [" ".join(base), " ".join(base[:150] + ["changed"] + base[151:]), "copy of this", "copy of this", "copy of this"]
    out = [(k, t, "en", None, None) for k, t in enumerate(texts)]
    return out + [(None, "no id", None, "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_line_dedup(docs, rows, empty):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    seen = {}
    for k, (i, t, *_) in enumerate(rows):
        for key in {x.strip(strip).translate(lower) for x in (t or "").split("\n")}:
            seen.setdefault(key, set()).add((i, t))
    common = {key for key, ids in seen.items() if key and len(ids) >= 10}
    assert "one  common line" in common
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(strip).translate(lower) not in common]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = [tuple(r) for r in line_dedup.line_dedup_digest(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.line_dedup_digest(empty).count() == 0
    assert line_dedup.dedup_lines(docs.withColumn("n_lines", docs.doc_id)).columns.count("n_lines") == 1


@pytest.mark.parametrize("size,bits", [(4096, (64,)), (16, (4, 64))])
def test_exact_dedup(docs, rows, size, bits):
    got = exact_dedup.dedup_classes(docs, size, bits).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        own = [r for r in got if r.text_sha256 == sha(t.encode())]
        top = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and sum(r.kept for r in own) == 1
        assert {(r.keep_id, r.group_size) for r in own} == {(top, len(ids))}


def test_exact_dedup_empty(empty):
    assert exact_dedup.dedup_classes(empty).count() == 0


def test_bpe(docs, rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bpe.bpe_digest(docs).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "ab" * 900, "\n" * 99 + " x", "é" * 200, "x\xa0 y   z"])
def test_bpe_long_pieces(text):
    from tokenizers import Tokenizer
    ids = Tokenizer.from_file(bpe.vocabulary_path()).encode(text, add_special_tokens=False).ids
    for kind in (bpe.encoder, bpe.compiled_encoder):
        e = kind(bpe.vocabulary_path())
        assert np.frombuffer(e.encode(text), "<u4").tolist() == ids
    assert e.decode(e.encode(text)) == text


def test_packing(docs, rows, empty):
    p = packing.pack_documents(docs, window=256).toPandas()
    assert (p.groupby("sequence_id").length.sum() <= 256).all()
    q = p.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all()
    known = p[p.doc_id.notna()]
    assert (known.groupby("doc_id").length.sum() == known.groupby("doc_id").doc_tokens.max()).all()
    assert known.doc_id.nunique() == len({r[0] for r in rows if r[0] is not None})
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_matches_plain_search():
    lengths = np.random.default_rng(2).integers(1, 65, 500)
    window, offset = packing.best_fit_decreasing(lengths, 64)
    room, fit = [], []
    for k in np.argsort(-lengths, kind="stable"):
        open_ = [(r, w) for w, r in enumerate(room) if r >= lengths[k]]
        if not open_:
            room.append(64)
            open_ = [(64, len(room) - 1)]
        fit.append(min(open_)[0] - lengths[k])
        room[min(open_)[1]] -= lengths[k]
    assert window.max() + 1 == len(room)


def test_substring_dedup(docs, rows, empty):
    first, split = {}, [(i, substring_dedup.words_of(t)) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k:k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    got = [tuple(r)[:4] for r in substring_dedup.substring_digest(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 40
    assert substring_dedup.substring_digest(empty).count() == 0


def test_near_dedup(docs, rows, empty):
    got = near_dedup.near_digest(docs).collect()
    assert len(got) == len(rows)
    ids = {r[1]: r[0] for r in reversed(rows) if r[0] is not None}
    cls = {r.doc_id: r.class_id for r in got}
    pair = [r[0] for r in rows if r[1] and len(r[1].split()) == 300]
    assert len(pair) == 2 and cls[pair[0]] == cls[pair[1]] == pair[0]
    assert cls[ids["a"]] == ids["a"]
    assert near_dedup.near_digest(empty).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    a, b = np.unique(base[:250]), np.unique(base[30:])
    wa, wb = rng.integers(1, 4, len(a)).astype(float), rng.integers(1, 4, len(b)).astype(float)
    s = near_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    da, db = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    brute = sum(1 / sum(max(da.get(k, 0) / da[i], db.get(k, 0) / db[i]) for k in {*da, *db}) for i in {*da} & {*db})
    exact, _ = near_dedup.jaccards(a, wa, b, wb)
    assert abs(exact - brute) < 1e-9 and abs((s[0] == s[1]).mean() - exact) < 0.05


def test_fingerprints(docs, rows, empty):
    got = fingerprint.fingerprint_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t, *_) in enumerate(order):
        e = fingerprint.edited(t or "", order[(k + 1) % len(order)][1] or "")
        want.append((i, len(t or ""), sha(e.encode()), fingerprint.as_text(fingerprint.digest(t or ""))))
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(want, key=str)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprint.fingerprint_edits(empty).count() == 0
    d = fingerprint.digest("some text of a document")
    assert (fingerprint.from_text(fingerprint.as_text(d)) == d).all() and fingerprint.likeness(d, d) == 1.0


def test_classifiers_on_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(30)], "doc_id bigint, quality int, toxic int")
    for model, score in ((quality.train(docs, labels), quality.score_quality), (toxicity.train(docs, labels), toxicity.score_toxicity),
                         (quality.train(docs, labels.limit(0)), quality.score_quality), (toxicity.train(docs, labels.limit(0)), toxicity.score_toxicity)):
        got = score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert score(empty, model).count() == 0
    got = langid.predict_language(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert all(r.lang_pred == "en" for r in got if r.doc_id == 4)
    assert all(r.lang_pred == "und" for r in langid.predict_language(docs, langid.train(empty)).collect())


def test_held_out_accuracy(spark):
    from renalyze.llm.common import documents, table
    from renalyze.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    for name, column in (("op1_quality", "quality"), ("op7_toxicity", "toxic")):
        held = [(r.predicted, labels[r.doc_id][column]) for r in QUERIES[name](spark, sf).where("held_out").collect() if r.doc_id in labels]
        assert np.mean([a == b for a, b in held]) > 0.9
    lang = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in QUERIES["op3_langid"](spark, sf).where("held_out").collect()]
    assert np.mean(held) > 0.95


def test_near_classes_of_large_buckets(spark, monkeypatch):
    """Many near copies of one text: parted and compared in a grid of cells, against all pairs."""
    rng = random.Random(11)
    base, texts = words(rng, 120, 10**6).split(), []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t, "en", None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    sets = [near_dedup.shingles([t])[1:] for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if max(near_dedup.jaccards(*sets[i], *sets[j])) >= near_dedup.SIMILARITY:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    for bucket, part, exact in ((500, 4000, 1024), (3, 5, 1024), (3, 5, 116)):
        monkeypatch.setattr(near_dedup, "EXACT_SHINGLES", exact)       # with 116, some texts are long
        monkeypatch.setattr(near_dedup, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(near_dedup, "PART_ROWS", part)
        assert {r.doc_id: r.class_id for r in near_dedup.near_digest(docs).collect()} == dict(enumerate(root))


def test_near_classes_of_unequal_repeats(spark):
    """Texts of the same shingles that repeat unequally are near by plain Jaccard alone."""
    rng = random.Random(8)
    texts, sets = [], []
    for _ in range(6):
        a, b = words(rng, 150, 10**6), words(rng, 150, 10**6)
        texts += [" ".join([a] * 200 + [b]), " ".join([a] + [b] * 200)]
    sets = [near_dedup.shingles([t])[1:] for t in texts]
    for k in range(0, 12, 2):
        p, plain = near_dedup.jaccards(*sets[k], *sets[k + 1])
        assert p < 0.35 and plain > 0.9
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.class_id for r in near_dedup.near_digest(docs).collect()} == {k: k // 2 * 2 for k in range(12)}


def test_near_cell_of_unequal_repeats():
    """Inside a cell too, where the centre is not one of the two."""
    rng = random.Random(9)
    parts = [words(rng, 100, 10**6) for _ in range(3)]
    texts = [" ".join(parts), " ".join([parts[0]] * 100 + parts[1:])]
    got = next(near_dedup._sign(near_dedup.EXACT_SHINGLES)([pa.record_batch({"t1": pa.array([1, 2]), "t2": pa.array([1, 2]), "text": pa.array(texts)})]))
    own = next(near_dedup._elements([pa.record_batch({"node": pa.array([1, 2]), "text": pa.array(texts)})]))
    linked = set()
    for band in range(near_dedup.BANDS):
        fixed = {"band": band, "later": -1, "left": True, "right": True, "open": True, "whole": True}
        cell = pa.table({"node": [1, 2], "root": [1, 2], "long": got["long"], "mini": got["mini"],
                         "elements": own["elements"], "weights": own["weights"], **{c: [v, v] for c, v in fixed.items()}})
        linked |= {tuple(r.values()) for r in near_dedup._partners(False)(cell).to_pylist()}
    assert linked == {(1, 2, True)}


def test_near_bands_shared_are_buckets_shared(spark):
    """A cell sees two nodes share a band exactly where they share its bucket, codes that match by chance included."""
    rng = np.random.default_rng(3)
    sig = rng.integers(1, 1 << 60, (2, near_dedup.REGISTERS), np.uint64)
    sig[1, 80:] = sig[0, 80:]                                  # bands 20 and on are shared
    first = np.repeat(sig[:1], 1 << 18, 0)
    first[:, 3] = rng.integers(1, 1 << 60, len(first), np.uint64)
    codes = near_dedup.band_codes(first)[:, 0]
    sig[0, :4] = first[np.flatnonzero(codes == near_dedup.band_codes(sig)[1, 0])[0], :4]
    minis = near_dedup._packed(sig)
    _, keys = near_dedup._register_sets(minis)[0]
    nodes = spark.createDataFrame([(0, False, minis[0]), (1, False, minis[1])], "node bigint, long boolean, mini binary")
    rows = near_dedup._bands(nodes).collect()
    buckets = [{r.band: r.bucket for r in rows if r.node == k} for k in (0, 1)]
    met = [buckets[0][b] == buckets[1][b] for b in range(near_dedup.BANDS)]
    assert (keys[0] == keys[1]).tolist() == met == [b >= 20 for b in range(near_dedup.BANDS)]


def test_substring_buckets_grow_with_the_text(docs, monkeypatch):
    """At a fixed number of partitions the text behind a bucket stays bounded, with the same results."""
    for gb in (1, 30, 1000):
        size = gb << 30
        assert size / substring_dedup._counts(8, size)[1] <= substring_dedup.BUCKET_BYTES
    want = sorted(map(str, substring_dedup.substring_digest(docs).collect()))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 300)
    assert sorted(map(str, substring_dedup.substring_digest(docs).collect())) == want


def test_rare_language_is_learned(spark):
    """Four documents of 2,000 are enough to be in the sample, and a hot language leaves the others their share."""
    from renalyze.llm import learning
    rng = random.Random(6)
    rows = [(k, words(rng, 12) if k % 500 else "zorb quix vlar " * 4, "en" if k % 500 else "xx", None, None) for k in range(1, 2001)]
    rows += [(k, "rare text", "yy", None, None) for k in range(3000, 3150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sample = learning.sample_of_each(docs.select("doc_id", docs.lang.alias("label")), docs, 40)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {"xx": 4, "yy": 18, "en": 18}
    assert learning.shares({"a": 1000, "b": 3, "c": 5}, 100) == {"b": 3, "c": 5, "a": 92}
    assert learning.shares({"a": 9, "b": 9, "c": 9}, 2) == {"a": 1, "b": 1, "c": 1}
    assert "xx" in langid.train(docs, 40).langs
