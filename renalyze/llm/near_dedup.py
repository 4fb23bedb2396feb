"""Near-duplicate detection: ProbMinHash, banding, verification.

A document is the weighted set of its five-word shingles (lower-cased
white-space words; weight = 1 + ln of the number of occurrences).  Each element is a Poisson
process with its weight as rate: arrivals come at exponential distances, each
hits a random register, and a register keeps the element that reached it
first.  Two registers agree with the sets' probability Jaccard.  Arrivals are
drawn round by round over all elements of a batch, and an element stops as soon
as its next arrival lies behind its document's latest register, so most
stop after one.  A text with repeated shingles has a second set of registers, drawn
with weights of 1: these agree with plain Jaccard.  For the others both sets are the same.

Registers form bands.  Documents that agree in a band form a bucket; a bucket
proposes its members against its centre (smallest number), so a bucket of any size
costs one pair a member.  Pairs are verified on whole texts: probability
Jaccard, or plain Jaccard, of at least SIMILARITY.  Links are contracted to
classes.  Then members that ended in another class than others of their bucket
are compared within the bucket, each pair only in the first band it shares: by
registers first (of either set), and short texts (to ``EXACT_SHINGLES``) at once by all their shingles.  A
cell returns at most one link a class it joins, never its pairs.  Of long texts, the best
partner in every other class is verified on whole texts, and after contraction every candidate
that still lies in another class, so no candidate between two final classes is left out.
Buckets over ``BUCKET_ROWS`` are first parted by the members' later
bands, so a pair there needs two shared bands, and parts over ``PART_ROWS`` are compared block by block.

Equal texts are collapsed before anything else (a pre-aggregated group), so a
group of copies counts as one document and no link between different texts is lost
to it.  Verification streams sorted rows (a centre, then its members, dealt in
salted runs), so no group is ever held whole.

Defined cases: null text is empty; texts of fewer than five words have one
shingle, all their words; texts without words equal each other only if their text
is equal; rows with equal doc_ids are rows of their own; null doc_ids are
allowed and come last.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, written

SHINGLE = 5
SIMILARITY = 0.8
EXACT_SHINGLES = 1024            # texts of no more shingles are compared within a cell, by all their shingles
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BAND_BYTES = ROWS + 2            # of a band in a node's mini: 8 bits a register, and a 16-bit code
LEAST_AGREEMENT = 0.65           # of registers of either set, for a pair to be verified after the first round (0.8 less 4.7 deviations)
BUCKET_ROWS = 4000               # a larger bucket is parted by its members' later bands
PART_ROWS = 4000                 # and such a part is compared in blocks of as many
RUN_MEMBERS = 256                # members of a centre that are verified in a row

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight): the distinct shingles of each text."""
    import xxhash
    split = [(t or "").lower().split() for t in texts]
    size = np.array([len(x) for x in split], np.int64)
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    hashed = dict.fromkeys(chain.from_iterable(split))
    hashed = dict(zip(hashed, map(xxhash.xxh3_64_intdigest, hashed)))
    h = np.fromiter(map(hashed.__getitem__, chain.from_iterable(split)), np.uint64, n)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(split)), size)
    place = np.arange(n) - first[doc]
    width = np.minimum(size, SHINGLE)[doc]                     # of the document's shingles
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    acc = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        acc = np.where(j < width, acc * _GOLD + padded[j:j + n], acc)
    whole = place + width <= size[doc]
    doc, element = doc[whole], _mix(acc[whole] + width[whole].astype(np.uint64))
    ends = np.cumsum(np.bincount(doc, minlength=len(split)))
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        element[start:end].sort()
    new = np.flatnonzero(np.append(True, (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])))
    return doc[new], element[new], 1.0 + np.log(np.diff(np.append(new, len(doc))))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) elements: who reached each register of each document first (0 for
    a document without elements)."""
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    at, d, x, w = element.copy(), doc, np.zeros(len(doc)), weight
    own, turn = element, 0
    while len(own):
        turn += 1
        at = at + _GOLD
        r = _mix(at)
        x = x - np.log1p(-((r >> np.uint64(11)).astype(float) * 2.0 ** -53)) / w
        cell = d * m + (_mix(r ^ _GOLD) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(x < first[cell])
        order = better[np.argsort(-x[better], kind="stable")]      # the earliest is written last
        first[cell[order]] = x[order]
        who[cell[order]] = own[order]
        if turn < 8 or turn % 8 == 0:                              # an older bound stops later, with the same result
            latest = first.reshape(n, m).max(1)
        go = np.flatnonzero(x < latest[d])
        at, d, x, w, own = at[go], d[go], x[go], w[go], own[go]
    return who.reshape(n, m)


def jaccards(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, Jaccard) of two weighted sets (elements sorted)."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(both) / (len(a) + len(b) - len(both))
    if not len(both):
        return 0.0, plain
    # J_P = sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i): with r = x / y, elements of larger r
    # count x_j / x_i and the others y_j / y_i
    x, y = wa[ia], wb[ib]
    r = x / y
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(r, kind="stable")
    r_s = r[order]
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])   # x of ratio >= each place
    below = np.concatenate([[0.0], np.cumsum(y[order])])
    k = np.searchsorted(r_s, r, "right")
    total = (above[k] + only_x) / x + (below[k] + only_y) / y
    return float((1.0 / total).sum()), plain


# ---------------------------------------------------------------- signatures of distinct texts

def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): t1, t2 name the text."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return src.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")


def _sign(limit: int):
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            doc, element, weight = shingles(texts)
            sig = signatures(doc, element, weight, len(texts))
            some = sig.any(1).tolist()
            long = np.bincount(doc, minlength=len(texts)) > limit
            mini = [row if s else b"" for row, s in zip(_packed(sig), some)]
            again = np.bincount(doc, weight != 1, len(texts)) > 0                    # texts with repeated shingles
            if again.any():
                own = again[doc]
                plain = signatures((np.cumsum(again) - 1)[doc[own]], element[own], np.ones(own.sum()), int(again.sum()))
                for k, x in zip(np.flatnonzero(again).tolist(), _packed(plain)):
                    mini[k] += x
            yield pa.record_batch([b.column("t1"), b.column("t2"), pa.array(mini, pa.binary()), pa.array(long)],
                                  names=["t1", "t2", "mini", "long"])
    return run


def _packed(sig: np.ndarray) -> list[bytes]:
    """8 bits of each register, band by band: a band is its registers' bits and its code."""
    bits = sig.astype(np.uint8).reshape(len(sig), BANDS, ROWS)
    codes = band_codes(sig).view(np.uint8).reshape(len(sig), BANDS, 2)
    return [row.tobytes() for row in np.concatenate([bits, codes], 2)]


def band_codes(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 16-bit codes of the bands of 32-bit registers."""
    parts = (sig & np.uint64(0xFFFFFFFF)).reshape(len(sig), BANDS, ROWS)
    acc = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        acc = acc * _GOLD + parts[:, :, j]
    return (_mix(acc) >> np.uint64(48)).astype("<u2")


def text_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows(doc_id, t1, t2) one a row; nodes(node, t1, t2, mini, long)
    one a distinct text.  ``mini`` has 8 bits of each register and the band codes, BAND_BYTES a band;
    texts with repeated shingles have those of their plain registers behind."""
    texts = _texts(docs)
    rows = written(texts.select("doc_id", "t1", "t2"), "near-rows")
    signed = texts.mapInArrow(_sign(EXACT_SHINGLES), "t1 bigint, t2 bigint, mini binary, long boolean")
    nodes = signed.groupBy("t1", "t2").agg(*[F.first(c).alias(c) for c in ("mini", "long")])
    return rows, written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node, long, bucket): one row a band of each node that has shingles, and
    one a band of its plain registers that differs.  A bucket is named by the very bytes by
    which cells tell whether two nodes share a band."""
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("mini") / BAND_BYTES).cast("int") - 1)).alias("place")
    each = nodes.where(F.octet_length("mini") > 0).select("node", "long", "mini", place)
    key = lambda k: F.substring("mini", k * BAND_BYTES + 1, F.lit(BAND_BYTES))
    each = each.where((F.col("place") < BANDS) | (key(F.col("place")) != key(F.col("place") - BANDS)))
    each = each.select((F.col("place") % BANDS).alias("band"), "node", "long", key(F.col("place")).alias("key"))
    return each.select("band", "node", "long", F.xxhash64("band", "key").alias("bucket"))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, long, centre, n): the bands' buckets with two members or more."""
    each = _bands(nodes)
    shared = written(each.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n"))
                         .where("n > 1").select("bucket", "centre", "n"), "near-buckets")
    return written(each.join(_dealt(shared), "bucket"), "near-members")


def _dealt(side: DataFrame) -> DataFrame:
    """``side`` of a join, to be shuffled and merged at every size: it grows with
    the documents, so it is not to be broadcast while it happens to be small."""
    return side.hint("merge")


# ---------------------------------------------------------------- verification

def _verify(batches):
    """Rows sorted by (a, run, role): a's text (role 0), then its members' (role 1)."""
    centre, key = None, None
    for batch in batches:
        a, run, role, b = (batch.column(c).to_pylist() for c in ("a", "run", "role", "b"))
        doc, element, weight = shingles(batch.column("text").to_pylist())
        bounds = np.searchsorted(doc, np.arange(len(a) + 1))
        out = []
        for k in range(len(a)):
            own = slice(bounds[k], bounds[k + 1])
            if role[k] == 0:
                centre, key = (element[own].copy(), weight[own].copy()), (a[k], run[k])
            elif key == (a[k], run[k]) and max(jaccards(*centre, element[own], weight[own])) >= SIMILARITY:
                out.append((a[k], b[k]))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def _texts_of(used: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``used`` (node)."""
    ids = written(nodes.join(used, "node", "left_semi").select("node", "t1", "t2"), "near-used")
    return texts.select("t1", "t2", "text").join(_dealt(ids), ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The (a, b) pairs of nodes whose whole texts are similar enough."""
    runs = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("r"))
                        .join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
                        .select("a", "b", (F.col("r") % F.ceil(F.col("n") / RUN_MEMBERS)).alias("run")), "near-pairs")
    members = runs.select("a", "run", F.lit(1).alias("role"), "b", F.col("b").alias("node"))
    heads = runs.select("a", "run").distinct().select("a", "run", F.lit(0).alias("role"), F.col("a").alias("b"), F.col("a").alias("node"))
    rows = _dealt(members.unionByName(heads)).join(text, "node").select("a", "run", "role", "b", "text")
    dealt = rows.repartition("a", "run").sortWithinPartitions("a", "run", "role")
    return dealt.mapInArrow(_verify, "a bigint, b bigint")


# ---------------------------------------------------------------- classes

def _jumped(up: DataFrame, name: str) -> DataFrame:
    """Pointers (root, up) that lead on, moved ahead until each points at a root
    that points at itself: a path of n pointers takes log2(n) jumps."""
    jump = 0
    while True:
        ahead = up.select(F.col("root").alias("up"), F.col("up").alias("far"))
        far = written(up.join(ahead, "up").select("root", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), f"{name}-jump-{jump}")
        up = far.select("root", "up")
        if far.where("moved").isEmpty():
            return up
        jump += 1


def contracted(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): connected components, by
    hooking each node to its smallest neighbour, jumping along the pointers, and contracting."""
    links = written(links.select("a", "b").distinct(), f"{name}-links")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both(links).select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), f"{name}-labels")
    turn = 0
    while not links.isEmpty():
        turn += 1
        up = _jumped(written(both(links).groupBy("a").agg(F.min("b").alias("low"))
                             .select(F.col("a").alias("root"), F.least("a", "low").alias("up")), f"{name}-up-{turn}"), f"{name}-up-{turn}")
        labels = written(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels-{turn}")
        a, b = up.select(F.col("root").alias("a"), F.col("up").alias("a2")), up.select(F.col("root").alias("b"), F.col("up").alias("b2"))
        links = written(links.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                             .where("a < b").distinct(), f"{name}-links-{turn}")
    return labels


def _elements(batches):
    """The shingles of texts, and their weights where some are not 1."""
    for b in batches:
        texts = b.column("text").to_pylist()
        doc, element, weight = shingles(texts)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        own = [slice(x, y) for x, y in zip(bounds, bounds[1:])]
        yield pa.record_batch([b.column("node"), pa.array([element[x].tobytes() for x in own], pa.binary()),
                               pa.array([weight[x].tobytes() if (weight[x] != 1).any() else None for x in own], pa.binary())],
                              names=["node", "elements", "weights"])


def _similar(k: int, others: np.ndarray, own: list, code: list, weight: list, seen: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose shingles are similar enough to k's.  ``code``
    numbers the cell's shingles and ``seen`` is a False for each number."""
    seen[code[k]] = True
    sizes = np.array([len(code[j]) for j in others])
    shared = np.add.reduceat(seen[np.concatenate([code[j] for j in others])], np.cumsum(sizes) - sizes, dtype=np.int64)
    seen[code[k]] = False
    hit = shared / (len(code[k]) + sizes - shared) >= SIMILARITY
    ones = lambda j: np.ones(len(own[j])) if weight[j] is None else weight[j]
    for i in np.flatnonzero(~hit).tolist():
        j = others[i]
        if weight[k] is not None or weight[j] is not None:     # with weights of 1 both measures are the same
            hit[i] = max(jaccards(own[k], ones(k), own[j], ones(j))) >= SIMILARITY
    return others[hit]


def _register_sets(minis: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(registers, band keys) of some nodes, and those of plain registers if any node has its own."""
    size = BANDS * BAND_BYTES
    ends = [slice(0, size), slice(-size, None)] if any(len(x) > size for x in minis) else [slice(0, size)]
    sets = [np.frombuffer(b"".join(x[e] for x in minis), np.uint8).reshape(len(minis), BANDS, BAND_BYTES) for e in ends]
    whole = [np.concatenate([x, np.zeros((len(minis), BANDS, 8 - BAND_BYTES), np.uint8)], 2).view("<u8")[:, :, 0] for x in sets]
    return [(np.ascontiguousarray(x[:, :, :ROWS]).reshape(len(minis), REGISTERS), key) for x, key in zip(sets, whole)]


def _partners(every: bool):
    """A function of one cell: links between short texts, compared here by their
    shingles, and pairs to verify for the long ones (the best partner in every other
    class, or every partner).  Open members (outside the largest class) are compared with all
    others, each pair where its first shared bands are the cell's."""
    def run(t: pa.Table) -> pa.Table:
        node, long, opened = (t[c].to_numpy(zero_copy_only=False) for c in ("node", "long", "open"))
        sets = _register_sets(t["mini"].to_pylist())
        wanted = [x for x in (t["band"][0].as_py(), t["later"][0].as_py()) if x >= 0]
        of = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        left, right = t["left"].to_numpy(zero_copy_only=False), np.flatnonzero(t["right"].to_numpy(zero_copy_only=False))
        if t["whole"][0].as_py():                              # no cell of several: the largest class is known here only
            left = opened = of != np.bincount(of).argmax()
        if not every:
            own = [np.frombuffer(x or b"", np.uint64) for x in t["elements"].to_pylist()]
            weight = [x if x is None else np.frombuffer(x) for x in t["weights"].to_pylist()]
            number = np.unique(np.concatenate(own), return_inverse=True)[1]
            code = np.split(number, np.cumsum([len(x) for x in own])[:-1])
            seen = np.zeros(len(number), bool)
        sure: list[tuple[int, int]] = []
        unsure: set[tuple[int, int]] = set()
        for k in np.flatnonzero(left).tolist():
            others = right[(of[right] != of[k]) & (~opened[right] | (node[right] > node[k]))]
            if every and not long[k]:
                others = others[long[others]]
            equal = np.max([np.count_nonzero(r[others] == r[k], axis=1) for r, _ in sets], axis=0)
            near = equal >= LEAST_AGREEMENT * REGISTERS
            others, equal = others[near], equal[near]
            bands = np.any([c[others] == c[k] for _, c in sets], axis=0)
            rank = np.cumsum(bands, 1)
            here = np.all([bands[:, x] & (rank[:, x] == i + 1) for i, x in enumerate(wanted)], axis=0)
            others, equal = others[here], equal[here]
            short = ~long[others] & ~long[k]
            if not every and short.any():
                for j in _similar(k, others[short], own, code, weight, seen).tolist():
                    if of[j] != of[k]:
                        of[of == of[j]] = of[k]
                        sure.append((node[k], node[j]))
            others, equal = others[~short], equal[~short]
            if not every:
                best = np.lexsort((-equal, of[others]))
                others = others[best[np.unique(of[others[best]], return_index=True)[1]]]
            unsure.update((node[k], node[j]) for j in others.tolist())
        out = [(int(min(x)), int(max(x)), True) for x in sure] + [(int(min(x)), int(max(x)), False) for x in unsure]
        return pa.table({c: pa.array([x[i] for x in out], kind)
                         for i, (c, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())))})
    return run


def _open_cells(members: DataFrame, nodes: DataFrame, labels: DataFrame, long_only: bool) -> DataFrame:
    """(cell, band, later, node, long, root, left, right, open, whole) of the buckets that
    hold more than one class (and a long text, if ``long_only``).  Larger buckets are parted
    by the later bands of their members.  A part over PART_ROWS becomes a grid of cells, blocks
    of its open members against blocks of all members, so each cell is bounded and no pair is left out."""
    placed = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed.select("bucket", "band", "n", "node", "long", "root"), "near-placed")
    split = (placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("long").alias("any_long"))
                   .where((F.col("x") < F.col("y")) & (F.col("any_long") | F.lit(not long_only))))
    rows = placed.join(written(split.select("bucket"), "near-open"), "bucket")
    kept = ["band", "later", "node", "long", "root"]
    small = rows.where(F.col("n") <= BUCKET_ROWS).select(F.col("bucket").alias("cell"), F.lit(-1).alias("later"), "band", "node", "long", "root")
    large = rows.where(F.col("n") > BUCKET_ROWS).select("bucket", "band", "node", "long", "root")
    other = members.select(F.col("band").alias("later"), "node", F.col("bucket").alias("other"))
    parts = (large.join(other, "node").where("later > band")
                  .select(F.xxhash64("bucket", "other").alias("cell"), *kept))
    parts = written(parts, "near-parted")
    sizes = (parts.groupBy("cell", "root").agg(F.count("*").alias("c"), F.max("long").alias("long")).groupBy("cell")
                  .agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("classes"), F.max("long").alias("any_long")))
    sizes = written(sizes.where((F.col("classes") > 1) & (F.col("any_long") | F.lit(not long_only))).select(
        "cell", F.col("top.root").alias("top"), F.ceil(F.col("n") / PART_ROWS).alias("high"),
        F.ceil((F.col("n") - F.col("top.c")) / PART_ROWS).alias("wide")), "near-parts")
    parts = parts.join(sizes, "cell")
    alone = [F.lit(True).alias(c) for c in ("left", "right", "open", "whole")]
    plain = small.select("cell", *kept).unionByName(parts.where("high = 1").select("cell", *kept)).select("*", *alone)
    cut = parts.where("high > 1").withColumn("open", F.col("root") != F.col("top"))
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    sides = [cut.where("open").withColumns({"i": block(0, "wide"), "left": F.lit(True)}).withColumn("j", upto("high")),
             cut.withColumns({"j": block(1, "high"), "left": F.lit(False)}).withColumn("i", upto("wide"))]
    cells = [x.select(F.xxhash64("cell", "i", "j").alias("cell"), *kept, "left",
                      (~F.col("left")).alias("right"), "open", F.lit(False).alias("whole")) for x in sides]
    return plain.unionByName(cells[0]).unionByName(cells[1])


def proposed(members: DataFrame, nodes: DataFrame, text: DataFrame, labels: DataFrame, every: bool) -> DataFrame:
    """(a, b, sure): links found in the cells, and pairs to verify."""
    cells = written(_open_cells(members, nodes, labels, every), "near-cells")
    load = cells.select("node", "long").distinct()
    minis = nodes.select("node", "mini")
    if not every:
        short = text.join(_dealt(load.where("not long").select("node")), "node", "left_semi")
        minis = minis.join(_dealt(load.select("node")), "node", "left_semi")
        minis = minis.join(_dealt(short.mapInArrow(_elements, "node bigint, elements binary, weights binary")), "node", "left")
    loaded = cells.join(_dealt(written(minis, "near-minis") if not every else minis), "node")
    return loaded.groupBy("cell").applyInArrow(_partners(every), "a bigint, b bigint, sure boolean").distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, class_id (smallest doc_id), class_size and kept of every row."""
    texts = _texts(docs)
    rows, nodes = text_nodes(docs)
    members = bucket_rows(nodes)
    tried = written(members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "near-tried")
    # only these rows' texts are moved: every later round's pairs are of them
    text = written(_texts_of(members.select("node").distinct(), nodes, texts), "near-texts")
    links = written(verified(tried, text), "near-links")
    labels = contracted(links, "near-0")
    # first all short texts, and the best partners of long ones; then every candidate left of the long ones
    for name, every in (("best", False), ("rest", True)):
        found = written(proposed(members, nodes, text, labels, every), f"near-proposed-{name}")
        sure = found.where("sure").select("a", "b")
        fresh = written(found.where("not sure").select("a", "b").join(tried, ["a", "b"], "left_anti"), f"near-fresh-{name}")
        if not fresh.isEmpty():
            sure = sure.unionByName(verified(fresh, text))
            tried = tried.unionByName(fresh)
        sure = written(sure, f"near-found-{name}")
        if not sure.isEmpty():
            links = links.unionByName(sure)
            labels = contracted(links, f"near-{name}")
    named = rows.join(nodes.select("t1", "t2", "node"), ["t1", "t2"]).join(labels, "node", "left")
    # the row number tells apart rows that repeat both doc_id and text; it is drawn once and fixed by writing
    named = written(named.select("doc_id", "t1", "t2", F.coalesce("root", "node").alias("root"),
                                 F.monotonically_increasing_id().alias("rid")), "near-named")
    classes = written(named.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t1", "t2", "rid")).alias("top"),
        F.count("*").alias("class_size")), "near-classes")
    return named.join(classes, "root").select(
        "doc_id", "t1", "t2", F.col("top.doc_id").alias("class_id"), "class_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"))


def near_digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept of every document."""
    return near_classes(docs).select("doc_id", "class_id", "class_size", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id.  Of rows
    that repeat both doc_id and text (null as empty) the greatest by their columns stays."""
    kept = written(near_classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct(), "near-kept")
    t = F.coalesce(docs["text"], F.lit(""))
    hit = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(t) == kept["_t1"]) & (F.xxhash64(F.lit(1), t) == kept["_t2"]), "left_semi")
    return one_of_each(hit)
