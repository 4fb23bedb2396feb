"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; its rate (target / size) is the
expected number of copies of each of its documents.  The whole part of the
rate is taken outright; the fraction is a copy probability, and these are
rounded together: two documents with fractional probabilities exchange words of
probability mass until one of them is taken or left for good, the direction
drawn so that each one's expectation stays what it was.  The exchange keeps the
source's expected words exactly, so what is taken differs from the target by
less than the one document that is left at the end.

The exchanges form a reduction tree: the documents of a source, largest first,
are numbered by a distributed rank and meet in groups of GROUP; a group settles
all its documents but one, whose residual probability goes on to the next
level.  N documents need log(N) / log(GROUP) levels, and no group is larger than
GROUP however large a source is.  All of it is DataFrame functions: the group's
exchange is one fold over an array of at most GROUP entries.

Draws come from hashes of (seed, doc_id, text hash, level), and ranks from the
rows' contents, so reruns agree on any partitioning (rows equal in source, size,
doc_id and text are interchangeable).

Defined cases: a null text has no words; a document without words takes 0; a
null source is a source of its own, the last; null doc_ids are allowed;
repeated rows are documents of their own; an empty table has no rows; further
columns are ignored, only the three named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .ranking import ranked, same

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)              # of the sources in code point order, repeating
SHARE = 1.5                      # words of the mix over words of all documents
MOST_COPIES = 2                  # a target's bound, in sizes of its source
GROUP = 64                       # documents that exchange mass in one fold
SEED = 13


def sizes(docs: DataFrame) -> DataFrame:
    """rid (a row number), doc_id, source, size (words) and hash (of the text) of every row, written."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
                               F.xxhash64("text").alias("hash")), "sizes")


def shares(sources: DataFrame, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: ``share`` of all sizes,
    divided by weight, no target above ``most`` times its source's size.

    Each round is one aggregate: sources at their bound keep it, the rest
    share what is left by weight, until no further one is above its bound.
    """
    cap = F.col("source_size") * float(most)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, before = -1.0, None
    while True:
        held = cap <= F.col("weight") * F.lit(level)
        r = sources.agg(F.coalesce(F.sum(F.when(held, cap)), F.lit(0.0)).alias("held"), F.count(F.when(held, 1)).alias("n"),
                        F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        if not r["free"] or r["n"] == before:
            break
        level, before = max(0.0, (total - r["held"]) / r["free"]), r["n"]
    even = cap if not r["free"] else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", even)


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target of every source of ``rows`` (source, size)."""
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"))
                          .withColumn("last", F.col("source").isNull()), "sources")
    placed = ranked(sources, [], [F.col("last").asc(), F.col("source").asc()], "source-order")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    return written(shares(written(placed.withColumn("weight", weight), "source-weights"), share, most)
                   .select("source", "source_size", "target"), "targets")


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once (a one-row transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(2 ** 53))


def _exchange(open_: Column, other: Column) -> Column:
    """The pair after one exchange of mass: (settled, open), of structs
    (rid, size, p, draw).  ``draw`` of ``other`` decides the direction."""
    # words that can move to the first, and to the second, until one is integral
    up = F.least(open_["size"] * (1 - open_["p"]), other["size"] * other["p"])
    down = F.least(open_["size"] * open_["p"], other["size"] * (1 - other["p"]))

    def moved(m: Column) -> Column:
        to_first = other["draw"] * (m["up"] + m["down"]) < m["down"]
        p, q = open_["p"], other["p"]
        first = F.when(to_first, F.when(open_["size"] * (1 - p) <= other["size"] * q, 1.0).otherwise(p + m["up"] / open_["size"])) \
                 .otherwise(F.when(open_["size"] * p <= other["size"] * (1 - q), 0.0).otherwise(p - m["down"] / open_["size"]))
        second = F.when(to_first, F.when(other["size"] * q <= open_["size"] * (1 - p), 0.0).otherwise(q - m["up"] / other["size"])) \
                  .otherwise(F.when(other["size"] * (1 - q) <= open_["size"] * p, 1.0).otherwise(q + m["down"] / other["size"]))
        return F.struct(_with(open_, first).alias("a"), _with(other, second).alias("b"))

    def ordered(pair: Column) -> Column:
        settled = _integral(pair["a"]["p"])
        return F.struct(F.when(settled, pair["a"]).otherwise(pair["b"]).alias("settled"),
                        F.when(settled, pair["b"]).otherwise(pair["a"]).alias("open"))

    return _let(_let(F.struct(up.alias("up"), down.alias("down")), moved), ordered)


def _integral(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _with(doc: Column, p: Column) -> Column:
    return F.struct(doc["rid"].alias("rid"), doc["size"].alias("size"), p.alias("p"), doc["draw"].alias("draw"))


def _settle(members: Column) -> Column:
    """All members of a group with their probabilities after the exchanges,
    the one that may still be fractional last."""
    def step(state: Column, doc: Column) -> Column:
        pair = _exchange(state["open"], doc)
        fresh = F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), doc.alias("open"))
        exchanged = _let(pair, lambda x: F.struct(F.concat(state["done"], F.array(x["settled"])).alias("done"), x["open"].alias("open")))
        return F.when(_integral(state["open"]["p"]), fresh).otherwise(exchanged)

    first = F.element_at(members, 1)
    start = F.struct(F.slice(members, 1, 0).alias("done"), first.alias("open"))
    return F.aggregate(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), start, step,
                       lambda s: F.concat(s["done"], F.array(s["open"])))


def rounded(items: DataFrame, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """source, rid, p (0 or 1) of ``items``: a written table (source, pos, n, rid,
    size > 0, p in (0, 1), key), where pos numbers a source's n items."""
    most = items.agg(F.max("n")).first()[0] or 0
    done, level, open_ = [], 0, items
    while True:
        placed = open_.select("source", F.expr(f"pos div {group}").alias("slot"), F.ceil(F.col("n") / group).alias("n"),
                              F.struct("pos", "rid", "size", "p", _draw(seed, F.lit(level), F.col("key")).alias("draw"), "key").alias("doc"))
        sets = placed.groupBy("source", "slot").agg(F.array_sort(F.collect_list("doc")).alias("docs"), F.first("n").alias("n"))
        plain = F.transform("docs", lambda d: F.struct(d["rid"].alias("rid"), d["size"].alias("size"), d["p"].alias("p"), d["draw"].alias("draw")))
        settled = sets.select("source", "slot", "n", _settle(plain).alias("out"), F.element_at("docs", 1)["key"].alias("key"))
        settled = written(settled, f"settled-{level}")
        done.append(settled.select("source", F.explode(F.slice("out", 1, F.size("out") - 1)).alias("d"))
                           .select("source", "d.rid", "d.p"))
        last = settled.select("source", F.col("slot").alias("pos"), "n", F.element_at("out", -1).alias("d"), "key")
        open_ = last.select("source", "pos", "n", "d.rid", "d.size", "d.p", "key")
        most, level = -(-most // group), level + 1
        if most <= 1:
            break
    final = F.when(_draw(seed, F.lit(level), F.col("key")) < F.col("p"), 1.0).otherwise(0.0)
    out = open_.select("source", "rid", final.alias("p"))
    for d in done:
        out = out.unionByName(d)
    return out.select("source", "rid", "p")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
        group: int = GROUP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to ``most``) of every row."""
    rows = sizes(docs)
    aims = targets(rows, weights, share, most).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = written(rows.join(aims, same(rows, aims, {"source": "_source"})).drop("_source")
                        .withColumn("whole", F.floor(rate)).withColumn("p", rate - F.col("whole")), "rated")
    items = written(rated.where((F.col("size") > 0) & (F.col("p") > 0))
                         .select("source", "rid", "doc_id", "hash", "size", "p",
                                 F.xxhash64(F.lit(seed), "doc_id", "hash").alias("key")), "fractional")
    order = [F.col("size").desc(), *[F.col(c).asc() for c in ("key", "doc_id", "hash", "rid")]]
    placed = written(ranked(items, ["source"], order, "mass-order"), "mass")
    last = rounded(placed, group, seed).select(F.col("rid").alias("_rid"), F.col("p").alias("_more"))
    out = rated.join(last, rated["rid"] == last["_rid"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (F.col("whole") + F.coalesce("_more", F.lit(0.0))).cast("long").alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
