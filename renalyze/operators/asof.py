"""Features of a patient's history as of every reading that arrives.

A reading's value stands from its arrival until its date is overwritten, a
difference between neighbouring readings until one of them is overwritten or a
date between them arrives.  So every feature at a moment is a summary of the
intervals that cover it: counts and sums are running sums of their ends, the
extremes, the most recent reading and the largest step are maxima over covering
intervals, and the median is an order statistic of what has come and not gone.

Patients of at most BLOCK readings are computed many at a time as arrays, one
shuffle by patient.  A larger patient is split: its arrivals are cut into blocks
(BLOCK, or the square root of its readings if that is more), the intervals are
built by joins, and each block is computed apart from

* the intervals that begin or end in it;
* one row that sums up the intervals covering it whole: an interval is kept at
  the few nodes of a binary tree over the blocks that make it up, and a block
  reads the nodes above it;
* the values that can become its median: those whose rank at the block's
  start is within a block of the middle, found by counting standing values per
  (block, block of values).

So a task holds a few blocks of one patient, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURE_COLUMNS
from . import vectors as V
from .positions import ranked, written

BLOCK = 1 << 16                  # readings of a patient that are computed as one piece
BATCH = 1 << 16                  # rows of whole patients that are computed at once
FEATURES = "n_readings bigint, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)


# --- arrays ------------------------------------------------------------------

def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        r = x / y
    return np.where((y == 0) & (x == 0), 0.0, r)


def summaries(first: np.ndarray, end_of: np.ndarray, value: dict, step: dict, window: dict, base: dict) -> dict[str, np.ndarray]:
    """Features at every moment.  ``first`` / ``end_of``: the segment of each.

    ``value``: intervals start, end, v, code (orders a segment's values by
    date), fresh (came at start; else stood before the segment).
    ``step``: intervals start, end, v.  ``window``: v and the first moment ``at`` of their
    segment, for the values that stood before and may become the median; ``base``,
    per moment: what covers the whole segment (cnt, s1, s2, up, down,
    low, high, code, recent, step), the ``center`` of the sums, and ``below``, the number
    of earlier values that lie under the window.
    """
    n = len(first)
    s, e, v = value["start"], value["end"], value["v"]
    gone = e < end_of[s] if len(s) else np.zeros(0, bool)

    def running(x: np.ndarray) -> np.ndarray:
        add = np.zeros(n, np.longdouble)
        np.add.at(add, s, x)
        np.subtract.at(add, e[gone], x[gone])
        return V.segment_sums(first, add)

    finite = np.isfinite(v)
    x = np.where(finite, v, 0).astype(np.longdouble) - np.where(finite, base["center"][s] if len(s) else 0, 0)
    cnt = (running(np.ones(len(v))) + base["cnt"]).astype(np.int64)
    s1, s2 = running(x) + base["s1"], running(x * x) + base["s2"]
    up, down = running(v == np.inf) + base["up"], running(v == -np.inf) + base["down"]
    some = cnt > 0
    c = np.maximum(cnt, 1)
    mean = (s1 / c + base["center"]).astype(float)
    std = np.sqrt(np.maximum(s2 - s1 * s1 / c, 0) / np.maximum(c - 1, 1)).astype(float)
    odd = (up > 0) | (down > 0)
    mean = np.where(odd, np.where((up > 0) & (down > 0), np.nan, np.where(up > 0, np.inf, -np.inf)), mean)
    std = np.where(odd & (cnt > 1), np.nan, std)

    # the median: events in order of time, at one moment first what stood before, then what goes, then what comes
    fresh = value["fresh"]
    at = np.concatenate([window["at"], e[gone], s[fresh]])
    kind = np.repeat([0, 1, 2], [len(window["at"]), gone.sum(), fresh.sum()])
    vals, rank = np.unique(np.concatenate([window["v"], v[gone], v[fresh]]), return_inverse=True)
    sign = np.where(kind == 1, -1, 1)
    order = np.lexsort((kind, at))
    at, rank, sign = at[order], rank[order], sign[order]
    moments = np.flatnonzero(some)
    lo, hi = np.searchsorted(at, first[moments], "left"), np.searchsorted(at, moments, "right")
    mid = [V.kth_in_prefix(rank, sign, lo, hi, k - base["below"][moments]) for k in ((cnt[moments] - 1) // 2, cnt[moments] // 2)]
    median = np.zeros(n)
    if len(moments):
        a, b = (vals[np.minimum(m, len(vals) - 1)] for m in mid)
        median[moments] = np.where(a == b, a, (a + b) / 2.0)

    high = np.maximum(V.covering_max(n, s, e, v, -np.inf), base["high"])
    low = -np.maximum(V.covering_max(n, s, e, -v, -np.inf), -base["low"])
    code = V.covering_max(n, s, e, value["code"], -1)
    by_code = np.argsort(value["code"], kind="stable")
    codes = value["code"][by_code]
    recent = base["recent"].astype(float).copy()
    own = code > base["code"]
    if len(codes):
        # a code's versions follow each other; the one that stands is the last to start
        key = np.lexsort((s, value["code"]))
        k = V.last_at_most(codes * (n + 1) + s[key], code * (n + 1) + np.arange(n))
        recent = np.where(own, v[key][np.maximum(k, 0)], recent)
    delta = np.maximum(V.covering_max(n, step["start"], step["end"], step["v"], -np.inf), base["step"])
    out = {
        "creatinine_mean": mean, "creatinine_median": median, "creatinine_max": high, "creatinine_min": low,
        "creatinine_max_delta": np.where(delta == -np.inf, 0.0, delta), "creatinine_std": np.where(cnt > 1, std, 0.0),
        "most_recent": recent, "rv1_ratio": _ratio(recent, low), "rv2_ratio": _ratio(recent, median)}
    return {"n_readings": cnt, **{k: np.where(some, v, 0.0) for k, v in out.items()}}


def _nothing(n: int, center: np.ndarray) -> dict[str, np.ndarray]:
    """The base of a segment that begins with its patient."""
    zero = np.zeros(n)
    return {**dict.fromkeys(("cnt", "s1", "s2", "up", "down", "recent"), zero), "below": np.zeros(n, np.int64),
            "low": np.full(n, np.inf), "high": np.full(n, -np.inf), "step": np.full(n, -np.inf), "code": np.full(n, -1),
            "center": center}


def whole_histories(patient: np.ndarray, date: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Features and ``repeat`` at every row of whole patients: rows by patient
    and arrival; ``patient`` grows with the rows, ``date`` is a number, NaN a missing value."""
    n = len(patient)
    first, end_of = np.searchsorted(patient, patient, "left"), np.searchsorted(patient, patient, "right")
    rows = np.lexsort((np.arange(n), date, patient))
    new = np.r_[True, (patient[rows][1:] != patient[rows][:-1]) | (date[rows][1:] != date[rows][:-1])] if n else np.zeros(0, bool)
    date_id = np.empty(n, np.int64)
    date_id[rows] = np.cumsum(new) - 1
    ends = end_of.copy()
    again = np.zeros(n, bool)
    if n:
        later = ~new[1:]
        ends[rows[:-1][later]] = rows[1:][later]
        before, now = value[rows[:-1]][later], value[rows[1:]][later]
        again[rows[1:][later]] = (before == now) | (np.isnan(before) & np.isnan(now))
    ok = np.flatnonzero(~np.isnan(value))
    finite = np.flatnonzero(np.isfinite(value))
    at = np.searchsorted(finite, first, "left")                  # the patient's first finite value centers its sums
    has = at < len(finite)
    center = np.where(has, value[finite[np.minimum(at, len(finite) - 1)]] if len(finite) else 0.0, 0.0)
    start, end, step = V.step_intervals(date_id, first, end_of, value)
    out = summaries(first, end_of, {"start": ok, "end": ends[ok], "v": value[ok], "code": date_id[ok], "fresh": np.ones(len(ok), bool)},
                    {"start": start, "end": end, "v": step}, {"at": np.zeros(0, int), "v": np.zeros(0)}, _nothing(n, center))
    return {"repeat": again, **out}


# --- patients of one piece ---------------------------------------------------

def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by mrn, regrouped so that no patient is cut."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size < BATCH:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else b
        cut = int(np.argmax((whole["mrn"] == whole["mrn"].iloc[-1]).to_numpy()))
        if cut:
            yield whole.iloc[:cut]
            whole = whole.iloc[cut:]
        held, size = [whole], len(whole)
    if held:
        whole = pd.concat(held, ignore_index=True)
        if len(whole):
            yield whole


def _whole(keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            patient = np.r_[0, np.cumsum(b["mrn"].to_numpy()[1:] != b["mrn"].to_numpy()[:-1])]
            got = whole_histories(patient, b["_date"].to_numpy(np.int64), b["_value"].to_numpy(float, na_value=np.nan))
            out = b[keep].reset_index(drop=True).assign(**got)
            yield out[b["_live"].to_numpy(bool)]
    return run


# --- patients in blocks -------------------------------------------------------

def _neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """A run of dates: the nearest earlier-born dates on both sides within it."""
    pdf = pdf.sort_values("date_id", ignore_index=True)
    f, ids = pdf["born"].to_numpy(), pdf["date_id"].to_numpy()
    n, zero = len(f), np.zeros(len(f), int)
    left, right = V.nearest_smaller(f, zero), V.nearest_smaller(f[::-1], zero)[::-1]
    return pdf.assign(lft=pd.arrays.IntegerArray(ids[left], left < 0),
                      rgt=pd.arrays.IntegerArray(ids[np.where(right < 0, 0, n - 1 - right)], right < 0))


def _resolved(dates: DataFrame, side: str) -> DataFrame:
    """(mrn, date_id, found): for dates without an earlier-born neighbour in
    their own run on one side, the nearest one in the runs beyond."""
    minima = dates.groupBy("mrn", "run").agg(F.min("born").alias("low")).select(F.col("mrn").alias("_m"), F.col("run").alias("_run"), "low")
    beyond = (F.col("_run") < F.col("run")) if side == "lft" else (F.col("_run") > F.col("run"))
    nearest = F.max("_run") if side == "lft" else F.min("_run")
    asked = (dates.where(F.col(side).isNull()).join(minima, (F.col("mrn") == F.col("_m")) & beyond & (F.col("low") < F.col("born")))
                  .groupBy("mrn", "date_id", "born").agg(nearest.alias("target")))
    # in that run only the dates without an earlier-born one between them and its near end can be it
    other = "rgt" if side == "lft" else "lft"
    chain = dates.where(F.col(other).isNull()).select(F.col("mrn").alias("_m"), F.col("run").alias("_run"), F.col("date_id").alias("_d"), F.col("born").alias("_b"))
    hit = asked.join(chain, (F.col("mrn") == F.col("_m")) & (F.col("target") == F.col("_run")) & (F.col("_b") < F.col("born")))
    return hit.groupBy("mrn", "date_id").agg((F.max("_d") if side == "lft" else F.min("_d")).alias("found"))


def _neighbourhoods(versions: DataFrame) -> DataFrame:
    """(mrn, a, b, since, until, n, w): dates a and b of a patient, next to each other from ``since`` to ``until``."""
    dates = versions.groupBy("mrn", "date_id").agg(F.min("i").alias("born"), F.first("n").alias("n"), F.first("w").alias("w"))
    dates = dates.withColumn("run", F.expr("date_id div w"))
    schema = T.StructType(dates.schema.fields + [T.StructField(c, T.LongType()) for c in ("lft", "rgt")])
    own = written(dates.groupBy("mrn", "run").applyInPandas(_neighbours, schema), "asof-dates")
    near = own
    for side in ("lft", "rgt"):
        near = near.join(_resolved(own, side), ["mrn", "date_id"], "left").withColumn(side, F.coalesce(side, "found")).drop("found")
    near = written(near, "asof-near")
    left = near.where("lft IS NOT NULL").select("mrn", F.col("lft").alias("a"), F.col("date_id").alias("b"), F.col("born").alias("since"), "n", "w")
    right = near.where("rgt IS NOT NULL").select("mrn", F.col("date_id").alias("a"), F.col("rgt").alias("b"), F.col("born").alias("since"), "n", "w")
    split = near.where("lft IS NOT NULL AND rgt IS NOT NULL").select("mrn", F.col("lft").alias("a"), F.col("rgt").alias("b"), F.col("born").alias("_until"))
    return written(left.unionByName(right).join(split, ["mrn", "a", "b"], "left")
                       .withColumn("until", F.coalesce("_until", "n")).drop("_until"), "asof-neighbours")


def _steps(versions: DataFrame) -> DataFrame:
    """(mrn, s, e, v, n, w): the differences between neighbouring readings and how long they stand."""
    near = _neighbourhoods(versions)
    over = versions.where("overwrites").select("mrn", F.col("date_id").alias("_d"), F.col("i").alias("at"))
    moments = near.withColumn("at", F.col("since"))
    for side in ("a", "b"):
        hit = near.join(over.withColumnRenamed("mrn", "_m"), (F.col("mrn") == F.col("_m")) & (F.col(side) == F.col("_d"))
                        & (F.col("at") > F.col("since")) & (F.col("at") < F.col("until")))
        moments = moments.unionByName(hit.select(*moments.columns))
    run = Window.partitionBy("mrn", "a", "b").orderBy("at")
    moments = moments.withColumn("e", F.coalesce(F.lead("at").over(run), F.col("until")))
    for side in ("a", "b"):
        stands = versions.select(F.col("mrn").alias("_m"), F.col("date_id").alias("_d"), F.col("i").alias("_i"), F.col("e").alias("_e"), F.col("v").alias(f"v_{side}"))
        moments = moments.join(stands, (F.col("mrn") == F.col("_m")) & (F.col(side) == F.col("_d"))
                               & (F.col("at") >= F.col("_i")) & (F.col("at") < F.col("_e"))).drop("_m", "_d", "_i", "_e")
    return (moments.withColumn("v", F.col("v_b") - F.col("v_a")).where("v IS NOT NULL")
                   .select("mrn", F.col("at").alias("s"), "e", "v", "n", "w"))


def _cut(intervals: DataFrame, more: list[str]) -> DataFrame:
    """The pieces of intervals in the blocks where they begin and end:
    (mrn, block, start, stop, fresh, ...), moments counted from the block's start."""
    first, last = F.expr("s div w"), F.expr("(e - 1) div w")
    both = intervals.withColumns({"_f": first, "_l": last})
    stop = F.least(F.col("e"), (F.col("_f") + 1) * F.col("w"))
    begin = both.select("mrn", F.col("_f").alias("block"), (F.col("s") - F.col("_f") * F.col("w")).alias("start"),
                        (stop - F.col("_f") * F.col("w")).alias("stop"), F.lit(True).alias("fresh"), *more)
    end = both.where("_l > _f").select("mrn", F.col("_l").alias("block"), F.lit(0).cast("long").alias("start"),
                                       (F.col("e") - F.col("_l") * F.col("w")).alias("stop"), F.lit(False).alias("fresh"), *more)
    return begin.unionByName(end)


MAX_LEVEL = 62


def _nodes(intervals: DataFrame) -> DataFrame:
    """Intervals that cover whole blocks, once for each node of the tree over the blocks that makes them up."""
    def at(level: Column) -> Column:
        lo = F.ceil((F.expr("s div w") + 1) / F.pow(F.lit(2.0), level)).cast("long")
        hi = F.floor(F.expr("(e - 1) div w") / F.pow(F.lit(2.0), level)).cast("long")
        return F.array(F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("node"))),
                       F.when((lo < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("node"))))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") / F.col("w") + 2)).cast("int"))
    found = F.array_distinct(F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull()))
    return (intervals.where("(e - 1) div w - s div w > 1").withColumn("_at", F.explode(found))
                     .select("*", "_at.level", "_at.node").drop("_at"))


def _above(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` for each block under them."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") / F.col("w") + 2)).cast("int"))
    up = blocks.select("mrn", "block", F.explode(levels).alias("level"))
    up = up.withColumn("node", F.floor(F.col("block") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    return up.join(nodes, ["mrn", "level", "node"])


def _covering(blocks: DataFrame, values: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a block: what stands through all of it."""
    x = F.when(F.abs("v") < float("inf"), F.col("v") - F.col("center"))
    nodes = _nodes(values).groupBy("mrn", "level", "node").agg(
        F.count("v").alias("cnt"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
        F.count_if(F.col("v") == float("inf")).alias("up"), F.count_if(F.col("v") == -float("inf")).alias("down"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.max("date_id").alias("code"), F.max_by("v", "date_id").alias("recent"))
    kept = _above(blocks, nodes).groupBy("mrn", "block").agg(
        *[F.sum(c).alias(c) for c in ("cnt", "s1", "s2", "up", "down")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.max("code").alias("code"), F.max_by("recent", "code").alias("recent"))
    rise = _above(blocks, _nodes(steps).groupBy("mrn", "level", "node").agg(F.max("v").alias("step"))).groupBy("mrn", "block").agg(F.max("step").alias("step"))
    return blocks.join(kept, ["mrn", "block"], "left").join(rise, ["mrn", "block"], "left")


def _middle(blocks: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each block the values near the middle at its start (mrn, block, v),
    and the number of values that stand below them (mrn, block, below)."""
    placed = written(ranked(written(values.select("mrn", "i", "e", "v", "n", "w"), "asof-values"),
                            ["mrn"], [F.col("v").asc(), F.col("i").asc()], "asof-value-order", "rank", "n_values")
                     .withColumn("part", F.expr("rank div w")), "asof-ranks")
    come = placed.groupBy("mrn", "part", (F.expr("i div w") + 1).alias("block")).agg(F.count("*").alias("c"))
    go = placed.where("e < n").groupBy("mrn", "part", F.expr("(e + w - 1) div w").alias("block")).agg((-F.count("*")).alias("c"))
    change = come.unionByName(go).groupBy("mrn", "part", "block").agg(F.sum("c").alias("c"))
    grid = blocks.join(placed.select("mrn", "part").distinct(), "mrn").join(change, ["mrn", "part", "block"], "left")
    stand = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("mrn", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    grid = grid.select("mrn", "part", "block", "w", stand.alias("c"))
    by_part = Window.partitionBy("mrn", "block")
    grid = grid.select("*", (F.sum("c").over(by_part.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("below"),
                       F.sum("c").over(by_part).alias("total"))
    near = ((F.col("below") <= F.expr("total div 2") + F.col("w") + 1)
            & (F.col("below") + F.col("c") > F.expr("(total - 1) div 2") - F.col("w") - 1) & (F.col("total") > 0))
    near = written(grid.where(near).select("mrn", "part", "block", "w", "below"), "asof-middle")
    moment = F.col("block") * F.col("w")
    window = near.join(placed.drop("n", "w"), ["mrn", "part"]).where((F.col("i") < moment) & (F.col("e") > moment)).select("mrn", "block", "v")
    return window, near.groupBy("mrn", "block").agg(F.min("below").alias("below"))


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Features at the moments of one block."""
    one = pdf[pdf["kind"] == 0].iloc[0]
    n = int(one["stop"])
    first, end_of = np.zeros(n, int), np.full(n, n)

    def column(kind: int, c: str, t=float) -> np.ndarray:
        return pdf.loc[pdf["kind"] == kind, c].to_numpy(t)

    def given(c: str, default: float) -> np.ndarray:
        return np.full(n, default if pd.isna(one[c]) else one[c])
    base = {**{c: given(c, 0) for c in ("cnt", "s1", "s2", "up", "down", "recent", "center")}, "low": given("low", np.inf),
            "high": given("high", -np.inf), "step": given("step", -np.inf), "code": given("code", -1).astype(np.int64),
            "below": given("below", 0).astype(np.int64)}
    window = column(3, "v")
    out = summaries(first, end_of,
                    {"start": column(1, "start", int), "end": column(1, "stop", int), "v": column(1, "v"),
                     "code": column(1, "code", int), "fresh": column(1, "fresh", bool)},
                    {"start": column(2, "start", int), "end": column(2, "stop", int), "v": column(2, "v")},
                    {"at": np.zeros(len(window), int), "v": window}, base)
    return pd.DataFrame({"mrn": one["mrn"], "i": np.arange(n) + int(one["start"]), **out})


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (mrn, _order, _date, _value, ...) of large patients with ``repeat`` and their features."""
    placed = written(ranked(written(rows, "asof-rows"), ["mrn"], [F.col("_order").asc()], "asof-order", "i")
                     .withColumn("w", F.greatest(F.lit(block), F.ceil(F.sqrt("n"))).cast("long")), "asof-arrivals")
    dates = ranked(written(placed.select("mrn", "_date").distinct(), "asof-distinct"), ["mrn"], [F.col("_date").asc()],
                   "asof-date-order", "date_id", "n_dates").drop("n_dates")
    same_date = Window.partitionBy("mrn", "date_id").orderBy("i")
    versions = placed.join(dates, ["mrn", "_date"]).withColumn("v", F.nanvl("_value", F.lit(None).cast("double")))
    versions = versions.withColumns({"e": F.coalesce(F.lead("i").over(same_date), F.col("n")), "overwrites": F.lag("i").over(same_date).isNotNull(),
                                     "repeat": F.lag("i").over(same_date).isNotNull() & F.lag("v").over(same_date).eqNullSafe(F.col("v"))})
    versions = written(versions, "asof-versions")
    center = versions.groupBy("mrn").agg(F.coalesce(F.min(F.when(F.abs("v") < float("inf"), F.col("v"))), F.lit(0.0)).alias("center"),
                                         F.first("n").alias("n"), F.first("w").alias("w"))
    center = written(center, "asof-patients")
    values = versions.where("v IS NOT NULL").join(center.select("mrn", "center"), "mrn").select(
        "mrn", "i", F.col("i").alias("s"), "e", "v", "date_id", "center", "n", "w")
    steps = written(_steps(versions), "asof-steps")
    blocks = center.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div w"))))
    window, below = _middle(blocks.select("mrn", "block", "w"), values)
    head = _covering(blocks, values, steps).join(below, ["mrn", "block"], "left").select(
        F.lit(0).alias("kind"), "mrn", "block", (F.col("block") * F.col("w")).alias("start"),
        F.least("w", F.col("n") - F.col("block") * F.col("w")).alias("stop"),
        *["cnt", "s1", "s2", "up", "down", "low", "high", "code", "recent", "step", "center", "below"])
    parts = head
    for kind, part in ((1, _cut(values, ["v", F.col("date_id").alias("code")])), (2, _cut(steps, ["v"])), (3, window)):
        parts = parts.unionByName(part.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    got = parts.groupBy("mrn", "block").applyInPandas(_block, f"mrn string, i long, {FEATURES}")
    return versions.where("_live").join(got, ["mrn", "i"])


def features_as_of(rows: DataFrame, order: Column, date: str, value: str, live: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` (with mrn; no NULL dates) with ``repeat`` and the features of
    the patient's history when each has arrived.  ``order`` is the arrival
    (unique in a patient); a later arrival at the same date replaces the reading.
    One small job finds the patients of more than ``block`` rows; results do not
    depend on which way a patient goes.  Rows where ``live`` is false are part of the history but not returned."""
    keep = rows.columns
    staged = rows.withColumns({"_order": order, "_date": F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), F.lit(-1 << 62)),
                               "_value": F.col(value).cast("double"), "_live": F.lit(True) if live is None else live})
    schema = T.StructType(rows.schema.fields + [T.StructField("repeat", T.BooleanType()), T.StructField("n_readings", T.LongType())]
                          + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLUMNS])
    large = rows.groupBy("mrn").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("mrn")
    split = not large.isEmpty()
    if split:
        large, staged = written(large, "asof-large"), written(staged, "asof-input")
    small = staged.join(large, "mrn", "left_anti") if split else staged
    small = small.repartition("mrn").sortWithinPartitions("mrn", "_order").drop("_order").mapInPandas(_whole(keep), schema)
    if not split:
        return small
    hot = staged.join(large, "mrn", "left_semi").select("mrn", F.struct(*keep).alias("_row"), "_order", "_date", "_value", "_live")
    return small.unionByName(_in_blocks(hot, block).select("_row.*", "repeat", "n_readings", *FEATURE_COLUMNS))
