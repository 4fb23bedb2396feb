"""Per-patient creatinine features.

Serving features are one ``groupBy(mrn)`` of partial aggregates (map-side
combine, so a hot patient is reduced before the shuffle), the exact median
from ``quantile.exact_median`` (counts per (mrn, value), no task holds a
whole patient), and the only order-dependent statistic, the largest step
between consecutive readings, computed in time chunks (``max_delta``).
Running features (W3) are those of ``asof.py``; training features are row-local array arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..schemas import FEATURE_COLUMNS
from .reshape import DATE_PREFIX, RESULT_PREFIX, slot_numbers

# Fixed code for sex (stable across batches; see README "deliberate differences").
SEX_CODE = {"F": 0, "M": 1, "Other": 2}

DEFAULT_CHUNK_SECONDS = 7 * 24 * 3600


def encode_sex(sex: Column) -> Column:
    """P19 (fixed map): F=0, M=1, Other=2, anything else NULL."""
    e = F.lit(None).cast("int")
    for k, v in reversed(list(SEX_CODE.items())):
        e = F.when(sex == F.lit(k), F.lit(v)).otherwise(e)
    return e.cast("int")


def encode_sex_fitted(df: DataFrame, col: str = "sex", out: str = "sex_code") -> DataFrame:
    """P19 (fitted): index of the value in the sorted distinct values of the
    batch, as a label encoder fitted on the batch gives.  The distinct values
    are numbered with a block-wise running count (no single-task window) and
    joined back, broadcast only when the optimizer's size estimate is small."""
    from .joins import maybe_broadcast
    from .prefix import running_sums

    levels = (df.select(col).where(F.col(col).isNotNull()).groupBy(col).agg(F.lit(1).alias("_one")))
    numbered = running_sums(levels, col, ["_one"]).select(col, (F.col("cum__one") - 1).cast("int").alias(out))
    return df.join(maybe_broadcast(numbered), col, "left")


def max_delta(measurements: DataFrame, chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
              chunk_rows: int | None = None, none: float | None = 0.0) -> DataFrame:
    """A5: per mrn, the largest signed difference between consecutive
    readings in date order.  A NULL reading breaks both differences next to
    it; no difference at all gives ``none``.

    With ``chunk_seconds`` the ordered pass runs per (mrn, time chunk), so a
    patient with a huge history is split over many tasks; one row per chunk
    (first / last reading, largest inner step) then goes through a second,
    small ordered pass per mrn that adds the steps across chunk borders.
    Exact for any chunk size.  ``chunk_rows`` additionally gives patients
    with more rows than that finer chunks (``ordered._chunk``).
    """
    r, d = F.col("creatinine_result"), F.col("creatinine_date")
    if not chunk_seconds:
        w = Window.partitionBy("mrn").orderBy("creatinine_date")
        steps = measurements.select("mrn", (r - F.lag(r).over(w)).alias("step"))
        return steps.groupBy("mrn").agg(F.coalesce(F.max("step"), F.lit(none)).alias("creatinine_max_delta"))
    from .ordered import _chunk
    m = _chunk(measurements.select("mrn", d, r), "creatinine_date", chunk_seconds, "mrn", chunk_rows) \
        .withColumnRenamed("_chunk", "chunk")
    w = Window.partitionBy("mrn", "chunk").orderBy("creatinine_date")
    inner = (m.withColumn("step", r - F.lag(r).over(w))
              .groupBy("mrn", "chunk")
              .agg(F.max("step").alias("inner_max"),
                   # min_by / max_by keep a NULL reading (it breaks the border step)
                   F.min_by(r, d).alias("first"),
                   F.max_by(r, d).alias("last")))
    wc = Window.partitionBy("mrn").orderBy("chunk")
    border = inner.withColumn("border", F.col("first") - F.lag("last").over(wc))
    return border.groupBy("mrn").agg(
        F.coalesce(F.greatest(F.max("inner_max"), F.max("border")), F.lit(none)).alias("creatinine_max_delta"))


def measurement_stats(measurements: DataFrame, median: str = "split") -> DataFrame:
    """A1-A4, A6, A7 per mrn, NULL readings skipped; all partial aggregates.

    ``median="split"`` computes the exact median with ``quantile.exact_median``
    (counts per (mrn, value), block-wise ranks), so no task holds a whole
    patient; ``median="percentile"`` uses Spark's exact ``percentile``, whose
    final merge keeps one counter per distinct value of a patient in one task
    (fewer shuffles, fine when no patient is huge).
    """
    r, d = F.col("creatinine_result"), F.col("creatinine_date")
    aggs = [
        F.avg(r).alias("creatinine_mean"),
        F.max(r).alias("creatinine_max"),
        F.min(r).alias("creatinine_min"),
        F.stddev_samp(r).alias("creatinine_std"),
        F.max_by(r, F.when(r.isNotNull(), d)).alias("most_recent"),
        F.count(r).alias("n_readings"),
    ]
    if median == "percentile":
        return measurements.groupBy("mrn").agg(F.percentile(r, F.lit(0.5)).alias("creatinine_median"), *aggs)
    from .quantile import exact_median
    stats = measurements.groupBy("mrn").agg(*aggs)
    med = exact_median(measurements, "mrn", "creatinine_result", "creatinine_median")
    return stats.join(med, "mrn", "left")


def features_serving(patients: DataFrame, measurements: DataFrame,
                     chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS,
                     keep_counts: bool = False, median: str = "split",
                     chunk_rows: int | None = None) -> DataFrame:
    """One feature row per known patient.

    age, sex code, mean, median, max, min, largest step, sample std, most
    recent reading and its ratios to the minimum and the median.  Every
    missing value becomes 0 (a single reading has std 0; a patient without
    readings has all zeros); x/0 is infinite.
    """
    stats = measurement_stats(measurements, median)
    deltas = max_delta(measurements, chunk_seconds, chunk_rows)
    f = (patients.select("mrn", "age", "sex")
                 .join(stats, "mrn", "left")
                 .join(deltas, "mrn", "left"))
    mr = F.col("most_recent")
    out = f.select(
        "mrn",
        F.coalesce(F.col("age"), F.lit(0)).cast("int").alias("age"),
        F.coalesce(encode_sex(F.col("sex")), F.lit(0)).alias("sex"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
          ["creatinine_mean", "creatinine_median", "creatinine_max", "creatinine_min",
           "creatinine_max_delta", "creatinine_std", "most_recent"]],
        F.coalesce(ratio(mr, F.col("creatinine_min")), F.lit(0.0)).alias("rv1_ratio"),
        F.coalesce(ratio(mr, F.col("creatinine_median")), F.lit(0.0)).alias("rv2_ratio"),
        *([F.coalesce(F.col("n_readings"), F.lit(0)).alias("n_readings")] if keep_counts else []),
    )
    return out


def running_features(measurements: DataFrame, method: str = "blocks") -> DataFrame:
    """Features as of each reading, over all readings of the patient up to
    and including it in date order (arrival order = date order).

    ``method="blocks"`` (default): ``asof.features_as_of``, arrays of whole
    patients, and a patient too large for one piece split by blocks.
    ``method="stream"``: one shuffle by patient, rows sorted within
    partitions and streamed through ``running.running_features_stream`` --
    O(n log n) per patient, results identical to the window form.
    ``method="window"``: built-in window aggregates (running mean / min /
    max / std / count / last value, running max of the ``lag`` step, and
    ``percentile`` over the growing frame, which re-sorts the patient's
    value counts at every row: quadratic in the history length).
    """
    if method == "blocks":
        from .asof import features_as_of
        got = features_as_of(measurements.select("mrn", "creatinine_date", "creatinine_result"), F.col("creatinine_date"),
                             "creatinine_date", "creatinine_result")
        return got.select("mrn", "creatinine_date", "n_readings", *FEATURE_COLUMNS)
    if method == "stream":
        from .running import running_features_stream
        return running_features_stream(measurements)
    r = F.col("creatinine_result")
    w = Window.partitionBy("mrn").orderBy("creatinine_date")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = measurements.withColumn("step", r - F.lag(r).over(w))
    f = steps.select(
        "mrn", "creatinine_date", "creatinine_result",
        F.count(r).over(run).alias("n_readings"),
        F.avg(r).over(run).alias("creatinine_mean"),
        F.percentile(r, F.lit(0.5)).over(run).alias("creatinine_median"),
        F.max(r).over(run).alias("creatinine_max"),
        F.min(r).over(run).alias("creatinine_min"),
        F.max("step").over(run).alias("creatinine_max_delta"),
        F.stddev_samp(r).over(run).alias("creatinine_std"),
        F.last(r, ignorenulls=True).over(run).alias("most_recent"),
    )
    mr = F.col("most_recent")
    return f.select(
        "mrn", "creatinine_date", "n_readings",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
          ["creatinine_mean", "creatinine_median", "creatinine_max", "creatinine_min",
           "creatinine_max_delta", "creatinine_std", "most_recent"]],
        F.coalesce(ratio(mr, F.col("creatinine_min")), F.lit(0.0)).alias("rv1_ratio"),
        F.coalesce(ratio(mr, F.col("creatinine_median")), F.lit(0.0)).alias("rv2_ratio"),
    )


def relative_seconds(measurements: DataFrame) -> DataFrame:
    """Seconds since the patient's first reading (A10 ref_date);
    unparsable dates give 0.  The per-patient minimum is a partial
    aggregate joined back on the same partitioning."""
    ref = measurements.groupBy("mrn").agg(F.min("creatinine_date").alias("ref_date"))
    return (measurements.join(ref, "mrn")
            .withColumn("relative_seconds", F.coalesce(
                ((F.unix_micros("creatinine_date") - F.unix_micros("ref_date")) / F.lit(1e6)),
                F.lit(0.0))))


def training_statistics(measurements: DataFrame, chunk_seconds: int | None = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """A13 on the long form: the statistics of each patient's row of K results,
    K the longest history, where a missing result and every slot after the
    last reading is 0.  Nothing is pivoted: the K - n zeros enter in closed
    form.  They lower the mean, join the squared deviations, bound the
    extremes, stand between the negative and the other values (which moves
    the middle ranks), add the steps last -> 0 and 0 -> 0, and are the most recent value.
    """
    from .quantile import rank_ranges

    r = F.col("creatinine_result")
    m = measurements.select("mrn", "creatinine_date", F.coalesce(r, F.lit(0.0)).alias("creatinine_result"))
    per = m.groupBy("mrn").agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("total"), F.avg(r).alias("avg"), F.var_pop(r).alias("var"), F.max(r).alias("high"),
        F.min(r).alias("low"), F.max_by(r, "creatinine_date").alias("last"), F.count_if(r < 0).alias("negative"))
    width = measurements.groupBy("mrn").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("k")).scalar()
    per = per.withColumn("k", width).withColumn("zeros", F.col("k") - F.col("n"))
    k, n, z = F.col("k"), F.col("n"), F.col("zeros")
    ranges = rank_ranges(m, "mrn", "creatinine_result").join(per.select("mrn", "k", "zeros", "negative"), "mrn")

    def value_rank(rank: Column) -> Column:
        """The rank among the patient's own values; NULL where the padding holds it."""
        return F.when(rank < F.col("negative"), rank).when(rank >= F.col("negative") + z, rank - z)

    mid = {"lo": value_rank(F.floor((k - 1) / 2)), "hi": value_rank(F.floor(k / 2))}
    hit = {c: F.coalesce((F.col("_lt") <= x) & (x < F.col("_le")), F.lit(False)) for c, x in mid.items()}
    middle = ranges.groupBy("mrn").agg(*[F.coalesce(F.max(F.when(h, F.col("_v"))), F.lit(0.0)).alias(f"mid_{c}") for c, h in hit.items()])
    steps = max_delta(m, chunk_seconds, none=None).withColumnRenamed("creatinine_max_delta", "step")
    f = per.join(middle, "mrn").join(steps, "mrn", "left")
    padded = z > 0
    squares = F.col("var") * n + F.col("avg") * F.col("avg") * n * z / k
    f = f.select(
        "mrn", "k", (F.col("total") / k).alias("creatinine_mean"), ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("creatinine_median"),
        F.when(padded, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("creatinine_max"),
        F.when(padded, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("creatinine_min"),
        F.coalesce(F.greatest("step", F.when(padded, -F.col("last")), F.when(z > 1, F.lit(0.0))), F.lit(0.0)).alias("creatinine_max_delta"),
        F.when(k > 1, F.sqrt(squares / (k - 1))).alias("creatinine_std"),
        F.when(padded, F.lit(0.0)).otherwise(F.col("last")).alias("most_recent"))
    return f.withColumns({"rv1_ratio": ratio(F.col("most_recent"), F.col("creatinine_min")),
                          "rv2_ratio": ratio(F.col("most_recent"), F.col("creatinine_median"))})


def training_slots(measurements: DataFrame, pad_to: int = 50) -> DataFrame:
    """A13's raw slots on the long form (mrn, slot, relative_seconds,
    creatinine_result, width): dates as seconds after the patient's first one, a
    missing result as 0.  ``width`` is the row's number of slots (the longest history,
    at least ``pad_to``); the slots after a patient's last one are 0 and not listed."""
    from .reshape import slot_index

    width = measurements.groupBy("mrn").agg(F.count(F.lit(1)).alias("n")).agg(F.greatest(F.max("n"), F.lit(pad_to)).cast("int").alias("k")).scalar()
    placed = slot_index(relative_seconds(measurements))
    return placed.select("mrn", F.col("slot").cast("int").alias("slot"), "relative_seconds",
                         F.coalesce("creatinine_result", F.lit(0.0)).alias("creatinine_result"), width.alias("width"))


def _arr_stats(vals: Column, n: int) -> dict[str, Column]:
    """Row-local statistics over an array column of n non-NULL doubles."""
    srt = F.array_sort(vals)
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.lit(float(n))
    if n % 2:
        median = F.get(srt, n // 2)
    else:
        median = (F.get(srt, n // 2 - 1) + F.get(srt, n // 2)) / F.lit(2.0)
    if n > 1:
        # two-pass sample variance: sum of squared deviations from the mean
        ss = F.aggregate(vals, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        std = F.sqrt(ss / F.lit(float(n - 1)))
        steps = F.transform(F.slice(vals, 2, n - 1), lambda x, i: x - F.get(vals, i))
        max_step = F.array_max(steps)
    else:
        std = F.lit(None).cast("double")
        max_step = F.lit(0.0)
    return {
        "creatinine_mean": mean,
        "creatinine_median": median,
        "creatinine_max": F.array_max(vals),
        "creatinine_min": F.array_min(vals),
        "creatinine_max_delta": max_step,
        "creatinine_std": std,
        "most_recent": F.get(vals, n - 1),
    }


def features_training(wide: DataFrame, pad_to: int = 50) -> DataFrame:
    """A13 + P18 + R3: the training matrix from wide labelled rows.

    Dates become seconds after the row's first date, and every missing date
    or result becomes 0 **before** the statistics, which therefore see the
    zeros of the dataset's width (not the padding added after).  All work is
    row-local array arithmetic: no shuffle at all.  The slots are gathered
    into two arrays once (dates parsed once, the row minimum taken once);
    a one-row ``inline`` keeps the optimizer from re-expanding them into
    every output column.
    """
    slots = slot_numbers(wide.columns)
    n = len(slots)
    keep = [c for c in wide.columns
            if not (c.startswith(DATE_PREFIX) or c.startswith(RESULT_PREFIX))]
    dates = F.array(*[F.try_to_timestamp(F.col(f"{DATE_PREFIX}{i}").cast("string")) for i in slots])
    res = F.array(*[F.coalesce(F.col(f"{RESULT_PREFIX}{i}").cast("double"), F.lit(0.0)) for i in slots])
    staged = wide.select(*keep, F.inline(F.array(F.struct(dates.alias("_d"), res.alias("_v")))))
    ref = F.array_min(F.col("_d"))
    staged = staged.select(*keep, "_v", F.inline(F.array(F.struct(
        F.transform(F.col("_d"), lambda d: F.coalesce((F.unix_micros(d) - F.unix_micros(ref)) / F.lit(1e6),
                                                      F.lit(0.0))).alias("_rel")))))
    staged = staged.select(*keep, "_v", "_rel",
                           F.inline(F.array(F.struct(*[c.alias(k) for k, c in _arr_stats(F.col("_v"), n).items()]))))
    mr = F.col("most_recent")
    cols = [*keep]
    for j, i in enumerate(slots):
        cols += [F.get(F.col("_rel"), j).alias(f"{DATE_PREFIX}{i}"), F.get(F.col("_v"), j).alias(f"{RESULT_PREFIX}{i}")]
    for i in range(n, pad_to):
        cols += [F.lit(0.0).alias(f"{DATE_PREFIX}{i}"), F.lit(0.0).alias(f"{RESULT_PREFIX}{i}")]
    cols += [F.col(c) for c in FEATURE_COLUMNS[:7]]
    cols += [ratio(mr, F.col("creatinine_min")).alias("rv1_ratio"),
             ratio(mr, F.col("creatinine_median")).alias("rv2_ratio")]
    return staged.select(*cols)


__all__ = ["SEX_CODE", "encode_sex", "encode_sex_fitted", "max_delta", "measurement_stats",
           "features_serving", "running_features", "relative_seconds", "features_training",
           "FEATURE_COLUMNS"]
