"""Catalog part 3: features, windows, reshape, evaluation, scoring (2.7, 2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.numeric import round9
from ..operators import evaluation as ev
from ..operators import features as feat
from ..operators import reshape as R
from ..operators import scoring
from ..schemas import FEATURE_COLUMNS
from . import alerts as AL
from . import sql as S
from .catalog import _meas, _parsed, _r9, query

_FEAT = f"{S.PATIENTS}, {S.MEASUREMENTS}, {S.serving('patients_b', 'measurements_b')}"


def _serving(spark, sf, **kw):
    return feat.features_serving(B.patients(spark, sf), _meas(spark, sf), **kw)


@query("features_serving", f"WITH {_FEAT} SELECT mrn, age, sex, {S.r9()} FROM feat")
def q_features_serving(spark, sf):
    return _r9(_serving(spark, sf))


for _c in FEATURE_COLUMNS:
    def _mk(c):
        def fn(spark, sf):
            return _r9(_serving(spark, sf).select("mrn", c), [c])
        return fn
    query(_c, f"WITH {_FEAT} SELECT mrn, round({_c}, 9) AS {_c} FROM feat")(_mk(_c))


@query("rule_score", f"""
WITH {_FEAT} SELECT mrn, CAST(CASE WHEN rv1_ratio >= 1.5 OR rv2_ratio >= 1.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM feat""")
def q_rule_score(spark, sf):
    return scoring.rule_score(_serving(spark, sf)).select("mrn", "prediction")


@query("positive_predictions", f"""
WITH {_FEAT} SELECT mrn, CAST(1 AS INTEGER) AS prediction FROM feat WHERE rv1_ratio >= 1.5 OR rv2_ratio >= 1.5""")
def q_positive(spark, sf):
    s = scoring.rule_score(_serving(spark, sf))
    return s.where(F.col("prediction") == 1).select("mrn", "prediction")


@query("slot_index", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, creatinine_date, CAST(row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS INTEGER) AS slot
FROM measurements_b""")
def q_slot_index(spark, sf):
    return R.slot_index(_meas(spark, sf)).select("mrn", "creatinine_date", "slot")


@query("history_sorted", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, creatinine_date, creatinine_result FROM measurements_b ORDER BY mrn, creatinine_date""")
def q_history_sorted(spark, sf):
    return _meas(spark, sf).orderBy("mrn", "creatinine_date")


@query("consecutive_delta", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, creatinine_date,
  round(creatinine_result - lag(creatinine_result) OVER (PARTITION BY mrn ORDER BY creatinine_date), 9) AS step
FROM measurements_b""")
def q_consecutive_delta(spark, sf):
    from ..operators.ordered import keyed_lag
    m = keyed_lag(_meas(spark, sf), "mrn", "creatinine_date", "creatinine_result", "prev")
    return m.select("mrn", "creatinine_date", round9(F.col("creatinine_result") - F.col("prev")).alias("step"))


@query("running_features", f"""
WITH {S.MEASUREMENTS}, {S.running('measurements_b')}
SELECT mrn, creatinine_date, n_readings, {S.r9()} FROM run""")
def q_running(spark, sf):
    return _r9(feat.running_features(_meas(spark, sf)))


@query("alerts", f"""
WITH {S.APPLIED}, {S.running('applied_m')}
SELECT mrn, strftime(creatinine_date, '%Y%m%d%H%M%S') AS alert_ts,
       mrn || ',' || strftime(creatinine_date, '%Y%m%d%H%M%S') AS payload
FROM run WHERE rv1_ratio >= 1.5 OR rv2_ratio >= 1.5""")
def q_alerts(spark, sf):
    return AL.alerts(B.hl7_raw(spark, sf), B.patients(spark, sf))


@query("alert_outbox", f"""
WITH {S.APPLIED}, {S.running('applied_m')}
SELECT mrn, strftime(creatinine_date, '%Y%m%d%H%M%S') AS alert_ts,
       mrn || ',' || strftime(creatinine_date, '%Y%m%d%H%M%S') AS payload
FROM run WHERE rv1_ratio >= 1.5 OR rv2_ratio >= 1.5""")
def q_alert_outbox(spark, sf):
    """The outbox written as a table and read back (batch append)."""
    from ..operators.store import write_snapshot
    out = AL.alerts(B.hl7_raw(spark, sf), B.patients(spark, sf))
    return write_snapshot(spark, out, "alert_outbox")


@query("upsert_applied", f"""
WITH {S.APPLIED} SELECT mrn, creatinine_date, creatinine_result FROM applied_m""")
def q_upsert_applied(spark, sf):
    applied = AL.apply_messages(_parsed(spark, sf), B.patients(spark, sf))
    return applied.measurements


def _wide(spark, sf, types=None):
    """The wide history table as columns, pivoted once and written under the
    shared checkpoint root (for ``pad_to_50``, whose operator adds columns)."""
    from ..operators.store import write_snapshot
    m = _meas(spark, sf, "second", types)
    width = m.groupBy("mrn").count().agg(F.max("count")).first()[0] or 0
    return write_snapshot(spark, R.pivot_history(m, width), "wide_history"), width


def _rows(spark, sf, types=None):
    """The wide history table, one row a patient, its slots in an array; written once."""
    from ..operators.store import write_snapshot
    return write_snapshot(spark, R.history_rows(_meas(spark, sf, "second", types)), "wide_rows")


@query("unpivot_history", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, CAST(row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS INTEGER) AS slot,
       creatinine_date, creatinine_result FROM measurements_b""")
def q_unpivot(spark, sf):
    return R.unpivot_rows(_rows(spark, sf))


@query("complete_pairs", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, count(*) AS n_pairs, count(*) FILTER (WHERE creatinine_result IS NOT NULL) AS n_results
FROM measurements_b GROUP BY mrn""")
def q_complete_pairs(spark, sf):
    long = R.unpivot_rows(_rows(spark, sf), keep_empty=True)
    ok = long.where(F.col("creatinine_date").isNotNull() & F.col("creatinine_result").isNotNull())
    return ok.groupBy("mrn").agg(F.count(F.lit(1)).alias("n_pairs"),
                                 F.count("creatinine_result").alias("n_results"))


@query("max_slot_index", f"""
WITH {S.MEASUREMENTS} SELECT CAST(max(c) - 1 AS INTEGER) AS max_slot FROM (SELECT count(*) AS c FROM measurements_b GROUP BY mrn)""")
def q_max_slot(spark, sf):
    return _rows(spark, sf).agg((F.max(F.size("slots")) - 1).cast("int").alias("max_slot"))


@query("pivot_history", f"""
WITH {S.MEASUREMENTS},
s AS (SELECT mrn, row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS slot,
             strftime(creatinine_date, '%Y-%m-%d %H:%M:%S') AS d, creatinine_result AS r FROM measurements_b)
SELECT mrn, count(*) AS n_slots, string_agg(d, ';' ORDER BY slot) AS dates,
       round(sum(r), 6) AS result_sum FROM s GROUP BY mrn""")
def q_pivot(spark, sf):
    """The wide row, checked through what it holds: slot count, dates in slot
    order and the result total."""
    result = F.transform("slots", lambda s: s["creatinine_result"])
    return _rows(spark, sf).select(
        "mrn", F.size("slots").cast("bigint").alias("n_slots"),
        F.array_join(F.transform("slots", lambda s: F.date_format(s["creatinine_date"], "yyyy-MM-dd HH:mm:ss")), ";").alias("dates"),
        F.round(F.aggregate(F.filter(result, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 6).alias("result_sum"))


@query("pad_to_50", f"""
WITH {S.mrows("r", "second", ("purchase",))}, {S.keyed("k", "r")},
c AS (SELECT mrn, count(*) AS n, count(*) FILTER (WHERE creatinine_result = 0) AS zeros,
             sum(creatinine_result) AS total FROM k GROUP BY mrn),
w AS (SELECT max(n) AS width FROM c)
SELECT mrn, CAST(greatest(50, width) AS INTEGER) AS n_slots, CAST(width - n AS INTEGER) AS n_empty,
       CAST(greatest(50, width) - width + zeros AS INTEGER) AS n_zero, round(total, 6) AS result_sum
FROM c, w""")
def q_pad(spark, sf):
    """R3 on wide rows of purchase readings (fewer than 50 per patient at
    the test scales, so the padding adds slots): slot count, empty slots,
    zero slots (padding plus any real zero reading: the wide row cannot
    tell them apart) and the result total per row."""
    wide, _ = _wide(spark, sf, ["purchase"])
    padded = R.pad_wide(wide.join(B.patients(spark, sf).select("mrn", "age"), "mrn", "left")
                            .select("mrn", "age", *[c for c in wide.columns if c != "mrn"]))
    slots = R.slot_numbers(padded.columns)
    res = F.array(*[F.col(f"{R.RESULT_PREFIX}{i}").cast("double") for i in slots])
    return padded.select(
        "mrn", F.lit(len(slots)).cast("int").alias("n_slots"),
        F.size(F.filter(res, lambda x: x.isNull())).cast("int").alias("n_empty"),
        F.size(F.filter(res, lambda x: x == 0)).cast("int").alias("n_zero"),
        F.round(F.aggregate(F.filter(res, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), 6)
         .alias("result_sum"))


@query("pad_to_50_all", f"""
WITH {S.MEASUREMENTS}
SELECT mrn, CAST(greatest(50, count(*)) AS INTEGER) AS n_slots, CAST(greatest(50 - count(*), 0) AS INTEGER) AS n_padded,
       CAST(greatest(50 - count(*), 0) + count(*) FILTER (WHERE creatinine_result = 0) AS INTEGER) AS n_zero,
       round(sum(creatinine_result), 6) AS result_sum
FROM measurements_b GROUP BY mrn""")
def q_pad_all(spark, sf):
    """R3 over every reading, in long form: patients with fewer than 50 readings
    are filled up to 50 slots, the others keep all of theirs."""
    padded = R.pad_history(_meas(spark, sf))
    return padded.groupBy("mrn").agg(
        (F.max("slot") + 1).cast("int").alias("n_slots"), F.count_if("padded").cast("int").alias("n_padded"),
        F.count_if(F.col("creatinine_result") == 0).cast("int").alias("n_zero"),
        F.round(F.sum(F.when(~F.col("padded"), F.col("creatinine_result"))), 6).alias("result_sum"))


_TRAIN = f"""{S.MEASUREMENTS},
cnt AS (SELECT mrn, count(*) AS c FROM measurements_b GROUP BY mrn),
k AS (SELECT max(c) AS kk FROM cnt),
vals AS (
  SELECT mrn, row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) AS pos, creatinine_result AS v FROM measurements_b
  UNION ALL
  SELECT cnt.mrn, cnt.c + r.range + 1 AS pos, 0.0 AS v FROM cnt, k, range(k.kk - cnt.c) r),
st AS (SELECT *, v - lag(v) OVER (PARTITION BY mrn ORDER BY pos) AS step FROM vals),
tf AS (
  SELECT mrn, avg(v) AS creatinine_mean, quantile_cont(v, 0.5) AS creatinine_median, max(v) AS creatinine_max,
         min(v) AS creatinine_min, coalesce(max(step), 0) AS creatinine_max_delta, stddev_samp(v) AS creatinine_std,
         arg_max(v, pos) AS most_recent
  FROM st GROUP BY mrn)"""


@query("features_training", f"""
WITH {_TRAIN}
SELECT mrn, {S.r9(FEATURE_COLUMNS[:7])},
  round({S.ratio('most_recent', 'creatinine_min')}, 9) AS rv1_ratio,
  round({S.ratio('most_recent', 'creatinine_median')}, 9) AS rv2_ratio
FROM tf""")
def q_features_training(spark, sf):
    return _r9(feat.training_statistics(_meas(spark, sf)).select("mrn", *FEATURE_COLUMNS))


@query("training_slots", f"""
WITH {S.MEASUREMENTS},
k AS (SELECT CAST(greatest(50, max(c)) AS INTEGER) AS width FROM (SELECT count(*) AS c FROM measurements_b GROUP BY mrn))
SELECT mrn, CAST(row_number() OVER (PARTITION BY mrn ORDER BY creatinine_date) - 1 AS INTEGER) AS slot,
       epoch_us(creatinine_date) / 1e6 - epoch_us(min(creatinine_date) OVER (PARTITION BY mrn)) / 1e6 AS relative_seconds,
       coalesce(creatinine_result, 0) AS creatinine_result, width
FROM measurements_b CROSS JOIN k""")
def q_training_slots(spark, sf):
    """A13's other columns: relative dates, zero-filled results and the padded width of every row."""
    return feat.training_slots(_meas(spark, sf))


# ---- evaluation (labels: quality = truth, toxic = prediction, n_chars = score)

_PRED = """pred AS (SELECT l.doc_id, l.quality AS label, l.toxic AS prediction, CAST(d.n_chars AS DOUBLE) AS score
                 FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)"""


@query("confusion_counts", f"""
WITH {_PRED}
SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE prediction = 1) AS positives, count(*) AS total FROM pred""")
def q_confusion(spark, sf):
    return ev.confusion_counts(B.predictions(spark, sf))


@query("accuracy", f"""
WITH {_PRED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM pred""")
def q_accuracy(spark, sf):
    return ev.accuracy(B.predictions(spark, sf)).select(round9(F.col("accuracy")).alias("accuracy"))


@query("fbeta", f"""
WITH {_PRED}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM pred)
SELECT round(CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0 ELSE 10.0 * tp / (10 * tp + 9 * fn + fp) END, 9) AS fbeta FROM c""")
def q_fbeta(spark, sf):
    return ev.fbeta(B.predictions(spark, sf), 3.0).select(round9(F.col("fbeta")).alias("fbeta"))


_ROC = f"""{_PRED},
per AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n
        FROM pred WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT threshold, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp_all, sum(n) OVER () AS tn_all
        FROM per WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pts AS (SELECT threshold, CAST(cn AS DOUBLE) / tn_all AS fpr, CAST(cp AS DOUBLE) / tp_all AS tpr FROM cum
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0, 0.0)"""


@query("roc_points", f"WITH {_ROC} SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM pts")
def q_roc_points(spark, sf):
    p = ev.roc_points(B.predictions(spark, sf))
    return p.select("threshold", round9(F.col("fpr")).alias("fpr"), round9(F.col("tpr")).alias("tpr"))


@query("roc_auc", f"""
WITH {_ROC}, seg AS (SELECT (fpr - lag(fpr) OVER (ORDER BY threshold DESC)) * (tpr + lag(tpr) OVER (ORDER BY threshold DESC)) / 2 AS a FROM pts)
SELECT round(coalesce(sum(a), 0), 9) AS roc_auc FROM seg""")
def q_roc_auc(spark, sf):
    return ev.roc_auc(B.predictions(spark, sf)).select(round9(F.col("roc_auc")).alias("roc_auc"))
