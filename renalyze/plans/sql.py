"""The bindings of ``renalyze.bindings`` restated in DuckDB SQL.

These fragments let each oracle query compute its expected rows straight
from the driver tables (no HL7 text is parsed on the oracle side).
"""

PATIENTS = """patients_b AS (
  SELECT CAST(c_custkey AS VARCHAR) AS mrn, CAST(18 + c_custkey % 70 AS INTEGER) AS age,
         CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Other' END AS sex
  FROM customer WHERE c_custkey % 10 <> 0)"""


def mrows(name: str, unit: str = "second", types=("click", "view", "purchase")) -> str:
    tl = ", ".join(f"'{t}'" for t in types)
    return f"""{name} AS (
  SELECT CAST(user_id AS VARCHAR) AS mrn, date_trunc('{unit}', ts) AS creatinine_date,
         value AS creatinine_result, event_id AS arrival
  FROM events WHERE event_type IN ({tl}))"""


def keyed(name: str, src: str) -> str:
    """Last arrival per (mrn, creatinine_date)."""
    return f"""{name} AS (
  SELECT mrn, creatinine_date, creatinine_result FROM {src}
  QUALIFY row_number() OVER (PARTITION BY mrn, creatinine_date ORDER BY arrival DESC) = 1)"""


MEASUREMENTS = mrows("mrows_b") + ",\n" + keyed("measurements_b", "mrows_b")

MSG = """msg AS (
  SELECT event_id AS msg_id, user_id, ts, value, event_type,
         CASE WHEN event_type = 'purchase' THEN event_id % 6 END AS odd,
         CASE WHEN event_type IN ('signup', 'error') THEN event_id % 5 END AS adt_odd,
         CASE WHEN event_type = 'signup' THEN 'ADT^A01' WHEN event_type = 'error' THEN 'ADT^A03'
              WHEN event_type = 'purchase' AND event_id % 6 = 4 THEN 'ORU^R99' ELSE 'ORU^R01' END AS message_type,
         CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d%H%M') ELSE strftime(ts, '%Y%m%d%H%M%S') END AS obr_time,
         CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS obr_ts,
         strftime(ts, '%Y%m%d%H%M%S') AS ts14,
         CASE WHEN event_type = 'purchase' AND event_id % 6 = 5 THEN '' ELSE 'MSG' || CAST(event_id AS VARCHAR) END AS control_id,
         CASE user_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'Other' END AS usex,
         DATE '1930-01-01' + CAST((user_id * 7919) % 25000 AS INTEGER) AS dob
  FROM events),
routed AS (
  SELECT *,
         CASE WHEN odd = 3 THEN 'bad_mrn' WHEN odd = 4 THEN 'unknown_type'
              WHEN event_type = 'signup' AND adt_odd = 0 THEN 'no_mrn'
              WHEN odd = 2 THEN 'no_result' END AS reason,
         CASE WHEN odd = 3 OR adt_odd = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS mrn
  FROM msg),
parsed AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN event_type = 'signup' THEN 'admissions'
                 WHEN event_type = 'error' THEN 'discharges' ELSE 'results' END AS route
  FROM routed)"""


# The text of each message (a row of ``parsed``), as the binding renders it.
RAW = """concat('MSH|^~\\&|WARDFEED|EAST CLINIC|||', strftime(ts, '%Y%m%d%H%M%S'), '||', message_type, '|', control_id, '|2.5',
  chr(13), 'PID|1||', CASE WHEN odd = 3 THEN 'MRN' || user_id WHEN adt_odd = 0 THEN '' ELSE user_id::VARCHAR END,
  CASE event_type
    WHEN 'signup' THEN concat('||P^', user_id, '||', strftime(dob, '%Y%m%d'), '|', CASE WHEN adt_odd = 1 THEN 'U' ELSE usex END,
                              chr(13), 'NK1|1|KIN^', user_id, '|PARTNER')
    WHEN 'error' THEN ''
    ELSE concat(chr(13), 'OBR|1||||||', obr_time, CASE WHEN odd = 2 THEN '' ELSE concat(
      chr(13), 'OBX|1|SN|CREATININE||', CASE WHEN odd = 0 THEN 'NEG' ELSE value::VARCHAR END,
      CASE WHEN odd = 1 THEN concat(chr(13), 'OBX|2|SN|CREATININE||', (value * 2)::VARCHAR) ELSE '' END) END) END)"""


ORDER_RAW = """concat('MSH|^~\\&|ARCHIVE|NORTH LAB|||', strftime(o_orderdate, '%Y%m%d%H%M%S'), '||ORU^R01|ORD', o_orderkey, '|2.5',
  chr(13), 'PID|1||', o_custkey, chr(13), 'OBR|1||||||', strftime(o_orderdate, '%Y%m%d%H%M%S'),
  chr(13), 'OBX|1|SN|CREATININE||', o_totalprice)"""


def age_sql(t: str) -> str:
    """Full years from dob to the time expression ``t``."""
    return (f"CAST(year({t}) - year(dob) - CASE WHEN month({t}) * 100 + day({t}) < month(dob) * 100 + day(dob) "
            f"THEN 1 ELSE 0 END AS INTEGER)")


AGE = age_sql("ts")   # age at the message time (MSH-7 = the event time)

ADMISSIONS = f"""adm AS (
  SELECT msg_id, mrn, 'P^' || CAST(user_id AS VARCHAR) AS name, {AGE} AS age,
         CASE WHEN adt_odd = 1 THEN 'U' ELSE usex END AS sex
  FROM parsed WHERE route = 'admissions')"""

RESULTS = """res AS (
  SELECT msg_id, CAST(1 AS INTEGER) AS obx_pos, mrn,
         CASE WHEN odd = 0 THEN NULL ELSE value END AS test_value, obr_time AS test_time, obr_ts
  FROM parsed WHERE route = 'results'
  UNION ALL
  SELECT msg_id, CAST(2 AS INTEGER), mrn, value * 2, obr_time, obr_ts
  FROM parsed WHERE route = 'results' AND odd = 1)"""

# Messages applied to the tables (see plans.alerts.apply_messages).
APPLIED = f"""{PATIENTS},
{MSG},
{ADMISSIONS},
{RESULTS},
good_adm AS (SELECT * FROM adm WHERE sex IN ('M', 'F', 'Other')),
first_adm AS (SELECT mrn, min(msg_id) AS adm_id FROM good_adm GROUP BY mrn),
first_res AS (SELECT * FROM res WHERE obx_pos = 1),
accepted AS (
  SELECT r.* FROM first_res r
  WHERE r.mrn IN (SELECT mrn FROM patients_b)
     OR EXISTS (SELECT 1 FROM first_adm a WHERE a.mrn = r.mrn AND a.adm_id < r.msg_id)),
applied_m AS (
  SELECT mrn, obr_ts AS creatinine_date, test_value AS creatinine_result FROM accepted
  QUALIFY row_number() OVER (PARTITION BY mrn, obr_ts ORDER BY msg_id DESC) = 1)"""


def running(src: str) -> str:
    """Features as of each reading of ``src`` (mrn, creatinine_date, creatinine_result)."""
    return f"""stepped AS (
  SELECT *, creatinine_result - lag(creatinine_result) OVER (PARTITION BY mrn ORDER BY creatinine_date) AS step
  FROM {src}),
run_raw AS (
  SELECT mrn, creatinine_date,
    count(creatinine_result) OVER w AS n_readings,
    avg(creatinine_result) OVER w AS m_mean,
    quantile_cont(creatinine_result, 0.5) OVER w AS m_median,
    max(creatinine_result) OVER w AS m_max,
    min(creatinine_result) OVER w AS m_min,
    max(step) OVER w AS m_delta,
    stddev_samp(creatinine_result) OVER w AS m_std,
    last_value(creatinine_result IGNORE NULLS) OVER w AS m_recent
  FROM stepped
  WINDOW w AS (PARTITION BY mrn ORDER BY creatinine_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
run AS (
  SELECT mrn, creatinine_date, n_readings,
    coalesce(m_mean, 0) AS creatinine_mean, coalesce(m_median, 0) AS creatinine_median,
    coalesce(m_max, 0) AS creatinine_max, coalesce(m_min, 0) AS creatinine_min,
    coalesce(m_delta, 0) AS creatinine_max_delta, coalesce(m_std, 0) AS creatinine_std,
    coalesce(m_recent, 0) AS most_recent,
    coalesce({ratio('m_recent', 'm_min')}, 0) AS rv1_ratio,
    coalesce({ratio('m_recent', 'm_median')}, 0) AS rv2_ratio
  FROM run_raw)"""


def ratio(n: str, d: str) -> str:
    return (f"CASE WHEN {n} IS NULL OR {d} IS NULL THEN NULL WHEN {d} = 0 THEN "
            f"CASE WHEN {n} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {n} < 0 THEN CAST('-Infinity' AS DOUBLE) "
            f"ELSE NULL END ELSE {n} / {d} END")


def serving(pat: str, meas: str) -> str:
    """Per-patient serving features of ``pat`` x ``meas``."""
    return f"""stepped_s AS (
  SELECT *, creatinine_result - lag(creatinine_result) OVER (PARTITION BY mrn ORDER BY creatinine_date) AS step
  FROM {meas}),
agg_s AS (
  SELECT mrn, avg(creatinine_result) AS m_mean, quantile_cont(creatinine_result, 0.5) AS m_median,
         max(creatinine_result) AS m_max, min(creatinine_result) AS m_min, max(step) AS m_delta,
         stddev_samp(creatinine_result) AS m_std,
         arg_max(creatinine_result, creatinine_date) FILTER (WHERE creatinine_result IS NOT NULL) AS m_recent,
         count(creatinine_result) AS n_readings
  FROM stepped_s GROUP BY mrn),
feat AS (
  SELECT p.mrn, CAST(coalesce(p.age, 0) AS INTEGER) AS age,
    CAST(coalesce(CASE p.sex WHEN 'F' THEN 0 WHEN 'M' THEN 1 WHEN 'Other' THEN 2 END, 0) AS INTEGER) AS sex,
    coalesce(m_mean, 0) AS creatinine_mean, coalesce(m_median, 0) AS creatinine_median,
    coalesce(m_max, 0) AS creatinine_max, coalesce(m_min, 0) AS creatinine_min,
    coalesce(m_delta, 0) AS creatinine_max_delta, coalesce(m_std, 0) AS creatinine_std,
    coalesce(m_recent, 0) AS most_recent,
    coalesce({ratio('m_recent', 'm_min')}, 0) AS rv1_ratio,
    coalesce({ratio('m_recent', 'm_median')}, 0) AS rv2_ratio,
    coalesce(n_readings, 0) AS n_readings
  FROM {pat} p LEFT JOIN agg_s a ON p.mrn = a.mrn)"""


FEATURE_COLS = ["creatinine_mean", "creatinine_median", "creatinine_max", "creatinine_min",
                "creatinine_max_delta", "creatinine_std", "most_recent", "rv1_ratio", "rv2_ratio"]


def r9(cols=FEATURE_COLS) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)
