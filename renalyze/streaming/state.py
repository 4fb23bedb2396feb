"""Per-patient history kept as streaming state.

``transformWithStateInPandas`` keyed by cells of patients.  State per patient: whether a
valid admission was seen, and the readings (date -> result; a late or
repeated reading is an upsert, so history is always "everything that has
arrived, ordered by date").  Each accepted result emits the features as of that
message; results for unknown patients are emitted with status
``unknown_patient`` and no features.  With ``defer`` they are also kept in the
state and emitted again, with status ``released`` and the features as of that
moment, when the patient's admission arrives.  No TTL: the upstream never forgets.

State lives in the RocksDB state store (on local disk of the executor,
checkpointed to the shared checkpoint folder), so the history of a key is
not held in JVM memory between batches.  Each output row also says whether
the result repeats a stored reading exactly (a redelivered message), which
the alert sink uses to avoid paging twice.

``history_batch`` gives the same rows over a table (W4), by the array and
block computation of ``operators.asof``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import asof, ordered, positions
from ..schemas import FEATURE_COLUMNS, SEX_VALUES
from .blocks import BLOCK, BlockHistory, ExactSums, MapStore, MemoryStore, ratio  # noqa: F401 - names of this module

OUTPUT_SCHEMA = ("mrn string, msg_time timestamp, control_id string, creatinine_date timestamp, "
                 "status string, repeat boolean, age int, sex int, n_readings bigint, "
                 + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))

# Fixed sex codes, as in the batch serving features.
SEX_CODE = {"F": 0, "M": 1, "Other": 2}

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def history_features(values: np.ndarray) -> dict[str, float]:
    """Serving features of readings in date order (NaN = missing reading);
    the direct (non-incremental) definition, used for checks."""
    ok = values[~np.isnan(values)]
    n = int(ok.size)
    if n == 0:
        return {"n_readings": 0, **{c: 0.0 for c in FEATURE_COLUMNS}}
    steps = np.diff(values) if values.size > 1 else np.array([])
    steps = steps[~np.isnan(steps)]
    mean, med = float(ok.mean()), float(np.median(ok))
    mn, mx = float(ok.min()), float(ok.max())
    recent = float(ok[-1])
    return {
        "n_readings": n,
        "creatinine_mean": mean, "creatinine_median": med, "creatinine_max": mx, "creatinine_min": mn,
        "creatinine_max_delta": float(steps.max()) if steps.size else 0.0,
        "creatinine_std": float(ok.std(ddof=1)) if n > 1 else 0.0,
        "most_recent": recent, "rv1_ratio": ratio(recent, mn), "rv2_ratio": ratio(recent, med),
    }


class History(ExactSums):
    """One patient's readings with incrementally maintained statistics.

    ``dates`` is kept sorted with the values alongside; ``sorted_vals`` holds
    the non-NULL readings in value order (median, min, max in O(1));
    ``steps`` is the sorted multiset of differences between neighbours in
    date order (both non-NULL), so the largest step is its last element.
    An upsert touches at most two steps.  Insertions are ``bisect``
    (memmove) operations, so a batch of m readings on a history of n costs
    O(m * n) byte moves, not O(m * n log n) Python work.  Mean and sample std
    come from exact (rational) running sums at every length, so they survive
    removals and do not depend on batch borders.
    """

    def __init__(self, items):
        pairs = sorted(items)
        self.dates = [d for d, _ in pairs]
        self.vals = [v for _, v in pairs]
        self.sorted_vals = sorted(v for v in self.vals if v is not None)
        self.steps = sorted(b - a for a, b in zip(self.vals, self.vals[1:]) if a is not None and b is not None)
        for v in self.sorted_vals:
            self._count(v, 1)

    @staticmethod
    def _step(a, b):
        return None if a is None or b is None else b - a

    def _remove_step(self, st):
        if st is not None:
            del self.steps[bisect.bisect_left(self.steps, st)]

    def _add_step(self, st):
        if st is not None:
            bisect.insort(self.steps, st)

    def _remove_val(self, v):
        if v is not None:
            del self.sorted_vals[bisect.bisect_left(self.sorted_vals, v)]
            self._count(v, -1)

    def _add_val(self, v):
        if v is not None:
            bisect.insort(self.sorted_vals, v)
            self._count(v, 1)

    def upsert(self, d, v) -> bool:
        """Insert or overwrite the reading at ``d``; True when it repeats the
        stored reading exactly (a redelivered message)."""
        i = bisect.bisect_left(self.dates, d)
        prev = self.vals[i - 1] if i > 0 else None
        if i < len(self.dates) and self.dates[i] == d:          # overwrite
            old = self.vals[i]
            if old == v:
                return True
            nxt = self.vals[i + 1] if i + 1 < len(self.vals) else None
            if i > 0:
                self._remove_step(self._step(prev, old))
                self._add_step(self._step(prev, v))
            if i + 1 < len(self.vals):
                self._remove_step(self._step(old, nxt))
                self._add_step(self._step(v, nxt))
            self._remove_val(old)
            self.vals[i] = v
        else:                                                  # insert
            nxt = self.vals[i] if i < len(self.vals) else None
            if i > 0 and i < len(self.vals):
                self._remove_step(self._step(prev, nxt))
            if i > 0:
                self._add_step(self._step(prev, v))
            if i < len(self.vals):
                self._add_step(self._step(v, nxt))
            self.dates.insert(i, d)
            self.vals.insert(i, v)
        self._add_val(v)
        return False

    def features(self) -> dict[str, float]:
        sv = self.sorted_vals
        n = len(sv)
        if n == 0:
            return {"n_readings": 0, **{c: 0.0 for c in FEATURE_COLUMNS}}
        mid = n // 2
        med = float(sv[mid]) if n % 2 else (sv[mid - 1] + sv[mid]) / 2.0
        if self.odd:
            mean = float(np.mean(sv))
            std = float(np.std(sv, ddof=1)) if n > 1 else 0.0
        else:
            mean, std = self._mean_std(n)
        recent = next(v for v in reversed(self.vals) if v is not None)
        mn, mx = float(sv[0]), float(sv[-1])
        return {
            "n_readings": n,
            "creatinine_mean": mean, "creatinine_median": med, "creatinine_max": mx, "creatinine_min": mn,
            "creatinine_max_delta": float(self.steps[-1]) if self.steps else 0.0,
            "creatinine_std": std,
            "most_recent": float(recent), "rv1_ratio": ratio(recent, mn), "rv2_ratio": ratio(recent, med),
        }


INLINE = 512                     # readings up to which a patient's history is kept in one piece
CELLS = 1 << 14                  # groups of patients; fixed for the life of a checkpoint

# Times are microseconds, an inline history two byte strings (int64 dates, float64 readings, NaN a missing one).
BLOCKS_TYPE = ("struct<did:array<bigint>,dfirst:array<bigint>,dhead:array<double>,dtail:array<double>,dstep:array<double>,"
               "drecent:array<double>,dn:array<int>,vid:array<bigint>,vlow:array<double>,vhigh:array<double>,vn:array<int>,"
               "s1:string,s2:string,odd:bigint,next_id:bigint>")
STATE_SCHEMA = ("patients array<struct<mrn:string,known:boolean,age:int,sex:string,d:binary,r:binary,"
                "held:array<struct<msg_time:bigint,control_id:string,d:bigint,r:double>>,"
                f"blocks:{BLOCKS_TYPE}>>")


_OUT_COLS = ("mrn", "msg_time", "control_id", "creatinine_date", "status", "repeat", "age", "sex",
             "n_readings", *FEATURE_COLUMNS)
_IN_COLS = ("mrn", "kind", "msg_time", "control_id", "base_known", "sex_ok", "creatinine_date",
            "age", "sex", "base_age", "base_sex")
_TIMES = ("msg_time", "creatinine_date")


NO_TIME = np.iinfo(np.int64).min     # a missing time among microseconds, as in datetime64


def _micros(times) -> np.ndarray:
    """Times as microseconds; the stream hands them over as such (a timestamp
    becomes an object of its own in each row of a group)."""
    if pd.api.types.is_integer_dtype(times):
        return times.to_numpy(np.int64)
    return pd.to_datetime(pd.Series(times)).to_numpy("datetime64[us]").astype(np.int64)


def _as_micros(time) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(NO_TIME))


class Replay:
    """One patient's replay in arrival order: admission flag, demographics
    and readings; ``out`` takes the output rows (times in microseconds).  ``held`` are results
    waiting for the patient's admission (kept with ``defer`` only).  A
    history of more than ``inline`` readings is kept in blocks in ``store``.
    ``st`` is the patient's entry in the state; its readings are unpacked when one is needed."""

    def __init__(self, mrn, out, st=None, defer=False, store=None, inline=INLINE, block=BLOCK):
        self.mrn, self.out, self.defer, self.store, self.inline, self.block = mrn, out, defer, store, inline, block
        self.held = [tuple(h) for h in st[6] or []] if st is not None else []
        self.known, self.age, self.sex = (bool(st[1]), st[2], st[3]) if st is not None else (False, None, None)
        self._st, self._hist = st, None

    def _readings(self) -> tuple[list, list]:
        """Dates and values of an inline history as they are stored."""
        if self._st is None:
            return [], []
        vals = np.frombuffer(self._st[5], np.float64).tolist()
        return np.frombuffer(self._st[4], np.int64).tolist(), [None if v != v else v for v in vals]

    @property
    def hist(self):
        if self._hist is None:
            if self._st is not None and self._st[7] is not None:
                self._hist = BlockHistory(self.store, self._st[7], self.block)
            else:
                self._hist = History(zip(*self._readings()))
        return self._hist

    def begin(self, dates, vals) -> None:
        """Readings stored before the stream, in their order."""
        if self._hist is not None or (self._st is not None and self._st[7] is not None):
            for d, v in zip(dates, vals):
                self.hist.upsert(d, v)
            return
        both = dict(zip(*self._readings()))
        both.update(zip(dates, vals))
        self._st = self._packed(sorted(both), [both[d] for d in sorted(both)])
        if len(both) > self.inline:
            self.hist                            # cut into blocks by ``state``

    def _packed(self, dates, vals) -> tuple:
        age = None if self.age is None or pd.isna(self.age) else int(self.age)
        r = np.array([math.nan if v is None else v for v in vals], np.float64)
        return (self.mrn, self.known, age, self.sex, np.array(dates, np.int64).tobytes(), r.tobytes(), self.held, None)

    def state(self) -> tuple:
        if self._hist is None:
            if self._st is None:
                return self._packed([], [])
            return (*self._packed([], [])[:4], bytes(self._st[4]), bytes(self._st[5]), self.held,
                    None if self._st[7] is None else tuple(self._st[7]))
        if isinstance(self._hist, History) and self.store is not None and len(self._hist.dates) > self.inline:
            self._hist = BlockHistory.of(self.store, self._hist, self.block)
        if isinstance(self._hist, BlockHistory):
            self.store.flush()
            return (*self._packed([], [])[:7], self._hist.summary())
        return self._packed(self._hist.dates, self._hist.vals)

    def feed(self, kind, msg_time, control_id, base_known, sex_ok, date, value, age, sex, base_age, base_sex):
        if kind == "adm":
            if sex_ok:
                self.known, self.age, self.sex = True, age, sex
                held, self.held = self.held, []
                for t, c, d, v in held:        # in the order they arrived in
                    self._accept("released", t, c, d, v, age, sex)
            return
        msg_time = None if msg_time == NO_TIME else msg_time
        v = None if value != value else float(value)
        if not (self.known or base_known):
            self.out.append((self.mrn, msg_time, control_id, date, "unknown_patient", *_UNKNOWN))
            if self.defer:
                self.held.append((msg_time, control_id, date, v))
            return
        self._accept("accepted", msg_time, control_id, date, v, *((self.age, self.sex) if self.known else (base_age, base_sex)))

    def _accept(self, status, msg_time, control_id, date, v, a, sx):
        repeat = self.hist.upsert(date, v)
        f = self.hist.features()
        self.out.append((self.mrn, msg_time, control_id, date, status, repeat, 0 if a is None or pd.isna(a) else int(a), SEX_CODE.get(sx, 0),
                         *f.values()))


_UNKNOWN = (None,) * (len(_OUT_COLS) - 5)


def _frame(out) -> pd.DataFrame:
    col = dict(zip(_OUT_COLS, zip(*out)))
    for c, kind in (("msg_time", "Int64"), ("creatinine_date", "Int64"), ("age", "Int32"), ("sex", "Int32"), ("repeat", "boolean")):
        col[c] = pd.array(col[c], dtype=kind)
    return pd.DataFrame(col)


def _columns(batch: pd.DataFrame, order) -> list[list]:
    """The columns ``Replay.feed`` takes, after the mrn, in the given order of rows."""
    col = {c: batch[c].to_numpy(dtype=object)[order].tolist() for c in _IN_COLS if c not in _TIMES}
    col.update({c: _micros(batch[c])[order].tolist() for c in _TIMES})
    vals = batch["creatinine_result"].to_numpy(dtype=float, na_value=np.nan)[order].tolist()
    return [*(col[c] for c in _IN_COLS[:7]), vals, *(col[c] for c in _IN_COLS[7:])]


class PatientHistory(StatefulProcessor):
    """Rows in: mrn, kind ('adm' | 'res'), msg_time, control_id, base_known,
    sex_ok, creatinine_date, creatinine_result, age / sex (admissions),
    base_age / base_sex (stored patient).

    Keyed by a cell, the patients with one remainder of a hash of their mrn.
    State per cell is one ValueState row with an entry per patient (admitted
    flag, age, sex, dates, results): a group costs some milliseconds (frames
    in and out, round trips to the JVM state server), so a cell's patients
    share them.  Patients of a cell do not see each other: each entry is
    replayed by itself, and only of those with rows in the micro-batch.  A
    long history lies in two map states of blocks, of which a micro-batch
    reads and writes only those it touches; the entry then holds one summary
    entry a block."""

    def __init__(self, defer: bool = False, inline: int = INLINE, block: int = BLOCK):
        self.defer, self.inline, self.block = defer, inline, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cell", STATE_SCHEMA)
        self.dates = handle.getMapState("dates", "mrn string, id bigint", "d array<bigint>, r array<double>")
        self.values = handle.getMapState("values", "mrn string, id bigint", "v array<double>")

    def _stored(self) -> dict:
        st = self.state.get()
        return {p[0]: p for p in st[0]} if st is not None else {}

    def _replay(self, mrn, out, stored: dict) -> Replay:
        return Replay(mrn, out, stored.get(mrn), self.defer, MapStore(self.dates, self.values, mrn), self.inline, self.block)

    def _keep(self, stored: dict, replays: dict) -> None:
        entries = [replays[m].state() if m in replays else Replay(m, None, p).state() for m, p in stored.items()]
        self.state.update((entries + [rp.state() for m, rp in replays.items() if m not in stored],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        order = np.lexsort((batch["control_id"].to_numpy(dtype=object).astype(str),
                            _micros(batch["msg_time"]).view("datetime64[us]")))
        stored, replays, out = self._stored(), {}, []
        for mrn, *row in zip(*_columns(batch, order)):
            if mrn not in replays:
                replays[mrn] = self._replay(mrn, out, stored)
            replays[mrn].feed(*row)
        self._keep(stored, replays)
        if out:
            yield _frame(out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Stored readings of a cell's patients, in one or several parts."""
        stored, given = self._stored(), {}
        vals = initialState["creatinine_result"].to_numpy(dtype=float, na_value=np.nan).tolist()
        for mrn, date, value in zip(initialState["mrn"].to_numpy(dtype=object).tolist(), _micros(initialState["creatinine_date"]).tolist(), vals):
            dates, values = given.setdefault(mrn, ([], []))
            dates.append(date)
            values.append(None if value != value else value)
        replays = {}
        for mrn, (dates, values) in given.items():
            replays[mrn] = self._replay(mrn, None, stored)
            replays[mrn].begin(dates, values)
        self._keep(stored, replays)

    def close(self) -> None:
        pass


def keyed_inputs(parsed: DataFrame, patients: DataFrame) -> DataFrame:
    """Admissions and first results of a parsed stream as state inputs.

    ``patients`` is the static Patients table: a stream-static join marks
    results whose patient exists before the stream starts.
    """
    from ..functions.hl7 import hl7_time
    # one projection over the parse for both kinds (a union of two filtered
    # branches would parse every message twice), its inputs generated columns
    # as in ``parse_messages``: with the route written out in every column the
    # generated method is too large for the JIT and runs interpreted
    t = F.get(F.col("tests"), 0)
    once = parsed.select(F.inline(F.array(F.struct(
        "route", "mrn", "age", "sex", F.col("msg_id.msg_time").alias("msg_time"), F.col("msg_id.control_id").alias("control_id"),
        t["mrn"].cast("string").alias("test_mrn"), hl7_time(t["test_time"]).alias("test_time"), t["test_value"].alias("test_value")))))
    is_adm = F.col("route") == "admissions"
    both = (once.where(F.col("route").isin("admissions", "results"))
                .select(F.when(is_adm, F.col("mrn")).otherwise(F.col("test_mrn")).alias("mrn"),
                        F.when(is_adm, F.lit("adm")).otherwise(F.lit("res")).alias("kind"),
                        "msg_time", "control_id",
                        F.when(is_adm, F.col("sex").isNull() | F.col("sex").isin(SEX_VALUES))
                         .otherwise(F.lit(True)).alias("sex_ok"),
                        F.when(is_adm, F.col("age").cast("int")).alias("age"),
                        F.when(is_adm, F.col("sex")).alias("sex"),
                        F.when(~is_adm, F.col("test_time")).alias("creatinine_date"),
                        F.when(~is_adm, F.col("test_value")).alias("creatinine_result"))
                # undated results are quarantined by the table sink
                .where((F.col("kind") == "adm") | F.col("creatinine_date").isNotNull()))
    known = patients.select("mrn", F.lit(True).alias("base_known"),
                            F.col("age").cast("int").alias("base_age"), F.col("sex").alias("base_sex"))
    return (both.join(known, "mrn", "left")
                .withColumn("base_known", F.coalesce(F.col("base_known"), F.lit(False))))


def history_stream(parsed: DataFrame, patients: DataFrame, measurements: DataFrame | None = None,
                   defer: bool = False, inline: int = INLINE, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """T4: features per result message from per-patient state.  ``defer`` holds
    results of unknown patients back and releases them with their admission.
    The state is keyed by ``cells`` groups of patients; a checkpoint keeps the number it began with.

    ``measurements`` are the readings stored before the stream starts: they
    begin each patient's state (read by the query's first batch only; a
    restart continues from its checkpoint)."""
    cell = F.pmod(F.xxhash64("mrn"), F.lit(cells).cast("bigint"))
    inputs = keyed_inputs(parsed, patients).withColumn("cell", cell).withColumns({c: _as_micros(c) for c in _TIMES})
    stored = None
    if measurements is not None:
        stored = measurements.where("creatinine_date is not null").select(cell.alias("cell"), "mrn", _as_micros("creatinine_date").alias("creatinine_date"), "creatinine_result").groupBy("cell")
    rows = inputs.groupBy("cell").transformWithStateInPandas(
        statefulProcessor=PatientHistory(defer, inline, block), outputStructType=OUTPUT_SCHEMA.replace("timestamp", "bigint"),
        outputMode="Append", timeMode="None", initialState=stored)
    return rows.withColumns({c: F.timestamp_micros(c) for c in _TIMES})


def history_batch(parsed: DataFrame, patients: DataFrame, measurements: DataFrame | None = None,
                  block: int = asof.BLOCK) -> DataFrame:
    """W4 in batch: the rows the state processor emits, over a table.

    Who is known at a message, with which age and sex, is the last valid
    admission before it (``ordered.keyed_last``), else the stored patient; the
    features come from ``asof.features_as_of``, which splits a patient of more than
    ``block`` readings.  ``measurements`` are stored readings, older than any message."""
    inputs = positions.written(keyed_inputs(parsed, patients), "arrivals")       # each message is parsed once
    admitted = F.when((F.col("kind") == "adm") & F.col("sex_ok"), F.struct("age", "sex"))
    seen = positions.written(ordered.keyed_last(inputs, "mrn", ["msg_time", "control_id"], admitted, "_adm")
                             .where(F.col("kind") == "res"), "arrived-results")
    code = F.lit(0)
    sex = F.when(F.col("_adm").isNotNull(), F.col("_adm.sex")).otherwise(F.col("base_sex"))
    for k, v in SEX_CODE.items():
        code = F.when(sex == k, v).otherwise(code)
    age = F.when(F.col("_adm").isNotNull(), F.col("_adm.age")).otherwise(F.col("base_age"))
    row = ["mrn", "msg_time", "control_id", "creatinine_date", "creatinine_result"]
    known = F.col("_adm").isNotNull() | F.col("base_known")
    accepted = seen.where(known).select(*row, F.coalesce(age, F.lit(0)).cast("int").alias("age"), code.cast("int").alias("sex"),
                                        F.lit(True).alias("arrived"))
    unknown = seen.where(~known).select(*row)
    if measurements is not None:
        stored = measurements.where("creatinine_date IS NOT NULL").join(accepted.select("mrn").distinct(), "mrn", "left_semi")
        accepted = accepted.unionByName(stored.select("mrn", "creatinine_date", "creatinine_result", F.lit(False).alias("arrived")),
                                        allowMissingColumns=True)
    arrival = F.struct("arrived", "msg_time", "control_id", "creatinine_date", "creatinine_result")
    got = asof.features_as_of(accepted, arrival, "creatinine_date", "creatinine_result", F.col("arrived"), block)
    both = got.withColumn("status", F.lit("accepted")).unionByName(
        unknown.withColumn("status", F.lit("unknown_patient")), allowMissingColumns=True)
    return both.select("mrn", "msg_time", "control_id", "creatinine_date", "status", "repeat", "age", "sex", "n_readings", *FEATURE_COLUMNS)
