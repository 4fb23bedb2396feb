"""Long patient histories in blocks: what ``state.PatientHistory`` keeps of a
patient with more readings than fit in one piece.  Dates are integers
(microseconds); the blocks lie in a store, one summary entry a block in the
patient's row.
"""

from __future__ import annotations

import bisect
import math
from fractions import Fraction

import numpy as np

from ..schemas import FEATURE_COLUMNS


def ratio(n: float, d: float) -> float:
    if n is None or d is None or (isinstance(n, float) and math.isnan(n)) or math.isnan(d):
        return 0.0
    if d == 0:
        return math.inf if n > 0 else (-math.inf if n < 0 else 0.0)
    return n / d


class ExactSums:
    """Exact running sums of the finite readings and of their squares, and the
    number ``odd`` of others.  A reading is an integer over a power of two, so
    the sums are integers ``n1`` over 2**shift and ``n2`` over 4**shift (no
    greatest common divisor a message, as fractions take)."""

    n1 = n2 = shift = odd = 0

    @property
    def s1(self) -> Fraction:
        return Fraction(self.n1, 1 << self.shift)

    @property
    def s2(self) -> Fraction:
        return Fraction(self.n2, 1 << 2 * self.shift)

    def _begin_sums(self, s1: Fraction, s2: Fraction) -> None:
        bits = lambda x: x.denominator.bit_length() - 1          # noqa: E731 - both are powers of two
        self.shift = max(bits(s1), (bits(s2) + 1) // 2)
        self.n1, self.n2 = int(s1 * (1 << self.shift)), int(s2 * (1 << 2 * self.shift))

    def _count(self, v, sign):
        if not math.isfinite(v):
            self.odd += sign
            return
        x, over = v.as_integer_ratio()
        up = over.bit_length() - 1 - self.shift
        if up > 0:
            self.n1, self.n2, self.shift = self.n1 << up, self.n2 << 2 * up, self.shift + up
        else:
            x <<= -up
        self.n1 += sign * x
        self.n2 += sign * x * x

    def _mean_std(self, n: int) -> tuple[float, float]:
        """Mean and sample deviation of ``n`` finite readings, each rounded once."""
        mean = self.n1 / (n << self.shift)
        return mean, math.sqrt((self.n2 * n - self.n1 * self.n1) / (n * (n - 1) << 2 * self.shift)) if n > 1 else 0.0


class MemoryStore:
    """Blocks kept in a dict, with the numbers of blocks read and written."""

    def __init__(self):
        self.kept: dict = {}
        self.reads = self.writes = 0

    def get(self, kind: str, k: int):
        self.reads += 1
        return self.kept[kind, k]

    def put(self, kind: str, k: int, block) -> None:
        self.writes += 1
        self.kept[kind, k] = block

    def remove(self, kind: str, k: int) -> None:
        del self.kept[kind, k]


class MapStore:
    """A patient's blocks in map states keyed (mrn, block); each is read at
    most once and written at most once per micro-batch."""

    def __init__(self, dates, values, mrn):
        self.maps, self.mrn = {"d": dates, "v": values}, mrn
        self.cache: dict = {}
        self.changed: set = set()

    def get(self, kind: str, k: int):
        if (kind, k) not in self.cache:
            got = self.maps[kind].getValue((self.mrn, k))
            self.cache[kind, k] = [list(x) for x in got] if kind == "d" else list(got[0])
        return self.cache[kind, k]

    def put(self, kind: str, k: int, block) -> None:
        self.cache[kind, k] = block
        self.changed.add((kind, k))

    def remove(self, kind: str, k: int) -> None:
        self.cache.pop((kind, k), None)
        self.changed.discard((kind, k))
        if self.maps[kind].containsKey((self.mrn, k)):
            self.maps[kind].removeKey((self.mrn, k))

    def flush(self) -> None:
        for kind, k in sorted(self.changed):
            block = self.cache[kind, k]
            self.maps[kind].updateValue((self.mrn, k), (block[0], block[1]) if kind == "d" else (block,))
        self.changed.clear()


BLOCK = 256                      # readings of a block; it is split at twice as many

_DATE_FIELDS = ("did", "dfirst", "dhead", "dtail", "dstep", "drecent", "dn")
_VALUE_FIELDS = ("vid", "vlow", "vhigh", "vn")


class BlockHistory(ExactSums):
    """A long history as blocks of dates and blocks of values, with one
    summary entry a block.  A message reads and writes the block of its date,
    one or two blocks of values (its own and an overwritten one), and at most
    two more for the median; the rest is read from the summaries.

    Of a date block: number, first date, first and last reading, largest step
    inside, last reading that is not missing, size.  Of a value block: number, least, greatest, size.
    """

    def __init__(self, store, summary=None, block: int = BLOCK):
        self.store, self.block = store, block
        s = dict(zip((*_DATE_FIELDS, *_VALUE_FIELDS, "s1", "s2", "odd", "next_id"), summary)) if summary is not None else {}
        for c in (*_DATE_FIELDS, *_VALUE_FIELDS):
            setattr(self, c, list(s.get(c) or []))
        self._begin_sums(Fraction(s.get("s1") or 0), Fraction(s.get("s2") or 0))
        self.odd, self.next_id = s.get("odd") or 0, s.get("next_id") or 0

    @classmethod
    def of(cls, store, hist, block: int = BLOCK) -> BlockHistory:
        """The same history cut into blocks."""
        out = cls(store, None, block)
        out.n1, out.n2, out.shift, out.odd = hist.n1, hist.n2, hist.shift, hist.odd
        for k in range(0, len(hist.dates), block):
            out._new("d", len(out.did), [hist.dates[k:k + block], hist.vals[k:k + block]])
        for k in range(0, len(hist.sorted_vals), block):
            out._new("v", len(out.vid), hist.sorted_vals[k:k + block])
        return out

    def summary(self) -> tuple:
        return (*(getattr(self, c) for c in (*_DATE_FIELDS, *_VALUE_FIELDS)), str(self.s1), str(self.s2), self.odd, self.next_id)

    def _new(self, kind: str, at: int, block) -> None:
        for c in (_DATE_FIELDS if kind == "d" else _VALUE_FIELDS):
            getattr(self, c).insert(at, None)
        (self.did if kind == "d" else self.vid)[at] = self.next_id
        self.next_id += 1
        self._keep(kind, at, block)

    def _keep(self, kind: str, at: int, block) -> None:
        """Write a block and its summary entry; split it if it has grown too large, drop it if it is empty."""
        size = len(block[0]) if kind == "d" else len(block)
        if size > 2 * self.block:
            half = size // 2
            more = [x[half:] for x in block] if kind == "d" else block[half:]
            self._keep(kind, at, [x[:half] for x in block] if kind == "d" else block[:half])
            self._new(kind, at + 1, more)
            return
        if kind == "d":
            dates, vals = block
            steps = [b - a for a, b in zip(vals, vals[1:]) if a is not None and b is not None]
            entry = (self.did[at], dates[0], vals[0], vals[-1], max(steps, default=None), next((v for v in reversed(vals) if v is not None), None), size)
            for c, x in zip(_DATE_FIELDS, entry):
                getattr(self, c)[at] = x
        elif size:
            self.vlow[at], self.vhigh[at], self.vn[at] = block[0], block[-1], size
        else:
            self.store.remove(kind, self.vid[at])
            for c in _VALUE_FIELDS:
                del getattr(self, c)[at]
            return
        self.store.put(kind, (self.did if kind == "d" else self.vid)[at], block)

    def _add_val(self, v) -> None:
        if v is None:
            return
        self._count(v, 1)
        if not self.vid:
            self._new("v", 0, [v])
            return
        at = max(0, bisect.bisect_right(self.vlow, v) - 1)
        block = self.store.get("v", self.vid[at])
        bisect.insort(block, v)
        self._keep("v", at, block)

    def _remove_val(self, v) -> None:
        if v is None:
            return
        self._count(v, -1)
        at = bisect.bisect_right(self.vlow, v) - 1              # the last block that begins at v or below holds it
        block = self.store.get("v", self.vid[at])
        del block[bisect.bisect_left(block, v)]
        self._keep("v", at, block)

    def upsert(self, d, v) -> bool:
        """As ``History.upsert``."""
        if not self.did:
            self._new("d", 0, [[d], [v]])
            self._add_val(v)
            return False
        at = max(0, bisect.bisect_right(self.dfirst, d) - 1)
        dates, vals = block = self.store.get("d", self.did[at])
        i = bisect.bisect_left(dates, d)
        if i < len(dates) and dates[i] == d:
            old = vals[i]
            if old == v:
                return True
            vals[i] = v
            self._remove_val(old)
        else:
            dates.insert(i, d)
            vals.insert(i, v)
        self._keep("d", at, block)
        self._add_val(v)
        return False

    def _value_at(self, rank: int) -> float:
        for k, n in zip(self.vid, self.vn):
            if rank < n:
                return self.store.get("v", k)[rank]
            rank -= n
        raise IndexError(rank)

    def features(self) -> dict[str, float]:
        n = sum(self.vn)
        if n == 0:
            return {"n_readings": 0, **{c: 0.0 for c in FEATURE_COLUMNS}}
        low, high = self._value_at((n - 1) // 2), self._value_at(n // 2)
        med = float(low) if n % 2 else (low + high) / 2.0
        if self.odd:
            sv = [x for k in self.vid for x in self.store.get("v", k)]
            mean, std = float(np.mean(sv)), float(np.std(sv, ddof=1)) if n > 1 else 0.0
        else:
            mean, std = self._mean_std(n)
        border = [b - a for a, b in zip(self.dtail, self.dhead[1:]) if a is not None and b is not None]
        step = max([s for s in self.dstep if s is not None] + border, default=None)
        recent = next(v for v in reversed(self.drecent) if v is not None)
        mn, mx = float(self.vlow[0]), float(self.vhigh[-1])
        return {
            "n_readings": n,
            "creatinine_mean": mean, "creatinine_median": med, "creatinine_max": mx, "creatinine_min": mn,
            "creatinine_max_delta": 0.0 if step is None else float(step), "creatinine_std": std,
            "most_recent": float(recent), "rv1_ratio": ratio(recent, mn), "rv2_ratio": ratio(recent, med),
        }
