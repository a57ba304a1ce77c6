"""Factors over sliding frames, by matrices: a code's bars become a matrix of frames, a row for each bar.

Spark's frames are evaluated anew for every bar, an aggregate and a value at a time; here a task takes one code's bars
after the other and evaluates all frames of one at once. Nulls are left out of aggregates, as in SQL; a frame's
aggregates come from deviations from its own mean, so that nothing is lost by subtraction.

A factor is a function of Bars and gives a value for each bar and whether there is one (else it is null).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
#: Bars whose frames are held at a time.
ROWS, START = 1024, 256

Values = tuple[np.ndarray, np.ndarray]


class Held:
    """The last w values of a column at some bars: a matrix x of frames over a line of values, and how many are there."""

    def __init__(self, line: np.ndarray, there: np.ndarray, w: int) -> None:
        self.line, self.marks, self.w = line, there, w
        count = np.concatenate([[0], np.cumsum(there)])
        self.n = count[w:] - count[:-w]
        self.x, self.there = sliding_window_view(line, w), sliding_window_view(there, w)
        self.every = bool((self.n == w).all())

    def filled(self, value: float) -> np.ndarray:
        return self.x if self.every else np.where(self.there, self.x, value)

    def sum(self) -> Values:
        return self.filled(0.0).sum(1), self.n > 0

    def mean(self) -> Values:
        return self._mean, self.n > 0

    @cached_property
    def _mean(self) -> np.ndarray:
        return self.sum()[0] / np.maximum(self.n, 1)

    @cached_property
    def deviations(self) -> np.ndarray:
        d = self.x - self._mean[:, None]
        return d if self.every else np.where(self.there, d, 0.0)

    @cached_property
    def _variance(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.deviations, self.deviations) / np.maximum(self.n, 1)

    def moment(self, k: int) -> Values:
        if k == 2:
            return self._variance, self.n > 0
        d = self.deviations
        return np.einsum("ij,ij->i", d * d, d if k == 3 else d * d) / np.maximum(self.n, 1), self.n > 0

    def std(self) -> Values:
        return np.where(self.moving, np.sqrt(self._variance), 0.0), self.n > 0

    @cached_property
    def moving(self) -> np.ndarray:
        """Whether the values differ; not a number differs from all. Equal ones may deviate from their mean by rounding."""
        out = self.n > 0
        for i in np.flatnonzero(~(self._variance > 1e-18 * self._mean**2) & out):
            x = self.x[i][self.there[i]]
            out[i] = not (x == x[0]).all()
        return out

    def _extreme(self, of: np.ufunc, value: float) -> Values:
        """By frames of doubled length."""
        out, size = np.where(self.marks, self.line, value), 1
        while 2 * size <= self.w:
            out, size = of(out[:-size], out[size:]), 2 * size
        rest = self.w - size
        return (of(out[: len(out) - rest], out[rest:]) if rest else out), self.n > 0

    def max(self) -> Values:
        return self._extreme(np.maximum, -np.inf)

    def min(self) -> Values:
        return self._extreme(np.fmin, np.inf)

    def both(self, other: Held) -> tuple[Held, Held]:
        """Where either side is missing, neither counts."""
        if self.every and other.every or (self.marks == other.marks).all():
            return self, other
        there = self.marks & other.marks
        return Held(self.line, there, self.w), Held(other.line, there, self.w)


def covariance(a: Held, b: Held, less: int = 0) -> Values:
    """Of pairs of which neither is missing; less: 1 for that of a sample."""
    a, b = a.both(b)
    return np.einsum("ij,ij->i", a.deviations, b.deviations) / np.maximum(a.n - less, 1), a.n > less


def divided(a: Values, b: Values) -> Values:
    """Null where either is, or where the divisor is 0."""
    ok = a[1] & b[1] & (b[0] != 0)
    return a[0] / np.where(ok, b[0], 1.0), ok


def times(a: Values, b: Values) -> Values:
    return a[0] * b[0], a[1] & b[1]


class Bars:
    """One code's columns in date order, at the bars from lo to hi."""

    def __init__(self, columns: dict[str, Values], lo: int, hi: int, kept: dict) -> None:
        self.columns, self.lo, self.hi, self.kept = columns, lo, hi, kept

    def column(self, c: str) -> Values:
        x, there = self.columns[c]
        return x[self.lo : self.hi], there[self.lo : self.hi]

    def own(self, name: str, make: Callable[..., Values]) -> str:
        """Adds a column that make gives from whole columns, by name."""
        if name not in self.columns:
            self.columns[name] = make(self.columns.get)
        return name

    def back(self, c: str, n: int) -> Values:
        """The value n bars before."""
        x, there = self.columns[c]
        at = np.arange(self.lo, self.hi) - n
        return x[np.maximum(at, 0)], there[np.maximum(at, 0)] & (at >= 0)

    def over(self, c: str, w: int, skip: int = 0) -> Held:
        """Frames of the w bars that end `skip` bars before each."""
        if (c, w, skip) not in self.kept:
            x, there = self.columns[c]
            first = self.lo - w + 1 - skip
            head = max(-first, 0)
            part = slice(max(first, 0), max(self.hi - skip, 0))
            pad = lambda v: np.concatenate([np.zeros(min(head, self.hi - self.lo + w - 1), v.dtype), v[part]])
            self.kept[c, w, skip] = Held(pad(x), pad(there), w)
        return self.kept[c, w, skip]

    def later(self, k: int) -> Bars:
        """These bars without the first k."""
        if ("later", k) not in self.kept:
            self.kept["later", k] = Bars(self.columns, self.lo + k, self.hi, {})
        return self.kept["later", k]

    def full(self, value: Values, w: int, over: str = "close") -> Values:
        """value, where the last w bars have w values of the column."""
        return value[0], value[1] & (self.over(over, w).n >= w)


def _moving(b: Bars, w: int, *columns: str) -> np.ndarray:
    return np.logical_and.reduce([b.over(c, w).moving for c in columns])


def _correlation(b: Bars, w: int, x: str, y: str) -> Values:
    return divided(covariance(b.over(x, w), b.over(y, w)), times(b.over(x, w).std(), b.over(y, w).std()))


def roc(b: Bars, w: int) -> Values:
    before = b.back("close", w - 1)
    v, ok = divided(b.column("close"), before)
    still = before[1] & (before[0] == 0)
    return b.full((np.where(still, 0.0, v - 1), ok | still), w)


def std(b: Bars, w: int) -> Values:
    return b.full(b.over("ret", w).std(), w, "ret")


def corr(b: Bars, w: int) -> Values:
    v, ok = _correlation(b, w, "close", "volume")
    return b.full((v, ok & _moving(b, w, "close", "volume")), w)


def high_max(b: Bars, w: int) -> Values:
    return b.full(divided(b.over("high", w).max(), b.column("close")), w)


def low_min(b: Bars, w: int) -> Values:
    return b.full(divided(b.over("low", w).min(), b.column("close")), w)


def vma(b: Bars, w: int) -> Values:
    m = b.over("volume", w).mean()
    v, ok = divided(b.column("volume"), m)
    none = m[1] & (m[0] == 0)
    return b.full((np.where(none, 1.0, v), ok | none), w)


def _variation(c: str) -> Callable[[Bars, int], Values]:
    return lambda b, w: b.full(divided(b.over(c, w).std(), b.over(c, w).mean()), w)


def _all(x: np.ndarray) -> Values:
    return x.astype(float), np.ones(len(x), bool)


def cntp(b: Bars, w: int) -> Values:
    rises = b.own("_rises", lambda of: _all((of("diff")[0] > 0) & of("diff")[1]))
    return b.full(b.over(rises, w).mean(), w, "diff")


def beta(b: Bars, w: int) -> Values:
    v, ok = covariance(b.over("ret", w), b.over("mkt", w), 1)
    m, there = b.over("mkt", w).moment(2)
    return b.full((v / (m + TINY), ok & there), w, "ret")


def rsqr(b: Bars, w: int) -> Values:
    v, ok = _correlation(b, w, "ret", "mkt")
    return b.full((v * v, ok & _moving(b, w, "ret", "mkt")), w, "ret")


def rank(b: Bars, w: int) -> Values:
    x, (now, there) = b.over("ret", w), b.column("ret")
    below = ((x.x <= now[:, None]) | np.isnan(now)[:, None]) & x.there
    return b.full((below.sum(1) / w, there), w, "ret")


def _shape(k: int, less: float) -> Callable[[Bars, int], Values]:
    """The k-th central moment over the deviation's power, less a constant."""

    def shape(b: Bars, w: int) -> Values:
        x = b.over("ret", w)
        v, ok = divided(x.moment(k), (x.moment(2)[0] ** (k / 2), x.moving))
        return b.full((v - less, ok), w, "ret")

    return shape


def _spread(part: str, whole: str, top: str, low: str) -> Callable[[Bars, int], Values]:
    """Mean of (top - low) / (whole + a tiny term)."""
    make = lambda of: ((of(top)[0] - of(low)[0]) / (of(whole)[0] + TINY), of(top)[1] & of(low)[1] & of(whole)[1])
    return lambda b, w: b.full(b.over(b.own(part, make), w).mean(), w)


def vwap(b: Bars, w: int) -> Values:
    m = divided(b.over("amount", w).sum(), b.over("volume", w).sum())
    close = b.column("close")
    return b.full(divided((close[0] - m[0], close[1] & m[1]), m), w)


amp, oc = _spread("_amp", "close", "high", "low"), _spread("_oc", "open", "close", "open")

#: Family by name: its function of bars and a window, and the columns it needs, first that which must fill the frame.
FAMILIES: dict[str, tuple[Callable[[Bars, int], Values], list[str]]] = {
    "roc": (roc, ["close"]), "std": (std, ["ret"]), "corr": (corr, ["close", "volume"]), "max": (high_max, ["close", "high"]), "min": (low_min, ["close", "low"]),
    "vma": (vma, ["close", "volume"]), "vstd": (_variation("volume"), ["close", "volume"]), "cntp": (cntp, ["diff"]), "beta": (beta, ["ret", "mkt"]), "rsqr": (rsqr, ["ret", "mkt"]),
    "rank": (rank, ["ret"]), "skew": (_shape(3, 0.0), ["ret"]), "kurt": (_shape(4, 3.0), ["ret"]), "turn": (_variation("turnover_rate"), ["close", "turnover_rate"]),
    "amp": (amp, ["close", "high", "low"]), "hl_spread": (amp, ["close", "high", "low"]), "vwap": (vwap, ["close", "amount", "volume"]), "oc": (oc, ["close", "open"]),
}


def family(name: str, w: int) -> tuple[Callable[[Bars], Values], list[str]]:
    """The family at a window; bars before the first full frame are left out, as most frames hold no gap after it."""
    made, columns = FAMILIES[name]

    def run(b: Bars) -> Values:
        full = b.over(columns[0], w).n >= w
        first = int(full.argmax()) if full.any() else len(full)
        v, ok = np.zeros(len(full)), np.zeros(len(full), bool)
        if first < len(full):
            v[first:], ok[first:] = made(b.later(first) if first else b, w)
        return v, ok

    return run, columns


def crossed(a: str, b: str, op: str, w: int) -> tuple[Callable[[Bars], Values], list[str]]:
    """Product or quotient of two families at one window."""
    (x, first), (y, second) = family(a, w), family(b, w)
    made = {"product": times, "ratio": divided}[op]
    return lambda bars: made(x(bars), y(bars)), [*first, *second]


YEAR = 252**0.5


def volatility(c: str, w: int, least: int, scale: float = 1.0) -> Callable[[Bars], Values]:
    def made(b: Bars) -> Values:
        x = b.over(c, w)
        v, ok = x.std()
        return v * scale, ok & (x.n >= least)

    return made


def downside_vol(b: Bars) -> Values:
    down = b.own("_down", lambda of: (of("ret")[0], of("ret")[1] & (of("ret")[0] < 0)))
    return volatility(down, 252, 10, YEAR)(b)


def market_beta(b: Bars) -> Values:
    r, m = b.over("ret", 252), b.over("mkt", 252)
    v, ok = divided(covariance(r, m), m.moment(2))
    return v, ok & (r.n >= 60) & m.moving


def var_95(b: Bars) -> Values:
    x = b.over("ret", 252)
    at = np.minimum(np.floor(x.n * 0.05).astype(int), 251)
    return np.abs(np.sort(x.filled(np.nan), axis=1)[np.arange(len(at)), at]) * YEAR, x.n >= 60


def mean_ratio(b: Bars) -> Values:
    """Also of frames that are not full."""
    return divided(b.over("volume", 5).mean(), b.over("volume", 20).mean())


def volume_ratio(b: Bars) -> Values:
    return b.full(mean_ratio(b), 20)


def money_flow(b: Bars) -> Values:
    def flow(of: Callable[[str], Values]) -> Values:
        (c, _), (o, _), (v, _), (a, _) = (of(k) for k in ("close", "open", "volume", "amount"))
        there = np.logical_and.reduce([of(k)[1] for k in ("close", "open", "volume", "amount")])
        return divided(((c - o) * v, there), (o * a, there))

    return b.full(b.over(b.own("_flow", flow), 5).sum(), 5)


def turnover_anomaly(b: Bars) -> Values:
    x, (now, there) = b.over("turnover_rate", 20, 1), b.column("turnover_rate")
    m, s = x.mean()[0], x.std()[0]
    still = s < 1e-15
    return np.where(still, 0.0, (now - m) / np.where(still, 1.0, s)), (still | there) & (x.n >= 20)


def turnover_momentum(b: Bars) -> Values:
    last, prior = b.over("turnover_rate", 21).mean(), b.over("turnover_rate", 21, 21).mean()
    v, ok = divided((last[0] - prior[0], last[1] & prior[1]), prior)
    return v, ok & (b.over("turnover_rate", 42).n >= 42)


#: Single factors by name, with the columns they need.
SINGLE: dict[str, tuple[Callable[[Bars], Values], list[str]]] = {
    "turnover_momentum": (turnover_momentum, ["turnover_rate"]), "historical_vol": (volatility("ret", 252, 20, YEAR), ["ret"]), "downside_vol": (downside_vol, ["ret"]), "beta": (market_beta, ["ret", "mkt"]),
    "var_95": (var_95, ["ret"]), "volume_ratio": (volume_ratio, ["close", "volume"]), "money_flow": (money_flow, ["close", "open", "volume", "amount"]), "turnover_anomaly": (turnover_anomaly, ["turnover_rate"]),
    "vol_1m": (volatility("ret", 21, 15), ["ret"]), "vol_3m": (volatility("ret", 63, 40), ["ret"]),
}


def column_of(table: pa.Table, c: str) -> Values:
    """A column's values, and which are not null."""
    x = table.column(c).combine_chunks()
    there = pc.is_valid(x).to_numpy(zero_copy_only=False)
    return pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), there


def with_factors(bars: DataFrame, factors: dict[str, tuple[Callable[[Bars], Values], list[str]]], keep: list[str] = (), where: dict[str, str] | None = None) -> DataFrame:
    """code, trade_date, the columns to keep and one for each factor: its value at every bar. A task holds one code's bars,
    and the frames of ROWS of them. where: columns of bars for those that factors need, if named otherwise."""
    needed = sorted({c for _, columns in factors.values() for c in columns})
    inner = {c: f"_in_{c}" for c in needed}
    held = ["code", "trade_date", *keep]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("trade_date", "ascending")], null_placement="at_start"))
        columns = {c: column_of(table, inner[c]) for c in needed}
        parts: dict[str, list[Values]] = {k: [] for k in factors}
        with np.errstate(all="ignore"):
            # the first bars stand alone: their longest frames are not full
            ends = [0, *range(START, table.num_rows, ROWS), table.num_rows] if table.num_rows > START else [0, table.num_rows]
            for lo, hi in zip(ends, ends[1:]):
                b = Bars(columns, lo, hi, {})
                for k, (made, _) in factors.items():
                    parts[k].append(made(b))
        out = {k: pa.array(np.concatenate([v for v, _ in p]), pa.float64(), mask=~np.concatenate([ok for _, ok in p])) for k, p in parts.items()}
        return pa.table({**{c: table.column(c) for c in held}, **out})

    kinds = [f"`{c}` {bars.schema[c].dataType.simpleString()}" for c in held] + [f"`{k}` double" for k in factors]
    given = bars.select(*held, *[F.col((where or {}).get(c, c)).cast("double").alias(inner[c]) for c in needed])
    return given.groupBy("code").applyInArrow(run, ", ".join(kinds))
