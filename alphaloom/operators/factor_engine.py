"""A registry of factors: expressions over a bar's windows, and vectorised functions of one code's bars.

Expressions of all enabled factors go into one select, so that they share a sort; those that aggregate frames are taken by
matrices of frames in one grouping (operators/sliding.py); functions run beside each other in one
grouped map. A factor that cannot be resolved against the bars is left out and counted, as the others need not wait for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import factors as fac
from alphaloom.operators import sliding

#: Factors for which a smaller value is better (fixed values).
LESS_IS_BETTER = ("pe", "pb", "ps", "peg", "historical_vol", "downside_vol", "beta", "var_95", "std")


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    direction: int
    expression: Callable[[], Column] | None = None
    batch: Callable[[pd.DataFrame], pd.Series] | None = None
    #: the expression's values by matrices of frames, with the columns they need
    frames: tuple[Callable[[sliding.Bars], sliding.Values], list[str]] | None = None


class Engine:
    """Factors by name; failed counts those that the last computation left out."""

    def __init__(self, factors: Mapping[str, Factor] | None = None) -> None:
        self.factors, self.failed = dict(factors or {}), {}

    def register(self, name: str, expression: Callable[[], Column], category: str = "", direction: int = 1, frames=None) -> None:
        self.factors[name] = Factor(name, category, direction, expression, frames=frames)

    def register_batch(self, name: str, batch: Callable[[pd.DataFrame], pd.Series], category: str = "", direction: int = 1) -> None:
        """batch: from the bars of one code in date order to a value for each."""
        self.factors[name] = Factor(name, category, direction, batch=batch)

    def enabled(self, names: list[str]) -> Engine:
        """The engine of these factors; unknown names are left out."""
        return Engine({n: self.factors[n] for n in names if n in self.factors})

    @classmethod
    def standard(cls) -> Engine:
        """The default factors: those of price and volume as expressions, those of reports as their columns."""
        out = cls()
        windows: dict[str, Callable[[], Column]] = {
            "momentum_1m": lambda: fac.momentum(21), "momentum_3m": lambda: fac.momentum(63), "momentum_6m": lambda: fac.momentum(126), "momentum_12m1m": fac.momentum_12m1m,
            "turnover_momentum": fac.turnover_momentum, "historical_vol": fac.historical_vol, "downside_vol": fac.downside_vol, "beta": fac.market_beta, "var_95": fac.var_95,
            "volume_ratio": fac.volume_ratio, "money_flow": fac.money_flow, "turnover_anomaly": fac.turnover_anomaly, "rsi_14": fac.rsi, "ma5_gap": fac.ma_gap,
        }
        of = {n: c for c, names in fac.CATEGORIES.items() for n in names}
        for name in [*windows, *[n for n in of if n not in windows]]:
            out.register(name, windows.get(name, lambda n=name: F.col(n)), of.get(name, ""), -1 if name in LESS_IS_BETTER else 1, sliding.SINGLE.get(name))
        for names, lengths in fac.FACTORY:
            for n in names:
                for w in lengths:
                    out.register(f"{n}_{w}", lambda n=n, w=w: fac.FAMILIES[n](w), "", -1 if n in LESS_IS_BETTER else 1, sliding.family(n, w))
        return out

    def compute(self, bars: DataFrame) -> DataFrame:
        """code, trade_date and a column for each factor that the bars can give. bars: with ret, diff and mkt."""
        self.failed = {}
        found: dict[str, Column] = {}
        for f in self.factors.values():
            if f.expression is not None:
                try:
                    bars.select(f.expression()).schema  # noqa: B018
                    found[f.name] = f.expression()
                except AnalysisException:
                    self.failed[f.name] = self.failed.get(f.name, 0) + 1
        held = {k: self.factors[k].frames for k in found if self.factors[k].frames}
        rest = [c.alias(k) for k, c in found.items() if k not in held]
        if held:
            inner = {c: f"_bar_{c}" for _, columns in held.values() for c in columns}
            wide = bars.select("code", "trade_date", *rest, *[F.col(c).alias(k) for c, k in inner.items()])
            wide = sliding.with_factors(wide, held, [k for k in found if k not in held], inner).select("code", "trade_date", *found)
        else:
            wide = bars.select("code", "trade_date", *rest)
        functions = {f.name: f.batch for f in self.factors.values() if f.batch is not None}
        if not functions:
            return wide

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("trade_date")
            return pd.DataFrame({"code": own["code"], "trade_date": own["trade_date"]} | {k: f(own).astype(float) for k, f in functions.items()})

        kind = f"code {bars.schema['code'].dataType.simpleString()}, trade_date date, " + ", ".join(f"{k} double" for k in functions)
        return wide.join(bars.groupBy("code").applyInPandas(run, kind), ["code", "trade_date"])


def configured(text: str, environment: Mapping[str, str], key: str) -> list[str]:
    """The list under the key in a configuration text of the form `key: [a, b]`; ${NAME} is replaced from environment,
    and stays where that has no such name."""
    filled = re.sub(r"\$\{(\w+)\}", lambda m: environment.get(m[1], m[0]), text)
    found = re.search(rf"\b{re.escape(key)}:\s*\[([^\]]*)\]", filled)
    return [x.strip() for x in found[1].split(",") if x.strip()] if found else []
