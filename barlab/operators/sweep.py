"""Search over a grid of exits: stop, two targets, hold, cooldown and splits, with overlap selection, gates and validation.

A first-passage index does a signal's walk once for all cells. Over the bars that follow a signal, the running best and the running worst
price are monotone, so the first bar that reaches a distance is found by bisection, once for each distinct distance; the first return
to the entry after that bar is read from a table of next returns. A cell then is a few comparisons of these numbers, and the
bars are read once whatever the size of the grid. Series are the unit of work: a task holds one series' bars and signals, and
puts out one short row for each pattern and cell.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.outcomes import COST, R_CAP

#: Least signals and share of wins of a cell that counts, the score of one that does not, and least signals of a validation.
LEAST_SIGNALS, LEAST_WINS, REJECTED, LEAST_VALIDATION = 25, 0.25, -10.0, 15
#: Signals whose following bars a task lays out at a time.
SIGNALS = 2048


@dataclass(frozen=True)
class Exits:
    """A cell: stop and targets in ATRs, hold and cooldown in bars, and the parts sold at the targets."""

    stop: float = 2.0
    t1: float = 2.0
    t2: float = 4.0
    hold: int = 60
    cooldown: int = 5
    split_t1: float = 0.5
    split_t2: float = 0.3

    def splits(self) -> tuple[float, float, float]:
        """The three parts; the last is 5 % at least, at the second one's cost."""
        rest = round(max(0.0, 1.0 - self.split_t1 - self.split_t2), 2)
        return (self.split_t1, self.split_t2, rest) if rest >= 0.05 else (self.split_t1, round(1.0 - self.split_t1 - 0.05, 2), 0.05)


def grid(**values: Iterable) -> list[Exits]:
    """All cells of the given values; fields that are not named keep their default."""
    return [Exits(**dict(zip(values, cell, strict=True))) for cell in product(*values.values())]


def first_at(running: np.ndarray, level: np.ndarray) -> np.ndarray:
    """By row of a rising matrix, the first position at which it is at least `level`; the width where it never is."""
    low, high = np.zeros(len(running), dtype=np.int64), np.full(len(running), running.shape[1])
    rows = np.arange(len(running))
    while (low < high).any():
        middle = (low + high) // 2
        hit = running[rows, np.minimum(middle, running.shape[1] - 1)] >= level
        low, high = np.where(~hit & (low < high), middle + 1, low), np.where(hit & (low < high), middle, high)
    return low


def _round3(x: np.ndarray) -> np.ndarray:
    """To three places, halves away from 0."""
    return np.sign(x) * np.floor(np.abs(x) * 1000 + 0.5) / 1000


class FirstPassages:
    """The index of one series' signals: positions count from the bar after a signal."""

    def __init__(self, k: np.ndarray, sign: np.ndarray, entry: np.ndarray, atr: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, cells: list[Exits]):  # noqa: E741
        self.k, self.sign, self.entry, self.close = k, sign, entry, c
        self.width = max(x.hold for x in cells)
        self.price, self.at, self.back = {}, {}, {}
        for kind, side in (("stop", -1), ("t1", 1), ("t2", 1)):
            for m in sorted({getattr(x, kind) for x in cells}):
                self.price[kind, m] = np.rint(entry + side * sign * atr * m)
                self.at[kind, m] = np.empty(len(k), dtype=np.int64)
        for m in {x.t1 for x in cells}:
            self.back[m] = np.empty(len(k), dtype=np.int64)
        for i in range(0, len(k), SIGNALS):
            self._index(slice(i, i + SIGNALS), h, l)

    def _index(self, some: slice, h: np.ndarray, l: np.ndarray) -> None:  # noqa: E741
        sign, entry = self.sign[some, None], self.entry[some, None]
        place = self.k[some, None] + 1 + np.arange(self.width)
        there, place = place < len(h), np.minimum(place, len(h) - 1)
        best = np.where(there, np.where(sign > 0, h[place] - entry, entry - l[place]), -np.inf)
        against = np.where(there, np.where(sign > 0, entry - l[place], h[place] - entry), -np.inf)
        runs = {"stop": np.maximum.accumulate(against, axis=1), "t1": np.maximum.accumulate(best, axis=1)}
        # the next position, from each on, at which the entry is touched again
        touched = np.where(against >= 0, np.arange(self.width), self.width)
        returns = np.minimum.accumulate(np.append(touched, np.full((len(touched), 2), self.width), axis=1)[:, ::-1], axis=1)[:, ::-1]
        for (kind, m), price in self.price.items():
            distance = self.sign[some] * (price[some] - self.entry[some])
            self.at[kind, m][some] = first_at(runs["stop" if kind == "stop" else "t1"], -distance if kind == "stop" else distance)
        for m, back in self.back.items():
            back[some] = returns[np.arange(len(returns)), self.at["t1", m][some] + 1]

    def resolve(self, x: Exits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each signal: the bar of its exit, R in thousandths, whether it won (a target at least), and whether it has bars at all."""
        end = np.minimum(x.hold, len(self.close) - 1 - self.k)
        stop, one, back = self.at["stop", x.stop], self.at["t1", x.t1], self.back[x.t1]
        two = np.maximum(self.at["t2", x.t2], one)
        got1 = (one < end) & (one < stop)
        got2 = got1 & (two < end) & ((back >= end) | (two < back))
        a, b, c = x.splits()
        risk = np.abs(self.entry - self.price["stop", x.stop])
        with np.errstate(divide="ignore", invalid="ignore"):
            leg = lambda price: _round3(self.sign * (price - self.entry) / risk)
            last = leg(self.close[np.minimum(self.k + np.maximum(end, 1), len(self.close) - 1)])
            rest = np.where(back < end, 0.0, last)
            first, second = a * leg(self.price["t1", x.t1]), b * leg(self.price["t2", x.t2])
            raw = np.where(got1 & got2, first + second + c * rest, np.where(got1, first + (b + c) * rest, np.where(stop < end, leg(self.price["stop", x.stop]), last)))
        raw = np.where(risk > 0, np.clip(raw, -R_CAP, R_CAP), -1.0 + COST)
        left = np.where(got1, np.where(back < end, back, end - 1), np.where(stop < end, stop, end - 1))
        return self.k + 1 + np.where(risk > 0, left, 0), np.rint(_round3(raw - COST) * 1000).astype(np.int64), got1 & (risk > 0), end > 0


def taken(k: np.ndarray, group: np.ndarray, exit_: np.ndarray, cooldown: int, usable: np.ndarray) -> np.ndarray:
    """Positions of the signals, in order of k, that a trader with one open trade takes; a group is a side and price bucket, with a cooldown of its own."""
    out, fired, i = [], {}, 0
    while i < len(k):
        if usable[i] and k[i] - fired.get(group[i], -(10**9)) >= cooldown:
            out.append(i)
            fired[group[i]] = k[i]
            # the bar that a trade closes on is free again
            i = max(i + 1, int(np.searchsorted(k, exit_[i])))
        else:
            i += 1
    return np.array(out, dtype=np.int64)


_ROW = "symbol string, tf string, pattern string, cell int, n long, wins long, total_milli long, won_milli long, lost_milli long"


def sweep(signals: DataFrame, bars: DataFrame, cells: list[Exits]) -> DataFrame:
    """One row for each series, pattern and cell with signals taken. signals: symbol, tf, k, bias, pattern, confidence, bucket, entry, atr; bars: symbol, tf, k (from 0), h, l, c."""

    def run(some: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("k")
        h, l, c = (series[x].to_numpy(dtype=np.float64) for x in "hlc")  # noqa: E741
        rows = []
        for pattern, own in some.sort_values(["k", "confidence", "bias", "bucket"], ascending=[True, False, True, True], kind="stable").groupby("pattern", sort=True):
            k = own["k"].to_numpy(dtype=np.int64)
            sign = np.where(own["bias"] == "long", 1, -1)
            group = pd.factorize(own["bias"].astype(str) + "|" + own["bucket"].astype(str))[0]
            index = FirstPassages(k, sign, own["entry"].to_numpy(dtype=np.float64), own["atr"].to_numpy(dtype=np.float64), h, l, c, cells)
            for number, cell in enumerate(cells):
                exit_, r, won, usable = index.resolve(cell)
                at = taken(k, group, exit_, cell.cooldown, usable)
                lost = r[at][~won[at] & (r[at] <= 0)]
                rows.append((own["symbol"].iloc[0], own["tf"].iloc[0], pattern, number, len(at), int(won[at].sum()), int(r[at].sum()), int(r[at][won[at]].sum()), int(-lost.sum())))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _ROW.split(", ")])

    fields = ["symbol", "tf", "k", "bias", "pattern", "confidence", "bucket", "entry", "atr"]
    usable = signals.select(*fields).where("atr is not null and entry is not null")
    # new names of the same columns, as signals may come from these very bars
    series = bars.select(*(F.col(c).alias(c) for c in ("symbol", "tf", "k", "h", "l", "c")))
    return usable.groupBy("symbol", "tf").cogroup(series.groupBy("symbol", "tf")).applyInPandas(run, _ROW)


def _score(n: Column, wins: Column, total: Column) -> Column:
    """Expectancy weighted by the number of signals; cells that fail a gate get REJECTED."""
    good = (n >= LEAST_SIGNALS) & (wins >= LEAST_WINS * n)
    return F.when(good, total / n / 1000 * F.least(F.lit(1.0), F.sqrt(n / 100.0))).otherwise(REJECTED)


def by_cell(swept: DataFrame, cells: list[Exits]) -> DataFrame:
    """pattern, the cell's fields, n, wins, expectancy, win_rate, profit_factor, score."""
    sums = swept.groupBy("pattern", "cell").agg(*(F.sum(x).alias(x) for x in ("n", "wins", "total_milli", "won_milli", "lost_milli")))
    named = sums.join(F.broadcast(_named(swept, cells)), "cell")  # as many short rows as the caller's list has
    return named.withColumns(
        {
            "expectancy": F.try_divide("total_milli", "n") / 1000, "win_rate": F.try_divide("wins", "n"), "score": _score(F.col("n"), F.col("wins"), F.col("total_milli")),
            "profit_factor": F.least(F.lit(99.0), F.try_divide("won_milli", F.when(F.col("lost_milli") > 0, F.col("lost_milli")).otherwise(1))),
        }
    ).drop("won_milli", "lost_milli")


def _named(swept: DataFrame, cells: list[Exits]) -> DataFrame:
    schema = "cell int, stop double, t1 double, t2 double, hold int, cooldown int, split_t1 double, split_t2 double"
    return swept.sparkSession.createDataFrame([(i, *map(float, astuple(x)[:3]), x.hold, x.cooldown, float(x.split_t1), float(x.split_t2)) for i, x in enumerate(cells)], schema)


def best_cells(swept: DataFrame, halves: DataFrame, cells: list[Exits]) -> DataFrame:
    """Each pattern's best cell on the symbols of half 0, checked on those of half 1. halves: (symbol, half).

    A validation of under LEAST_VALIDATION signals is null and flags nothing; a negative one, or one under half the training score, flags overfit.
    """
    sides = swept.join(halves.hint("merge"), "symbol").groupBy("pattern", "cell", "half").agg(*(F.sum(x).alias(x) for x in ("n", "wins", "total_milli")))
    train, val = sides.where("half = 0"), sides.where("half = 1")
    scored = train.withColumn("train_score", _score(F.col("n"), F.col("wins"), F.col("total_milli"))).where(F.col("train_score") > REJECTED)
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc(F.round("train_score", 9)), "cell"))).where("rank = 1")
    best = best.select("pattern", "cell", F.col("n").alias("train_signals"), "train_score")
    checked = best.join(val.select("pattern", "cell", F.col("n").alias("val_signals"), F.col("total_milli").alias("val_total")).hint("merge"), ["pattern", "cell"], "left")
    expectancy = F.when(F.col("val_signals") >= LEAST_VALIDATION, F.col("val_total") / F.col("val_signals") / 1000)
    checked = checked.withColumn("val_expectancy", expectancy).withColumn("val_signals", F.coalesce("val_signals", F.lit(0).cast("long"))).drop("val_total")
    over = (F.col("val_expectancy") < 0) | ((F.col("train_score") > 0) & (F.col("val_expectancy") < 0.5 * F.col("train_score")))
    return checked.withColumn("overfit", F.coalesce(over, F.lit(False))).join(F.broadcast(_named(swept, cells)), "cell")
