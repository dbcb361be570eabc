"""Left-to-right recursions over one series. One Arrow batch per series; a decade of 5-minute bars is
about 200,000 rows, which one task folds in a second. `affine_scan` serves series too long for that."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_ranges(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    out = h - l
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    return out


def recur(x: np.ndarray, keep: float, gain: float, start: int, seed: float) -> np.ndarray:
    """y[start] = seed, y[i] = keep * y[i-1] + gain * x[i]; NaN before."""
    out = np.full(len(x), np.nan)
    if start < len(x):
        out[start] = y = seed
        for i, v in enumerate(x[start + 1 :].tolist(), start + 1):
            out[i] = y = keep * y + gain * v
    return out


def wilder_atr(h, l, c, p: int = 14) -> np.ndarray:  # noqa: E741
    tr = true_ranges(h, l, c)
    return recur(tr, (p - 1) / p, 1 / p, p - 1, float(tr[:p].mean()) if len(tr) >= p else np.nan)


def ema_sma_seed(c: np.ndarray, p: int) -> np.ndarray:
    k = 2 / (p + 1)
    return recur(c, 1 - k, k, p - 1, float(c[:p].mean()) if len(c) >= p else np.nan)


def ema_first_seed(c: np.ndarray, p: int) -> np.ndarray:
    k = 2 / (p + 1)
    return recur(c, 1 - k, k, 0, float(c[0]) if len(c) else np.nan)


def adx(h, l, c, p: int = 14) -> np.ndarray:  # noqa: E741
    """Average directional index; NaN under 3 * p bars and where it is not above 0."""
    n = len(c)
    out = np.full(n, np.nan)
    if n < 3 * p:
        return out
    up, down = np.diff(h, prepend=h[0]), -np.diff(l, prepend=l[0])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_ranges(h, l, c)
    smooth = lambda x: recur(x, 1 - 1 / p, 1.0, p, float(x[1 : p + 1].sum()))
    with np.errstate(invalid="ignore", divide="ignore"):
        sp, sm, st = smooth(plus), smooth(minus), smooth(tr)
        pdi, mdi = np.where(st > 0, 100 * sp / st, 0.0), np.where(st > 0, 100 * sm / st, 0.0)
        total = pdi + mdi
        dx = np.where(total > 0, 100 * np.abs(pdi - mdi) / total, 0.0)
    out = recur(dx, (p - 1) / p, 1 / p, 2 * p, float(dx[p : 2 * p + 1].mean()))
    out[: 3 * p - 1] = np.nan
    out[~(out > 0)] = np.nan
    return out


#: Reversal that confirms a swing, by timeframe.
ZIGZAG = {"5min": 0.005, "15min": 0.01, "1h": 0.02, "1d": 0.03}


class ZigzagFold:
    """Alternating extremes reversed by `threshold`, bar by bar: `push` gives (pivot, confirm, price, kind) once a swing is confirmed.

    The first direction goes by which extreme of the first 20 bars comes first, so these are held back; `finish` works off what a shorter series has.
    """

    def __init__(self, threshold: float):
        self.threshold, self.n, self._held, self._rising = threshold, 0, [], None

    def push(self, h: float, l: float) -> Iterator[tuple[int, int, float, str]]:  # noqa: E741
        if self._rising is None:
            self._held.append((h, l))
            if len(self._held) == 20:
                yield from self.finish()
        else:
            yield from self._step(h, l)

    def finish(self) -> Iterator[tuple[int, int, float, str]]:
        held, self._held = self._held, []
        if len(held) < 3:
            return
        hs, ls = zip(*held, strict=True)
        self._rising = hs.index(max(hs)) <= ls.index(min(ls))
        self._x, self._at, self.n = hs[0] if self._rising else ls[0], 0, 1
        for h, l in held[1:]:  # noqa: E741
            yield from self._step(h, l)

    def _step(self, h: float, l: float) -> Iterator[tuple[int, int, float, str]]:  # noqa: E741
        i, self.n = self.n, self.n + 1
        if self._rising:
            if h > self._x:
                self._x, self._at = h, i
            if l <= self._x * (1 - self.threshold):
                yield self._at, i, float(self._x), "high"
                self._rising, self._x, self._at = False, l, i
        else:
            if l < self._x:
                self._x, self._at = l, i
            if h >= self._x * (1 + self.threshold):
                yield self._at, i, float(self._x), "low"
                self._rising, self._x, self._at = True, h, i


def zigzag(h: np.ndarray, l: np.ndarray, threshold: float) -> list[tuple[int, int, float, str]]:  # noqa: E741
    """(pivot, confirm, price, kind): alternating extremes reversed by `threshold`. A pivot is known from `confirm` on."""
    fold = ZigzagFold(threshold)
    return [x for hl in zip(h.tolist(), l.tolist(), strict=True) for x in fold.push(*hl)] + list(fold.finish())


#: Columns of the one pass over a series that the detectors and features read.
FOLDS: dict[str, Callable] = {
    "atr": lambda b: wilder_atr(b["h"], b["l"], b["c"]),
    "adx": lambda b: adx(b["h"], b["l"], b["c"]),
    "ema9": lambda b: ema_sma_seed(b["c"], 9),
    "ema21": lambda b: ema_sma_seed(b["c"], 21),
    **{f"emaf{p}": (lambda b, p=p: ema_first_seed(b["c"], p)) for p in (12, 20, 21, 26, 50, 100, 200)},
}


def fold_series(bars: DataFrame, names: Iterable[str] = tuple(FOLDS)) -> DataFrame:
    """`bars` with the named folds of each (symbol, tf) series; null where there is too little history."""
    names = tuple(names)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in bars.dtypes), *(f"`{n}` double" for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        arrays = {x: pdf[x].to_numpy(dtype=np.float64) for x in ("o", "h", "l", "c", "v")}
        return pdf.assign(**{n: FOLDS[n](arrays) for n in names})

    out = bars.groupBy("symbol", "tf").applyInPandas(run, schema)
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


def zigzag_pivots(bars: DataFrame, threshold: float) -> DataFrame:
    """symbol, tf, pivot, confirm, price, kind of all series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found = zigzag(pdf["h"].to_numpy(dtype=np.float64), pdf["l"].to_numpy(dtype=np.float64), threshold)
        out = pd.DataFrame(found, columns=["pivot", "confirm", "price", "kind"])
        return out.assign(symbol=pdf["symbol"].iloc[0], tf=pdf["tf"].iloc[0])[["symbol", "tf", "pivot", "confirm", "price", "kind"]]

    return bars.groupBy("symbol", "tf").applyInPandas(run, "symbol string, tf string, pivot long, confirm long, price double, kind string")


def affine_fold(x: np.ndarray, keep: float, gain: float, block: int = 64) -> np.ndarray:
    """y[i] = keep * y[i-1] + gain * x[i] with 0 before, block by block: within a block a product with powers of `keep`."""
    n = len(x)
    place = np.arange(block)
    powers = np.where(place[:, None] >= place, keep ** np.abs(place[:, None] - place), 0.0)
    rows = gain * np.append(x, np.zeros(-n % block)).reshape(-1, block) @ powers.T
    decay, before = keep ** (place + 1), 0.0
    for row in rows:
        row += decay * before
        before = row[-1]
    return rows.ravel()[:n]


def affine_scan(df: DataFrame, keep: float, gain: float, value: str, name: str, chunk: int = 65_536) -> DataFrame:
    """y = keep * y_before + gain * value, from the first value on, for series of any length.

    A prefix scan of two levels: each chunk of a series is folded once with 0 before it; the chunks' ends, one row for
    each, are folded along the series; and every row adds keep ** (its place) times the end before its chunk. `k` is the bar number.
    """
    first = F.when(F.col("k") == 0, F.col(value) / gain).otherwise(F.col(value)).cast("double")
    rows = df.withColumns({"__chunk": F.floor(F.col("k") / chunk), "__x": first})
    kinds = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != "__x"), "__own double, __place long"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        own = affine_fold(pdf["__x"].to_numpy(dtype=np.float64), keep, gain)
        return pdf.drop(columns="__x").assign(__own=own, __place=np.arange(1, len(pdf) + 1))

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        start, y = [], 0.0
        for e, n in zip(pdf["e"].tolist(), pdf["n"].tolist(), strict=True):
            start.append(y)
            y = keep**n * y + e
        return pdf.assign(__start=start)[["symbol", "tf", "__chunk", "__start"]]

    folded = rows.groupBy("symbol", "tf", "__chunk").applyInPandas(inside, kinds)
    ends = folded.groupBy("symbol", "tf", "__chunk").agg(F.max_by("__own", "__place").alias("e"), F.max("__place").alias("n"))
    starts = ends.groupBy("symbol", "tf").applyInPandas(along, "symbol string, tf string, __chunk long, __start double")
    out = folded.join(starts.hint("merge"), ["symbol", "tf", "__chunk"])
    return out.withColumn(name, F.col("__own") + F.pow(F.lit(keep), F.col("__place")) * F.col("__start")).drop("__chunk", "__own", "__place", "__start")


def windowed_atr(tr_list: Column, p: int = 14) -> Column:
    """Wilder's mean restarted on a short list of true ranges: the last value."""
    seed = F.aggregate(F.slice(tr_list, 1, p), F.lit(0.0), lambda y, x: y + x) / p
    rest = F.slice(tr_list, p + 1, F.greatest(F.size(tr_list) - p, F.lit(0)))
    return F.when(F.size(tr_list) >= p, F.aggregate(rest, seed, lambda y, x: (y * (p - 1) + x) / p))


def rsi_wilder(closes: Column, p: int = 14) -> Column:
    """Wilder's RSI on a short list of closes: the last value."""
    moves = F.transform(F.sequence(F.lit(2), F.size(closes)), lambda i: F.element_at(closes, i) - F.element_at(closes, i - 1))

    def smooth(sign: int) -> Column:
        side = F.transform(moves, lambda x: F.greatest(x * sign, F.lit(0)).cast("double"))
        seed = F.aggregate(F.slice(side, 1, p), F.lit(0.0), lambda y, x: y + x) / p
        return F.aggregate(F.slice(side, p + 1, F.greatest(F.size(side) - p, F.lit(0))), seed, lambda y, x: (y * (p - 1) + x) / p)

    gain, loss = smooth(1), smooth(-1)
    return F.when(F.size(closes) > p, F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))))
