"""Chart structures: boxes, channels, their volume and what followed.

Each detector walks the sessions of one symbol in order, so it runs as a grouped
map: a task holds one symbol's history, some thousand rows.  Rolling inputs come
from windows in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import series as S

YEAR = 252
AHEAD = (5, 10, 21, 42, 63, 126, 252)


@dataclass(frozen=True)
class Limits:
    """What counts as a structure."""

    seed: int = 60
    shortest: int = 60
    width_floor: float = 0.08
    width_ceiling: float = 0.35
    drift: float = 0.50
    touch_share: float = 0.15
    touch_gap: int = 5
    touches: int = 2
    break_atr: float = 0.25
    channel_seed: int = 90
    channel_slope: float = 0.15
    channel_r2: float = 0.60
    channel_width: float = 1.2
    channel_break: float = 0.5
    channel_closes: int = 2
    channel_longest: int = 3
    buffer: int = 10
    votes: int = 2


def prepare(bars: DataFrame) -> DataFrame:
    """Prices with log return, yearly volatility of 60, average true range of 20, and volume over the median of the 250 before."""
    w = S.by_symbol()
    x = S_priced(bars).where("close > 0").withColumn("r", F.log("close") - F.log(F.lag("close").over(w))).withColumn("prev", F.lag("close").over(w)).withColumn("v1", F.lag(F.col("volume").cast("double")).over(w))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
    x = x.withColumn("tr", tr)
    return x.select("symbol", "date", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "r", (S.rolling(F.stddev_samp, "r", 60) * F.sqrt(F.lit(252.0))).alias("sigma"), S.rolling(F.avg, "tr", 20).alias("atr"), (F.col("volume") / F.nullif(S.rolling_median("v1", 250, 250), F.lit(0.0))).alias("vn"))


def S_priced(bars: DataFrame) -> DataFrame:
    from sessionloom.sources.bars import priced

    return priced(bars).select("symbol", "date", "high", "low", "close", "volume")


class Series:
    """The prepared history of one symbol as arrays."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("date")
        self.date = pdf["date"].to_numpy()
        for c in ("high", "low", "close", "r", "sigma", "atr", "vn"):
            setattr(self, c, pdf[c].to_numpy(float))
        self.n = len(pdf)
        self.log = np.log(self.close)


def width_cap(sigma: float, length: int, lim: Limits) -> float:
    """The travel of a random walk of that volatility, within bounds."""
    return min(lim.width_ceiling, max(lim.width_floor, sigma * (length / YEAR) ** 0.5))


def tests_of(values: np.ndarray, edge: float, height: float, above: bool, lim: Limits) -> int:
    """Separate tests of an edge; touches a few sessions apart are one."""
    near = lim.touch_share * height
    at = np.flatnonzero(values >= edge - near if above else values <= edge + near)
    return int(len(at) > 0) + int(np.count_nonzero(np.diff(at) > lim.touch_gap))


@dataclass
class Box:
    start: int
    end: int
    brk: int
    hi: float
    lo: float
    direction: str

    @property
    def length(self) -> int:
        return self.end - self.start + 1

    @property
    def height(self) -> float:
        return float(np.log(self.hi / self.lo))


def _grow(s: Series, start: int, lim: Limits) -> Box | None:
    """The box that starts there, grown to its break; None if the seed is too wide."""
    last = start + lim.seed - 1
    if not np.isfinite(s.sigma[last]):
        return None
    top, bottom = s.high[start : last + 1].max(), s.low[start : last + 1].min()
    middle = np.median(s.close[start : last + 1])
    if (top - bottom) / middle > width_cap(s.sigma[last], lim.seed, lim):
        return None
    for j in range(last + 1, s.n):
        slack = lim.break_atr * s.atr[j] if np.isfinite(s.atr[j]) else 0.0
        # the cap keeps the seed's volatility: a break must not widen its own box
        cap = width_cap(s.sigma[last], j - start + 1, lim)
        if s.close[j] > top + slack:
            wider = max(top, s.high[j])
            if (wider - bottom) / middle > cap:
                return Box(start, j - 1, j, float(top), float(bottom), "up")
            top = wider
        elif s.close[j] < bottom - slack:
            wider = min(bottom, s.low[j])
            if (top - wider) / middle > cap:
                return Box(start, j - 1, j, float(top), float(bottom), "down")
            bottom = wider
    return Box(start, s.n - 1, s.n - 1, float(top), float(bottom), "open")


def boxes(s: Series, lim: Limits = Limits()) -> list[Box]:
    """Boxes from left to right; the search goes on after a box's break."""
    found, i = [], 0
    while i + lim.seed <= s.n:
        b = _grow(s, i, lim)
        if b is not None and b.length >= lim.shortest and abs(s.log[b.end] - s.log[b.start]) / b.height <= lim.drift:
            inside, tall = slice(b.start, b.end + 1), b.hi - b.lo
            if min(tests_of(s.high[inside], b.hi, tall, True, lim), tests_of(s.low[inside], b.lo, tall, False, lim)) >= lim.touches:
                found.append(b)
                i = b.brk
        i += 1
    return found


@dataclass
class Channel:
    start: int
    end: int
    brk: int
    slope: float
    up: float
    down: float
    r2: float
    direction: str

    @property
    def length(self) -> int:
        return self.end - self.start + 1

    @property
    def height(self) -> float:
        return self.up - self.down

    @property
    def label(self) -> str:
        return "rising" if self.slope > 0 else "falling"


def line(y: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """Intercept, slope, R2 and residuals of the least-squares line through y."""
    x = np.arange(len(y), dtype=float)
    dx, dy = x - x.mean(), y - y.mean()
    slope = float(dx @ dy / (dx @ dx))
    start = float(y.mean() - slope * x.mean())
    rest = y - start - slope * x
    spread = float(dy @ dy)
    return start, slope, 1.0 - float(rest @ rest) / spread if spread > 0 else 0.0, rest


def channels(s: Series, taken: list[tuple[int, int]], lim: Limits = Limits()) -> list[Channel]:
    """Straight trends outside the taken stretches, with rails frozen at the seed."""
    free = np.ones(s.n, bool)
    for a, b in taken:
        free[a : b + 1] = False
    k, found, i = lim.channel_seed, [], 0
    while i + k <= s.n:
        c = None
        if free[i : i + k].all() and np.isfinite(s.sigma[i + k - 1]):
            start, slope, r2, rest = line(s.log[i : i + k])
            up, down = float(rest.max()), float(rest.min())
            tall = up - down
            fits = abs(slope * YEAR) >= lim.channel_slope and r2 >= lim.channel_r2 and tall <= lim.channel_width * s.sigma[i + k - 1] * (k / YEAR) ** 0.5
            if fits and min(tests_of(rest, up, tall, True, lim), tests_of(rest, down, tall, False, lim)) >= lim.touches:
                c = _extend(s, i, start, slope, up, down, r2, lim)
        if c is not None and c.length >= k:
            found.append(c)
            i = c.brk
        i += 1
    return found


def _extend(s: Series, i: int, start: float, slope: float, up: float, down: float, r2: float, lim: Limits) -> Channel:
    above = below = 0
    stop = min(s.n, i + lim.channel_seed * lim.channel_longest)
    slack = lim.channel_break * (up - down)
    for j in range(i + lim.channel_seed, stop):
        off = s.log[j] - start - slope * (j - i)
        above, below = (above + 1) * (off > up + slack), (below + 1) * (off < down - slack)
        if max(above, below) >= lim.channel_closes:
            return Channel(i, j - 1, j, slope, up, down, r2, "up" if above else "down")
    end = min(max(stop, i + lim.channel_seed), s.n - 1)
    return Channel(i, end, end, slope, up, down, r2, "open")


def _mean_ratio(a: np.ndarray, b: np.ndarray, least: int) -> float:
    return float(a.mean() / b.mean()) if len(a) >= least and len(b) >= least and b.mean() > 0 else np.nan


def volume_in_box(s: Series, b: Box, buffer: int, baseline: int = 750) -> dict:
    """Five readings of volume in the box that end ``buffer`` sessions before the break; none for too few sessions."""
    end = min(max(b.brk - buffer, b.start + 20), b.end)
    k = slice(b.start, end + 1)
    r, vn = s.r[k], s.vn[k]
    known = np.isfinite(r) & np.isfinite(vn)
    if known.sum() < 20:
        return {}
    down = known & (r < 0)
    late = np.arange(len(r)) >= len(r) // 2
    before = slice(max(0, b.start - baseline), b.start)
    pr, pv = s.r[before], s.vn[before]
    pk = np.isfinite(pr) & np.isfinite(pv)
    ratio, usual = _mean_ratio(vn[known & (r > 0)], vn[down], 3), _mean_ratio(pv[pk & (pr > 0)], pv[pk & (pr < 0)], 30)
    weight = np.where(np.isfinite(vn), vn, 0.0)
    span = s.high[k] - s.low[k]
    place = np.divide(2 * s.close[k] - s.high[k] - s.low[k], span, out=np.zeros(len(span)), where=span > 0)
    share = lambda x: float((x * weight).sum() / weight.sum()) if weight.sum() > 0 else np.nan
    return {"dryup": _mean_ratio(vn[down & late], vn[down & ~late], 3), "updown": ratio / usual if np.isfinite(usual) and usual > 0 else np.nan, "close_place": share(place), "flow": share(np.sign(np.where(np.isfinite(r), r, 0.0))), "springs": springs(s, b, end)}


def springs(s: Series, b: Box, end: int, recover: int = 5) -> int:
    """Dips below the box that close back inside within a few sessions, less pokes above it that do."""
    net, j = 0, b.start
    while j <= end:
        k = min(j + recover, end)
        if s.low[j] < b.lo:
            if (s.close[j : k + 1] > b.lo).any():
                net, j = net + 1, k
        elif s.high[j] > b.hi and (s.close[j : k + 1] < b.hi).any():
            net, j = net - 1, k
        j += 1
    return net


def vote(f: dict, lim: Limits = Limits()) -> tuple[str, int]:
    """accumulation, distribution or unresolved, from the signs of the five readings."""
    if not f:
        return "unresolved", 0

    def sign(x: float, low: float, high: float) -> int:
        return int(x > high) - int(x < low) if np.isfinite(x) else 0

    total = -sign(f["dryup"], 0.85, 1.15) + sign(f["updown"], 0.95, 1.05) + sign(f["close_place"], -0.05, 0.05) + sign(f["flow"], -0.05, 0.05) + sign(float(f["springs"]), 0, 0)
    return ("accumulation" if total >= lim.votes else "distribution" if total <= -lim.votes else "unresolved"), total


def outcome(s: Series, at: int, height: float) -> dict:
    """Net, best and worst move after a break, in heights of the structure; null past the data."""
    out = {}
    for h in AHEAD:
        j = at + h
        ok = at < s.n - 1 and height > 0 and j < s.n
        out[f"net{h}"] = float((s.log[j] - s.log[at]) / height) if ok else None
        out[f"best{h}"] = float(np.log(s.high[at : j + 1].max() / s.close[at]) / height) if ok else None
        out[f"worst{h}"] = float(np.log(s.low[at : j + 1].min() / s.close[at]) / height) if ok else None
    return out


def break_tag(s: Series, b: Box, back: int = 21, again: int = 63) -> str | None:
    """How a break went on: pending, follow-through, fakeout-recovered, chopped or reversal."""
    if b.direction == "open":
        return None
    after = s.close[b.brk + 1 : b.brk + 1 + back]
    if not len(after):
        return "pending"
    inside = np.flatnonzero((after >= b.lo) & (after <= b.hi))
    if not len(inside):
        return "follow-through"
    first = b.brk + 1 + int(inside[0])
    later = s.close[first : first + again]
    up = b.direction == "up"
    if (later < b.lo).any() if up else (later > b.hi).any():
        return "reversal"
    return "fakeout-recovered" if ((later > b.hi).any() if up else (later < b.lo).any()) else "chopped"


SCAN = "symbol string, kind string, start date, end date, break_date date, days int, height double, width_pct double, direction string, label string, vote int, slope_ann_pct double, r2 double, tag string, " + ", ".join(f"{k}{h} double" for h in AHEAD for k in ("net", "best", "worst"))


def scan(bars: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """All boxes and channels of every symbol, with label and what followed."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, name, rows = Series(pdf), pdf["symbol"].iloc[0], []
        found = boxes(s, lim)
        none = outcome(s, s.n, 1.0)
        for b in found:
            label, votes = vote(volume_in_box(s, b, lim.buffer), lim)
            rows.append({"kind": "box", "start": s.date[b.start], "end": s.date[b.end], "break_date": s.date[b.brk], "days": b.length, "height": b.height, "width_pct": (b.hi / b.lo - 1) * 100, "direction": b.direction, "label": label, "vote": votes, "tag": break_tag(s, b), **(outcome(s, b.brk, b.height) if b.direction != "open" else none)})
        for c in channels(s, [(b.start, b.brk) for b in found], lim):
            rows.append({"kind": "channel", "start": s.date[c.start], "end": s.date[c.end], "break_date": s.date[c.brk], "days": c.length, "height": c.height, "direction": c.direction, "label": c.label, "vote": 0, "slope_ann_pct": c.slope * YEAR * 100, "r2": c.r2, **(outcome(s, c.brk, c.height) if c.direction != "open" else none)})
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in SCAN.split(", ")][1:])
        out.insert(0, "symbol", name)
        return out

    return prepare(bars).groupBy("symbol").applyInPandas(run, SCAN)


def audit_buffer(bars: DataFrame, extra: int = 10, lim: Limits = Limits()) -> DataFrame:
    """symbol, boxes, flips: how many labels change when the readings end ``extra`` sessions earlier."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, flips = Series(pdf), 0, 0
        for b in boxes(s, lim):
            a, c = volume_in_box(s, b, lim.buffer), volume_in_box(s, b, lim.buffer + extra)
            if a and c:
                n, flips = n + 1, flips + int(vote(a, lim)[0] != vote(c, lim)[0])
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "boxes": [n], "flips": [flips]})

    return prepare(bars).groupBy("symbol").applyInPandas(run, "symbol string, boxes int, flips int")
