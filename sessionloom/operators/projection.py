"""Projection from past sessions in the same chart state, with its nulls and calibration; and weekly analogs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.analytics import weekly_closes
from sessionloom.operators.structures import YEAR, Limits, Series, line, prepare, tests_of, width_cap

AHEAD, LOOK_BACK, YOUNGEST = 252, 420, 60
TREND_LENGTHS, TREND_SLOPE, TREND_R2 = (252, 189, 126, 90, 60), 0.12, 0.50
PLACE, AGES, VOLS = 0.25, (0.5, 2.0), (0.6, 1.7)


@dataclass
class State:
    """What the chart looks like at a session, from sessions up to it."""

    kind: str = "none"
    label: str = "none"
    age: int = 0
    place: float = np.nan
    height: float = np.nan
    vol: float = np.nan


def state_at(s: Series, t: int, lim: Limits = Limits()) -> State:
    """The longest range that ends at t, else the longest straight trend, else none."""
    if t < YOUNGEST or not np.isfinite(s.sigma[t]):
        return State()
    vol = float(s.sigma[t])
    most = min(t + 1, LOOK_BACK)
    for length in range(most, YOUNGEST - 1, -5):
        k = slice(t + 1 - length, t + 1)
        top, bottom = s.high[k].max(), s.low[k].min()
        tall, height = top - bottom, float(np.log(top / bottom))
        if tall / np.median(s.close[k]) > width_cap(vol, length, lim) or not height > 0:
            continue
        if abs(s.log[t] - s.log[t + 1 - length]) / height > lim.drift:
            continue
        if min(tests_of(s.high[k], top, tall, True, lim), tests_of(s.low[k], bottom, tall, False, lim)) >= lim.touches:
            return State("range", "range", length, float((s.close[t] - bottom) / tall), height, vol)
    for length in TREND_LENGTHS:
        if length <= most:
            _, slope, r2, rest = line(s.log[t + 1 - length : t + 1])
            height = float(rest.max() - rest.min())
            if r2 >= TREND_R2 and abs(slope * YEAR) >= TREND_SLOPE and height > 0:
                return State("trend", "rising" if slope > 0 else "falling", length, float((rest[-1] - rest.min()) / height), height, vol)
    return State()


def alike(now: State, then: State) -> bool:
    if (then.kind, then.label) != (now.kind, now.label) or now.kind == "none" or not abs(then.place - now.place) <= PLACE:
        return False
    return AGES[0] <= then.age / max(now.age, 1) <= AGES[1] and now.vol > 0 and VOLS[0] <= then.vol / now.vol <= VOLS[1]


def matches(states: dict[int, State], now: State, last: int, spacing: int = AHEAD) -> list[int]:
    """Sessions before ``last`` in a like state, earliest first, ``spacing`` apart."""
    kept: list[int] = []
    for t in sorted(states):
        if t < last and (not kept or t - kept[-1] >= spacing) and alike(now, states[t]):
            kept.append(t)
    return kept


def paths(s: Series, anchors: list[int], ahead: int = AHEAD) -> np.ndarray:
    """Log moves after each anchor, a row each; NaN past the data."""
    out = np.full((len(anchors), ahead + 1), np.nan)
    for i, t in enumerate(anchors):
        p = s.log[t : t + ahead + 1] - s.log[t]
        out[i, : len(p)] = p
    return out


def block_paths(r: np.ndarray, ahead: int = AHEAD, block: int = 63, draws: int = 2000, seed: int = 0) -> np.ndarray:
    """Paths of returns drawn in circular blocks."""
    r = r[np.isfinite(r)]
    first = np.random.default_rng(seed).integers(0, len(r), size=(draws, -(-ahead // block)))
    at = (first[..., None] + np.arange(block)) % len(r)
    moves = r[at].reshape(draws, -1)[:, :ahead]
    return np.hstack([np.zeros((draws, 1)), moves.cumsum(axis=1)])


def window_medians(log: np.ndarray, k: int, ahead: int = AHEAD, draws: int = 5000, seed: int = 1) -> np.ndarray:
    """Medians of the moves of k windows drawn at random."""
    room = len(log) - ahead - 1
    if room <= 0 or k <= 0:
        return np.zeros(0)
    rng = np.random.default_rng(seed)
    at = np.stack([rng.integers(0, room, size=k) for _ in range(draws)])
    return np.median(log[at + ahead] - log[at], axis=1)


def percentile_in(value: float, sample: np.ndarray) -> float:
    """Per cent of the sample below a value."""
    sample = sample[np.isfinite(sample)]
    return float((sample < value).mean() * 100) if len(sample) and np.isfinite(value) else np.nan


def project(bars: DataFrame, ahead: int = AHEAD, step: int = 5) -> DataFrame:
    """For each symbol: its state, its matches, the quantiles of their moves, of the bootstrap's, and where the median stands among random windows."""
    columns = "symbol string, label string, age int, place double, matches int, " + ", ".join(f"q{q} double, base{q} double" for q in (10, 25, 50, 75, 90)) + ", median_rank double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Series(pdf)
        now = state_at(s, s.n - 1)
        last = s.n - ahead - 1
        found = matches({t: state_at(s, t) for t in range(YOUNGEST, last, step)}, now, last, ahead) if now.kind != "none" else []
        ends = paths(s, found, ahead)[:, -1] if found else np.zeros(0)
        base = block_paths(s.r, ahead)[:, -1] if s.n > 1 else np.zeros(0)
        row = {"symbol": pdf["symbol"].iloc[0], "label": now.label, "age": now.age, "place": now.place, "matches": len(found)}
        for q in (10, 25, 50, 75, 90):
            row[f"q{q}"] = float(np.percentile(ends, q)) if len(ends) else None
            row[f"base{q}"] = float(np.percentile(base, q)) if len(base) else None
        row["median_rank"] = percentile_in(float(np.median(ends)), window_medians(s.log, len(ends), ahead)) if len(ends) else None
        return pd.DataFrame([row])

    return prepare(bars).groupBy("symbol").applyInPandas(run, columns)


def audit_causal(bars: DataFrame, sessions: int = 60) -> DataFrame:
    """symbol, checked, causal: whether states stay the same when the future is cut off."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        s = Series(pdf)
        at = range(YOUNGEST, s.n - sessions, max(1, s.n // 20))
        told = lambda x: (x.kind, x.label, x.age)
        same = [told(state_at(s, t)) == told(state_at(Series(pdf.iloc[: t + 1]), t)) for t in at]
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "checked": [len(same)], "causal": [all(same)]})

    return prepare(bars).groupBy("symbol").applyInPandas(run, "symbol string, checked int, causal boolean")


def walk_forward(bars: DataFrame, ahead: int = AHEAD, step: int = 63, begin: float = 0.35, least: int = 4) -> DataFrame:
    """symbol, forecasts, cover50, cover80, mae, mae_naive, beat_naive, verdict: projections made at past dates from their past, scored.

    Symbols are independent, so they run in parallel; a state is computed once a
    session and serves all forecasts after it.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, rows, states = Series(pdf), [], {}
        for t in range(int(s.n * begin), s.n - ahead - 1, step):
            now = state_at(s, t)
            if now.kind == "none":
                continue
            last = t - ahead
            for u in range(YOUNGEST, last, 10):
                if u not in states:
                    states[u] = state_at(s, u)
            found = matches(states, now, last, ahead)
            if len(found) < least:
                continue
            ends = s.log[np.array(found) + ahead] - s.log[found]
            real, past = s.log[t + ahead] - s.log[t], s.log[ahead : t + 1] - s.log[: t + 1 - ahead]
            p10, p25, p50, p75, p90 = np.percentile(ends, [10, 25, 50, 75, 90])
            rows.append((p25 <= real <= p75, p10 <= real <= p90, abs(p50 - real), abs(np.median(past) - real)))
        x = np.array(rows, float).reshape(-1, 4)
        if len(x):
            err, naive = np.median(x[:, 2]), np.median(x[:, 3])
            cover80 = x[:, 1].mean()
            row = (len(x), x[:, 0].mean(), cover80, err, naive, (x[:, 2] < x[:, 3]).mean(), "usable" if cover80 >= 0.7 and err < naive else "miscalibrated")
        else:
            row = (0, None, None, None, None, None, None)
        return pd.DataFrame([(pdf["symbol"].iloc[0], *row)], columns=["symbol", "forecasts", "cover50", "cover80", "mae", "mae_naive", "beat_naive", "verdict"])

    return prepare(bars).groupBy("symbol").applyInPandas(run, "symbol string, forecasts int, cover50 double, cover80 double, mae double, mae_naive double, beat_naive double, verdict string")


def z_rows(m: np.ndarray) -> np.ndarray:
    """Each row less its mean over its population deviation; flat rows are NaN."""
    d = m - m.mean(axis=1, keepdims=True)
    sd = m.std(axis=1, keepdims=True)
    return np.where(sd < 1e-12, np.nan, d / np.where(sd < 1e-12, 1.0, sd))


CANDIDATE = "symbol string, at int, start date, end date, corr double, growth array<double>"


def analogs(bars: DataFrame, target: str, window: int = 104, ahead: int = 52, top: int = 15, stride: int = 2, least: int = 260) -> tuple[DataFrame, DataFrame]:
    """(matches, fan): past weekly windows of any symbol that correlate best with the target's last one, and the quantiles of what followed.

    Windows are compared as z-scored logs; a flat window has correlation 0.  Windows
    of one symbol nearer than half a window are one episode, the best of which
    stays.  Each symbol's task keeps its own best ``top`` episodes, which hold the
    overall best, so only those meet.
    """
    spark = bars.sparkSession
    weeks = weekly_closes(bars)
    mine = weeks.where(F.col("symbol") == target).orderBy(F.desc("week")).limit(window).toPandas().sort_values("week")
    if len(mine) < window:
        raise ValueError(f"{target} has {len(mine)} weeks and not {window}")
    goal = z_rows(np.log(mine["close"].to_numpy(float))[None])[0]
    from_week = pd.Timestamp(mine["week"].iloc[0])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week").reset_index(drop=True)
        out = pd.DataFrame(columns=["symbol", "at", "start", "end", "corr", "growth"])
        if len(pdf) < max(least, window + ahead + 1):
            return out
        close = pdf["close"].to_numpy(float)
        ends = np.arange(window - 1, len(close) - ahead, stride)
        z = z_rows(np.lib.stride_tricks.sliding_window_view(np.log(close), window)[ends - window + 1])
        corr = np.nansum(z * goal, axis=1) / window
        own = np.zeros(len(ends), bool)
        if pdf["symbol"].iloc[0] == target:
            own = pd.to_datetime(pdf["week"]).to_numpy()[ends] >= from_week.to_datetime64()
        kept: list[int] = []
        for i in np.argsort(-corr, kind="stable"):
            if not own[i] and all(abs(int(ends[i] - ends[j])) >= window // 2 for j in kept):
                kept.append(int(i))
                if len(kept) == top:
                    break
        rows = [(pdf["symbol"].iloc[0], int(ends[i]), pdf["week"].iloc[ends[i] - window + 1], pdf["week"].iloc[ends[i]], float(corr[i]), (close[ends[i] : ends[i] + ahead + 1] / close[ends[i]]).tolist()) for i in kept]
        return pd.DataFrame(rows, columns=out.columns)

    best = weeks.groupBy("symbol").applyInPandas(run, CANDIDATE).orderBy(F.desc("corr"), "symbol", "at").limit(top)
    found = best.select("symbol", "start", "end", F.round("corr", 3).alias("corr"), (F.element_at("growth", -1) - 1).alias("fwd_ret"), (F.array_max("growth") - 1).alias("fwd_max"), (F.array_min("growth") - 1).alias("fwd_min"))
    last = float(mine["close"].iloc[-1]) / 100_000
    steps = best.select(F.posexplode("growth").alias("step", "g")).withColumn("level", F.col("g") * last)
    fan = steps.groupBy("step").agg(F.percentile("level", F.lit(0.5)).alias("median"), F.percentile("level", F.lit(0.25)).alias("p25"), F.percentile("level", F.lit(0.75)).alias("p75"))
    return found, fan
