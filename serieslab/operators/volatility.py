"""GARCH(1,1): fits of greatest likelihood, filters by a two-level scan, and statistics of the conditional volatility."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import BUCKET, halo, lengths, matched, materialise, quantiles, ratio, windowed, with_row_index, with_scalars
from serieslab.operators.stats import autocorr, jarque_bera, moments


def _usable(p: str) -> Column:
    """Positive and finite; null and NaN are not."""
    return (F.col(p) > 0) & (F.col(p) < float("inf"))


def log_returns(df: DataFrame, p: str, most: int | None = None) -> DataFrame:
    """(series, idx, r): log returns of the last `most` positive prices, numbered anew."""
    rows = with_row_index(df.where(_usable(p)).select("series", F.col("idx").alias("_i"), p), ["series"], ["_i"]).drop("_i")
    if most:
        first = F.greatest(F.col("n") - most, F.lit(0))
        rows = with_scalars(rows, lengths(rows)).where(F.col("idx") >= first).withColumn("idx", F.col("idx") - first).drop("n")
    r = windowed(rows, {"r": lambda w: F.log(F.col(p) / F.lag(p).over(w))}, back=1).where("idx > 0")
    return r.select("series", (F.col("idx") - 1).alias("idx"), "r")


def all_log_returns(df: DataFrame, p: str) -> DataFrame:
    """(series, idx, r): log returns of every row but the first. A price of zero gives infinite returns, as the logarithm's limit (NaN between
    two of them); a missing or negative one gives null. `log_returns` leaves such prices out."""
    w = lambda c: F.col(f"_{c}")
    both = (w("p") > 0) & (w("q") > 0)
    r = F.when(both, F.log(ratio(w("p"), F.when(both, w("q")))))
    r = r.when((w("p") == 0) & (w("q") > 0), F.lit(float("-inf"))).when((w("p") > 0) & (w("q") == 0), F.lit(float("inf"))).when((w("p") == 0) & (w("q") == 0), F.lit(float("nan")))
    pairs = windowed(df.select("series", "idx", F.col(p).cast("double").alias("_p")), {"_q": lambda v: F.lag("_p").over(v)}, back=1).where("idx > 0")
    return pairs.select("series", (F.col("idx") - 1).alias("idx"), r.alias("r"))


def variance_of_returns(r: DataFrame) -> DataFrame:
    """(series, v): the variance of r over n, NaN with an infinite or a NaN r. Sums are of decimals, so no digit of it depends on how rows are
    dealt and added up."""
    whole = F.abs(F.col("r")) < float("inf")  # not so for NaN
    exact = lambda c: F.when(whole, c).cast("decimal(38,20)")
    means = r.groupBy("series").agg(F.avg(exact(F.col("r"))).cast("double").alias("_m"), F.count_if(F.col("r").isNotNull()).alias("_n"), F.count_if(whole).alias("_w"))
    squares = with_scalars(r, means).groupBy("series", "_n", "_w").agg(F.sum(exact((F.col("r") - F.col("_m")) ** 2)).cast("double").alias("_s"))
    return squares.select("series", F.when(F.col("_w") < F.col("_n"), F.lit(float("nan"))).otherwise(ratio(F.col("_s"), F.col("_n").cast("double"))).alias("v"))


def decayed(x: np.ndarray, beta: float, start: float = 0.0) -> np.ndarray:
    """y with y[0] = start and y[t + 1] = beta y[t] + x[t], by doubling: after k rounds each value holds the last 2^k terms of its sum."""
    y, k, power = np.concatenate([[start], x]), 1, beta
    while k < len(y) and power > 1e-300:
        y[k:] += power * y[:-k].copy()
        k, power = 2 * k, power * power
    return y


#: Bounds of a fit: persistence below 1, omega as a share of the variance; returns of a series that one task fits; steps of the search.
MOST_PERSISTENCE, LOCAL_RETURNS, STEPS = 0.9999, 100_000, 200
EMPTY = np.zeros(4)


def parameters(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(omega in units of the variance, alpha, beta) of points (..., 3) of a search, which has no bounds, and the derivatives (rows) by their
    parts."""
    e = np.clip(u, -30, 30)
    omega, p, share = np.exp(e[..., 0]), MOST_PERSISTENCE / (1 + np.exp(-e[..., 1])), 1 / (1 + np.exp(-e[..., 2]))
    dp, ds, none = p * (1 - p / MOST_PERSISTENCE), share * (1 - share), np.zeros_like(omega)
    slopes = np.stack([omega, none, none, none, share * dp, (1 - share) * dp, none, p * ds, -p * ds], axis=-1)
    return np.stack([omega, p * share, p * (1 - share)], axis=-1), slopes.reshape(*e.shape, 3)


def state_map(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What squared returns make of the variance and its three derivatives: where they lead from zeros. From a state s they lead to
    beta^n s plus this, and the last derivative also gets n beta^(n - 1) times the variance."""
    w, a, b = theta
    h = decayed(w + a * z, b)
    return np.array([h[-1], decayed(np.ones(len(z)), b)[-1], decayed(z, b)[-1], decayed(h[:-1], b)[-1]])


def after(state: np.ndarray, made: np.ndarray, n: int, beta: float) -> np.ndarray:
    out = beta**n * state + made
    out[3] += n * beta ** (n - 1) * state[0]
    return out


def likelihood_sums(z: np.ndarray, theta: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Minus the log-likelihood without its constant, its gradient (3) and the information (9) of squared returns, from a state on."""
    w, a, b = theta
    h = np.maximum(decayed(w + a * z, b, state[0])[:-1], 1e-12)
    d = np.stack([decayed(x, b, s)[:-1] for x, s in ((np.ones(len(z)), state[1]), (z, state[2]), (h, state[3]))]) / h
    return np.concatenate([[0.5 * (np.log(h) + z / h).sum()], 0.5 * d @ (1 - z / h), (0.5 * d @ d.T).ravel()])


#: Rows that are stepped through at a time, for all such pieces of a series together.
PIECE = 32


def decayed_columns(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """For each column y with y[0] = 0 and y[t + 1] = beta y[t] + x[t], up to the last row of x: pieces of rows run side by side from zero, then
    get what the pieces before them leave."""
    n, w = x.shape
    pieces = -(-n // PIECE)
    own = np.zeros((pieces * PIECE, w))
    own[:n] = x
    own, y = own.reshape(pieces, PIECE, w), np.zeros((pieces, PIECE + 1, w))
    for t in range(PIECE):
        np.multiply(y[:, t], beta, out=y[:, t + 1])
        y[:, t + 1] += own[:, t]
    power, state = beta ** np.arange(PIECE + 1)[:, None], np.zeros(w)
    for k in range(pieces):
        y[k] += power * state
        state = y[k, PIECE]
    return y[:, :PIECE].reshape(-1, w)[:n]


def likelihood_sums_of_columns(z: np.ndarray, there: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """likelihood_sums (a row for each column) of columns of squared returns where `there` is 1, each from a variance of one on."""
    w, a, b = np.ascontiguousarray(theta.T)
    power = np.cumprod(np.vstack([np.ones_like(b), np.broadcast_to(b, (len(z) - 1, len(b)))]), axis=0)
    ones, past = (1 - power) / (1 - b), decayed_columns(z, b)
    power += a * past  # becomes the variance
    power += w * ones
    h = np.maximum(power, 1e-12, out=power)
    d = [ones, past, decayed_columns(h, b)]
    over = there / h  # zero where a column has ended
    for v in d:
        v *= over
    q = np.multiply(z, over, out=over)
    sums = [0.5 * (np.einsum("tw,tw->w", np.log(h, out=h), there) + q.sum(axis=0))]
    rest = np.subtract(1, q, out=q)
    sums += [0.5 * np.einsum("tw,tw->w", v, rest) for v in d]
    cross = {(i, j): 0.5 * np.einsum("tw,tw->w", d[i], d[j]) for i in range(3) for j in range(i, 3)}
    return np.stack([*sums, *[cross[min(i, j), max(i, j)] for i in range(3) for j in range(3)]], axis=-1)


class Search:
    """Damped scoring steps to the least of the sums, whose value and slopes at `trial` the caller takes over all returns. `n` may be an array:
    then as many searches go on side by side, those that are done stand still."""

    def __init__(self, n: int | np.ndarray, tolerance: float = 1e-6):
        self.n, self.tolerance = np.asarray(n), tolerance
        some = self.n.shape
        self.trial = np.tile(np.log([0.05, 18.0, 0.06]), (*some, 1))
        self.at, self.damp, self.steps, self.done = self.trial, np.full(some, 1e-3), np.zeros(some, int), np.zeros(some, bool)
        self.value, self.slope, self.curve = np.full(some, np.inf), np.zeros((*some, 3)), np.tile(np.eye(3), (*some, 1, 1))

    def take(self, sums: np.ndarray) -> None:
        _, jacobian = parameters(self.trial)
        live, n = ~self.done, self.n
        better = live & (sums[..., 0] < self.value)
        with np.errstate(invalid="ignore"):
            small = self.value - sums[..., 0] < 1e-13 * n
        one, two = better[..., None], better[..., None, None]
        self.at, self.value = np.where(one, self.trial, self.at), np.where(better, sums[..., 0], self.value)
        self.slope = np.where(one, (jacobian @ sums[..., 1:4, None])[..., 0], self.slope)
        self.curve = np.where(two, jacobian @ sums[..., 4:].reshape(*n.shape, 3, 3) @ jacobian.swapaxes(-1, -2), self.curve)
        self.damp = np.where(better, np.maximum(self.damp / 4, 1e-9), np.where(live, self.damp * 6, self.damp))
        steepest = np.abs(self.slope).max(axis=-1)
        ended = np.where(better, (steepest <= self.tolerance * n) & small, (self.damp > 1e12) | (steepest <= 1e-9 * n))
        self.steps = self.steps + live
        self.done = self.done | live & (ended | (self.steps >= STEPS))
        bend = np.diagonal(self.curve, axis1=-2, axis2=-1) + 1e-9 * n[..., None]
        step = np.linalg.solve(self.curve + self.damp[..., None, None] * bend[..., None] * np.eye(3), -self.slope[..., None])[..., 0]
        self.trial = np.where(live[..., None], self.at + np.clip(step, -2, 2), self.trial)

    def result(self, var: float | np.ndarray) -> tuple:
        """(omega, alpha, beta, log-likelihood) of returns with this variance."""
        theta = parameters(self.at)[0]
        return theta[..., 0] * var, theta[..., 1], theta[..., 2], -self.value - 0.5 * self.n * np.log(2 * np.pi * var)


def fit_garch(r: np.ndarray) -> tuple[float, float, float, float]:
    """(omega, alpha, beta, log-likelihood) of greatest likelihood; the first variance is that of the returns."""
    var = max(float(r.var()), 1e-300)
    z, search = r * r / var, Search(len(r))
    while not search.done:
        search.take(likelihood_sums(z, parameters(search.trial)[0], np.array([1.0, 0, 0, 0])))
    return tuple(map(float, search.result(var)))


def fit_windows(returns: list[np.ndarray]) -> np.ndarray:
    """fit_garch of each, in rows, side by side."""
    n = np.array([len(r) for r in returns])
    var = np.array([max(float(r.var()), 1e-300) for r in returns])
    z, there = np.zeros((n.max(), len(n))), (np.arange(n.max())[:, None] < n).astype(float)
    for i, r in enumerate(returns):
        z[: len(r), i] = r * r / var[i]
    search, own = Search(n), np.arange(len(n))
    while not search.done.all():
        live = ~search.done[own]
        if 2 * live.sum() < len(live):  # the columns of searches that are done go, now and then
            own, z, there, live = own[live], np.ascontiguousarray(z[:, live]), np.ascontiguousarray(there[:, live]), live[live]
        sums = np.zeros((len(n), 13))
        sums[own] = likelihood_sums_of_columns(z, there, parameters(search.trial[own])[0])
        search.take(sums)
    return np.stack(search.result(var), axis=-1)


FIT = "omega double, alpha double, beta double, loglik double, n bigint"


def _fit_long(r: DataFrame, facts: DataFrame, size: int) -> DataFrame:
    """Fits of long series: their returns as a row of bytes for each bucket; a step is one pass that reduces buckets to what they make of
    a state, and one that adds up the sums of buckets from the states that these lead to. The searches themselves are a table by series."""
    kind = dict(r.dtypes)["series"]
    cut = with_scalars(r, facts).select("series", F.floor(F.col("idx") / size).alias("b"), F.struct("idx", (F.col("r") * F.col("r") / F.col("var")).alias("z")).alias("x"))
    rows = materialise(cut.groupBy("series", "b").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["z"]).alias("z")))

    def begin(d: pd.DataFrame) -> pd.DataFrame:
        return d.assign(search=[pickle.dumps(Search(n)) for n in d["n"]], done=False)

    states = materialise(facts.mapInPandas(lambda ds: map(begin, ds), f"series {kind}, n bigint, var double, search binary, done boolean"))

    def reduce_bucket(ds):
        for d in ds:
            made = [state_map(np.array(z), parameters(pickle.loads(s).trial)[0]) for z, s in zip(d["z"], d["search"], strict=True)]
            yield pd.DataFrame({"series": d["series"], "b": d["b"], "n": d["z"].map(len), "made": [m.tolist() for m in made], "search": d["search"]})

    def compose(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("b")
        beta, state, out = parameters(pickle.loads(d["search"].iat[0]).trial)[0][2], np.array([1.0, 0, 0, 0]), []
        for made, n in zip(d["made"], d["n"], strict=True):
            out.append(state.tolist())
            state = after(state, np.array(made), n, beta)
        return pd.DataFrame({"series": d["series"], "b": d["b"], "state": out, "search": d["search"]})

    def add(ds):
        for d in ds:
            made = [likelihood_sums(np.array(z), parameters(pickle.loads(s).trial)[0], np.array(at)) for z, s, at in zip(d["z"], d["search"], d["state"], strict=True)]
            yield pd.DataFrame({"series": d["series"], "b": d["b"], "sums": [m.tolist() for m in made]})

    def step(d: pd.DataFrame) -> pd.DataFrame:
        search = pickle.loads(d["search"].iat[0])
        search.take(np.sum(d.sort_values("b")["sums"].tolist(), axis=0))
        return pd.DataFrame({"series": d["series"].iloc[:1], "n": d["n"].iloc[:1], "var": d["var"].iloc[:1], "search": [pickle.dumps(search)], "done": [bool(search.done)]})

    while states.where("not done").limit(1).count():
        live = states.where("not done")
        maps = with_scalars(rows, live.select("series", "search")).mapInPandas(reduce_bucket, f"series {kind}, b bigint, n bigint, made array<double>, search binary")
        starts = maps.groupBy("series").applyInPandas(compose, f"series {kind}, b bigint, state array<double>, search binary")
        sums = with_scalars(rows, starts, keys=["series", "b"]).mapInPandas(add, f"series {kind}, b bigint, sums array<double>")
        stepped = matched(sums, live, "series").groupBy("series").applyInPandas(step, f"series {kind}, n bigint, var double, search binary, done boolean")
        states = materialise(states.where("done").unionByName(stepped))

    def end(ds):
        for d in ds:
            found = [pickle.loads(s).result(v) for s, v in zip(d["search"], d["var"], strict=True)]
            yield pd.DataFrame({"series": d["series"], **{c: [float(f[i]) for f in found] for i, c in enumerate(("omega", "alpha", "beta", "loglik"))}, "n": d["n"]})

    return states.mapInPandas(end, f"series {kind}, {FIT}")


def garch_fit(df: DataFrame, p: str, most: int | None = 10_000, local: int = LOCAL_RETURNS, size: int = BUCKET) -> DataFrame:
    """(series, omega, alpha, beta, persistence, loglik, n, aic, bic, stationary) of greatest likelihood, on the log returns of the last `most`
    prices (None: of all); missing prices are skipped, series under 100 prices are left out. Series of up to `local` returns are fitted in a
    task each; longer ones by passes over buckets of rows."""
    r = materialise(log_returns(df, p, most))
    facts = r.groupBy("series").agg(F.count("*").alias("n"), F.greatest(F.var_pop("r"), F.lit(1e-300)).alias("var")).where("n >= 99")
    facts = materialise(facts)
    kind = dict(df.dtypes)["series"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("idx")["r"].to_numpy(float)
        return pd.DataFrame([(g["series"].iat[0], *fit_garch(v), len(v))], columns=["series", "omega", "alpha", "beta", "loglik", "n"])

    out = with_scalars(r, facts.where(F.col("n") <= local).select("series")).groupBy("series").applyInPandas(fit, f"series {kind}, {FIT}")
    long = facts.where(F.col("n") > local)
    if long.limit(1).count():
        out = out.unionByName(_fit_long(r, long, size))
    return out.withColumns({"persistence": F.col("alpha") + F.col("beta"), "aic": 6 - 2 * F.col("loglik"), "bic": 3 * F.log("n") - 2 * F.col("loglik")}).withColumn("stationary", F.col("persistence") < 1)


#: Windows that are fitted side by side.
SIDE_BY_SIDE = 128


def garch_rolling(df: DataFrame, p: str, window: int = 1000, step: int = 100, embargo: int = 0, least: int = 50) -> DataFrame:
    """(series, idx, omega, alpha, beta, persistence) for rows [anchor + embargo, anchor + step), fitted on the rows [anchor - window, anchor). A
    missing or non-positive price is skipped, the return over it counts once; windows with fewer than `least` returns give no rows. A task takes
    the windows that start in a bucket of rows, from the bucket and the rows after it that these windows reach."""
    rows = df.select("series", "idx", F.when(_usable(p), F.col(p).cast("double")).alias("p"))
    size = -(-max(SIDE_BY_SIDE * step, window) // step) * step
    kind = dict(df.dtypes)["series"]

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        v, at = np.log(t["p"].to_numpy()), t["idx"][0].as_py()
        starts, returns = [], []
        for first in range(0, min(size, len(v) - window + 1), step):
            own = v[first : first + window]
            r = np.diff(own[~np.isnan(own)])
            if len(r) >= least:
                starts.append(at + first + window)
                returns.append(r)
        found = [fit_windows(returns[i : i + SIDE_BY_SIDE]) for i in range(0, len(returns), SIDE_BY_SIDE)]
        found = np.concatenate(found) if found else np.empty((0, 4))
        own = t["series"].combine_chunks().take(pa.array(np.zeros(len(starts)), pa.int64()))
        return pa.table([own, pa.array(starts, pa.int64()), *[pa.array(found[:, i]) for i in range(3)]], names=["series", "anchor", "omega", "alpha", "beta"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, many fits: tasks are not to be put together by their size
    spread = halo(rows, ahead=max(window - step, 0), size=size).drop("_home").repartition(tasks, "series", "_bucket")
    found = spread.groupBy("series", "_bucket").applyInArrow(fit, f"series {kind}, anchor bigint, omega double, alpha double, beta double")
    at = F.floor((F.col("idx") - window) / step) * step + window
    own = df.select("series", "idx", at.alias("anchor")).where((F.col("idx") >= window) & (F.col("idx") - F.col("anchor") >= embargo))
    return with_scalars(own, found, keys=["series", "anchor"]).select("series", "idx", "omega", "alpha", "beta", (F.col("alpha") + F.col("beta")).alias("persistence"))


def conditional_variance(r: DataFrame, fits: DataFrame, size: int = 20_000) -> DataFrame:
    """(series, idx, r, h): h = omega + alpha r^2 + beta h of the row before, from the variance of r. After a missing r there is no h; with an
    infinite one the variance, and so every h, is NaN.

    A bucket of rows turns the variance before it into scale * h + shift; these pairs are composed along the buckets, then each bucket
    starts from its own value. A task holds a bucket of rows, or one pair for each bucket of a series."""
    var = variance_of_returns(r).withColumnRenamed("v", "h0")
    rows = r.transform(with_scalars, fits.select("series", "omega", "alpha", "beta")).transform(with_scalars, var).withColumn("_b", F.floor(F.col("idx") / size))
    kind = dict(r.dtypes)["series"]

    def steps(t: pa.Table) -> tuple[np.ndarray, float]:
        """What each row adds to the variance before it, and beta."""
        w, a, b = (t[c][0].as_py() for c in ("omega", "alpha", "beta"))
        return w + a * t["r"].combine_chunks().to_numpy(zero_copy_only=False).astype(float) ** 2, b

    def summary(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        x, b = steps(t)
        shift = None if t["r"].null_count else float(decayed(x, b)[-1])
        return t.slice(0, 1).select(["series", "_b", "h0"]).append_column("scale", pa.array([b ** len(t)])).append_column("shift", pa.array([shift], pa.float64()))

    pairs = rows.groupBy("series", "_b").applyInArrow(summary, f"series {kind}, _b bigint, h0 double, scale double, shift double")

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("_b")
        h, out = t["h0"][0].as_py(), []
        for scale, shift in zip(t["scale"].to_pylist(), t["shift"].to_pylist(), strict=True):
            out.append(h)
            h = None if h is None or shift is None else scale * h + shift
        return t.select(["series", "_b"]).append_column("start", pa.array(out, pa.float64()))

    starts = pairs.groupBy("series").applyInArrow(compose, f"series {kind}, _b bigint, start double")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        h, (x, b) = t["start"][0].as_py(), steps(t)
        gone = np.full(len(t), h is None) | (np.cumsum(np.concatenate([[False], t["r"].is_null().to_numpy()[:-1]])) > 0)
        out = decayed(x, b, np.nan if h is None else h)[:-1]
        return t.select(["series", "idx", "r"]).append_column("h", pa.array(out, mask=gone))

    return matched(rows, starts, ["series", "_b"]).groupBy("series", "_b").applyInArrow(run, f"series {kind}, idx bigint, r double, h double")


def garch_loglik(path: DataFrame) -> DataFrame:
    return path.groupBy("series").agg((-0.5 * F.sum(F.lit(math.log(2 * math.pi)) + F.log("h") + ratio(F.col("r") ** 2, F.col("h")))).alias("loglik"))


def vol_statistics(path: DataFrame) -> DataFrame:
    """Statistics of the volatility, the root of h."""
    v = path.withColumn("v", F.sqrt("h"))
    out = v.groupBy("series").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), (F.kurtosis("v") + 3).alias("kurt"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = quantiles(v, "v", ["series"], [0.5, 0.25, 0.75], "_q").select("series", *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "q25", "q75"))])
    out = matched(out, q, "series")
    return out.withColumns({"range": F.col("max") - F.col("min"), "cv": F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))})


def vol_autocorr(path: DataFrame) -> DataFrame:
    return autocorr(path.withColumn("v", F.sqrt("h")), "v", [1, 5, 10, 20, 50])


def residual_stats(path: DataFrame) -> DataFrame:
    """Moments and Jarque-Bera of r over its volatility; rows without volatility are left out."""
    z = path.withColumn("z", ratio(F.col("r"), F.sqrt("h")))
    return moments(z, "z").transform(matched, jarque_bera(z, "z"), "series")


def vol_forecast(path: DataFrame, fits: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(series, horizon, vol): the last variance drawn to its long-run level by persistence to the power of the horizon; null without a
    long-run level."""
    last = path.groupBy("series").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("idx"))).alias("_h"))
    long_run = ratio(F.col("omega"), 1 - F.col("persistence"))
    each = matched(last, fits, "series").withColumn("horizon", F.explode(F.array(*[F.lit(k) for k in horizons])))
    return each.select("series", "horizon", F.sqrt(long_run + F.pow("persistence", "horizon") * (F.col("_h") - long_run)).alias("vol"))


def vol_diagnostics(path: DataFrame, fits: DataFrame) -> DataFrame:
    """(series, asymmetry, clustering, reversion, half_life)."""
    signs = path.groupBy("series").agg(ratio(F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))), F.stddev_pop(F.when(F.col("r") > 0, F.col("r")))).alias("asymmetry"))
    lag1 = autocorr(path.withColumn("v", F.sqrt("h")), "v", [1]).select("series", F.col("r").alias("clustering"))
    p = F.col("persistence")
    own = fits.select("series", (1 - p).alias("reversion"), F.when((p > 0) & (p < 1), F.log(F.lit(0.5)) / F.log(p)).alias("half_life"))
    return matched(matched(signs, lag1, "series"), own, "series")

