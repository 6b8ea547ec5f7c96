"""Estimation over panels: sums on Spark, small solves on what they give."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-30)
        c = (1 + num / c) or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def correlation(rows: DataFrame, key: str, x: str, y: str, least: int = 5) -> DataFrame:
    """(key, r, p, n): Pearson's r with its two-sided p by Student's t, for keys of at least so many pairs."""
    s = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)

    def add(batches):
        for pdf in batches:
            pdf["p"] = [t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2) if r == r and r is not None else None for r, n in zip(pdf["r"], pdf["n"])]
            yield pdf[[key, "r", "p", "n"]]

    return s.mapInPandas(add, f"{key} {s.schema[key].dataType.simpleString()}, r double, p double, n long")


def gram(rows: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X with the intercept first, X'y, y'y, n) of the rows without NULLs, in one pass."""
    cols = ["1", *[f"`{x}`" for x in xs]]
    clean = rows.na.drop(subset=[y, *xs])
    k = len(cols)
    sums = [F.sum(F.expr(f"double({cols[i]} * {cols[j]})")) for i in range(k) for j in range(i, k)] + [F.sum(F.expr(f"double({c} * `{y}`)")) for c in cols]
    r = clean.agg(*sums, F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))).first()
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = r[at] or 0.0
            at += 1
    return a, np.array([v or 0.0 for v in r[at : at + k]]), r[at + k] or 0.0, r[at + k + 1]


def ols(rows: DataFrame, y: str, xs: Sequence[str]) -> dict:
    """Coefficients (the intercept first), their standard errors and p values, R squared, the sum of squared residuals and n."""
    a, b, yy, n = gram(rows, y, xs)
    inv = np.linalg.pinv(a)
    beta = inv @ b
    ssr = float(max(yy - beta @ b, 0.0))
    df = n - len(beta)
    se = np.sqrt(np.maximum(np.diag(inv) * ssr / max(df, 1), 0))
    tss = yy - b[0] ** 2 / max(n, 1)
    p = [t_two_sided(c / s, df) if s > 0 else float("nan") for c, s in zip(beta, se)]
    return {"beta": beta, "se": se, "p": np.array(p), "r2": 1 - ssr / tss if tss > 0 else float("nan"), "ssr": ssr, "n": n}


def incremental_f(rows: DataFrame, y: str, fewer: Sequence[str], more: Sequence[str]) -> tuple[float, float]:
    """(F, p) of the regressors in more that aren't in fewer."""
    clean = rows.na.drop(subset=[y, *more])
    r, u = ols(clean, y, fewer), ols(clean, y, more)
    q, df = len(more) - len(fewer), u["n"] - len(more) - 1
    f = ((r["ssr"] - u["ssr"]) / q) / (u["ssr"] / df) if u["ssr"] > 0 else float("inf")
    return f, f_tail(f, q, df)


def demean(rows: DataFrame, cols: Sequence[str], entity: str, time: str, simultaneous: bool = True) -> DataFrame:
    """cols within entity and time: x - its means + the grand mean, or one after the other."""
    e, t = Window.partitionBy(entity), Window.partitionBy(time)
    if simultaneous:
        grand = rows.agg(*[F.avg(c).alias(f"_all_{c}") for c in cols])  # one row
        both = rows.join(F.broadcast(grand)).withColumns({c: F.col(c) - F.avg(c).over(e) - F.avg(c).over(t) + F.col(f"_all_{c}") for c in cols})
        return both.drop(*[f"_all_{c}" for c in cols])
    once = rows.withColumns({c: F.col(c) - F.avg(c).over(e) for c in cols})
    return once.withColumns({c: F.col(c) - F.avg(c).over(t) for c in cols})


def clustered_errors(rows: DataFrame, y: str, xs: Sequence[str], one: str, two: str) -> np.ndarray:
    """Standard errors clustered both ways: the sandwich of each clustering, less that of their crossing."""
    clean = rows.na.drop(subset=[y, *xs])
    fit = ols(clean, y, xs)
    a, *_ , n = gram(clean, y, xs)
    inv, k = np.linalg.pinv(a), len(xs) + 1
    resid = F.col(y) - sum((F.lit(float(b)) * F.col(x) for b, x in zip(fit["beta"][1:], xs)), F.lit(float(fit["beta"][0])))
    scored = clean.withColumn("_u", resid).select(one, two, *[(F.col("_u") * (F.lit(1.0) if i == 0 else F.col(xs[i - 1]))).alias(f"_s{i}") for i in range(k)])

    def meat(by: Sequence[str]) -> np.ndarray:
        g = scored.groupBy(*by).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)])
        outer = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(k) for j in range(k)]
        r = g.agg(*outer, F.count(F.lit(1))).first()
        groups = r[k * k]
        scale = groups / max(groups - 1, 1) * (n - 1) / max(n - k, 1)
        return scale * np.array([v or 0.0 for v in r[: k * k]]).reshape(k, k)

    v = inv @ (meat([one]) + meat([two]) - meat([one, two])) @ inv
    return np.sqrt(np.abs(np.diag(v)))


def rolling_alpha(returns: DataFrame, factors: DataFrame, names: Sequence[str], window: int = 24) -> DataFrame:
    """(series, date, alpha): the intercept of ret - rf on the factors over the window rows before each date; NULL where one is missing.

    Sums of products are taken by window frames in the JVM; only the solves are vectorised in numpy, over all rows of a batch at once.
    """
    k = len(names) + 1
    j = returns.join(factors, "date").withColumn("_y", F.col("ret") - F.col("rf"))
    w = Window.partitionBy("series").orderBy("date").rowsBetween(-window, -1)
    col = lambda i: F.lit(1.0) if i == 0 else F.col(names[i - 1])
    sums = {f"_a{i}_{m}": F.sum(col(i) * col(m)).over(w) for i in range(k) for m in range(i, k)} | {f"_b{i}": F.sum(col(i) * F.col("_y")).over(w) for i in range(k)}
    ok = F.when(F.col("_y").isNotNull(), 1)
    j = j.withColumns({**sums, "_n": F.count(ok).over(w)})

    def solve(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), k, k))
            for i in range(k):
                for m in range(i, k):
                    a[:, i, m] = a[:, m, i] = pdf[f"_a{i}_{m}"].to_numpy(float)
            b = np.stack([pdf[f"_b{i}"].to_numpy(float) for i in range(k)], axis=1)
            full = (pdf["_n"].to_numpy() == window) & np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
            alpha = np.full(len(pdf), np.nan)
            if full.any():
                alpha[full] = (np.linalg.pinv(a[full]) @ b[full][:, :, None])[:, 0, 0]
            yield pd.DataFrame({"series": pdf["series"], "date": pdf["date"], "alpha": pd.Series(alpha).astype(object).where(full, None)})

    return j.select("series", "date", "_n", *sums).mapInPandas(solve, "series string, date date, alpha double")


def _small(rows: DataFrame, most_rows: int) -> pd.DataFrame:
    """rows on the driver; raises where there are more than most_rows."""
    pdf = rows.limit(most_rows + 1).toPandas()
    if len(pdf) > most_rows:
        raise ValueError(f"resampling takes panels of up to {most_rows} rows")
    return pdf


def placebo(rows: DataFrame, y: str, x: str, draws: int = 1000, seed: int = 42, most_rows: int = 1_000_000) -> DataFrame:
    """One row: observed slope of y on x, the 99th percentile of slopes with x shuffled, the share of draws at least as large, and draws.

    The panel of one signal is small (hundreds of rows; more than most_rows raise); draws are spread over the tasks, each seeded by its number.
    """
    pdf = _small(rows.select(y, x).na.drop(), most_rows).sort_values([x, y], ignore_index=True)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((pdf[y].to_numpy(float), pdf[x].to_numpy(float)))

    def slope(a, b):
        c = b - b.mean()
        return float((c * a).sum() / max((c * c).sum(), 1e-300))

    def run(batches):
        a, b = sent.value
        for ids in batches:
            yield pd.DataFrame({"slope": [slope(a, np.random.default_rng([seed, int(i)]).permutation(b)) for i in ids["id"]]})

    seen = slope(*sent.value) if len(pdf) else 0.0
    drawn = spark.range(draws).mapInPandas(run, "slope double")
    return drawn.agg(F.lit(seen).alias("observed"), F.percentile("slope", F.lit(0.99)).alias("p99"), F.avg((F.col("slope") >= seen).cast("double")).alias("p"), F.count(F.lit(1)).alias("draws"))


def wild_bootstrap(rows: DataFrame, y: str, x: str, cluster: str, draws: int = 999, seed: int = 42, most_rows: int = 1_000_000) -> DataFrame:
    """One row: the slope of y on x and its two-sided p by a wild cluster bootstrap with signs, the null imposed."""
    pdf = _small(rows.select(y, x, cluster).na.drop(), most_rows).sort_values([cluster, x, y], ignore_index=True)
    codes = pd.factorize(pdf[cluster])[0]
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((pdf[y].to_numpy(float), pdf[x].to_numpy(float), codes))

    def t_of(a, b, g):
        c = b - b.mean()
        s = max((c * c).sum(), 1e-300)
        beta = (c * a).sum() / s
        u = (a - a.mean() - beta * c) * c
        return beta, beta / max(np.sqrt((np.bincount(g, weights=u) ** 2).sum()) / s, 1e-300)

    def run(batches):
        a, b, g = sent.value
        e = a - a.mean()
        for ids in batches:
            out = []
            for i in ids["id"]:
                sign = np.random.default_rng([seed, int(i)]).choice([-1.0, 1.0], g.max() + 1)
                out.append(abs(t_of(a.mean() + e * sign[g], b, g)[1]))
            yield pd.DataFrame({"t": out})

    beta, t = t_of(*sent.value) if len(pdf) else (0.0, 0.0)
    return spark.range(draws).mapInPandas(run, "t double").agg(F.lit(float(beta)).alias("slope"), F.lit(float(t)).alias("t"), F.avg((F.col("t") >= abs(float(t))).cast("double")).alias("p"))
