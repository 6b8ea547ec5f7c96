"""Profiles of communities, portfolios and sectors, best matches of names, track records and guards."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.session import written


def top_of(counts: DataFrame, key: Sequence[str], name: str, n: str, k: int) -> DataFrame:
    """The k rows of each key with the greatest n, ties by name."""
    w = Window.partitionBy(*key).orderBy(F.desc(n), name)
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)


def _joined(top: DataFrame, key: str, name: str, out: str, sep: str = ", ") -> DataFrame:
    return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", name))), lambda x: x[name]), sep).alias(out))


def community_profiles(partition: DataFrame, degrees: DataFrame, scores: DataFrame, deals: DataFrame, *, least: int = 5, first: str = "series-a") -> DataFrame:
    """(community_id, size, top_investors, mean_out_degree, mean_in_degree, mean_tps, top_sectors, top_countries, pct_series_a) of communities of at least so many members.

    partition is (node, community_id). Members without a degree or a score count as 0; sectors and countries are the three of each member by deals, summed over
    members; pct_series_a is the mean over members that have deals, one half where none has.
    """
    m = partition.join(degrees.select("node", "out_weight", "in_weight"), "node", "left").join(scores.select(F.col("investor").alias("node"), "tps"), "node", "left")
    m = m.select("node", "community_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("out_weight", "in_weight", "tps")])
    size = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in ("out_weight", "in_weight", "tps")]).filter(F.col("size") >= least)
    out = size.join(_joined(top_of(m, ["community_id"], "node", "out_weight", 5), "community_id", "node", "top_investors"), "community_id")
    of = deals.select(F.col("investor_name").alias("node"), F.lower("category_code").alias("sector"), F.col("country_code").alias("country"), (F.col("funding_round_type") == first).cast("double").alias("a"))
    for c, name in (("sector", "top_sectors"), ("country", "top_countries")):
        each = top_of(of.filter(F.col(c).isNotNull()).groupBy("node", c).agg(F.count(F.lit(1)).alias("n")), ["node"], c, "n", 3)
        both = each.join(partition, "node").groupBy("community_id", c).agg(F.sum("n").alias("n"))
        out = out.join(_joined(top_of(both, ["community_id"], c, "n", 3), "community_id", c, name), "community_id", "left")
    share = of.groupBy("node").agg(F.avg("a").alias("a")).join(partition, "node").groupBy("community_id").agg(F.avg("a").alias("pct"))
    out = out.join(share, "community_id", "left")
    return out.select(
        "community_id", "size", "top_investors", F.round("mean_out_weight", 3).alias("mean_out_degree"), F.round("mean_in_weight", 3).alias("mean_in_degree"), F.round("mean_tps", 4).alias("mean_tps"),
        F.coalesce("top_sectors", F.lit("")).alias("top_sectors"), F.coalesce("top_countries", F.lit("")).alias("top_countries"), F.round(F.coalesce("pct", F.lit(0.5)), 3).alias("pct_series_a"),
    )


def exits(held: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """(key, n_companies, n_acq, n_ipo, exit_rate) of holdings (key, company_id) and companies (id, status); the rate is in percent."""
    h = held.select(key, "company_id").distinct().join(companies.select(F.col("id").alias("company_id"), "status").distinct(), "company_id", "left")
    g = h.groupBy(key).agg(F.countDistinct("company_id").alias("n_companies"), F.count_if(F.col("status") == "acquired").alias("n_acq"), F.count_if(F.col("status") == "ipo").alias("n_ipo"))
    return g.withColumn("exit_rate", (F.col("n_acq") + F.col("n_ipo")) / F.greatest("n_companies", F.lit(1)) * 100)


def risk_flags(scores: DataFrame, panel: DataFrame, names: DataFrame) -> DataFrame:
    """(investor, flag, severity) of names (investor): a score below half the median, or one that fell by over 30% within the last four observations."""
    median = scores.agg(F.median("tps").alias("median"))
    low = scores.join(names, "investor", "left_semi").join(F.broadcast(median)).filter(F.col("tps") < F.col("median") * 0.5).select("investor", F.lit("LOW_TPS").alias("flag"), F.lit("MEDIUM").alias("severity"))
    w = Window.partitionBy("investor").orderBy(F.desc("eval_date"))
    last = panel.join(names, "investor", "left_semi").withColumn("r", F.row_number().over(w)).filter("r <= 4").groupBy("investor").agg(F.count(F.lit(1)).alias("n"), F.max_by("tps", "r").alias("then"), F.min_by("tps", "r").alias("now"))
    falling = last.filter("n = 4 and now < then * 0.7").select("investor", F.lit("DECLINING_TPS").alias("flag"), F.lit("HIGH").alias("severity"))
    return low.unionByName(falling)


def best_match(names: DataFrame, universe: DataFrame, *, name: str, known: str, cutoff: float = 0.78) -> DataFrame:
    """(name, known, score): for each distinct name the known one that equals it but for case (score 1), else the one of the highest matching ratio of at least cutoff.

    Names without one get none, NULLs none. Ties go to the name that the standard library prefers (the greater in lower case). Ratcliff and Obershelp's ratio
    counts 2 M / (la + lb), M being letters in common blocks, so it is never above the ratio of letters that both have in any order; and blocks are parted by
    letters left over, so the names share at least M - (la + lb - 2 M + 1) pairs of neighbouring letters. Blocks of names of like length meet; letters are
    counted for a whole block of names at once, pairs of letters for what is left, and only the rest is compared.
    """
    n = names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("k", F.lower("name"))
    u = universe.select(F.col(known).alias("known")).filter("known is not null").groupBy(F.lower("known").alias("u")).agg(F.max("known").alias("known"))
    exact = n.join(u, n["k"] == u["u"]).select("name", "known", F.lit(1.0).alias("score"))
    rest = written(n.join(u.select(F.col("u").alias("k")), "k", "left_anti"), "names")

    def blocks(df: DataFrame, c: str, size: int = 1000) -> DataFrame:
        """(names, lo, hi): names of like length with the least and the greatest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, size):
                    x = b.column("x").slice(k, size).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.string())), pa.array([min(map(len, x))], pa.int32()), pa.array([max(map(len, x))], pa.int32())], names=["names", "lo", "hi"])

        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        d = df.select(F.col(c).alias("x")).distinct().repartitionByRange(parts, F.length("x")).sortWithinPartitions(F.length("x"))
        return written(d.mapInArrow(run, "names array<string>, lo int, hi int"), "blocks")

    # Of lengths l and m, the lesser is at least cutoff / (2 - cutoff) of the greater.
    share = cutoff / (2 - cutoff) - 1e-9
    met = blocks(rest, "k").toDF("xs", "lo", "hi").join(blocks(u, "u").toDF("ys", "from", "to"), (F.col("to") >= F.col("lo") * share) & (F.col("from") * share <= F.col("hi")))
    met = met.select("xs", "ys").repartition(2 * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
        for b in batches:
            for k in range(b.num_rows):
                out = _alike(b.column("xs")[k].as_py(), b.column("ys")[k].as_py(), cutoff)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["x", "y", "s", "told"])

    scored = met.mapInArrow(compare, "x string, y string, s double, told double")
    best = scored.groupBy("x").agg(F.max(F.struct("s", "y", "told")).alias("b"))
    found = rest.join(best, rest["k"] == best["x"]).join(u, F.col("b.y") == u["u"]).select("name", "known", F.col("b.told").alias("score"))
    return exact.unionByName(found)


def _alike(xs: list[str], ys: list[str], cutoff: float) -> list[tuple[str, str, float, float]]:
    """(x, y, ratio as the library tells close matches, ratio) of the pairs whose matching ratio reaches the cutoff."""
    both = letters_ratio(xs, ys)
    px, py, out, m = [_pairs(x) for x in xs], [_pairs(y) for y in ys], [], difflib.SequenceMatcher(None)
    for i, j in zip(*np.nonzero(both >= cutoff - 1e-6)):
        x, y = xs[i], ys[j]
        whole = len(x) + len(y)
        if x and y and 2 * (len(px[i] & py[j]) + whole + 1) < (cutoff - 1e-9) * 3 * whole:
            continue
        if m.b is not x:
            m.set_seq2(x)  # the name comes second, as where the library tells close matches
        m.set_seq1(y)
        r = m.ratio()
        if r >= cutoff:
            out.append((x, y, r, difflib.SequenceMatcher(None, x, y).ratio()))
    return out


def _pairs(x: str) -> set[str]:
    """The pairs of neighbouring letters, numbered where they recur."""
    seen: dict[str, int] = {}
    out = set()
    for i in range(len(x) - 1):
        g = x[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.add(f"{g}{seen[g]}")
    return out


def letters_ratio(xs: list[str], ys: list[str]) -> np.ndarray:
    """For each x and y the ratio of letters that both have, in any order: never below the matching ratio."""
    at = {c: k for k, c in enumerate(sorted(set().union(*xs, *ys)))}
    longest = max([0, *map(len, xs), *map(len, ys)])

    def counts(names: list[str]) -> np.ndarray:
        n = np.zeros((len(at), len(names)), np.uint8 if longest < 256 else np.int32)
        for k, name in enumerate(names):
            for c in name:
                n[at[c], k] += 1
        return n

    nx, ny = counts(xs), counts(ys)
    common = np.zeros((len(xs), len(ys)), np.uint16 if longest < 256 else np.int32)
    for a, b in zip(nx, ny):
        i = np.flatnonzero(a)
        if len(i) and b.any():
            common[i] += np.minimum(a[i][:, None], b[None, :])
    whole = np.array([len(x) for x in xs], np.float32)[:, None] + np.array([len(y) for y in ys], np.float32)[None, :]
    return np.where(whole > 0, 2 * common / np.maximum(whole, 1), 1.0)


def track_record(outcomes: DataFrame, least: int = 3) -> DataFrame:
    """(horizon_days, n, hit_rate, mean_excess) of outcomes (horizon_days, direction_correct, excess); rates only from so many outcomes on."""
    enough = lambda c, x: F.when(F.count(c) >= least, x)
    hit = F.col("direction_correct").cast("double")
    return outcomes.groupBy("horizon_days").agg(F.count(F.lit(1)).alias("n"), enough("direction_correct", F.avg(hit)).alias("hit_rate"), enough("excess", F.avg("excess")).alias("mean_excess"))


def seed_signals(panel: DataFrame, protocol: str, *, threshold: float, least_tier: int, horizons: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(signals, outcomes) of the panel rows (sector, eval_date, value, n_top_tier, names, mean_tps and the alphas) at or above the threshold.

    A signal expects a fall unless the alpha named for ninety days is positive; its receipt chains protocol, input, output and date. Outcomes come from the alphas.
    """
    p = panel.filter((F.col("value") >= threshold) & (F.col("n_top_tier") >= least_tier))
    up = F.coalesce(F.col(horizons[90]) > 0, F.lit(False))
    p = p.withColumn("direction", F.when(up, "POSITIVE_ALPHA").otherwise("NEGATIVE_ALPHA"))
    day = F.col("eval_date").cast("string")
    given = F.sha2(F.concat(F.lit('{"eval_date": "'), day, F.lit('", "n_top_tier": '), F.col("n_top_tier").cast("string"), F.lit(', "sector": "'), "sector", F.lit('", "sms_value": '), F.col("value").cast("string"), F.lit("}")), 256)
    names = F.slice(F.split("names", "[|]"), 1, 5)
    told = F.sha2(F.concat(F.lit('{"direction": "'), "direction", F.lit('", "top_investors": ["'), F.array_join(names, '", "'), F.lit('"]}')), 256)
    p = p.withColumns({"input_sha256": given, "output_sha256": told, "issued_at": F.concat(day, F.lit("T00:00:00+00:00"))})
    p = p.withColumn("receipt_sha256", F.sha2(F.concat(F.lit(protocol), "input_sha256", "output_sha256", "issued_at"), 256))
    signals = p.select("sector", "eval_date", "direction", "value", F.when(F.col("mean_tps") != 0, F.round((F.col("value") - F.col("mean_tps")) / 0.1, 2)).otherwise(0.0).alias("deviation_sigma"), "input_sha256", "output_sha256", "receipt_sha256", "issued_at")
    each = p.select("sector", "eval_date", "direction", F.inline(F.array(*[F.struct(F.lit(d).alias("horizon_days"), F.col(c).alias("excess")) for d, c in horizons.items()]))).filter("excess is not null")
    right = F.when(F.col("direction") == "NEGATIVE_ALPHA", F.col("excess") < 0).otherwise(F.col("excess") > 0)
    return signals, each.select("sector", "eval_date", "horizon_days", F.round("excess", 6).alias("excess"), right.alias("direction_correct"))


def volume_scores(events: DataFrame, baseline: DataFrame, least_share: float = 0.05) -> DataFrame:
    """(sector, sms_score, n_expected, n_silent, baseline_mean, baseline_sigma, deviation_sigma): what a sector's share of events lacks to its mean, where names are missing."""
    counts = events.groupBy("sector").agg(F.count(F.lit(1)).alias("n_live"))
    total = events.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    b = baseline.join(counts, "sector", "left").join(F.broadcast(total)).withColumn("n_live", F.coalesce("n_live", F.lit(0)))
    score = F.greatest(F.lit(0.0), F.round(F.col("mean") - F.col("n_live") / F.col("total") + least_share, 4))
    b = b.withColumns({"sms_score": score, "n_expected": F.greatest(F.lit(1), F.floor(F.col("total") * F.col("mean"))).cast("long")})
    return b.select("sector", "sms_score", "n_expected", F.greatest(F.lit(0), F.col("n_expected") - F.col("n_live")).alias("n_silent"), F.round("mean", 4).alias("baseline_mean"), F.round("sigma", 4).alias("baseline_sigma"), F.round((F.col("sms_score") - F.col("mean")) / F.col("sigma"), 2).alias("deviation_sigma"))


def only_until(rows: DataFrame, time: str, cutoff: str) -> DataFrame:
    """rows; any row after the cutoff fails the query, and so does a table all of whose rows are after it. NULL times pass."""
    late = F.col(time) > F.lit(cutoff).cast("date")
    first = rows.agg(F.count_if(~late | F.col(time).isNull()).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    if first["n"] and not first["ok"]:
        raise ValueError(f"every row of {time} is after {cutoff}")
    return rows.filter(F.when(late, F.raise_error(F.concat(F.lit(f"{time} after {cutoff}: "), F.col(time).cast("string"))).cast("boolean")).otherwise(True))


def union_of_tops(rows: DataFrame, key: str, measures: Sequence[str], k: int, missing: int = 9999) -> DataFrame:
    """(key, measures, rank_m for each): the rows among the k greatest of some measure, ties by key; a rank beyond k is `missing`."""
    ranks = None
    for m in measures:
        top = rows.select(key, m).orderBy(F.desc(m), key).limit(k)
        top = top.select(key, F.row_number().over(Window.orderBy(F.desc(m), key)).alias("r"), F.lit(m).alias("m"))  # k rows
        ranks = top if ranks is None else ranks.unionByName(top)
    wide = ranks.groupBy(key).pivot("m", list(measures)).agg(F.first("r"))
    out = wide.select(key, *[F.coalesce(m, F.lit(missing)).alias(f"rank_{m}") for m in measures])
    return rows.select(key, *measures).join(out, key)


def thinned(rows: DataFrame, key: Sequence[str], order: Sequence[str], step: int = 2) -> DataFrame:
    """Every step-th row of each key, from the first on."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % step == 0).drop("_n")


def canonical_json(fields: dict[str, Column]) -> Column:
    """A flat JSON object with sorted keys and a blank after comma and colon; texts are escaped as JSON, numbers stand as they print, NULL is null."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_text(c: Column) -> Column:
    """c as a JSON string."""
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias("x"))), '^\\{"x":|\\}$', ""))
