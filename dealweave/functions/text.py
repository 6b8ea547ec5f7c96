"""Text, date and hash helpers: each takes columns and gives a column."""

from __future__ import annotations

import difflib
import json
import uuid
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# They must equal those of the reference for equal results.
CATEGORY_TO_ETF = (
    ("IGV", ("software", "enterprise", "analytics", "security", "cloud_computing", "saas", "crm", "erp", "devops", "productivity", "collaboration")),
    ("SOXX", ("semiconductor", "hardware", "networking", "embedded", "chip")),
    ("XBI", ("biotech", "health", "medical", "pharmaceutical", "life sciences", "diagnostics", "genomics", "healthcare")),
    ("IGV", ("web", "internet", "mobile", "ecommerce", "games_video", "advertising", "social", "media", "search", "marketplace", "network_hosting")),
    ("SOXX", ("cleantech", "energy", "greentech")),
    ("IGV", ("finance", "fintech", "payments", "insurance", "other", "unknown")),
)
KEYWORDS_TO_SECTOR = (
    ("IGV", ("software", "saas", "cloud", "enterprise")),
    ("SOXX", ("chip", "semiconductor", "hardware")),
    ("XBI", ("biotech", "pharma", "genomics", "health")),
    ("XLF", ("fintech", "payments", "banking", "insurtech")),
    ("FDN", ("ecommerce", "marketplace", "social")),
    ("QCLN", ("cleantech", "solar", "renewable")),
    ("ARKW", ("ai", "llm", "deep learning")),
    ("HACK", ("security", "cybersecurity")),
)
ROUNDS = {
    "series-a": ("series a", "series-a", "seriesa"),
    "series-b": ("series b", "series-b", "seriesb"),
    "series-c": ("series c", "series-c"),
    "seed": ("seed",),
    "pre-seed": ("pre-seed", "preseed"),
    "angel": ("angel",),
    "venture": ("venture",),
}
ROUND_ORDER = ("series d", "series c", "series b", "series a", "seed", "pre-seed", "angel")
HEADLINE_VERBS = ("raises", "secures", "closes", "lands", "gets", "receives")


def _first(cases: Iterable[tuple[Column, Column | str]], default: Column | str) -> Column:
    out = None
    for test, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def category_to_etf(c: Column, default: str = "IGV") -> Column:
    """The ticker of a category: exact, else the first known category contained in it, else the default."""
    t = F.lower(F.trim(c))
    known = [(k, etf) for etf, ks in CATEGORY_TO_ETF for k in ks]
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in known for x in kv]), t)
    return F.coalesce(exact, _first(((F.contains(t, F.lit(k)), etf) for k, etf in known), default))


def sector_of_text(c: Column, default: str = "IGV", word_boundary: bool = False) -> Column:
    """The sector of the first keyword in the text; keywords match inside words unless word_boundary is set."""
    t = F.lower(c)
    hit = lambda k: t.rlike(rf"\b{k}\b") if word_boundary else F.contains(t, F.lit(k))
    return _first(((hit(k), sector) for sector, ks in KEYWORDS_TO_SECTOR for k in ks), default)


def normalise_round(c: Column) -> Column:
    t = F.lower(F.trim(c))
    pairs = [F.lit(x) for name, spelled in ROUNDS.items() for s in spelled for x in (s, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), t), t)


def round_of_text(c: Column) -> Column:
    t = F.lower(c)
    return _first(((F.contains(t, F.lit(k)), normalise_round(F.lit(k))) for k in ROUND_ORDER), "venture")


def company_of_headline(c: Column) -> Column:
    """What stands before a headline's verb, else the first 200 characters."""
    found = [F.nullif(F.regexp_extract(c, rf"(?i)^(.+?)\s+{v}\b", 1), F.lit("")) for v in HEADLINE_VERBS]
    return F.coalesce(*[F.substring(F.trim(x), 1, 200) for x in found], F.nullif(F.substring(c, 1, 200), F.lit("")))


def amount_of_text(c: Column) -> Column:
    """A dollar amount: billions, millions, or plain."""
    big = F.nullif(F.regexp_extract(c, r"(?i)\$(\d+(?:\.\d+)?)\s*(?:billion|bn)", 1), F.lit("")).try_cast("double")
    mid = F.nullif(F.regexp_extract(c, r"(?i)\$(\d+(?:\.\d+)?)\s*(?:million|mn|m)\b", 1), F.lit("")).try_cast("double")
    plain = F.regexp_replace(F.nullif(F.regexp_extract(c, r"\$(\d+(?:,\d{3})*(?:\.\d+)?)", 1), F.lit("")), ",", "").try_cast("double")
    return F.coalesce(big * 1e9, mid * 1e6, plain).cast("long")


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of the two texts' character pairs, counted as often as they occur; lower case, 1 for equal texts."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
    gx, gy = grams(x), grams(y)
    times = lambda g, u: F.size(F.filter(g, lambda v: v == u))
    common = F.aggregate(F.array_distinct(gx), F.lit(0), lambda acc, u: acc + F.least(times(gx, u), times(gy, u)))
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2.0 * common / (F.length(x) + F.length(y) - 2))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of two texts, as the standard library gives it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def portfolio_names(rows: DataFrame, text: str, row_id: str) -> DataFrame:
    """(row_id, pos, name): names of a pasted list, in order, without quotes, repeats (in any case) and names of fewer than three letters."""
    parts = F.split(F.regexp_replace(F.col(text), "[;,]", "\n"), "\n")
    p = rows.select(F.col(row_id), F.posexplode(parts).alias("pos", "name")).withColumn("name", F.trim(F.regexp_replace(F.trim("name"), "^[\"']+|[\"']+$", "")))
    p = p.filter(F.length("name") >= 3).groupBy(row_id, F.lower("name").alias("_k")).agg(F.min(F.struct("pos", "name")).alias("x"))
    return p.select(row_id, "x.pos", "x.name")


def severity(c: Column, high: float = 0.5, medium: float = 0.3) -> Column:
    return F.when(c >= high, "HIGH").when(c >= medium, "MEDIUM").otherwise("LOW")


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def compact(c: Column) -> Column:
    """1.2B, 3.4M, 5.6K or the whole number."""
    f = lambda d, u: F.concat(F.format_number(c / d, 1), F.lit(u))
    return F.when(F.abs(c) >= 1e9, f(1e9, "B")).when(F.abs(c) >= 1e6, f(1e6, "M")).when(F.abs(c) >= 1e3, f(1e3, "K")).otherwise(F.format_number(c, 0))


def years_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / F.lit(365.25).cast("double")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("Q"), F.quarter(c))


def quarter_ends(dates: DataFrame, first: str, last: str) -> DataFrame:
    """(eval_date): all quarter ends from the one of first to the one of last."""
    start, end = F.trunc(F.col(first), "quarter"), F.trunc(F.col(last), "quarter")
    return dates.select(F.explode(F.sequence(start, end, F.expr("interval 3 months"))).alias("q")).select(F.last_day(F.add_months("q", 2)).alias("eval_date"))


def seal(values: dict) -> str:
    """SHA-256 of a mapping as JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()


def chain(*parts: Column | str) -> Column:
    """SHA-256 of the parts put one after the other."""
    return F.sha2(F.concat(*parts), 256)


def audit_hashes(panel: DataFrame) -> DataFrame:
    """(eval_date, audit_hash): the first 16 hex digits of the hash of a date's scores, rounded to 8 digits, in the order of their investors.

    Each investor's hash is summed as a decimal, so a date is never collected; the order of rows doesn't matter.
    """
    one = F.conv(F.substring(F.sha2(F.concat_ws("=", "investor", F.format_number(F.round("tps", 8), 8)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return panel.groupBy("eval_date").agg(F.substring(F.sha2(F.concat_ws("|", F.sum(one).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 16).alias("audit_hash"))


def stable_uuid(seed: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, seed))


def any_keyword(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(F.lower(c), k))
