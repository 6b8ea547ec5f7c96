"""Timestamps typed in many manners, brought to one UTC instant.

An ordered cascade of anchored patterns rewrites a text into one canonical list of parts (year|month|day|hour|minute|second|fraction|
half|zone); the parts are then read strictly, once. What a part list denotes is decided by, in this order: the zone or offset in the text,
the home zone of its source. All of it is built-in expressions, so it stays in the JVM.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|Sept|October|November|December)\\.?"
_WEEKDAY = "(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? )?"
_ZONE = "(Z|[+-]\\d{2}:?\\d{2}|[A-Z]{1,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+){1,2})"
_CLOCK = "(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d{1,9}))?)?"
_HALF = "(?: ?([AaPp])\\.?[Mm]\\.?)?"

#: (name, pattern, parts). In parts, A and B are the first and second figure of a date whose order the source decides.
CASCADE = (
    ("iso", f"^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})(?:[Tt ] ?{_CLOCK})?(?: ?{_ZONE}(?:\\[[A-Za-z_/+-]+\\])?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("iso_zone", f"^(\\d{{4}})-(\\d{{1,2}})-(\\d{{1,2}})[Tt ]{_CLOCK} ?\\[{_ZONE}\\]$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("compact", "^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})?(Z|[+-]\\d{2}:?\\d{2})?$", "$1|$2|$3|$4|$5|$6|||$7"),
    ("mail", f"^{_WEEKDAY}(\\d{{1,2}}) {_MONTH} (\\d{{4}})(?:,? {_CLOCK}{_HALF})?(?: {_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_first", f"^{_WEEKDAY}{_MONTH} (\\d{{1,2}})(?:st|nd|rd|th)?,? (\\d{{4}})(?:,? {_CLOCK}{_HALF})?(?: {_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("short_year", f"^(\\d{{1,2}})-{_MONTH}-(\\d{{2}})(?: {_CLOCK}{_HALF})?(?: {_ZONE})?$", "20$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("figures", f"^(\\d{{1,2}})[/.](\\d{{1,2}})[/.](\\d{{4}})(?:,? {_CLOCK}{_HALF})?(?: Uhr)?(?: {_ZONE})?$", "$3|B|A|$4|$5|$6|$7|$8|$9"),
)


def zone_table(sources: DataFrame, source: str, home_zone: str, day_first: str) -> DataFrame:
    """(_source, _home, _day_first, _abbr) by source: the abbreviations of its home zone with their offsets in seconds.

    The abbreviations come from the public time zone database, over the years 1970 to 2037; where one had several offsets, the latest holds.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["_abbr"] = [_abbreviations(z) for z in pdf["_home"]]
            yield pdf

    one = sources.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("_source")).agg(
        F.min(F.when(F.col(home_zone).isin(sorted(zoneinfo.available_timezones())), F.col(home_zone))).alias("_home"), F.max(F.col(day_first)).alias("_day_first")
    )
    return one.mapInPandas(read, "_source string, _home string, _day_first boolean, _abbr map<string,int>")


def _abbreviations(zone: str | None) -> dict[str, int]:
    if not zone:
        return {}
    z, out = zoneinfo.ZoneInfo(zone), {}
    for year in range(1970, 2038):
        for month in (1, 4, 7, 10):
            at = dt.datetime(year, month, 1, tzinfo=z)
            if at.tzname().isalpha():
                out[at.tzname()] = int(at.utcoffset().total_seconds())
    return out


def to_instants(rows: DataFrame, sources: DataFrame, *, row_id: str, text: str, source: str, home_zone: str = "home_zone", day_first: str = "day_first", keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, *keep, format, epoch_us) for each row: the UTC instant in microseconds that its text denotes.

    epoch_us is NULL, with format "none", for NULL, blanks, words and impossible dates; with the format's name where the text has a form
    but no instant (31 June, hour 25; no zone in the text and none known for its source). Parts not written are zero; a date
    alone is the start of that day. Ten, thirteen or sixteen figures are seconds, milliseconds or microseconds since 1970. A local
    time that occurs twice is its first occurrence; one that a clock change skips is moved forward by the length of the gap. A weekday
    in the text isn't checked. Repeated rows are read alike; columns not in keep are ignored; several rows of one source: the smallest zone.
    """
    t = rows.select(F.col(row_id).alias("_id"), F.regexp_replace(F.trim(F.col(text)), "[\\s\\u00a0]+", " ").alias("_x"), F.col(source).alias("_source"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    t = t.join(zone_table(sources, source, home_zone, day_first), "_source", "left")
    is_epoch = F.col("_x").rlike("^\\d{10}(\\d{3}(\\d{3})?)?$")
    parts = F.when(is_epoch, F.concat(F.lit("epoch|"), "_x"))
    for name, pattern, order in CASCADE:
        hit, order = F.col("_x").rlike(pattern), f"{name}|{order}"
        if "|A|" in order:
            day, month = order.replace("|A|", "|$1|").replace("|B|", "|$2|"), order.replace("|A|", "|$2|").replace("|B|", "|$1|")
            parts = parts.when(hit & F.coalesce(F.col("_day_first"), F.lit(True)), F.regexp_replace("_x", pattern, day))
            parts = parts.when(hit, F.regexp_replace("_x", pattern, month))
        else:
            parts = parts.when(hit, F.regexp_replace("_x", pattern, order))
    r = _let(F.split(parts.otherwise("none"), "\\|", -1), _read)
    kept = [f"_k{i}" for i in range(len(keep))]
    t = t.select("_id", *kept, r.alias("_r"))
    return t.select(F.col("_id").alias(row_id), *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("_r.format").alias("format"), F.col("_r.us").alias("epoch_us"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once; being a lambda, it also keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _read(c: Column) -> Column:
    """The instant of a list of parts (format, year, month, day, hour, minute, second, fraction, half, zone), read strictly."""
    part = lambda i: F.get(c, F.lit(i))
    number = lambda x: F.when(x == "", F.lit(0)).otherwise(x.try_cast("int"))
    below_60 = lambda x: F.when(number(x) < 60, number(x))
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    month = F.coalesce(part(2).try_cast("int"), F.try_element_at(names, F.lower(F.substring(part(2), 1, 3))))
    half, hour = F.lower(part(8)), number(part(4))
    hour = F.when(half == "", F.when(hour < 24, hour)).when(
        hour.between(1, 12), hour % 12 + F.when(half == "p", F.lit(12)).otherwise(F.lit(0))
    )
    digits = part(1).try_cast("long")
    epoch = digits * F.when(F.length(part(1)) == 10, F.lit(1_000_000)).when(F.length(part(1)) == 13, F.lit(1000)).otherwise(F.lit(1))
    local = F.try_make_timestamp_ntz(part(1).try_cast("int"), month, part(3).try_cast("int"), hour, below_60(part(5)), below_60(part(6)))
    fraction = F.coalesce(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("long"), F.lit(0))
    denoted = _let(F.struct(local.alias("local"), part(9).alias("zone")), _place)
    return F.struct(part(0).alias("format"), F.when(part(0) == "epoch", epoch).when(part(0) != "none", denoted + fraction).alias("us"))


def _place(x: Column) -> Column:
    """Microseconds since 1970 UTC of a local time: by its offset or abbreviation, else by its named or home zone."""
    local, zone = x["local"], x["zone"]
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, -2, 2).try_cast("int")
    offset_s = (
        F.when(zone.isin("Z", "UTC", "GMT", "UT"), F.lit(0))
        .when(zone.rlike("^[+-]\\d{2}:?\\d{2}$"), F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes) * 60)
        .when(zone != "", F.try_element_at(F.col("_abbr"), zone))
    )
    named = F.when(zone == "", F.col("_home")).when(zone.isin(sorted(zoneinfo.available_timezones())), zone)
    by_zone = _let(F.convert_timezone(named, F.lit("UTC"), local), _ntz_micros)
    return F.coalesce(_ntz_micros(local) - offset_s.cast("long") * 1_000_000, by_zone)


def _ntz_micros(at: Column) -> Column:
    return F.unix_date(at.cast("date")).cast("long") * DAY_US + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("long") * 1_000_000
