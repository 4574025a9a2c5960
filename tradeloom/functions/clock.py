"""Text of many habits to one UTC instant.

An ordered cascade of anchored patterns rewrites a text to its fields; the first pattern that fits decides, so the
meaning of a text never depends on a later pattern. Fields are checked strictly (no roll-over of the 30th of February).
The zone comes from the text, else from the feed. A local time that a zone shows twice or never follows the policies
``ambiguous`` and ``nonexistent``.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]{1,9}))?(?: ?([AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r" ?(?:\[?([Zz]|[+-][0-9]{2}(?::?[0-9]{2})?|[A-Z]{2,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)\]?)?"
#: Order matters. Each replacement yields kind|year|month|day|hour|minute|second|fraction|half of day|zone.
CASCADE = [
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})T?([0-9]{2})([0-9]{2})([0-9]{2})(?:[.,]([0-9]{1,9}))?(Z|z|[+-][0-9]{2}:?[0-9]{2})?$", "c|$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^([0-9]{9,19})(?:\.([0-9]{1,9}))?$", "n|$1||||||$2||"),
    (rf"^([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})[T ]{_TIME}{_ZONE}$", "c|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^([0-9]{{1,2}})[./-]([0-9]{{1,2}})[./-]([0-9]{{4}})[T ]{_TIME}{_ZONE}$", "o|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Z][a-z]{{2}}, ?)?([0-9]{{1,2}})[ -]([A-Z][a-z]{{2}})[ -]([0-9]{{4}}) {_TIME}{_ZONE}$", "m|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
]
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: Bare counts are taken in the unit that puts them into these years (end exclusive).
COUNT_YEARS = (2021, 2027)
_DAY = 86_400_000_000


def _us(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000


def zone_names() -> list[str]:
    """Names of the IANA zones that a text may carry."""
    return sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/")))


def abbreviations(zones: DataFrame, years: tuple[int, int] = (2015, 2030)) -> dict[tuple[str, str], int]:
    """Offset in seconds by (tz_name, abbreviation). An abbreviation with two meanings in one zone is left out.
    zones: column tz_name; there are about 600 IANA zones, which bounds what is read to the driver."""
    out: dict[tuple[str, str], int] = {}
    for (name,) in zones.select("tz_name").where("tz_name is not null").distinct().collect():
        try:
            z = ZoneInfo(name)
        except (KeyError, ValueError, OSError):
            continue
        seen: dict[str, set[int]] = {}
        t = datetime(years[0], 1, 1, tzinfo=timezone.utc)
        while t.year < years[1]:
            x = t.astimezone(z)
            seen.setdefault(x.tzname(), set()).add(int(x.utcoffset().total_seconds()))
            t += timedelta(days=7)
        out |= {(name, a): o.pop() for a, o in sorted(seen.items()) if len(o) == 1 and a.isalpha()}
    return out


def _bound(df: DataFrame, **cols: Column) -> DataFrame:
    """df with further columns worked out once. A generator keeps the optimizer from copying their expressions into
    every later use (a filter on the last of them would otherwise hold all of them many times over)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _int(parts: Column, i: int) -> Column:
    return F.expr("null") if parts is None else F.when(parts[i] == "", None).otherwise(parts[i]).try_cast("long")


def local_to_utc(local_us: Column, zone: Column, ambiguous: str = "reject", nonexistent: str = "reject") -> Column:
    """Microseconds UTC of a clock reading in a zone.

    The offsets a day before and after the reading are the only ones it can have (one transition in two days); an
    instant counts if it reads back as the same clock time. Policies: ambiguous in reject, earlier, later;
    nonexistent in reject, shift (moved on by the gap).
    """
    read = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))
    before = local_us - (read(local_us - F.lit(_DAY)) - (local_us - F.lit(_DAY)))
    after = local_us - (read(local_us + F.lit(_DAY)) - (local_us + F.lit(_DAY)))
    s = F.struct(before.alias("a"), after.alias("b"))
    # the struct is made in a lambda so that each instant is worked out once
    def pick(x: Column) -> Column:
        a, b = x["a"], x["b"]
        ok_a, ok_b = read(a) == local_us, read(b) == local_us
        both = {"reject": F.lit(None).cast("long"), "earlier": F.least(a, b), "later": F.greatest(a, b)}[ambiguous]
        none = {"reject": F.lit(None).cast("long"), "shift": a}[nonexistent]
        return F.when(a == b, F.when(ok_a, a)).when(ok_a & ok_b, both).when(ok_a, a).when(ok_b, b).otherwise(none)

    return F.transform(F.array(s), pick)[0]


def normalise_timestamps(
    df: DataFrame, zones: DataFrame, text: str = "trade_timestamp", feed: str = "feed", out: str = "utc_us", ambiguous: str = "reject", nonexistent: str = "reject", count_years: tuple[int, int] = COUNT_YEARS
) -> DataFrame:
    """df with column ``out``: microseconds since 1970 UTC where ``text`` denotes exactly one instant, else null.

    zones has one row per feed: feed, tz_name, date_order (YMD, DMY, MDY); for several rows of a feed the result keeps
    one row per row of df by taking the least (tz_name, date_order). Null, empty and very long texts, unknown feeds
    and unknown zones give null (a text with its own zone needs no feed unless its date is numeric). Further columns
    of df are kept; columns of zones are not added. Digits beyond the microsecond are dropped. Bare counts are taken in the
    unit that puts them into ``count_years`` (end exclusive).
    """
    z = zones.groupBy(F.col("feed").alias("__feed")).agg(F.min(F.struct("tz_name", "date_order")).alias("__z"))
    z = z.select("__feed", F.col("__z.tz_name").alias("__tz"), F.col("__z.date_order").alias("__order"))
    t = F.col("__t")
    fields = F.lit(None).cast("string")
    for pattern, to in reversed(CASCADE):
        fields = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, to)).otherwise(fields)
    x = df.withColumn("__t", F.col(text)).join(z, F.col(feed) == F.col("__feed"), "left")
    x = _bound(x, __f=F.split(fields, r"\|")).drop("__feed", "__t")
    f = F.col("__f")
    kind, frac = f[0], F.col("__f")[7]
    dmy = F.col("__order")
    month_name = F.coalesce(*[F.when(f[2] == m, F.lit(i + 1).cast("long")) for i, m in enumerate(_MONTHS)])
    month = F.when(kind == "c", _int(f, 2)).when(kind == "m", month_name).when(dmy == "DMY", _int(f, 3)).when(dmy == "MDY", _int(f, 2))
    day = F.when(kind.isin("c", "m"), _int(f, 3)).when(dmy == "DMY", _int(f, 2)).when(dmy == "MDY", _int(f, 3))
    half = F.upper(f[8])
    hour = F.when(half == "", _int(f, 4)).when(_int(f, 4).between(1, 12), _int(f, 4) % 12 + F.when(half == "PM", 12).otherwise(0))
    us = F.substring(F.rpad(frac, 6, "0"), 1, 6).try_cast("long")
    x = _bound(x, __kind=kind, __y=_int(f, 1), __mo=month, __d=day, __h=hour, __mi=_int(f, 5), __s=_int(f, 6), __us=us, __zone=f[9]).drop("__f")
    y, mo, d, h, mi, s = (F.col(c) for c in ("__y", "__mo", "__d", "__h", "__mi", "__s"))
    ok = y.between(1, 9999) & mo.between(1, 12) & (d >= 1) & h.between(0, 23) & mi.between(0, 59) & s.between(0, 59)
    first = F.make_date(F.when(ok, y).cast("int"), F.when(ok, mo).cast("int"), F.lit(1))
    days = F.when(d <= F.dayofmonth(F.last_day(first)), F.unix_date(first) + d - 1)
    local = (days * 86400 + h * 3600 + mi * 60 + s) * F.lit(1_000_000) + F.col("__us")
    # a table of a few rows per zone name, of which about 600 exist
    known = df.sparkSession.createDataFrame([(tz, ab, o) for (tz, ab), o in abbreviations(zones).items()], "__ntz string, __nab string, __abbr long")
    x = x.join(F.broadcast(known), (F.col("__tz") == F.col("__ntz")) & (F.col("__zone") == F.col("__nab")), "left").drop("__ntz", "__nab")
    abbr = F.when(F.col("__zone").rlike("^[A-Z]{2,5}$"), F.col("__abbr"))
    own = F.when(F.col("__zone") == "", F.col("__tz")).when(F.col("__zone").contains("/"), F.col("__zone"))
    x = _bound(x, __local=local, __abbr_s=abbr, __in=F.when(own.isin([*zone_names(), "UTC", "GMT"]), own))
    zone, local = F.col("__zone"), F.col("__local")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    oh, om = F.substring(digits, 1, 2).try_cast("long"), F.coalesce(F.substring(digits, 3, 2).try_cast("long"), F.lit(0))
    offset = F.when((oh <= 18) & (om <= 59), F.when(zone.startswith("-"), -1).otherwise(1) * (oh * 3600 + om * 60))
    count = F.lit(None).cast("long")
    lo, hi = (_us(n) for n in count_years)
    for unit, div in ((1_000_000, 1), (1000, 1), (1, 1), (1, 1000)):
        # the fraction belongs to the unit; what is finer than a microsecond is dropped
        whole = F.expr(f"__y div {div}") if div > 1 else y
        digits6 = {1_000_000: F.col("__us"), 1000: F.expr("__us div 1000"), 1: F.lit(0)}[unit]
        count = F.coalesce(count, F.when(whole.between(lo // unit, (hi - 1) // unit), whole * unit + digits6))
    utc = (
        F.when(F.col("__kind") == "n", count)
        .when(zone.isin("Z", "z", "UTC", "GMT") & F.col("__abbr_s").isNull(), local)
        .when(zone.rlike("^[+-]"), local - offset * F.lit(1_000_000))
        .when(F.col("__abbr_s").isNotNull(), local - F.col("__abbr_s") * F.lit(1_000_000))
        .otherwise(local_to_utc(local, F.col("__in"), ambiguous, nonexistent))
    )
    keep = [c for c in df.columns if c != out]
    return _bound(x.drop(*[out] if out in df.columns else []), **{out: utc}).select(*keep, out)
