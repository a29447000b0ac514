"""Dates in text: an ordered list of shapes, each a native expression. Days that don't exist roll over into the next month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.transforms import REGISTRY, col, text, transform, trim

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 7 * 86_400_000, "month": 30 * 86_400_000, "year": 365 * 86_400_000}


_NAMES = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
#: Each shape is rewritten to its parts behind a tag, none of which another shape matches.
_SHAPES = [
    (r"^(\d{10})$", "\x01s|$1"),
    (r"^(\d{13})$", "\x01ms|$1"),
    (r"^(?:in\s+)?(\d+)\s*(second|minute|hour|day|week|month|year)s?(\s+ago)?$", "\x01rel|$1|$2|$3"),
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[t ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(z|[+-]\d{2}:?\d{2})?)?$", "\x01iso|$1|$2|$3|$4|$5|$6|$7"),
    (rf"(?s)^(?:[a-z]+,\s*)?{_NAMES}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}).*$", "\x01day|$3|$1|$2"),
    (rf"(?s)^(?:[a-z]+,\s*)?(\d{{1,2}})\s+{_NAMES},?\s+(\d{{4}}).*$", "\x01day|$3|$2|$1"),
    (r"^(\d{1,4})[./-](\d{1,2})[./-](\d{2,4})$", "\x01num|$1|$2|$3"),
]


def _day(y: Column, m: Column, d: Column) -> Column:
    """A day in epoch ms; month 1 to 12, any day number."""
    date = F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)
    return F.unix_millis(date.cast("timestamp"))


def parse_date_ms(x, now: str = "2024-01-01T00:00:00Z", day_first: bool = False) -> Column:
    """Epoch milliseconds of the date in a text, or null. `now` is a literal of the run, so a run can be repeated."""
    v = F.lower(trim(text(x)))
    for pattern, parts in _SHAPES:
        v = F.regexp_replace(v, pattern, parts)
    now_ms = F.unix_millis(F.lit(now).cast("timestamp"))
    today = F.floor(now_ms / 86_400_000) * 86_400_000

    def of(p: Column) -> Column:
        tag, at = p[0], lambda i: F.get(p, F.lit(i))
        i = lambda k: at(k).try_cast("int")
        unit = F.element_at(F.create_map(*[F.lit(u) for pair in UNIT_MS.items() for u in pair]), at(2)).cast("long")
        sign = F.when(at(3) != "", -1).otherwise(1)
        zone = at(7)
        shift = F.when(zone.isin("", "z"), 0).otherwise(
            (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        )
        part = lambda k: F.coalesce(i(k), F.lit(0))
        iso = _day(i(1), i(2), i(3)) + (part(4) * 3600 + part(5) * 60 + part(6)).cast("long") * 1000 - shift.cast("long") * 60_000
        month = F.array_position(F.array(*map(F.lit, MONTHS)), at(2)).cast("int")
        a, b, c = i(1), i(2), i(3)
        year = F.when(c < 100, F.when(c > 50, c + 1900).otherwise(c + 2000)).otherwise(c)
        day_is_first = (a > 12) | ((b <= 12) & F.lit(day_first))
        return (
            F.when(tag == "\x01s", at(1).try_cast("long") * 1000)
            .when(tag == "\x01ms", at(1).try_cast("long"))
            .when(tag == "\x01rel", now_ms + sign * i(1).cast("long") * unit)
            .when(tag == "\x01iso", iso)
            .when(tag == "\x01day", _day(a, month, c))
            .when(tag == "\x01num", F.when(a > 31, _day(a, b, c)).when(day_is_first, _day(year, b, a)).otherwise(_day(year, a, b)))
            .when(tag == "now", now_ms)
            .when(tag == "today", today)
            .when(tag == "yesterday", today - 86_400_000)
            .when(tag == "tomorrow", today + 86_400_000)
            .cast("long")
        )

    # the parts are split once and named, or every branch would split them again
    return F.transform(F.array(F.split(v, r"\|")), of)[0]


def format_ms(ms: Column, output: str = "iso") -> Column:
    ts = F.timestamp_millis(ms)
    if output == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if output == "timestamp":
        return ms
    if output == "date":
        return ts
    if output == "object":
        return F.when(ms.isNotNull(), F.struct(format_ms(ms).alias("iso"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"), ms.alias("timestamp")))
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@transform("date")
def date(x, output="iso", now="2024-01-01T00:00:00Z"):
    return format_ms(parse_date_ms(col(x), now), output)


REGISTRY["dateOnly"] = lambda x, **k: date(x, "day", **k)
REGISTRY["timestamp"] = lambda x, **k: date(x, "timestamp", **k)
REGISTRY["dateEU"] = lambda x, output="iso": format_ms(parse_date_ms(col(x), day_first=True), output)
