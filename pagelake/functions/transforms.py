"""The scalar transforms of a recipe, as functions from Column to Column.

Strings follow the reference's language: white space is Unicode white space, a null that a string transform meets counts
as the empty string, rounding is half up, sorting is by string. Only Unicode normal forms and numeric character
references need Python; they are Arrow UDFs of their own, so the rest of a chain stays native.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x{FEFF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
REGISTRY: dict[str, Callable] = {}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x) -> Column:
    """A value as text: null is empty."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def transform(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def register_transform(name: str, column_fn: Callable | None = None, pandas_fn: Callable | None = None, returns: str = "string") -> None:
    """A user's transform: a function of Columns, or a function of a pandas Series that becomes an Arrow UDF."""
    if column_fn is None:
        udf = F.pandas_udf(pandas_fn, returns)
        column_fn = lambda x, *a: udf(col(x))
    REGISTRY[name] = column_fn


def list_transforms() -> list[str]:
    return sorted(REGISTRY)


def parse_spec(spec) -> tuple[str, list]:
    """"name", "name:arg", [name, a, b] or {name: [...]} or {name, args}."""
    if isinstance(spec, str):
        name, sep, arg = spec.partition(":")
        return name, [arg] if sep else []
    if isinstance(spec, (list, tuple)):
        return spec[0], list(spec[1:])
    if "name" in spec:
        args = spec.get("args", [])
    else:
        (name, args), = spec.items()
        spec = {"name": name}
    return spec["name"], list(args) if isinstance(args, (list, tuple)) else [args]


#: transforms that take an array as a whole; the others map over its elements
WHOLE = {"join", "first", "last", "nth", "unique", "compact", "sort", "count", "slice", "extractAll", "default", "nullIfEmpty", "json", "toString"}


def _each(f, args):
    return lambda v: f(v, *args)


def apply_transforms(x, specs, array: bool = False) -> Column:
    """A chain, left to right; over the elements of an array where the transform isn't one of arrays."""
    c = col(x)
    for spec in specs if isinstance(specs, (list, tuple)) else [specs]:
        if callable(spec):
            c = spec(c)
            continue
        name, args = parse_spec(spec)
        if name not in REGISTRY:
            raise ValueError(f'unknown transform "{name}"')
        f = REGISTRY[name]
        if array and name not in WHOLE:
            c = F.transform(c, _each(f, args))
        else:
            c = f(c, *args)
            array = (array and name in {"unique", "compact", "sort", "slice"}) or name in {"split", "extractAll"}
    return c


def java_replacement(s: str) -> str:
    """$& and $1 of a replacement, in Java's form."""
    return s.replace("\\", "\\\\").replace("$&", "$0")


trim = transform("trim")(lambda x: F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", ""))


@transform("collapse")
def collapse(x):
    return F.trim(F.regexp_replace(text(x), f"{SPACE}+", " "))


REGISTRY["normalizeSpace"] = collapse


@transform("squeeze")
def squeeze(x):
    return trim(F.regexp_replace(F.regexp_replace(text(x), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


lower = transform("lower")(lambda x: F.lower(text(x)))
upper = transform("upper")(lambda x: F.upper(text(x)))
#: Letters whose capital form is several letters, and the capital that is a single one (themselves where there is none)
_SEVERAL = [c for c in map(chr, [*range(0xDF, 0x590), *range(0x1E96, 0x2000), *range(0xFB00, 0xFB18)]) if len(c.upper()) > 1]
_SINGLE = {c: c.title() if len(c.title()) == 1 else "ẞ" if c == "ß" else c for c in _SEVERAL}


@transform("capitalize")
def capitalize(x, single: bool = False):
    """The first letter as a capital. ß and the like become several letters as in the reference (SS); one if `single` (ẞ)."""
    head = F.substr(text(x), F.lit(1), F.lit(1))
    up = F.upper(head)
    if single:
        up = F.when(F.length(up) > 1, F.translate(head, "".join(_SINGLE), "".join(_SINGLE.values()))).otherwise(up)
    return F.concat(up, F.substr(text(x), F.lit(2)))



@F.pandas_udf(StringType())
def _title(s: pd.Series) -> pd.Series:
    return s.map(lambda v: re.sub(r"(?a:\w)\S*", lambda m: m[0][:1].upper() + m[0][1:].lower(), v or ""))


title = transform("title")(lambda x: _title(text(x)))

ENTITIES = dict(x.split("=") for x in "quot=\" apos=' lt=< gt=> nbsp=\xa0 copy=© reg=® trade=™ hellip=… mdash=— ndash=– laquo=« raquo=» lsquo=‘ rsquo=’ ldquo=“ rdquo=” bull=• middot=· times=× divide=÷ euro=€ pound=£ yen=¥ cent=¢ deg=° sect=§".split(" "))
ENTITIES = {k: v or "\xa0" for k, v in ENTITIES.items()} | {"amp": "&"}
_REF = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#(\d+)|([a-zA-Z]+));")


def decode_text(v: str | None) -> str:
    def one(m):
        if m[3]:
            return ENTITIES.get(m[3].lower(), m[0])
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]

    return _REF.sub(one, v or "")


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(decode_text)


decode_entities = transform("decodeEntities")(lambda x: _decode(text(x)))


@transform("stripTags")
def strip_tags(x):
    c = F.regexp_replace(text(x), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|li|tr|h[1-6])\s*>", "\n")
    return trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t]+", " "))


clean = transform("clean")(lambda x: collapse(decode_entities(strip_tags(x))))
strip_nonprintable = transform("stripNonPrintable")(lambda x: F.regexp_replace(text(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", ""))
strip_emoji = transform("stripEmoji")(lambda x: trim(F.regexp_replace(F.regexp_replace(text(x), r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F1E6}-\x{1F1FF}]", ""), r"\s{2,}", " ")))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)


normalize_unicode = transform("normalizeUnicode")(lambda x: _nfkc(text(x)))


@transform("slug")
def slug(x, ascii_only: bool = False):
    """ascii_only skips the normal form, for text that is known to have no marks."""
    c = text(x) if ascii_only else _unmarked(text(x))
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Each step reads its input once, so the expression stays small however it is nested. A semicolon marks a decimal sign.
_SEPARATORS = [
    # dots alone, several or before three digits: they part thousands
    (r"(?<=^[^,]{0,200})(?:\.(?=[^,.]*\.[^,]*$)|(?<=\.[^,]{0,200})\.(?=[^,]*$)|(?<=^\d{1,3})\.(?=\d{3}$))", ""),
    # a dot after the last comma is the decimal sign
    (r",(?=(?:.*,)?[^,]*\.[^,]*$)", ""),
    # otherwise, where there are dots, the first comma is
    (r"^(?=.*\.)([^,]*),", "$1;"),
    (r"\.(?=.*;)|(?<=;.{0,200})\.", ""),
    # commas alone: several or one before three digits part thousands, or else the first is the decimal sign
    (r"(?<!;.{0,200})(?!.*;)(?:(?<=^\d{1,3}),(?=\d{3}$)|,(?=.*,[^,]{3}$)|(?<=,.{0,200}),(?=[^,]{3}$))", ""),
    (r"^([^,.;]*),", "$1."),
]


@transform("number")
def number(x):
    """The number that a text shows, whatever its separators; null if none."""
    raw = F.translate(F.trim(text(x)), "−‒–—   ", "----")
    v = F.translate(F.regexp_substr(raw, F.lit(r"-?\d[\d., ']*\d|\d")), " '", "")
    for pattern, to in _SEPARATORS:
        v = F.regexp_replace(v, pattern, to)
    size = F.abs(F.regexp_substr(F.translate(v, ";", "."), F.lit(r"^-?(\d+\.?\d*|\.\d+)")).try_cast("double"))
    return size * F.when(raw.rlike(r"^\s*[-(]|-\s*$|^\D*-\d[\d., ']*\d"), -1.0).otherwise(1.0) + 0.0


REGISTRY["float"] = REGISTRY["currency"] = number


@transform("int")
def integer(x):
    return number(x).try_cast("long")  # towards zero


@transform("round")
def round_half_up(x, digits=0):
    p = F.lit(10.0 ** int(digits))
    return F.floor(number(x) * p + 0.5).cast("double") / p


CODES = sorted("AUD BRL CAD CHF CNY CZK DKK EUR GBP HKD HUF INR JPY KRW MXN NOK NZD PLN RUB SEK SGD THB TRY UAH USD ZAR ILS".split())
SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₽", "RUB"), ("₩", "KRW"), ("₺", "TRY"), ("₴", "UAH"), ("₪", "ILS"), ("zł", "PLN"), ("Kč", "CZK"), ("฿", "THB")]


@transform("currencyCode")
def currency_code(x):
    code = F.regexp_substr(text(x), F.lit(r"\b[A-Z]{3}\b"))
    by_symbol = F.lit(None).cast("string")
    for s, c in reversed(SYMBOLS):
        by_symbol = F.when(F.contains(text(x), F.lit(s)), F.lit(c)).otherwise(by_symbol)
    return F.when(code.isin(CODES), code).otherwise(by_symbol)


@transform("price")
def price(x):
    n = number(x)
    return F.when(n.isNotNull(), F.struct(n.alias("amount"), currency_code(x).alias("currency"), trim(text(x)).alias("raw")))


percent = transform("percent")(lambda x: number(x) / 100)


@transform("test")
def test_pattern(x, pattern="", flags="i"):
    return F.rlike(col(x), F.lit(f"(?{flags})" * bool(flags) + pattern))


@transform("boolean")
def boolean(x):
    v = F.lower(trim(text(x)))
    yes, no = ["true", "yes", "y", "1", "on", "available", "in stock"], ["false", "no", "n", "0", "off", "unavailable", "out of stock"]
    return F.when(v.isin(yes), True).when(v.isin(no), False)


replace = transform("replace")(lambda x, p, r="": F.regexp_replace(text(x), p, java_replacement(r)))
remove = transform("remove")(lambda x, p: F.regexp_replace(text(x), p, ""))


@transform("extract")
def extract(x, pattern, group=0):
    return F.when(F.rlike(text(x), F.lit(pattern)), F.regexp_extract(text(x), pattern, int(group)))


@transform("extractAll")
def extract_all(x, pattern):
    group = 1 if re.compile(pattern).groups else 0
    return F.regexp_extract_all(text(x), F.lit(pattern), group)


@transform("split")
def split(x, sep=","):
    return F.filter(F.transform(F.split(text(x), re.escape(sep)), trim), lambda v: v != "")


join = transform("join")(lambda a, sep=", ": F.array_join(F.filter(col(a), lambda v: v.isNotNull() & (v != "")), sep))
prefix = transform("prefix")(lambda x, p: F.concat(F.lit(p), text(x)))
suffix = transform("suffix")(lambda x, s: F.concat(text(x), F.lit(s)))


@transform("truncate")
def truncate(x, n=200, ell="…"):
    n = int(n)
    return F.when(F.length(text(x)) <= n, text(x)).otherwise(F.concat(F.regexp_replace(F.substr(text(x), F.lit(1), F.lit(n)), r"\s+$", ""), F.lit(ell)))


@transform("padStart")
def pad_start(x, n=2, pad="0"):
    return F.when(F.length(text(x)) >= int(n), text(x)).otherwise(F.lpad(text(x), int(n), pad))


email = transform("email")(lambda x: F.regexp_substr(text(x), F.lit(r"[\w.+-]+@[\w-]+\.[\w.-]+")))


@transform("phone")
def phone(x):
    v = F.regexp_replace(text(x), "[^0-9+]", "")
    return F.when(F.length(v) >= 7, v)


digits = transform("digits")(lambda x: F.nullif(F.regexp_replace(text(x), "[^0-9]", ""), F.lit("")))
url_path = transform("urlPath")(lambda x: F.when(F.try_parse_url(col(x), F.lit("HOST")).isNotNull(), F.coalesce(F.nullif(F.try_parse_url(col(x), F.lit("PATH")), F.lit("")), F.lit("/"))))
domain = transform("domain")(lambda x: F.lower(F.try_parse_url(col(x), F.lit("HOST"))))
query_param = transform("queryParam")(lambda x, name: F.try_url_decode(F.try_parse_url(col(x), F.lit("QUERY"), F.lit(name))))

first = transform("first")(lambda a: F.get(col(a), F.lit(0)))
last = transform("last")(lambda a: F.try_element_at(col(a), F.lit(-1)))
nth = transform("nth")(lambda a, i=0: F.get(col(a), F.lit(int(i))))
unique = transform("unique")(lambda a: F.array_distinct(col(a)))
compact = transform("compact")(lambda a: F.filter(col(a), lambda v: v.isNotNull() & (v.cast("string") != "")))
sort = transform("sort")(lambda a: F.array_sort(col(a).cast("array<string>")))
count = transform("count")(lambda a: F.coalesce(F.size(col(a)), F.lit(0)))


@transform("slice")
def slice_(a, start=0, end=None):
    n = F.size(col(a))
    at = lambda v: F.greatest(n + v, F.lit(0)) if v < 0 else F.least(F.lit(v), n)
    s, e = at(int(start)), n if end is None else at(int(end))
    return F.slice(col(a), s + 1, F.greatest(e - s, F.lit(0)))


json = transform("json")(lambda x: F.try_parse_json(col(x)))


def js_num_str(x):
    """A double as the reference's language prints it: no trailing .0."""
    c = col(x)
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


to_string = transform("toString")(lambda x: col(x).cast("string"))
default = transform("default")(lambda x, d=None: F.coalesce(F.nullif(col(x), F.lit("")), F.lit(d)))
null_if_empty = transform("nullIfEmpty")(lambda x: F.nullif(col(x), F.lit("")))
