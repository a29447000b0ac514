"""De-duplication and validation of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import exists

IGNORED = ("_scraped_at", "_url", "_depth")


def _leaf(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _leaf(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_leaf(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    return c


def record_key(df: DataFrame, ignore=IGNORED) -> Column:
    """The key of a whole record: its fields by name, white space and case folded, missing ones left out."""
    fields = sorted((f for f in df.schema if f.name not in ignore), key=lambda f: f.name)
    return F.sha1(F.to_json(F.struct(*[_leaf(F.col(f.name), f.dataType).alias(f.name) for f in fields])))


def fields_key(fields) -> Column:
    """The key of some fields; 1 and '1' are the same, null is empty."""
    return F.sha1(F.concat_ws("|", *[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]))


def first_of_each(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def unseen(df: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key no earlier run has."""
    return df.join(seen.select(key), key, "left_anti")


def dedupe_stats(df: DataFrame, key: Column) -> DataFrame:
    total, unique = F.count("*"), F.count_distinct("k")
    rate = F.round((total - unique).cast("double") * 100 / total, 1)
    return df.select(key.alias("k")).agg(total.alias("checked"), unique.alias("unique"), (total - unique).alias("duplicates"), rate.alias("duplicate_rate"))


class Bloom:
    """A Bloom filter of fixed size, built by one aggregation of set bits. No false negatives."""

    def __init__(self, capacity: int, p: float = 0.01):
        import math

        self.m = max(1024, math.ceil(-capacity * math.log(p) / math.log(2) ** 2))
        self.k = max(1, round(self.m / capacity * math.log(2)))

    def bits(self, c: Column) -> list[Column]:
        a, b = F.xxhash64(c, F.lit(1)), F.xxhash64(c, F.lit(2)).bitwiseOR(F.lit(1))
        return [F.pmod(a + i * (b % F.lit(1 << 40)), F.lit(self.m)) for i in range(self.k)]

    def build(self, df: DataFrame, c: str) -> DataFrame:
        """One row (bits): the filter, m / 8 bytes, whatever the number of keys."""
        part = 1 << 15  # bits of a bitmap_construct_agg
        set_ = df.select(F.explode(F.array(*self.bits(F.col(c)))).alias("bit")).distinct()
        maps = set_.groupBy(F.floor(F.col("bit") / part).alias("id")).agg(F.bitmap_construct_agg(F.col("bit") % part).alias("map"))
        every = df.sparkSession.range(-(-self.m // part)).join(maps, "id", "left").select("id", F.coalesce(F.hex("map"), F.lit("00" * (part // 8))).alias("map"))
        return every.agg(F.array_sort(F.collect_list(F.struct("id", "map"))).alias("maps")).select(F.unhex(F.array_join(F.transform("maps", lambda x: x["map"]), "")).alias("bits"))

    def maybe(self, df: DataFrame, c: str, bloom: DataFrame) -> DataFrame:
        """Rows that may be in the filter; the rest certainly aren't. A projection: no row is shuffled."""
        bits = bloom.scalar()
        on = [F.conv(F.hex(F.substring(bits, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (p % 8).cast("int"))) != 0 for p in self.bits(F.col(c))]
        return df.where(reduce(lambda x, y: x & y, on))


def validation_stats(validated: DataFrame) -> DataFrame:
    """One row: checked, valid, invalid, quarantined, dropped."""
    bad = F.size("_issues") > 0
    of = lambda a: F.count_if(F.col("action") == a)
    return validated.agg(F.count("*").alias("checked"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"), of("quarantine").alias("quarantined"), of("drop").alias("dropped"))


class SeenStore:
    """The keys of earlier runs: a Parquet table that names the version of its keys. Another version is refused."""

    VERSION = 2

    def __init__(self, path: str):
        self.path = path

    def load(self, spark) -> DataFrame:
        """(key); empty if there is no store yet."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], "key string")
        kept = spark.read.parquet(self.path)
        if kept.where(F.col("version") != self.VERSION).limit(1).count():
            raise ValueError(f"{self.path} has keys of another version than {self.VERSION}")
        return kept.select("key")

    def add(self, keys: DataFrame) -> None:
        """Appends the keys that the store hasn't."""
        new = unseen(keys.select("key").distinct(), self.load(keys.sparkSession))
        new.withColumn("version", F.lit(self.VERSION)).write.mode("append").parquet(self.path)


def is_empty(c: Column, kind: T.DataType) -> Column:
    """Null, '' or []: the validator's idea of empty."""
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if isinstance(kind, T.ArrayType) else c.isNull()


_TYPES = {"url": r"^(?i)https?://[^\s/?#]+", "email": r"^[^\s@]+@[^\s@]+\.[^\s@]+$"}
_KINDS = {"string": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}


def _type_ok(c: Column, kind: T.DataType, name: str) -> Column:
    if name in _TYPES:
        return c.cast("string").rlike(_TYPES[name])
    if name == "date":
        return c.try_cast("timestamp").isNotNull()
    if name == "any":
        return F.lit(True)
    if name == "integer" and isinstance(kind, T.DoubleType):
        return c == F.floor(c)
    return F.lit(isinstance(kind, _KINDS[name]))


def issues(df: DataFrame, schema: dict, strict: bool = False, min_filled: int = 0) -> Column:
    """array<struct<field, rule, message>> of a record. A rule is a type name or a dict of rules."""
    found = []

    def add(bad: Column, field: str, rule: str, message: str):
        found.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), F.lit(message).alias("message"))))

    kinds = {f.name: f.dataType for f in df.schema}
    for field, rule in schema.items():
        rule = {"type": rule} if isinstance(rule, str) else rule
        if field not in kinds:
            if rule.get("required"):
                add(F.lit(True), field, "required", "is missing")
            continue
        c, kind = F.col(field), kinds[field]
        empty = is_empty(c, kind)
        if rule.get("required"):
            add(empty, field, "required", "is missing")
        ok = ~empty
        if "type" in rule:
            typed = F.coalesce(_type_ok(c, kind, rule["type"]), F.lit(False))
            add(ok & ~typed, field, "type", f"is not a {rule['type']}")
            ok = ok & typed
        number, text, array = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
        size = F.length(c) if text else F.size(c) if array else None
        checks = [("min", number, lambda v: c < v), ("max", number, lambda v: c > v), ("minLength", size is not None, lambda v: size < v), ("maxLength", size is not None, lambda v: size > v)]
        checks += [("pattern", True, lambda v: ~c.cast("string").rlike(v)), ("enum", True, lambda v: ~c.isin(v)), ("custom", True, lambda v: ~v(c))]
        for name, applies, bad in checks:
            if name in rule and applies:
                add(ok & bad(rule[name]), field, name, f"fails {name}" + (f" {rule[name]}" if name != "custom" else ""))
    if strict:
        for name in kinds:
            if name not in schema and not name.startswith("_"):
                add(~is_empty(F.col(name), kinds[name]), name, "strict", "is not expected")
    if min_filled:
        filled = reduce(lambda a, b: a + b, [(~is_empty(F.col(n), k)).cast("int") for n, k in kinds.items() if not n.startswith("_")])
        add(filled < min_filled, "*", "minFilledFields", f"has fewer than {min_filled} fields")
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<field:string,rule:string,message:string>>")


def validate(df: DataFrame, schema: dict, on_invalid: str = "quarantine", strict: bool = False, min_filled: int = 0) -> DataFrame:
    """df with _issues and action: keep, drop or quarantine. `error` raises in the job; `warn` keeps."""
    df = df.withColumn("_issues", issues(df, schema, strict, min_filled))
    bad = {"quarantine": F.lit("quarantine"), "drop": F.lit("drop"), "keep": F.lit("keep"), "warn": F.lit("keep"), "error": F.raise_error(F.to_json("_issues")).cast("string")}[on_invalid]
    return df.withColumn("action", F.when(F.size("_issues") > 0, bad).otherwise("keep"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with _issues)."""
    return validated.where("action = 'keep'").drop("_issues", "action"), validated.where("action = 'quarantine'").drop("action")
