"""Quality rules as a bitmask ledger: measure each rule once, keep the failure bits, apply policies later.

`ledger` evaluates every rule once and stores the measurements and one bit per failed rule. A `Policy` is a versioned
mask over those bits, so `verdict` and `ablation` never look at a text again. DataFrame functions only.

Null or empty text: no words, every count 0. A document fails `too_few_words` then. Repeated rows stay rows. Null
doc_id: kept as it is. Extra columns: `ledger` reads doc_id and text alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm._common import WS_CHARS, WS_CLASS

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A named rule; its bit is its place in RULES and never changes meaning."""

    name: str
    failed: Column


def rules() -> list[Rule]:
    """Integer arithmetic only, so that every engine gives the same bits."""
    c = F.col
    return [
        Rule("too_few_words", c("n_words") < 50),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("too_many_words", c("n_words") > 1_000_000),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("capitals", 2 * c("n_capitals") > c("word_chars")),
    ]


@dataclass(frozen=True)
class Policy:
    """The rules that reject, by name. A version is never edited; a new one is added."""

    version: str
    names: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = [r.name for r in rules()]
        return sum(1 << known.index(n) for n in self.names)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
V1 = Policy("v1", ("too_few_words", "repeated_windows", "too_many_words", "word_length", "symbols", "duplicate_lines", "capitals"))


def _count(c: Column, chars: str) -> Column:
    """Characters of a regex class. A regex strips runs at once; translate() would look every character up in a map."""
    return (F.length(c) - F.length(F.regexp_replace(c, chars + "+", ""))).cast("long")


def measured(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, the columns to keep and the measurements. Windows of a text are compared by their 64-bit hash within that text only: n windows
    of different words meet with a chance of n * n / 2**65 (a text of 20,000 words: 1e-11)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WS_CLASS + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    df = docs.select("doc_id", *keep, text.alias("text"))
    df = df.select("doc_id", *keep, "text", words.alias("w"), lines.alias("l"))
    n = F.size("w")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    df = df.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), "[A-Z]").alias("n_capitals"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    # only a text that repeats a window pays for the sort; equal hashes are neighbours then
    ordered = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("s", ordered).drop("h")
    again = F.filter(
        F.transform("s", lambda e, j: F.when((F.get("s", j - 1)["h"] == e["h"]) | (F.get("s", j + 1)["h"] == e["h"]), e["i"])),
        lambda i: i.isNotNull(),
    )
    df = df.withColumn("p", F.sort_array(again)).drop("s")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"]
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def ledger(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, the columns to keep, the measurements and failure_bits: bit k is set where rule k fails."""
    df = measured(docs, keep)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules())])
    return df.withColumn("failure_bits", bits)


def verdict(entries: DataFrame, policy: Policy = V1, name: str = "kept") -> DataFrame:
    """A ledger with the verdict of a policy; no text is read."""
    return entries.withColumn(name, F.col("failure_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(entries: DataFrame, policy: Policy = V1) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that would be kept without it.

    The ledger shrinks to one row per distinct mask (2**rules at most) before it meets the rules.
    """
    known = [r.name for r in rules()]
    masks = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << known.index(n)).cast("long").alias("bit")) for n in policy.names])
    rows = masks.select("m", "n", F.explode(bits).alias("r")).select("m", "n", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone")
    )


def quality_rules(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The ledger of `docs` with base_failed and kept."""
    return verdict(verdict(ledger(docs), BASE, "passed"), policy, "kept").withColumn("base_failed", ~F.col("passed")).drop("passed")


def accepted(docs: DataFrame, policy: Policy = V1) -> DataFrame:
    """The rows of `docs` that a policy keeps, with their columns; the rules ride along with the row, nothing is joined."""
    entries = ledger(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), keep=["_row"])
    # a filter that sank through the measurements would hold copies of all of them: the partition's number, which the
    # optimizer may not move, keeps it above
    entries = verdict(entries.select("_row", "failure_bits", F.spark_partition_id().alias("_part")), policy, "_kept")
    return entries.where(F.col("_kept") & (F.col("_part") >= 0)).select("_row.*")
