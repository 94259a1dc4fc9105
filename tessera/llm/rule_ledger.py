"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one long whose bit ``i`` is set where rule ``i`` fails. A policy is a
version with the set of rules that it enforces, i.e. a mask; applying another
policy, or asking what one rule alone removes, is bitwise work on the ledger
and never reads a text again.

Everything is DataFrame functions; a text is only ever handled inside its own
row, so there is no shuffle and no limit on its length.

Edge cases: a null text has no words, so it fails ``few_words``; ids may be
null or repeated (rows are independent); an empty table gives an empty ledger.
Other columns pass through. The names of the measurements, ``failed_bits``,
``policy`` and ``kept`` are the operator's own: an input column of such a name
is replaced. Names that start with ``_ledger_`` are used in between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: The bit of a rule is its place in this list; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: str
    enforced: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(name) for name in self.enforced)


#: Policies by version. The last one is in force.
POLICIES = (
    Policy("2024-base", BASE),
    Policy("2024-strict", tuple(r.name for r in RULES)),
)


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows that occur at least twice, from (hash, place) pairs in hash order."""
    pairs = hashes

    def marked(x: Column, j: Column) -> Column:
        same_before = F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False))
        same_after = F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False))
        return F.when(same_before | same_after, F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>"))

    return F.size(F.array_distinct(F.flatten(F.transform(pairs, marked))))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements; each looks at the whole text once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumns(
        {
            "_ledger_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_ledger_lines": lines,
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
            "n_capitals": (F.length(bare) - F.length(F.translate(bare, CAPITALS, ""))).cast("long"),
        }
    )
    windows = F.transform(
        F.slice(F.col("_ledger_words"), 1, F.greatest(F.size("_ledger_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col("_ledger_words"), i + 1), F.get(F.col("_ledger_words"), i + 2)),
    )
    out = out.withColumns(
        {
            "n_words": F.size("_ledger_words").cast("long"),
            "n_lines": F.size("_ledger_lines").cast("long"),
            "n_dup_lines": (F.size("_ledger_lines") - F.size(F.array_distinct("_ledger_lines"))).cast("long"),
            "_ledger_windows": windows,
        }
    )
    # Most texts repeat no window; only those that do are sorted.
    repeats = F.size(F.array_distinct("_ledger_windows")) < F.size("_ledger_windows")
    pairs = F.when(repeats, F.sort_array(F.transform("_ledger_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_ledger_pairs", pairs)
    covered = F.when(F.col("_ledger_pairs").isNull(), F.lit(0)).otherwise(_covered(F.col("_ledger_pairs")))
    return out.withColumn("n_repeat_words", covered.cast("long")).drop("_ledger_words", "_ledger_lines", "_ledger_windows", "_ledger_pairs")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits``, one row per document, without the text: what is stored, and what policies read.

    Every rule is evaluated here, once; a policy, a base or an ablation is a mask
    over the bits. Repeated windows are told by 64-bit hashes of their three
    words; within a text of a million words two unequal ones have equal hashes
    with a chance of 3e-8.
    """
    bits = F.lit(0).cast("long")
    for place, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << place)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed_bits", bits).drop("text")


def apply_policy(book: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``kept`` under one policy: no enforced rule failed."""
    mask = F.lit(policy.mask(rules)).cast("long")
    return book.withColumns({"policy": F.lit(policy.version), "kept": F.col("failed_bits").bitwiseAND(mask) == 0})


def ablation(book: DataFrame, policy: Policy = POLICIES[-1], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per enforced rule: how many documents fail it, and how many only it removes.

    One aggregation over the ledger; each rule is a bitwise count.
    """
    mask, names = policy.mask(rules), [r.name for r in rules]
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    aggs = []
    for name in policy.enforced:
        bit = F.lit(1 << names.index(name)).cast("long")
        aggs += [
            F.count_if(failed.bitwiseAND(bit) != 0).alias(f"{name}|failed"),
            F.count_if(failed == bit).alias(f"{name}|only"),
        ]
    one = book.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}|failed`").alias("failed"), F.col(f"`{n}|only`").alias("removed_by_it_alone")) for n in policy.enforced])
    return one.select(F.inline(rows)).withColumn("policy", F.lit(policy.version))
