"""Quality rules as a bitmask ledger (operator 3), DataFrame functions only.

Method: every rule is evaluated once for each document; the ledger keeps the
measurements and one bit for each rule that failed.  A policy is a named, versioned set
of rules: applying it is one AND with its mask, and ablations (what each rule removes
alone, what would be kept without it) are sums over the few distinct bit patterns.

Defined results: NULL or blank text has no words and fails ``few_words``; texts are
measured whole; repeated rows are judged one by one; an empty table gives an empty
ledger; other columns are carried along unless ``keep`` says otherwise.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What parts words, and what counts as a symbol.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_SIGNS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3  # words of a window in which repetition is counted

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


class Rule(NamedTuple):
    name: str
    failed: Column  # over the measures; never NULL


def rules() -> list[Rule]:
    """All rules in bit order; a rule keeps its place for ever, new ones go to the end."""
    words, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return [
        Rule("few_words", words < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * words),
        Rule("symbols", 100 * symbols > 5 * chars),
        Rule("short_words", 10 * chars < 20 * words),
        Rule("long_words", chars > 20 * words),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    ]


BASE = ("few_words", "repeated_windows")


class Policy(NamedTuple):
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in rules()]
        return sum(1 << names.index(n) for n in self.rules)


POLICIES = {
    ("base", 1): Policy("base", 1, BASE),
    ("prose", 1): Policy("prose", 1, (*BASE, "symbols", "short_words", "long_words", "repeated_lines")),
}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures.  Everything is counted inside the row; nothing is shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, BLANKS, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANK_SIGNS, "")) > 0)
    out = docs.withColumns(
        {
            "_words": words,
            "_lines": lines,
            "word_chars": F.length(F.translate(text, BLANK_SIGNS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    # One hash for each window, with its place; equal windows are neighbours after sorting.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")),
    )
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(F.size("_words") >= WINDOW, F.sort_array(windows)),
        }
    )
    again = F.filter(
        F.col("_windows"),
        lambda x, i: F.coalesce(x["h"] == F.get("_windows", i + 1)["h"], F.lit(False))
        | ((i > 0) & F.coalesce(x["h"] == F.get("_windows", i - 1)["h"], F.lit(False))),
    )
    out = out.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["at"])))
    # A repeated window covers its words up to the next repeated window.
    covered = F.transform(
        F.col("_again"), lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_again", i + 1) - at, F.lit(WINDOW)))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_words", "_lines", "_windows", "_again")


def ledger(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns, measures and ``rule_bits``: bit *i* is set where rule *i* failed."""
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(kept)], F.col(text_col).alias("_text"))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.failed, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    names = [F.col(f"k_{i}").alias(c) for i, c in enumerate(kept) if c not in MEASURES and c != "rule_bits"]
    out = measured(source, "_text").withColumn("rule_bits", bits)
    return out.select(*names, *MEASURES, "rule_bits")


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``policy`` and ``kept``; no text is read again."""
    passed = F.col("rule_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0
    return rows.withColumns({"policy": F.lit(f"{policy.name}/{policy.version}"), "kept": passed})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it removes, and kept without it.

    The ledger is counted by bit pattern first (at most two to the number of rules), so
    the rules meet the patterns, never the documents.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = rows.groupBy(F.col("rule_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules()]
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in policy.rules]))
    each = patterns.select("bits", "n", own.alias("r")).select("bits", "n", "r.*")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
