"""Secret scan through a trigram inverted index (operator 9), DataFrame functions only.

Method: from each rule's regular expression a Boolean query over trigrams is derived
(an OR of ANDs; a document without them cannot match).  An inverted index of the
trigrams that the rules ask for is built once and written to the shared folder; postings
are intersected per clause; only candidates are verified with the expression.  A rule
without mandatory trigrams is verified on every document.

Spans are ``[start, end)`` in code points, leftmost and non-overlapping for each rule.
Matches whose checked group is too short are dropped after matching, so they still use up
their text.

Defined results: NULL is the empty text and has no spans; NULL ids share one posting
(a superset, verified row by row); repeated rows are scanned one by one; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from re import _constants as sre  # names of the parsed operations
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitrapanel.session import materialize


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length is checked
    least: int = 1  # code points it must have


_WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

# The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # Maximal runs, so asking for the length in the expression drops the same matches.
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", f"{either_case('bearer')}\\x20+[A-Za-z0-9._~+/=-]{{16,}}"),
)
RULES = (*BASE, *MORE)

MOST_ALTERNATIVES = 64  # beyond it a part of an expression counts as unknown
GAP = None


def _alternatives(parsed) -> list[tuple]:
    """Every way to read ``parsed`` as characters and gaps; lower case, a superset of the language."""
    ways: list[tuple] = [()]
    for op, arg in parsed:
        if op is sre.LITERAL:
            own = [(chr(arg).lower(),)]
        elif op is sre.IN:
            signs: set[str] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    signs.add(chr(value).lower())
                else:
                    signs = None
                    break
            own = [(c,) for c in sorted(signs)] if signs and len(signs) <= 6 else [(GAP,)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            own = [(GAP,)]
            if (low, high) == (0, 1):
                own = [(), *_alternatives(inner)]
            elif low:
                first = _alternatives(inner)
                own = [w * low for w in first] if low == high and len(first) == 1 else [(*w, GAP) for w in first]
        elif op is sre.SUBPATTERN:
            own = _alternatives(arg[-1])
        elif op is sre.BRANCH:
            own = [w for branch in arg[1] for w in _alternatives(branch)]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            own = [()]
        else:
            own = [(GAP,)]
        ways = [a + b for a in ways for b in own] if len(ways) * len(own) <= MOST_ALTERNATIVES else [w + (GAP,) for w in ways]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams of which at least one is whole in every match; None if there are none."""
    clauses = set()
    for way in _alternatives(parser.parse(pattern)):
        runs = "".join("\0" if c is GAP else c for c in way).split("\0")
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings ``gram, doc_id`` of the wanted trigrams, written to the shared folder."""
    folded = docs.select("doc_id", F.lower("text").alias("text"))
    found = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("text"), g))
    return materialize(folded.select("doc_id", F.explode(found).alias("gram")), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, rule_bits``: rules of which a clause is whole in the document."""
    rows = []
    for i, rule in enumerate(rules):
        for j, clause in enumerate(trigram_query(rule.pattern) or []):
            rows += [(1 << i, j, (1 << len(clause)) - 1, 1 << k, gram) for k, gram in enumerate(sorted(clause))]
    wanted = postings.sparkSession.createDataFrame(rows, "rule long, clause int, whole long, bit long, gram string")
    # One row for each trigram of the rules: it grows with the rules only.
    met = postings.join(F.broadcast(wanted), "gram")
    whole = met.groupBy("doc_id", "rule", "clause", "whole").agg(F.bit_or("bit").alias("have")).where("have = whole")
    return whole.groupBy("doc_id").agg(F.bit_or("rule").alias("rule_bits"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of one rule's matches, from the lengths between and of them."""
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), match.alias("hit"), checked.alias("own"))
    span = "struct<start:bigint,kind:int,end:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["gap"])
        end = at + F.length(F.coalesce(x["hit"], F.lit("")))
        one = F.array(F.struct(at.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        good = F.length(F.coalesce(x["own"], F.lit(""))) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    # Without a match there is one gap and nothing to add up.
    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(F.array().cast(f"array<{span}>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secret_spans``: (start, kind as index into ``rules``, end), sorted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for clause in q for g in clause})
    # Rows meet their candidates by a hash of the id, or of the text where the id is NULL, so rows
    # without an id are spread.  Two rows of one hash share their candidates, which only costs time.
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col)))
    plain = docs.select(key.alias("doc_id"), text.alias("text"))
    found = candidates(build_index(plain, grams), rules).select(F.col("doc_id").alias("_found_id"), F.col("rule_bits").alias("_found"))
    rows = docs.join(found, key == F.col("_found_id"), "left")
    bits = F.coalesce(F.col("_found"), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    parts = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        own = _spans(text, rule, i)
        parts.append(own if query is None else F.when(bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0, own).otherwise(empty))
    return rows.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop("_found_id", "_found")


def kind_name(index: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.element_at(F.array(*[F.lit(r.kind) for r in rules]), index + 1)


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    one = lambda s: F.concat_ws(":", kind_name(s["kind"], rules), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``text`` with every span replaced by ``[kind]``; of overlapping spans the first names the whole."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), kind_name(s["kind"], rules), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, mark).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, rest))
