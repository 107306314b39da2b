"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query is derived: sets of trigrams, one of which any match must contain in full (over
lower-cased text). The index holds postings for the trigrams that the rules ask for, in blocks of documents; the queries
are answered block by block by intersecting and uniting postings, and only the candidates are verified by the regex
itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

BLOCK = 8192  # documents whose postings are intersected together


@dataclass(frozen=True)
class Rule:
    """kind, regex (in the syntax that Java and Python share), and the least length of one of its groups."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base kinds, in the order of the report.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # AKIA[A-Z0-9]+ of 20 characters or more: the same matches
    Rule("hex", r"[0-9a-f]{24,}"),  # [0-9a-f]+ of 24 characters or more: the same matches
)
# Further kinds, of public token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+"),
)

_MOST = 64  # strings that an exact set may have before it is given up

Clauses = frozenset[frozenset[str]]  # OR of ANDs of trigrams; empty: no demand
NO_DEMAND: Clauses = frozenset()


def _absorbed(clauses: set[frozenset[str]]) -> Clauses:
    return NO_DEMAND if frozenset() in clauses else frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> Clauses:
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _and(a: Clauses, b: Clauses) -> Clauses:
    if not a or not b:
        return a or b
    return _absorbed({x | y for x in a for y in b})


def _sequence(items) -> tuple[set[str] | None, Clauses]:
    """The exact strings of a sequence if they are few, and what any match of it demands."""
    exact, demand, whole = {""}, NO_DEMAND, True
    for item in items:
        strings, more = _node(*item)
        if strings is not None and len(exact) * len(strings) <= _MOST:
            exact = {a + b for a in exact for b in strings}
        else:
            demand = _and(_and(demand, _of_strings(exact)), more if strings is None else _of_strings(strings))
            exact, whole = {""}, False
    demand = _and(demand, _of_strings(exact))
    return (exact if whole else None), demand


def _node(kind, value) -> tuple[set[str] | None, Clauses]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, NO_DEMAND
    if kind is op.IN:
        found: set[str] = set()
        for what, x in value:
            if what is op.LITERAL:
                found.add(chr(x).lower())
            elif what is op.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, NO_DEMAND
        return (found if len(found) <= 8 else None), NO_DEMAND
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(x is not None for x, _ in parts):
            return set().union(*(x for x, _ in parts)), NO_DEMAND
        every = [d if x is None else _of_strings(x) for x, d in parts]
        return None, NO_DEMAND if NO_DEMAND in every else _absorbed(set().union(*every))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, what = value
        strings, demand = _sequence(what)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, NO_DEMAND
        if low == high and strings is not None and len(strings) ** low <= _MOST:
            return _sequence(list(what) * low)
        return None, (demand if strings is None else _of_strings(strings)) if low else NO_DEMAND
    return None, NO_DEMAND


def trigram_query(regex: str) -> list[list[str]]:
    """Sets of lower-case trigrams; a text that matches contains all of one of them. Empty: any text may match."""
    _, demand = _sequence(parser.parse(regex))
    return sorted(sorted(c) for c in demand)


def spans_of(text: Column, number: int, rule: Rule) -> Column:
    """(start, number, stop) of the rule's leftmost, non-overlapping matches whose group is long enough; code points.

    What lies between the matches is the text split by the same regex, so that lengths add up to places.
    """
    found, between = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    group = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    lengths = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("n"), F.transform(group, F.length).alias("least"))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,stop:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["n"]).alias("stop"))
        spans = F.when(x["least"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + F.coalesce(x["n"], F.lit(0))).alias("at"), spans.alias("spans"))

    spans = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.regex), spans).otherwise(none)


def any_trigram(trigrams: list[str]) -> str:
    """A regex that matches, of no width, before each of these trigrams and has it as group 1.

    The three classes leave most places at little cost, before the alternatives are tried.
    """

    def one_of(chars) -> str:
        return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars))) + "]"

    ends: dict[str, dict[str, str]] = {}
    for a, b, c in trigrams:
        after = ends.setdefault(a, {})
        after[b] = after.get(b, "") + c
    tree = "|".join(one_of(a) + "(?:" + "|".join(one_of(b) + one_of(c) for b, c in after.items()) + ")" for a, after in ends.items())
    return f"(?={''.join(map(one_of, zip(*trigrams, strict=True)))})(?=({tree}))"


def build_index(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """Postings from (key, text): block, trigram (its number), keys. A key is a 64-bit hash of doc_id and text; equal rows share postings."""
    present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_trigram(trigrams)), F.lit(1)))
    number = F.create_map(*(F.lit(x) for pair in enumerate(trigrams) for x in reversed(pair)))
    rows = docs.select("key", F.explode(present).alias("found")).select("key", F.element_at(number, F.col("found")).alias("trigram"))
    return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: list[tuple[int, list[list[int]]]]) -> DataFrame:
    """(key, mask): bit n of the mask says that rule n must verify the documents of this key."""
    by_trigram = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    none = F.expr("CAST(array() AS array<bigint>)")

    def answer(query: list[list[int]]) -> Column:
        every = none
        for clause in query:
            both = F.coalesce(F.element_at("postings", F.lit(clause[0])), none)
            for t in clause[1:]:
                both = F.array_intersect(both, F.coalesce(F.element_at("postings", F.lit(t)), none))
            every = F.array_union(every, both)
        return every

    def marked(n: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1 << n).alias("bit")))

    found = F.concat(*(marked(n, answer(q)) for n, q in queries))
    return by_trigram.select(F.explode(found).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("mask"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Every row of docs as `row`, and its spans: (start, kind: the rule's place in rules, stop), by start, then kind.

    Null and empty texts have no spans; repeated rows and equal or null doc_ids are verified row by row (the index may
    only add candidates); other columns are kept inside `row`.
    """
    queries = {n: trigram_query(r.regex) for n, r in enumerate(rules)}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    number = {t: i for i, t in enumerate(trigrams)}
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("key"), text_or_empty().alias("text"))
    blocks = max(1, -(-docs.count() // BLOCK))
    index = staged(build_index(keyed.select("key", "text"), trigrams, blocks), "trigram-index")
    asked = candidates(index, [(n, [[number[t] for t in c] for c in q]) for n, q in queries.items() if q])
    joined = keyed.join(asked.withColumnRenamed("key", "asked_key"), F.col("key") == F.col("asked_key"), "left")
    mask = F.coalesce("mask", F.lit(0))
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,stop:int>>)")
    spans = [F.when(mask.bitwiseAND(1 << n) != 0, spans_of(F.col("text"), n, r)).otherwise(none) if queries[n] else spans_of(F.col("text"), n, r) for n, r in enumerate(rules)]
    return joined.select("row", F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each run of overlapping or touching spans replaced by mark; spans are in order of start."""

    def step(acc: Column, s: Column) -> Column:
        ahead = F.when(s["start"] > acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        first = F.when(acc["at"] == 0, F.lit(mark)).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.coalesce(ahead, first)).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
