"""Cleaning of a document corpus: header, hyphens, tail, repeated lines, noise lines, thin documents.

All of it concerns one row alone, so that nothing is shuffled or joined: null and repeated ids, and rows that are equal in
every column, are rows like others. Null and empty texts have no lines and an empty body. Work is n log n in a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Where a tail may begin, what makes a line repeated, and what a document must have.
TAIL_SHARE = 0.55
MIN_REPEAT_CHARS = 15
MIN_REPEATS = 4
MIN_DOC_CHARS = 1500


def body_lines(text: Column) -> Column:
    """The stripped lines of the header-free, de-hyphenated text."""
    return F.transform(T.split_lines(T.dehyphenated(T.after_header(F.coalesce(text, F.lit(""))))), T.strip)


def before_tail(lines: Column) -> Column:
    """Without everything from the first reference heading in the back part."""

    def cut(x: Column) -> Column:
        # Only short lines can be headings: the regex reads no others.
        heads = F.transform(x, lambda s, i: F.when((i > TAIL_SHARE * F.size(x)) & T.is_tail_heading(s), i))
        return F.slice(x, F.lit(1), F.coalesce(F.array_min(heads), F.size(x)))

    return T.bound(lines, cut)


def _by_form(lines: Column) -> Column:
    """(form, i, line) in order of the form: the line without a page number."""
    return F.array_sort(F.transform(lines, lambda s, i: F.struct(T.without_page_number(s).alias("form"), i.alias("i"), s.alias("line"))))


def _runs(sorted_lines: Column, j: Column) -> Column:
    """Whether the form at j stands MIN_REPEATS times in a row or more, and is long enough."""
    form = F.get(sorted_lines, j)["form"]
    near = [F.get(sorted_lines, j + (a - MIN_REPEATS + 1))["form"] == F.get(sorted_lines, j + a)["form"] for a in range(MIN_REPEATS)]
    own = [n & (F.get(sorted_lines, j + a)["form"] == form) for a, n in enumerate(near)]
    return (F.length(form) >= MIN_REPEAT_CHARS) & T.any_of(F.coalesce(x, F.lit(False)) for x in own)


def repeated_forms(lines: Column) -> Column:
    """(form, repeats) of running headers and footers."""

    def counted(x: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda j: ((j == 0) | (F.get(x, j)["form"] != F.coalesce(F.get(x, j - 1)["form"], F.lit("")))) & _runs(x, j))
        return F.transform(begins, lambda j: F.struct(F.get(x, j)["form"].alias("form"), F.size(F.filter(x, lambda y: y["form"] == F.get(x, j)["form"])).cast("long").alias("repeats")))

    none = F.expr("CAST(array() AS array<struct<form:string,repeats:bigint>>)")
    return F.when(F.size(lines) > 0, T.bound(_by_form(lines), counted)).otherwise(none)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, repeats) of each row's running headers and footers."""
    return docs.select(id_col, F.inline(repeated_forms(before_tail(body_lines(F.col(text_col))))))


def kept_lines(lines: Column) -> Column:
    """Without running headers and footers and without noise; blank lines stay."""

    def alive(x: Column) -> Column:
        marked = F.transform(x, lambda y, j: F.struct(y["i"].alias("i"), y["line"].alias("line"), (~_runs(x, j) | (y["line"] == "")).alias("kept")))
        return F.filter(marked, lambda y: y["kept"] & ((y["line"] == "") | (T.noise_rule(y["line"]) == 0)))

    return F.transform(F.array_sort(T.bound(_by_form(lines), alive)), lambda y: y["line"])


def clean_body(text: Column) -> Column:
    """What is left of a text, with at most one blank line between two others."""
    lines = kept_lines(before_tail(body_lines(text)))
    return T.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, body) and the kept columns of each row."""
    return docs.select(id_col, clean_body(F.col(text_col)).alias("body"), *(F.col(f"`{c}`") for c in keep))


def thin_report(bodies: DataFrame, least: int = MIN_DOC_CHARS) -> DataFrame:
    """Adds chars and thin."""
    return bodies.withColumn("chars", F.length("body").cast("long")).withColumn("thin", F.col("chars") < least)
