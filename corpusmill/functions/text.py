"""Column functions over text: normal forms, line rules, number and key extraction, anchor matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The end of a header, line breaks, and the headings that begin a tail.
HEADER_END = "\n---\n\n"
#: What str.splitlines splits at.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Boilerplate phrases, line beginnings, and the words that make a "this article" line noise.
BOILERPLATE = ("retrieved from", "all rights reserved", "downloaded from", "creative commons", "this page was last edited")
LINK_STARTS = ("doi:", "arxiv:", "issn", "isbn", "http://", "https://", "www.")
ARTICLE_WORDS = ("issue", "help improve", "verif", "additional citations", "sources")
PAGE_NUMBER = r"(?i)\s*(page\s+)?\d+(\s+of\s+\d+)?\s*$"
TAIL_HEADING = r"(?i)^(references?|bibliography|external links|further reading|see also|notes|citations?|sources|acknowledge?ments?|works cited)\s*:?\s*$"
# Words that say nothing about what a question asks for.
STOP_WORDS = (
    "what whats which where when whos whose how does did and the for its with from are there has have much many about you your using use "
    "into over why check would should this that these those give get pull grab show tell list name walk through between value values "
    "data file files sensor building room number what's me run loop each per all any both not but his her their"
).split()
# What a path ends in, and the prompt around a slice and its question.
PATH_ENDINGS = (".txt", ".ttl", ".csv", ".md", ".pdf", ".png")

PROMPT_HEAD = "Use only the building's data below to answer.\n\n--- BUILDING DATA ---\n"
PROMPT_TAIL = "\n--- END BUILDING DATA ---\n\nQuestion: "


def any_of(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# White space, Unicode's and the four separators of ASCII.
WHITE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim() knows the space alone)."""
    return F.btrim(c, F.lit(WHITE))


def split_lines(c: Column) -> Column:
    """Lines without their ends; a last break begins no line, and an empty text has none."""
    return bound(F.split(c, LINE_BREAKS, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x))


def after_header(c: Column) -> Column:
    at = F.instr(c, HEADER_END)
    return F.when(at > 0, F.substring(c, at + len(HEADER_END), F.length(c))).otherwise(c)


def dehyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"-\n(?=[a-z])", "")


def without_page_number(c: Column) -> Column:
    """A stripped line's form in which running headers and footers repeat; only a line that ends in a digit has a number to lose."""
    return F.when(F.substring(c, -1, 1).between("0", "9"), strip(F.regexp_replace(c, PAGE_NUMBER, ""))).otherwise(c)


def letters(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{L}++", ""))


def noise_rule(s: Column) -> Column:
    """The number of the first rule that calls a stripped line noise, or 0: 1 page number, 2 roman numeral, 3 link, 4 reference entry, 5 boilerplate, 6 article note, 7 too few letters."""

    def first(low: Column) -> Column:
        return (
            F.when((F.length(s) <= 4) & s.rlike(r"^\d{1,4}\z"), 1)
            .when((F.length(low) <= 7) & low.rlike(r"^[ivxlcdm]{1,7}\z"), 2)
            .when(any_of(low.startswith(p) for p in LINK_STARTS), 3)
            .when((s.startswith("[") | s.startswith("(")) & s.rlike(r"^\[\d+\]|^\(\d+\)\s"), 4)
            .when(any_of(low.contains(p) for p in BOILERPLATE), 5)
            .when(low.startswith("this article") & any_of(low.contains(w) for w in ARTICLE_WORDS), 6)
            .when((F.length(s) >= 8) & (letters(s) / F.length(s) < 0.5), 7)
            .otherwise(0)
        )

    return bound(F.lower(s), first)


def is_tail_heading(s: Column) -> Column:
    return s.rlike(TAIL_HEADING)


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def plain_norm(s: Column) -> Column:
    """Lower case, with one space for each run of other than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def anchor_norm(s: Column) -> Column:
    """Lower case, underscores as spaces, and one space for each run of what is not a-z, 0-9 or one of ./:-"""
    # The two letters beyond ASCII that have an ASCII lower case go first; what is then kept is ASCII, of which lower() is
    # much faster. A space between two kept characters stays as it is, so that most words cost no replacement.
    ascii_able = F.replace(F.replace(s, F.lit("\u212a"), F.lit("k")), F.lit("\u0130"), F.lit("i "))
    return F.trim(F.lower(F.regexp_replace(ascii_able, r"[^A-Za-z0-9./:\- ][^A-Za-z0-9./:\-]*+| [^A-Za-z0-9./:\-]++", " ")))


def last_part(s: Column, mark: str) -> Column:
    """After the last mark, or all of it."""
    return F.substring_index(s, mark, -1)


def local_name(uri: Column) -> Column:
    return last_part(last_part(uri, "#"), "/")


def anchor_in(anchor: Column, text: Column, normal: Column | None = None) -> Column:
    """Whether a text states an anchor: a bare number as a number of its own, a path also by its base name, anything else by its normal form or by its first and all but one of its words.

    normal is the text's normal form, where many anchors share it.
    """
    if normal is None:
        return bound(anchor_norm(text), lambda nt: anchor_in(anchor, text, nt))
    return bound(strip(anchor), lambda a: bound(anchor_norm(a), lambda na: _stated(a, na, text, normal)))


def _stated(a: Column, na: Column, text: Column, nt: Column) -> Column:
    number = F.rlike(text, F.concat(F.lit(r"(?<![\d.])"), F.replace(a, F.lit("."), F.lit("\\.")), F.lit(r"(?![\d.])")))
    base = anchor_norm(last_part(a, "/"))

    def most_of(words: Column) -> Column:
        found = F.size(F.filter(words, lambda w: F.contains(nt, w)))
        return (F.size(words) >= 2) & F.contains(nt, F.coalesce(F.get(words, F.lit(0)), F.lit("\0"))) & (found >= F.greatest(F.lit(2), F.size(words) - 1))

    by_words = bound(F.filter(F.split(na, " "), lambda w: F.length(w) >= 2), most_of)
    is_path = a.contains("/") | any_of(a.endswith(e) for e in PATH_ENDINGS)
    return (
        F.when(na == "", False)
        .when(a.rlike(r"^-?\d+(\.\d+)?\z"), number)
        .when(is_path, F.contains(nt, na) | ((F.length(base) >= 4) & F.contains(nt, base)))
        .otherwise(F.contains(nt, na) | by_words)
    )


def anchors_in(anchors: Column, text: Column) -> Column:
    """The anchors that a text states; its normal form is computed once for them all."""
    return bound(anchor_norm(text), lambda nt: F.filter(anchors, lambda a: anchor_in(a, text, nt)))


def last_match(s: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.lit(-1))


def final_number(s: Column) -> Column:
    """The last number (after the last #### if there is one), without commas and final full stops; null without one."""
    return F.rtrim(F.replace(last_match(last_part(s, "####"), r"(?U)-?\d[\d,]*\.?\d*"), F.lit(",")), F.lit("."))


def question_keys(q: Column, ignored: Column | None = None) -> Column:
    """Quoted phrases and identifiers of a question, lower case, of 3 characters or more; repeated ones stay."""
    quoted = F.regexp_extract_all(q, F.lit("\"([^\"]+)\"|'([^']+)'"), F.lit(0))
    phrases = F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    names = F.filter(F.regexp_extract_all(q, F.lit(r"[A-Za-z_][A-Za-z0-9_:\-]{2,}"), F.lit(0)), lambda x: x.rlike("[0-9_:]"))
    keys = F.transform(F.filter(F.concat(phrases, names), lambda k: F.length(k) >= 3), F.lower)
    return keys if ignored is None else F.filter(keys, lambda k: ~F.array_contains(ignored, k))


def question_words(q: Column, ignored: Column | None = None) -> Column:
    """Distinct words of four letters a-z or more that aren't stop words."""
    words = F.array_except(F.regexp_extract_all(F.lower(q), F.lit("[a-z]{4,}"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))
    return words if ignored is None else F.array_except(words, ignored)


def json_object_text(s: Column) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit(""))


def grounded_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_TAIL), question)


def messages(**roles: Column) -> Column:
    """Chat messages in the order of the arguments."""
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in roles.items()))


def choices_prompt(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(". "), c))
    return F.concat(question, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\nAnswer:"))


def lower_is_better(metric: Column) -> Column:
    return metric.rlike("(?i)ppl|perplex|loss")
