"""RDF triples from Turtle files (N-Triples included): one Arrow-batched function over whole files.

Covered: prefixes and base in both spellings, `a`, predicate and object lists, literals of all quotings with language or
datatype (dropped), numbers and booleans, comments, labelled and anonymous blank nodes, and collections. A file that
doesn't parse gives no triples but a row in `bad_files`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\s]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.\-]*[\w\-])|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))"""
    r"""|(?P<name>(?:[^\W\d_][\w\-.]*)?:(?:[\w\-:%]|\.(?=[\w\-:%.])|\\.)*|[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


def resolved(base: str, relative: str) -> str:
    """A relative IRI against its base, by the rules for http, whatever the base's scheme."""
    scheme, mark, rest = base.partition(":")
    if not relative:
        return base.partition("#")[0]
    return scheme + urljoin(f"http:{rest}", relative).removeprefix("http") if mark else relative


class Turtle:
    """A reader of one document."""

    def __init__(self, text: str, scope: str = ""):
        self.tokens = [(m.lastgroup, m[0]) for m in self._scan(text)]
        self.at, self.prefixes, self.base, self.scope, self.made = 0, {}, "", scope, 0
        self.found: list[tuple[str, str, str]] = []

    @staticmethod
    def _scan(text: str) -> Iterator[re.Match]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"at {at}: {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _next(self, *wanted: str) -> str:
        kind, word = self._peek()
        if wanted and word not in wanted:
            raise ValueError(f"{word!r} where {wanted} was expected")
        self.at += 1
        return word

    def _new(self) -> str:
        self.made += 1
        return f"_:{self.scope}.{self.made}"

    def read(self) -> list[tuple[str, str, str]]:
        while self._peek()[0] != "end":
            word = self._peek()[1]
            if word.lower() in ("@prefix", "prefix"):
                self.at += 1
                name = self._next()
                self.prefixes[name[:-1]] = self._iri(self._next())
                self._dot(word)
            elif word.lower() in ("@base", "base"):
                self.at += 1
                self.base = self._iri(self._next())
                self._dot(word)
            else:
                anonymous = word == "["
                subject = self._term()
                if not (anonymous and self._peek()[1] == "."):
                    self._predicates(subject)
                self._next(".")
        return self.found

    def _dot(self, word: str) -> None:
        if word[0] == "@":
            self._next(".")

    def _iri(self, word: str) -> str:
        bare = _unescaped(word[1:-1])
        return bare if re.match(r"[A-Za-z][\w+.\-]*:", bare) else resolved(self.base, bare)

    def _predicates(self, subject: str) -> None:
        while self._peek()[1] not in (".", "]"):
            predicate = f"{_RDF}type" if self._peek() == ("name", "a") and self._next() else self._term()
            while True:
                self.found.append((subject, predicate, self._term()))
                if self._peek()[1] != ",":
                    break
                self._next()
            if self._peek()[1] not in (".", "]"):
                self._next(";")
                while self._peek()[1] == ";":
                    self._next()

    def _term(self) -> str:
        kind, word = self._peek()
        self.at += 1
        if kind == "iri":
            return self._iri(word)
        if kind == "blank":
            return f"_:{self.scope}.{word[2:]}"
        if kind == "number" or word in ("true", "false"):
            return word
        if kind == "text":
            n = 3 if word[:3] in ('"""', "'''") else 1
            if self._peek()[0] == "lang":
                self.at += 1
            elif self._peek()[0] == "type":
                self.at += 1
                self._term()
            return _unescaped(word[n:-n])
        if kind == "name" and ":" in word:
            prefix, _, local = word.partition(":")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if word == "[":
            node = self._new()
            self._predicates(node)
            self._next("]")
            return node
        if word == "(":
            items = []
            while self._peek()[1] != ")":
                items.append(self._term())
            self._next()
            rest = f"{_RDF}nil"
            for item in reversed(items):
                node = self._new()
                self.found += [(node, f"{_RDF}first", item), (node, f"{_RDF}rest", rest)]
                rest = node
            return rest
        raise ValueError(f"unexpected {word!r}")


def parsed_files(files: DataFrame) -> DataFrame:
    """From (building, rel_path, content) of Turtle files: (building, rel_path, s, p, o, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for building, path, content in zip(batch["building"], batch["rel_path"], batch["content"], strict=True):
                try:
                    found, error = Turtle(bytes(content).decode("utf-8", "replace"), path).read(), None
                except (ValueError, KeyError, IndexError) as e:
                    found, error = [(None, None, None)], str(e)[:200]
                rows = pd.DataFrame(found, columns=["s", "p", "o"], dtype="object")
                yield rows.assign(building=building, rel_path=path, error=error)[["building", "rel_path", "s", "p", "o", "error"]]

    return files.select("building", "rel_path", "content").mapInPandas(run, "building string, rel_path string, s string, p string, o string, error string")


def triples(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").select("building", "s", "p", "o").distinct()


def bad_files(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("building", "rel_path", "error")
