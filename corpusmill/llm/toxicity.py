"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, link (articles, forms of to be and the like), other,
and the clause's end. Small transducers read them. From right to left, one turns an insult or a threat that only links
part from a target after it into its faced form. From left to right, an insult machine turns one that only links part
from a target before it into its aimed form, a pair machine one that only links part from another insult into its paired
form, a threat machine drops threats that face no target, negation and reported speech weaken a pattern that they reach,
and the last machine gives each form its weight. Those from left to right are composed into one deterministic table; a
clause's weight is the sum along its path. A word that stands in no pattern weighs a small part of itself, so that it
makes no document toxic: it takes a pattern, or such words throughout the text.

What a word weighs is how sure it is: half for the short list of English words, and for words and word beginnings that set
toxic documents apart in a bounded sample of labelled rows (near copies count once), the share of toxic ones among the
documents that have it. A document's score is the logistic of its heaviest clause and of the sum of its clauses, fitted
on the same rows and on made-up rows that have one word in no pattern and are clean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore
from .common import bounded_batches, staged, text_or_empty

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, LINK, END = range(8)
# The words that the grammar knows before it has seen labels.
WORDS = {
    INSULT: "clown disgusting dumb fool garbage idiot idiots imbecile loser losers moron morons pathetic scum stupid trash ugly useless vermin worthless",
    THREAT: "beat burn destroy hang hurt kill murder punch shoot stab strangle",
    TARGET: "you your yours yourself he him his she her they them their people tu vous toi du dich ihr sie usted ustedes",
    NEGATION: "not never no isn't aren't wasn't weren't don't doesn't didn't cannot can't neither nor nicht kein keine nunca jamais pas",
    LINK: "is are am was were be been being a an the all such so really just total complete utter big little that and or est es un une le la les et der die das ein eine bist ist sind seid und eres son una el los las y",
    REPORTED: "said says say wrote writes claimed claims quoted reported told according called alleged dit sagte dijo",
}
_CLAUSE_END = frozenset(".!?;:")
_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*-_#%&/\\«»„“”‘’¿¡"

# Forms of a pattern, and what they weigh of its word's own weight.
PLAIN, AIMED, WEAK, FACED, PAIRED = range(5)
_WEIGHT = {
    INSULT: {PLAIN: 0.3, AIMED: 1.5, WEAK: 0.1, FACED: 1.5, PAIRED: 1.0},
    THREAT: {PLAIN: 0.05, AIMED: 0.05, WEAK: 0.1, FACED: 2.0, PAIRED: 0.05},
}


@dataclass
class Transducer:
    """Deterministic: moves[state][symbol] is (next state, output symbol); state 0 is the start, END returns to it."""

    moves: list[dict]


_ALPHABET = [(s, form) for s in range(8) for form in range(5)]


def _reaching(triggers: set[int], reach: int, changed: dict, passing: set[int] | None = None) -> Transducer:
    """After a trigger and for `reach` symbols, or until one that isn't in `passing`, symbols in `changed` come out changed."""
    moves = []
    for left in range(reach + 1):
        row = {}
        for s in _ALPHABET:
            after = reach if s[0] in triggers else 0 if passing is not None and s[0] not in passing else max(left - 1, 0)
            row[s] = (0, s) if s[0] == END else (after, changed.get(s, s) if left else s)
        moves.append(row)
    return Transducer(moves)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """second reads what first writes; only reachable pairs of states."""
    number, moves, todo = {(0, 0): 0}, [], [(0, 0)]
    while todo:
        a, b = todo.pop(0)
        row = {}
        for s in _ALPHABET:
            a2, middle = first.moves[a][s]
            b2, out = second.moves[b][middle]
            if (a2, b2) not in number:
                number[a2, b2] = len(number)
                todo.append((a2, b2))
            row[s] = (number[a2, b2], out)
        moves.append(row)
    return Transducer(moves)


@dataclass
class Grammar:
    """ahead reads a clause from its end; table then reads from its start what ahead wrote, and writes shares of weights."""

    ahead: Transducer
    table: Transducer


def grammar() -> Grammar:
    near = {LINK, INSULT, NEGATION}
    ahead = _reaching({TARGET}, 3, {(s, PLAIN): (s, FACED) for s in (INSULT, THREAT)}, near | {THREAT})
    insult = _reaching({TARGET}, 5, {(INSULT, f): (INSULT, AIMED) for f in (PLAIN, FACED)}, near)
    pair = _reaching({INSULT}, 3, {(INSULT, PLAIN): (INSULT, PAIRED)}, near)
    # A threat that faces no target is no pattern: there is nothing to weaken, nor to pair.
    threat = Transducer([{s: (0, s if s[0] != THREAT or s[1] == FACED else (OTHER, PLAIN) if s[1] != PLAIN else s) for s in _ALPHABET}])
    weak = {(s, f): (s, WEAK) for s in (INSULT, THREAT) for f in range(5) if (s, f) != (THREAT, PLAIN)}
    weights = Transducer([{(s, f): (0, _WEIGHT[s][f] if s in _WEIGHT else 0.0) for s, f in _ALPHABET}])
    table = compose(insult, pair)
    for machine in (threat, _reaching({NEGATION}, 3, weak), _reaching({REPORTED}, 12, weak), weights):
        table = compose(table, machine)
    return Grammar(ahead, table)


@dataclass
class Model:
    """What scoring needs: weights of words and of word beginnings, and the logistic's coefficients."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    heaviest: float = 4.0
    total: float = 4.0


def _tag(word: str, model: Model, fixed: dict[str, int]) -> tuple[int, float, bool]:
    """Symbol, weight and whether a clause ends after the word."""
    ends = word[-1:] in _CLAUSE_END
    bare = word.strip(_EDGE).lower()
    if bare in model.words:
        return INSULT, model.words[bare], ends
    symbol = fixed.get(bare, OTHER)
    if symbol == OTHER:
        for n in range(min(len(bare), STEM_MAX), STEM_MIN - 1, -1):
            if bare[:n] in model.stems:
                return INSULT, model.stems[bare[:n]], ends
    return symbol, PRIOR if symbol in (INSULT, THREAT) else 0.0, ends


PRIOR = 0.5  # of the fixed words, before labels say more
STEM_MIN, STEM_MAX = 3, 8
_BATCH = 2 << 20
_FIXED = {w: s for s, ws in WORDS.items() for w in ws.split()}


def clause_weights(texts: pa.Array, model: Model, patterns: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its heaviest clause, the sum of its clauses, and the clauses that weigh anything."""
    heaviest, total, matched = (np.zeros(len(texts)) for _ in range(3))
    for lo, hi in textcore._spans(textcore.flat(texts)[1], _BATCH):
        w = textcore.words(texts.slice(lo, hi - lo))
        if not len(w.start):
            continue
        _, first, which = np.unique(textcore.word_hashes(w), return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        tags = [_tag(raw[a:b].decode(), model, _FIXED) for a, b in zip(w.start[first].tolist(), w.stop[first].tolist(), strict=True)]
        symbol = np.array([t[0] for t in tags], np.int8)[which]
        hit = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hit):
            continue
        ends = np.array([t[2] for t in tags])[which]
        # A line break ends a clause too.
        gap = np.append(0, np.cumsum(w.data == 10))
        ends[:-1] |= gap[w.start[1:]] > gap[w.stop[:-1]]
        weight = np.array([t[1] for t in tags])[which]
        # Only clauses with an insult or a threat weigh anything: these run through the table.
        last = np.flatnonzero(ends)
        owner = np.searchsorted(w.doc_at, hit, "right") - 1
        begin = np.maximum(np.append(-1, last)[np.searchsorted(last, hit)] + 1, w.doc_at[owner])
        place = np.searchsorted(last, hit)
        stop = np.minimum(np.append(last, len(symbol) - 1)[place] + 1, w.doc_at[owner + 1])
        for a, b, doc in sorted(set(zip(begin.tolist(), stop.tolist(), owner.tolist(), strict=True))):
            state, marked = 0, []
            for s in symbol[a:b][::-1].tolist():
                state, out = patterns.ahead.moves[state][s, PLAIN]
                marked.append(out)
            state, value = 0, 0.0
            for s, own in zip(reversed(marked), weight[a:b].tolist(), strict=True):
                state, share = patterns.table.moves[state][s]
                value += own * share
            heaviest[lo + doc] = max(heaviest[lo + doc], value)
            total[lo + doc] += value
            matched[lo + doc] += 1
    return heaviest, total, matched


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _features(text: str) -> set[str]:
    found = set()
    for word in {w.strip(_EDGE).lower() for w in text.split()}:
        if word:
            found.add(f"={word}")
            found.update(word[:n] for n in range(STEM_MIN, min(len(word), STEM_MAX) + 1))
    return found


def _near_key(texts: pa.Array) -> np.ndarray:
    """The least hash of a text's runs of three words: near copies mostly share it, others don't."""
    w = textcore.words(texts)
    h = textcore.word_hashes(w)
    runs = textcore.window_hashes(h, 3)
    out = np.zeros(len(texts), np.uint64)
    for i, (a, b) in enumerate(zip(w.doc_at[:-1], w.doc_at[1:], strict=True)):
        part = runs[a : b - 2] if b - a >= 3 else h[a:b]
        out[i] = part.min() if len(part) else 0
    return out.view(np.int64)


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in textcore._spans(textcore.flat(batch["text"])[1], _BATCH):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part["text"], part["toxic"], pa.array(_near_key(part["text"]))], ["text", "toxic", "near"])


def _counting(wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found = _features(text.as_py())
                count.update(found if wanted is None else found & wanted)
                if len(count) > 2_000_000:
                    yield _counts(count)
                    count = Counter()
        yield _counts(count)

    return run


def _counts(count: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["feature", "n"])


def _gain(pos: int, neg: int, base: float) -> float:
    """Twice the log likelihood ratio of the feature's share of toxic documents against `base`."""
    n, share = pos + neg, pos / (pos + neg)
    if share <= base:
        return 0.0
    return 2 * (pos * math.log(share / base) + (neg * math.log((1 - share) / (1 - base)) if neg else 0.0))


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, least_gain: float, precision: float) -> Model:
    """Lexicon from document counts: all features of clear gain and precision in what taken ones don't match already."""
    base = n_pos / (n_pos + n_neg)
    ranked = sorted(((_gain(p, neg.get(f, 0), base), len(f), f) for f, p in pos.items()), reverse=True)
    model = Model(words={w: PRIOR for w in WORDS[INSULT].split()})
    covered: dict[str, tuple[int, int]] = {}  # of each word beginning: what taken features that begin with it have counted
    for gain, _, f in ranked:
        if gain < least_gain:
            break
        bare = f.removeprefix("=")
        starts = [bare[:n] for n in range(STEM_MIN, min(len(bare), STEM_MAX) + 1)]
        if any(t in model.stems for t in starts):
            continue
        # Longer ones and exact words are looked up first, so that a beginning stands for the rest alone.
        p, q = (max(0, n - c) for n, c in zip((pos[f], neg.get(f, 0)), (0, 0) if f.startswith("=") else covered.get(f, (0, 0)), strict=True))
        if not p or p < precision * (p + q) or _gain(p, q, base) < least_gain:
            continue
        for t in starts:
            covered[t] = tuple(a + b for a, b in zip(covered.get(t, (0, 0)), (p, q), strict=True))
        weight = (p + 0.5) / (p + q + 1)
        (model.words if f.startswith("=") else model.stems)[bare] = weight
    return model


_RIDGE = 0.01


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's steps, with a little ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + _RIDGE * np.eye(len(b)), x.T @ (y - p) - _RIDGE * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def features_of(heaviest: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(heaviest)), np.minimum(heaviest, 3), np.log1p(total)], 1)


def _measuring(model: Model, keep: list[str]):
    names = [*keep, "heaviest_clause", "clause_sum", "n_clauses", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = grammar()
        beta = np.array([model.bias, model.heaviest, model.total])
        for batch in batches:
            heaviest, total, matched = clause_weights(batch["text"], model, patterns)
            score = 1 / (1 + np.exp(-features_of(heaviest, total) @ beta))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(heaviest), pa.array(total), pa.array(matched.astype(np.int64)), pa.array(score)], names)

    return run


def measure(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns of texts, and heaviest_clause, clause_sum, n_clauses and score of the column text."""
    bounded_batches(texts.sparkSession)
    kept = [f for f in texts.schema.fields if f.name in keep]
    made = [T.StructField(n, T.LongType() if n == "n_clauses" else T.DoubleType()) for n in ("heaviest_clause", "clause_sum", "n_clauses", "score")]
    return texts.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_measuring(model, [f.name for f in kept]), T.StructType([*kept, *made]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 12_000, least_gain: float = 18.0, precision: float = 0.4, alone: float = 0.05) -> Model:
    """Learns from at most `rows` labelled rows that aren't held out: those of the least hash of doc_id.

    The sample's doc_ids, its features of clear support and two numbers of each document come to the driver, all bounded
    by `rows`. Without labels, or with one class alone, the model is the fixed words with fixed coefficients. To each toxic
    row come `alone` rows with one word in no pattern that are clean.
    """
    plain = Model(words={w: PRIOR for w in WORDS[INSULT].split()})
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    joined = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select(text_or_empty().alias("text"), "toxic")
    keyed = joined.mapInArrow(_keying, "text string, toxic int, near long")
    kept = staged(keyed.groupBy("near", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in kept.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return plain

    def counted(label: int, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
        rows = kept.where(F.col("toxic") == label).select("text").repartition(8).mapInArrow(_counting(wanted), "feature string, n long")
        return {r["feature"]: r["n"] for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}

    # A feature below this support can't reach the gain.
    support = max(3, math.ceil(least_gain / (2 * math.log((n_pos + n_neg) / n_pos))))
    pos = counted(1, None, support)
    neg = counted(0, frozenset(pos), 1)
    model = choose(pos, neg, n_pos, n_neg, least_gain, precision)
    seen = measure(kept, model, ["toxic"]).select("toxic", "heaviest_clause", "clause_sum").toPandas()
    if (seen["heaviest_clause"] > 0).any():
        one = np.full(math.ceil(alone * n_pos), _WEIGHT[INSULT][PLAIN])
        x = features_of(np.append(seen["heaviest_clause"], one), np.append(seen["clause_sum"], one))
        y = np.append(seen["toxic"], 0 * one).astype(float)
        model.bias, model.heaviest, model.total = map(float, _logistic(x, y))
        if model.heaviest < 0:  # more of a pattern never makes a text cleaner
            model.bias, model.total = map(float, _logistic(x[:, [0, 2]], y))
            model.heaviest = 0.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and the clauses' weights.

    Null and empty texts have no clause and the score of the bias alone; repeated rows get equal scores; label, language,
    source and doc_id are never inputs; other columns are left out.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    found = measure(texts, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "heaviest_clause", "clause_sum", "n_clauses")


def rejected(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least `threshold`; rows and columns otherwise as they were."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return measure(rows, model, ["row"]).where(F.col("score") < threshold).select("row.*")
