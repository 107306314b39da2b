"""The slice of a corpus that a question needs, by lexical overlap, within a character budget.

Questions are few beside chunks: they are gathered by corpus, in blocks of bounded size. Where their measured size allows
it, they go to the workers as one automaton for each block (Aho and Corasick), which finds all terms in one pass over a
chunk, however many there are; beyond that size, blocks join chunks by corpus, and each distinct term is sought by itself.
Only questions that score come out. Ranks see numbers alone; texts join what was picked.

A null corpus_id belongs to no corpus. Null questions have no keys and words; null chunks contain nothing; questions with
equal ids are one question to the ranks, and repeated (corpus_id, k) come in together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.functions import text as T
from corpusmill.operators.staging import staged

BUDGET = 14_000
BLOCK_QUESTIONS = 256
BROADCAST_BYTES = 8 << 20


def with_keys(questions: DataFrame, question_col: str = "question", ignored_col: str | None = None) -> DataFrame:
    """Adds keys and words; the ignored terms are compared in lower case."""
    q = F.coalesce(F.col(question_col), F.lit(""))
    ignored = F.transform(F.col(ignored_col), F.lower) if ignored_col else None
    return questions.withColumn("keys", T.question_keys(q, ignored)).withColumn("words", T.question_words(q, ignored))


def measured(df: DataFrame, width: Column) -> int:
    """The sum of `width` over df."""
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def asked_by_corpus(questions: DataFrame) -> DataFrame:
    """(asked_corpus, asked: question_id, keys, words; terms: all distinct keys and words) in blocks of about BLOCK_QUESTIONS."""
    rows = staged(with_keys(questions).select("question_id", F.col("corpus_id").alias("asked_corpus"), "keys", "words"), "questions")
    sizes = rows.groupBy("asked_corpus").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUESTIONS)).cast("int").alias("blocks"))
    placed = rows.join(sizes, "asked_corpus").withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("blocks")))
    asked = placed.groupBy("asked_corpus", "block").agg(F.collect_list(F.struct("question_id", "keys", "words")).alias("asked"))
    terms = F.array_distinct(F.flatten(F.transform("asked", lambda q: F.concat(q["keys"], q["words"]))))
    return staged(asked.select("asked_corpus", "asked", terms.alias("terms")), "asked")


def _asked_bytes(blocks: DataFrame) -> int:
    return measured(blocks, F.aggregate("asked", F.lit(0), lambda n, q: n + 40 + F.aggregate(F.concat(q["keys"], q["words"]), F.lit(0), lambda m, t: m + 20 + F.octet_length(t))))


def _searching(blocks: list, kinds: pa.Schema):
    """Scores (corpus_id, k, chars, low) by automata; blocks are rows of asked_by_corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of_corpus = defaultdict(list)
        for corpus, asked, terms in blocks:
            place = {t: i for i, t in enumerate(terms)}
            weight = np.zeros((len(terms), len(asked)), np.int64)
            search = ahocorasick.Automaton()
            for j, (_, keys, words) in enumerate(asked):
                for t in keys:
                    weight[place[t], j] += 10
                for t in words:
                    weight[place[t], j] += 1
            for t, i in place.items():
                search.add_word(t, i)
            search.make_automaton()
            of_corpus[corpus].append((search if terms else None, weight, pa.array([q for q, _, _ in asked], kinds.field("question_id").type)))
        def hits(batch: pa.RecordBatch, rows: list, scores: list, ids: list) -> pa.RecordBatch:
            at = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(batch[c].take(at) for c in ("corpus_id", "k", "chars")), pa.array(np.concatenate(scores))], schema=kinds)

        for batch in batches:
            rows, scores, ids, n = [], [], [], 0
            for i, (corpus, low) in enumerate(zip(batch["corpus_id"].to_pylist(), batch["low"].to_pylist(), strict=True)):
                for search, weight, asked in of_corpus.get(corpus, ()) if low is not None else ():
                    found = list({t for _, t in search.iter(low)}) if search else []
                    score = weight[found].sum(0)
                    hit = np.flatnonzero(score)
                    if len(hit):
                        rows.append(np.full(len(hit), i))
                        scores.append(score[hit])
                        ids.append(asked.take(pa.array(hit)))
                        n += len(hit)
                if n > 1 << 20:
                    yield hits(batch, rows, scores, ids)
                    rows, scores, ids, n = [], [], [], 0
            if n:
                yield hits(batch, rows, scores, ids)

    return run


def _scored(low: Column, asked: Column, terms: Column) -> Column:
    """(question_id, score) of the questions that score above 0: ten for each key and one for each word that the chunk contains."""

    def count(has: Column, own: Column) -> Column:
        return F.size(F.filter(own, lambda t: F.array_contains(has, t)))

    def each(has: Column) -> Column:
        scores = F.transform(asked, lambda q: F.struct(q["question_id"].alias("question_id"), (count(has, q["keys"]) * 10 + F.size(F.array_intersect(q["words"], has))).cast("long").alias("score")))
        return F.filter(scores, lambda x: x["score"] > 0)

    return T.bound(low, lambda c: T.bound(F.filter(terms, lambda t: F.contains(c, t)), each))


def chunk_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, corpus_id, k, chars, score) of the chunks of each question's corpus that score; k is any place that sorts."""
    blocks = asked_by_corpus(questions)
    chars = F.length("chunk").cast("long").alias("chars")
    if _asked_bytes(blocks) <= BROADCAST_BYTES:
        rows = chunks.select("corpus_id", "k", chars, F.lower("chunk").alias("low"))
        kind = {f.name: f.dataType for f in [*rows.schema.fields, *questions.schema.fields]}
        schema = ST.StructType([*(ST.StructField(c, kind[c]) for c in ("question_id", "corpus_id", "k", "chars")), ST.StructField("score", ST.LongType())])
        return rows.mapInArrow(_searching([(r["asked_corpus"], [tuple(q) for q in r["asked"]], r["terms"]) for r in blocks.collect()], to_arrow_schema(schema)), schema)
    pairs = chunks.join(blocks, F.col("corpus_id") == F.col("asked_corpus"))
    # A generator's result is computed once; conditions on it stay above it.
    return pairs.select("corpus_id", "k", chars, F.inline(_scored(F.lower("chunk"), F.col("asked"), F.col("terms")))).select("question_id", "corpus_id", "k", "chars", "score")


def picked_chunks(scores: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Chunks by score, then place, as long as their running length stays within the budget; the best one always.

    As every chunk has a character, ranks beyond the budget can't be picked: that bound prunes before the shuffle.
    """
    by_score = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "k")
    ranked = scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= budget)
    running = F.sum("chars").over(by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("running", running).where((F.col("rank") == 1) | (F.col("running") <= budget))


def retrieve(questions: DataFrame, chunks: DataFrame, heads: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(question_id, slice, n_chunks): picked chunks in document order, or the corpus's head where none scores.

    heads: (corpus_id, head), the first `budget` characters of each corpus.
    """
    picked = staged(picked_chunks(chunk_scores(questions, chunks), budget).select("question_id", F.col("corpus_id").alias("its_corpus"), F.col("k").alias("its_k")), "picked")
    few = F.broadcast(picked) if measured(picked, F.lit(64)) <= BROADCAST_BYTES else picked
    texts = chunks.join(few, (F.col("corpus_id") == F.col("its_corpus")) & (F.col("k") == F.col("its_k")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk"))), lambda x: x["chunk"]), "\n\n")
    slices = texts.groupBy("question_id").agg(F.substring(joined, 1, budget).alias("slice"), F.count(F.lit(1)).alias("n_chunks"))
    with_head = questions.select("question_id", "corpus_id").join(heads, "corpus_id", "left").join(slices, "question_id", "left")
    return with_head.select("question_id", F.coalesce("slice", F.substring("head", 1, budget), F.lit("")).alias("slice"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def corpus_heads(texts: DataFrame, budget: int, rank_col: str = "rank", separator: str = "\n\n") -> DataFrame:
    """(corpus_id, head): (corpus_id, rank, text) joined in order and cut. Texts that begin beyond the cut are left out first.

    Each text takes its separator at least, so that more than budget / separator of them can't begin before the cut:
    that limit is met where texts are read, before a large corpus comes together.
    """
    order = Window.partitionBy("corpus_id").orderBy(rank_col)
    texts = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget // max(1, len(separator)) + 1)
    before = F.coalesce(F.sum(F.length("text").cast("long") + len(separator)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = texts.withColumn("before", before).where(F.col("before") < budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, "text"))), lambda x: x["text"]), separator)
    return needed.groupBy("corpus_id").agg(F.substring(joined, 1, budget).alias("head"))
