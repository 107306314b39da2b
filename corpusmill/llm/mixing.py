"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: each source gets its weight's share of `budget` times all words; a target above `cap` times its source's size
stops there, and the excess is shared again by weight until none is above. That fixed point is found at once: sources
in order of cap over weight, the first whose cap is above its share, and one water level for it and all after it.

Sampling: every document of a source has the expected copies target / size of the source. The documents of a source
stand in order of size; their prefix-summed copies, plus one random offset of the source, cross integers, and a document
is taken once for each integer that it crosses. As sizes ascend, what is taken differs from the target by at most the
source's largest document. No document is taken more than ceil(cap) times. Ranks are global without a one-task window:
range partitions, and the counts of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, range_no, staged, staged_in_order


def word_count(column: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """From (source, size): source, n_docs, source_size, target. The windows run over sources, not documents."""
    named, level, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "place"), Window.partitionBy(F.lit(1))
    before, onward = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = sources.withColumn("place", F.row_number().over(named)).withColumn("weight", weight)
    sources = sources.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    shared = F.lit(float(budget)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sources = sources.withColumn("share", shared / F.sum("weight").over(onward))
    water = F.min(F.when(F.col("level") > F.col("share"), F.struct("level", "place", "share"))).over(every)["share"]
    target = F.least("most", F.coalesce(water * F.col("weight"), F.col("most")))
    return sources.select("source", "n_docs", "source_size", target.alias("target"))


def offset(seed: int) -> Column:
    """The random offset of a source, 0 to 1: from the seed and the source's name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 7, carry: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (= copies * size); with carry, also `row`.

    Sources take the weights by code point of their name, null last, repeating. Null and empty texts have size 0: they
    are taken as often as others and add no words. Equal rows of one source may get different copies; as rows of one
    source, size and doc_id stand in order of the whole row's hash, reruns take the same rows however they are dealt. A
    source without words has target 0 and copies 0. carry keeps the whole input row as a struct, so that no column name
    can clash.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    if carry:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        sized = docs.select("doc_id", "source", word_count().alias("size"), row.alias("row"))
        placed = staged_in_order(sized, [*order, F.xxhash64(F.to_json("row"))], "mixing")
    else:
        # Staged, as finding the ranges and dealing the rows would each count the words.
        placed = staged_in_order(staged(docs.select("doc_id", "source", word_count().alias("size")), "mixing-sizes"), order, "mixing")
    placed = placed.withColumn("range", range_no())
    ranges = placed.groupBy("source", "range").agg(F.min("_mid").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumnsRenamed({"source": "its_source", "range": "its_range"}).drop("n")
    targets = source_targets(placed.select("source", "size"), weights, budget, cap).withColumnRenamed("source", "of_source")
    plan = ranges.join(targets, F.col("its_source").eqNullSafe(F.col("of_source")))
    ranked = placed.join(plan, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("range") == F.col("its_range")))
    rank = F.col("_mid") - F.col("first") + F.col("ahead") + 1
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(offset(seed) + rank * each) - F.floor(offset(seed) + (rank - 1) * each)).cast("long")
    out = ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; the same rows in every run."""
    found = mix(docs, carry=True, **options).where(F.col("copies") > 0)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
