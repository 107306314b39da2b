"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's paragraphs are its lines; a line of over PIECE characters goes in pieces that end at white space. Each distinct
digest is put into one cell of each of three subtables; a cell is (count, xor of digests, xor of checks). Cells of two
versions subtract. Peeling takes cells with the count 1 or -1 whose check fits, removes their digests from the other
cells, and so on: what it recovers are the digests that one version has and the other hasn't. If cells are left, the
sketch was too small, and a larger one is tried: the digests are split by their hash over sketches for 8 each, and one
of these that fails is tried again with 4 and 16 times the cells, then compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_no, staged, staged_in_order, text_or_empty

PIECE = 400
CELLS = 24  # of the fingerprint: three subtables of 8
ROUNDS = 30

_CELL = "struct<n:bigint,key:bigint,check:bigint>"


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the trimmed paragraphs that aren't blank."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}(?=\s|\z)|[^\n]{{{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def _places(key: Column, cells: int) -> Column:
    each = cells // 3
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(2 + j)), F.lit(each)).cast("int") + j * each for j in range(3)))


def sketch(digests: Column, cells: int) -> Column:
    """The cells of these digests."""
    placed = F.transform(digests, lambda d: F.struct(d.alias("key"), _check(d).alias("check"), _places(d, cells).alias("at")))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), acc["key"].bitwiseXOR(x["key"]).alias("key"), acc["check"].bitwiseXOR(x["check"]).alias("check"))

    return bound(placed, lambda p: F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.aggregate(F.filter(p, lambda x: F.array_contains(x["at"], i)), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(difference: Column, cells: int) -> Column:
    """The digests that differ, as (key, n: 1 if the first version has it, -1 if the second); null if cells are left."""
    each = cells // 3

    def remove(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] - x["n"]).alias("n"), acc["key"].bitwiseXOR(x["key"]).alias("key"), acc["check"].bitwiseXOR(x["check"]).alias("check"))

    def step(acc: Column, turn: Column) -> Column:
        # One subtable at a time: there a digest has one cell, so it is never removed twice.
        own = F.slice(acc["cells"], (turn % 3) * each + 1, F.lit(each))
        pure = F.transform(F.filter(own, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))), lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"), c["check"].alias("check"), _places(c["key"], cells).alias("at")))

        def after(found: Column) -> Column:
            cells_left = F.transform(acc["cells"], lambda c, i: F.aggregate(F.filter(found, lambda x: F.array_contains(x["at"], i)), c, remove))
            known = F.concat(acc["found"], F.transform(found, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))))
            return F.when(F.size(found) > 0, F.struct(cells_left.alias("cells"), known.alias("found"))).otherwise(acc)

        return bound(pure, after)

    start = F.struct(difference.alias("cells"), F.expr("CAST(array() AS array<struct<key:bigint,n:bigint>>)").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.when(F.forall(acc["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0)), acc["found"]))


def _exact(a: Column, b: Column) -> Column:
    def side(x: Column, y: Column, n: int) -> Column:
        return F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("key"), F.lit(n).cast("long").alias("n")))

    return F.concat(side(a, b, 1), side(b, a, -1))


def differing(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """peel's digests of two versions from their fingerprints' cells, and from larger sketches where these fail."""

    def part(digests: Column, parts: Column, i: Column) -> Column:
        return F.filter(digests, lambda d: F.pmod(F.xxhash64(d, F.lit(9)), parts) == i)

    def one(x: Column, y: Column) -> Column:
        tries = [peel(subtract(sketch(x, CELLS * grow), sketch(y, CELLS * grow)), CELLS * grow) for grow in (1, 4, 16)]
        return F.coalesce(*tries, _exact(x, y))

    def split(parts: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: bound(F.struct(part(a, parts, i).alias("x"), part(b, parts, i).alias("y")), lambda p: one(p["x"], p["y"]))))

    parts = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / F.lit(8)).cast("int"))
    return F.coalesce(peel(subtract(a_cells, b_cells), CELLS), bound(parts, split))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Jaccard likeness of the digest sets from how many differ; two texts without paragraphs are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * both / (both + F.size(found)) - 1.0)


def encoded(cells: Column) -> Column:
    """A sketch as text: count, digests and checks of each cell, or - for an empty cell."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("-")).otherwise(F.concat_ws(".", c["n"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))), ";")


def with_next_text(docs: DataFrame) -> DataFrame:
    """(place, doc_id, text, next_text): the text of the next document by doc_id (null last, ties by the text's hash), after the last the first.

    Ranges of documents are windows of their own; each gets the first document of the range after it as a guest.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    placed = staged_in_order(texts, [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")], "fingerprint-texts").withColumn("range", range_no())
    first = placed.where(F.col("_mid").bitwiseAND((1 << 33) - 1) == 0).select("range", "text")
    # Over ranges, of which there are as many as staged files.
    order = Window.orderBy("range")
    before = first.select("range", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy(F.lit(1)))).alias("host"))
    guests = first.join(before, "range").select(F.lit((1 << 63) - 1).alias("place"), F.lit(None).cast("long").alias("doc_id"), "text", F.col("host").alias("range"), F.lit(True).alias("guest"))
    rows = placed.select(F.col("_mid").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text", "range", F.lit(False).alias("guest"))
    led = rows.unionByName(guests).withColumn("next_text", F.lead("text").over(Window.partitionBy("range").orderBy("place")))
    return led.where(~F.col("guest")).select("place", "doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, its edited text's (the last half replaced by the first characters of the next
    document), what differs from that and from the next document, and the likenesses.

    Null and empty texts have no paragraphs: an empty sketch, alike to another empty one (1.0), unlike any other (0.0).
    Equal texts have equal fingerprints; repeated rows stay rows of their own; one row is its own next document; other
    columns are left out.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    texts = with_next_text(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    digests = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(paragraph_digests(F.col(c)).alias(a) for c, a in (("text", "own"), ("edited", "new"), ("next_text", "other"))))
    # Peeling is work of many seconds on few bytes: dealt evenly over twice the tasks that a shuffle has.
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digests = staged(digests, "fingerprint-digests").repartition(tasks, "doc_id", "edited_sha256")
    cells = digests.select("*", *(sketch(F.col(c), CELLS).alias(f"{c}_cells") for c in ("own", "new", "other")))
    found = cells.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("own_cells")).alias("fingerprint"), encoded(F.col("new_cells")).alias("edited_fingerprint"), "own", "new", "other",
        *(differing(F.col("own"), F.col(c), F.col("own_cells"), F.col(f"{c}_cells")).alias(f"{c}_found") for c in ("new", "other")),
    )
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("new"), F.col("new_found")).alias("near_edited"), likeness(F.col("own"), F.col("other"), F.col("other_found")).alias("near_next"), F.col("new_found").alias("edited_differing"))
