"""Resharding by minimum-cost flow: equal row counts with the fewest bytes moved, then only affected files rewritten.

An old shard that has too many rows gives its smallest ones. A new shard holds n / shards rows, and n mod shards of them
one more, so that of each old shard only one row is in question: the largest of those that go if its shard isn't one with
one more. So three blocks of each old shard (rows that stay, the row in question, rows that go) make the flow exact: its
cost is the bytes moved, whatever the number of rows.

Ranks are found on rows without texts: (old shard, size, hash, place in the layout). Where one run of an old shard's rows
ends and the next begins is a key of that order; the runs' keys are as few as pairs of shards, and with them each task
tells by itself where its rows go. Rows that move are dealt by their new shard; the rows that stay in a shard that loses
some are rewritten where they are read; shards that lose none keep their files. The layout has a folder for each shard.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import range_no, staged, staged_in_order, staged_path


class Flow:
    """Minimum-cost flow by successive shortest paths; each path fills an arc, so their number doesn't grow with rows."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: int, cost: float = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source: int, sink: int) -> None:
        while True:
            best = [float("inf")] * len(self.out)
            via, queued, queue = [-1] * len(self.out), [False] * len(self.out), deque([source])
            best[source] = 0
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and best[a] + self.cost[e] < best[b] - 1e-9:
                        best[b], via[b] = best[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[sink] < 0:
                return
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def plan(rows: dict[int, int], edges: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """From the rows of each old shard and the size of its row in question: runs (old shard, first rank, end rank, shard).

    Ranks are by size within an old shard, from 0. The row in question is that of rank rows - total // shards - 1, for old
    shards of more than total // shards rows. Old shards that aren't 0 to shards - 1 give up all their rows.
    """
    low, more = divmod(sum(rows.values()), shards)
    source, sink, pool, extra = range(4)
    node = {j: 4 + j for j in range(shards)}
    flow, moves, takes = Flow(4 + shards + 3 * len(rows)), defaultdict(list), {}
    for k, (i, n) in enumerate(sorted(rows.items())):
        over = max(0, n - low) if i in node else n
        edge = edges.get(i, 0) if i in node else 0
        for part, (size, cost) in enumerate(((n - over, 1 + edge), (min(over, 1), edge), (max(0, over - 1), 0))):
            block = 4 + shards + 3 * k + part
            flow.arc(source, block, size)
            if i in node:
                flow.arc(block, node[i], size)
            moves[i].append(flow.arc(block, pool, size, cost))
    for j, at in node.items():
        takes[j] = flow.arc(pool, at, low + 1)
        flow.arc(at, sink, low)
        flow.arc(at, extra, 1)
    flow.arc(extra, sink, more)
    flow.solve(source, sink)
    gone = {i: sum(map(flow.sent, arcs)) for i, arcs in moves.items()}
    runs = [(i, gone[i], n, i) for i, n in sorted(rows.items()) if gone[i] < n]
    wanted = deque([j, flow.sent(e)] for j, e in takes.items() if flow.sent(e))
    for i in sorted(rows):
        at = 0
        while at < gone[i]:
            n = min(wanted[0][1], gone[i] - at)
            runs.append((i, at, at + n, wanted[0][0]))
            at += n
            wanted[0][1] -= n
            if not wanted[0][1]:
                wanted.popleft()
    return runs


def utf8_size(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 8


MOST_FILES = 250_000  # of a layout, whose first slots are broadcast: two numbers for each
_KEY = "struct<size:bigint,hash:bigint,file:bigint,at:bigint>"


def _key() -> Column:
    """A total order of an old shard's rows: of equal size and hash, by their place in the layout."""
    return F.struct("size", "hash", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def write_layout(docs: DataFrame, old_shard: Column) -> str:
    """The folder of a layout: row, size, hash and old_shard in shard=<old shard>/gen=0; a null old shard is -1.

    Each task writes its rows of each shard, so that nothing is shuffled.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    old = F.coalesce(old_shard.cast("int"), F.lit(-1))
    path = staged_path(docs.sparkSession, "reshard")
    rows = docs.select(row, utf8_size().alias("size"), F.xxhash64("doc_id", "text").alias("hash"), old.alias("old_shard"), old.alias("shard"), F.lit(0).alias("gen"))
    staged(rows, "reshard", ["shard", "gen"], path)
    return path


def _read(spark: SparkSession, path: str, row: StructType) -> DataFrame:
    rest = StructType().add("size", "long").add("hash", "long").add("old_shard", "integer").add("shard", "integer").add("gen", "integer")
    return spark.read.schema(StructType([StructField("row", row), *rest])).parquet(path)


def move(spark: SparkSession, path: str, row: StructType, shards: int) -> None:
    """Rewrites the layout at path (rows of type `row`) for so many shards, whose rows differ by one at most."""
    layout = _read(spark, path, row).where("gen = 0")
    order = [F.col("old_shard"), F.col("key")]
    placed = staged_in_order(layout.select("old_shard", _key().alias("key")), order, "reshard-ranks")
    # One row for each range and old shard.
    ranges = placed.groupBy("old_shard", range_no().alias("range")).agg(F.min("_mid").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("old_shard", "range").collect()
    rows: dict[int, int] = defaultdict(int)
    for r in ranges:
        rows[r["old_shard"]] += r["n"]

    def keys(ranks: list[tuple[int, int]]) -> dict[tuple[int, int], tuple]:
        """Of these (old shard, rank), which are a few for each pair of shards at most."""
        mid, left = {}, defaultdict(int)
        for r in ranges:
            for i, rank in ranks:
                if i == r["old_shard"] and 0 <= rank - left[i] < r["n"]:
                    mid[r["first"] + rank - left[i]] = (i, rank)
            left[r["old_shard"]] += r["n"]
        return {mid[r["_mid"]]: tuple(r["key"]) for r in placed.where(F.col("_mid").isin(list(mid))).collect()} if mid else {}

    low = sum(rows.values()) // shards
    asked = keys([(i, n - low - 1) for i, n in rows.items() if 0 <= i < shards and n > low])
    runs = plan(rows, {i: key[0] for (i, _), key in asked.items()}, shards)
    if all(i == j for i, _, _, j in runs):
        return
    ends = keys(sorted({(i, x) for i, a, b, _ in runs for x in (a, b) if 0 < x < rows[i]}))
    cuts = spark.createDataFrame([(i, ends.get((i, a)), ends.get((i, b)), j) for i, a, b, j in runs], f"run_of int, from_key {_KEY}, to_key {_KEY}, to_shard int")
    loses = sorted({i for i, _, _, j in runs if i != j})
    # Runs are at most old and new shards together: known to be few, so broadcast.
    keyed = layout.where(F.col("old_shard").isin(loses)).withColumn("key", _key())
    within = (F.col("from_key").isNull() | (F.col("key") >= F.col("from_key"))) & (F.col("to_key").isNull() | (F.col("key") < F.col("to_key")))
    dealt = keyed.join(F.broadcast(cuts), (F.col("old_shard") == F.col("run_of")) & within)
    dealt = dealt.select("row", "size", "hash", "old_shard", F.col("to_shard").alias("shard"), F.lit(1).alias("gen"))
    staged(dealt.where("shard = old_shard"), "reshard", ["shard", "gen"], path)
    staged(dealt.where("shard <> old_shard").repartition("shard", F.pmod("hash", F.lit(8))), "reshard", ["shard", "gen"], path)
    for i in loses:
        _delete(spark, f"{path}/shard={i}/gen=0")


def reshard(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """Every row of docs as `row`, with size, old_shard, shard, slot and moved, read from the layout that results.

    Row counts of the shards differ by one at most; slots of a shard are 0, 1, 2, ... along its files. Size is the text's
    UTF-8 bytes plus 8 (null: 8). Equal rows are rows of their own; null doc_ids and texts are values like others; a null
    old shard, or one that isn't 0 to shards - 1, gives up all its rows; other columns are kept inside `row`. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).schema["row"].dataType
    path = write_layout(docs, old_shard)
    move(spark, path, row, shards)
    found = _read(spark, path, row).withColumns({"file": F.xxhash64("_metadata.file_path"), "at": F.col("_metadata.row_index")})
    files = found.groupBy(F.col("shard").alias("of_shard"), F.col("file").alias("of_file")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("of_shard").orderBy("of_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(files.select("of_file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "reshard-files")
    if bases.count() <= MOST_FILES:
        bases = F.broadcast(bases)
    moved = (F.col("shard") != F.col("old_shard")).alias("moved")
    return found.join(bases, F.col("file") == F.col("of_file")).select("row", "size", "old_shard", "shard", (F.col("base") + F.col("at")).alias("slot"), moved)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
