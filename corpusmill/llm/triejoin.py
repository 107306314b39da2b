"""N-gram Jaccard join by prefix trees: which documents' word n-gram sets are alike, and what hangs together.

Global order: each task counts its n-grams in a table of fixed size and reports its fullest counters; their sums tell
frequent n-grams from others, by their share of the documents and so at any size. N-grams stand by frequency class, then
by hash, so that the frequent ones come last in every set. Sets that reach the threshold share an
n-gram among the first of this order (the prefix filter), so the documents of each such n-gram, cut where sizes differ
too much, are one star around its least member. Stars fall apart where parity bitmaps of the sets (about a bit for each
n-gram) differ in more places than linked sets can; most chance meetings end here, before any text is sent.
The members of what is left are stored in a trie of their ordered sets: a traversal carries the overlap of the path,
shared by all sets below, and leaves a subtree when the n-grams passed in vain and the lengths below rule the threshold
out, or when all sets below are linked already. Every linked pair meets in some star, no set is cut, and equal sets are
one node throughout. Verified links go to a connected-components loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore
from .common import bounded_batches, staged, text_or_empty, utf8_total

SKETCH_BITS = 21
SLICES = 16
REPORTED = 1 << 16  # counters that a task reports at most
_BYTES = 2 << 20
_ODD = np.uint64(0xD6E8FEB86659FD93)
_COUNT = np.dtype([("at", "<u4"), ("n", "<i8")])


def ngram_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct 64-bit n-gram hashes) of each text; under k words: one hash of them all, or none."""
    for lo, hi in textcore._spans(textcore.flat(texts)[1], _BYTES):
        w = textcore.words(texts.slice(lo, hi - lo), lower=True)
        h = textcore.word_hashes(w)
        n = max(len(h) - k + 1, 0)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams = grams * _ODD + h[j : j + n]
        grams = textcore.mix(grams)
        for i in range(hi - lo):
            a, b = int(w.doc_at[i]), int(w.doc_at[i + 1])
            if b - a >= k:
                yield lo + i, np.unique(grams[a : b - k + 1])
            else:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        one = one * _ODD + x
                yield lo + i, textcore.mix(np.array([one] if b > a else [], np.uint64))


def signature(grams: np.ndarray) -> int:
    """Of a set, whatever its order: 63 bits."""
    total = np.array([np.sum(textcore.mix(grams ^ _ODD), dtype=np.uint64) + np.uint64(len(grams))], np.uint64)
    return int(textcore.mix(total)[0] >> np.uint64(1))


def parity_bitmap(grams: np.ndarray) -> bytes:
    """Each n-gram flips one of 2**j bits, at least 64 and about as many as n-grams: two sets' bitmaps differ in no more places than the sets.

    Xor of its halves is the bitmap of half the bits.
    """
    bits = 1 << max(6, int(len(grams)).bit_length() - 1)
    flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def least_overlap(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _surveying(k: int):
    """Of each batch: a row per document; of each task: its fullest counters, in slices."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("bits", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            n, sig = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            bits: list[bytes] = [b""] * len(batch)
            held: list[np.ndarray] = []
            for i, grams in ngram_sets(batch["text"], k):
                n[i], sig[i], bits[i] = len(grams), signature(grams), parity_bitmap(grams)
                held.append(grams)
                if len(held) == 1000:
                    total += np.bincount(_counter(np.concatenate(held)), minlength=len(total))
                    held = []
            if held:
                total += np.bincount(_counter(np.concatenate(held)), minlength=len(total))
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["key"], pa.array(n), pa.array(sig), pa.array(bits, pa.binary()), none, pa.nulls(len(batch), pa.binary())], schema=schema)
        full = fullest(total)
        parts = np.searchsorted(full["at"], np.arange(SLICES + 1) * (len(total) // SLICES))
        data = [full[a:b].tobytes() for a, b in zip(parts[:-1], parts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(data, pa.binary())], schema=schema)

    return run


def fullest(counters: np.ndarray, most: int = REPORTED) -> np.ndarray:
    """The counters of 2 and more, in order of place; of over `most` those that are fuller than the rest."""
    at = np.flatnonzero(counters > 1)
    if len(at) > most:
        at = at[counters[at] > np.partition(counters[at], -most - 1)[-most - 1]]
    out = np.empty(len(at), _COUNT)
    out["at"], out["n"] = at, counters[at]
    return out


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _summing(table: pa.Table) -> pa.Table:
    parts = np.concatenate([np.frombuffer(x.as_py(), _COUNT) for x in table["counts"]])
    at, place = np.unique(parts["at"], return_inverse=True)
    total = np.empty(len(at), _COUNT)
    total["at"], total["n"] = at, np.bincount(place, parts["n"], len(at))
    return pa.table({"slice": table["slice"].slice(0, 1).cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _classing(table: pa.Table) -> pa.Table:
    """Of a slice: the counters that exceed what chance gives twice or more, each with that power of two as its number."""
    total = np.frombuffer(_summing(table)["counts"][0].as_py(), _COUNT)
    mean = total["n"].sum() / ((1 << SKETCH_BITS) // SLICES)
    power = np.floor(np.log2(np.maximum(total["n"] / (mean + 8 * np.sqrt(mean) + 8), 1)))
    out = total[power > 0].copy()
    out["n"] = np.minimum(power[power > 0], 31)
    return pa.table({"slice": table["slice"].slice(0, 1).cast(pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})


def frequency_classes(rows: DataFrame) -> np.ndarray:
    """(at, n) of each counter whose n-grams are frequent: the power of two by which it exceeds what chance gives."""
    parts = rows.where("slice IS NOT NULL").select("slice", "counts", (F.monotonically_increasing_id() % 64).alias("salt"))
    some = parts.groupBy("slice", "salt").applyInArrow(_summing, "slice int, counts binary")
    found = some.groupBy("slice").applyInArrow(_classing, "slice int, counts binary").collect()
    return np.concatenate([np.zeros(0, _COUNT), *(np.frombuffer(r["counts"], _COUNT) for r in found)])


def dense(classes: np.ndarray) -> np.ndarray:
    """The class of every counter, as `ordered` takes it."""
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    out[classes["at"]] = classes["n"]
    return out


def ordered(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in global order, each n-gram as its rank: class in 5 bits, then 59 bits of its hash."""
    return np.sort(classes[_counter(grams)].astype(np.uint64) << np.uint64(59) | textcore.mix(grams) >> np.uint64(5))


_ENTRY = np.dtype([("token", "<u8"), ("sig", "<i8"), ("n", "<i4")])


def _prefixing(k: int, percent: int, classes: np.ndarray, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = dense(classes)
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        count = 0

        def sent() -> pa.RecordBatch:
            entries = np.empty(sum(len(t) for t, _, _ in held), _ENTRY)
            entries["token"] = np.concatenate([t for t, _, _ in held])
            size = [len(t) for t, _, _ in held]
            entries["sig"], entries["n"] = np.repeat([s for _, s, _ in held], size), np.repeat([n for _, _, n in held], size)
            bucket = (textcore.mix(entries["token"]) % np.uint64(buckets)).astype(np.int64)
            entries = entries[np.argsort(bucket, kind="stable")]
            at = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([entries[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())], schema=schema)

        for batch in batches:
            for _, grams in ngram_sets(batch["text"], k):
                if len(grams):
                    sig = signature(grams)
                    if sig in seen:
                        continue
                    seen.add(sig)
                    prefix = ordered(grams, class_of)[: len(grams) - least_overlap(len(grams), percent) + 1]
                    held.append((prefix, sig, len(grams)))
                    count += len(prefix)
                    if count > 1 << 20:
                        yield sent()
                        held, seen, count = [], set(), 0
        if held:
            yield sent()

    return run


def _starring(percent: int):
    def run(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_py(), _ENTRY) for x in table["data"]])
        e = e[np.lexsort((e["sig"], e["n"], e["token"]))]
        same = np.zeros(len(e), bool)
        same[1:] = (e["token"][1:] == e["token"][:-1]) & (100 * e["n"][:-1].astype(np.int64) >= percent * e["n"][1:].astype(np.int64))
        run_no = np.cumsum(~same) - 1
        least = np.minimum.reduceat(e["sig"], np.flatnonzero(~same))[run_no] if len(e) else e["sig"]
        arms = least != e["sig"]
        pairs = np.unique(np.stack([least[arms], e["sig"][arms]], 1), axis=0) if arms.any() else np.zeros((0, 2), np.int64)
        return pa.table({"center": pa.array(pairs[:, 0], pa.int64()), "sig": pa.array(pairs[:, 1], pa.int64())})

    return run


def _narrowing(percent: int):
    """Takes a star apart into what hangs together by sizes and bitmaps; each part is a star around its least member."""

    def run(table: pa.Table) -> pa.Table:
        sig, n = table["sig"].to_numpy(), table["n"].to_numpy()
        raw = [x.as_py() for x in table["bits"]]
        width = np.array([len(x) for x in raw])
        # Members of one width are one array of words; a narrower asker folds it.
        groups = {w: (own := np.flatnonzero(width == w), np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1)) for w in np.unique(width).tolist()}
        folded = {w: {w: bits} for w, (_, bits) in groups.items()}

        def at_width(w: int, to: int) -> np.ndarray:
            if to not in folded[w]:
                wide = at_width(w, 2 * to)
                half = wide.shape[1] // 2
                folded[w][to] = wide[:, :half] ^ wide[:, half:]
            return folded[w][to]

        place = np.zeros(len(sig), np.int64)
        for own, _ in groups.values():
            place[own] = np.arange(len(own))
        new = np.ones(len(sig), bool)
        out: list[np.ndarray] = []
        for first in range(len(sig)):
            if not new[first]:
                continue
            new[first] = False
            part, todo = [first], [first]
            while todo:
                i = todo.pop()
                for w, (own, _) in groups.items():
                    ask = new[own] & (100 * np.minimum(n[own], n[i]) >= percent * np.maximum(n[own], n[i]))
                    at = np.flatnonzero(ask)
                    if not len(at):
                        continue
                    to = min(w, int(width[i]))
                    apart = np.bitwise_count(at_width(w, to)[at] ^ at_width(int(width[i]), to)[place[i]]).sum(1, dtype=np.int64)
                    near = own[at[apart * (100 + percent) <= (100 - percent) * (n[own[at]] + n[i])]]
                    new[near] = False
                    part += near.tolist()
                    todo += near.tolist()
            if len(part) > 1:
                out.append(np.array(part))
        least = [np.full(len(x), sig[x].min()) for x in out]
        return pa.table({"center": pa.array(np.concatenate([*least, np.zeros(0, np.int64)]), pa.int64()), "sig": pa.array(np.concatenate([*(sig[x] for x in out), np.zeros(0, np.int64)]), pa.int64())})

    return run


class Node:
    __slots__ = ("label", "children", "sets", "low", "high", "tag")

    def __init__(self, label: np.ndarray):
        self.label, self.children, self.sets = label, {}, []
        self.low, self.high, self.tag = 1 << 62, 0, None


class Trie:
    """Ordered sets under shared paths; an edge holds a run of n-grams. Sets are added and asked for in any order."""

    def __init__(self, percent: int):
        self.percent, self.root, self.parent, self.of = percent, Node(np.zeros(0, np.uint64)), [], []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.parent[j] = i

    def add(self, grams: np.ndarray) -> int:
        """Links a set with every linked set of another component, then stores it; its number."""
        i = len(self.parent)
        self.parent.append(i)
        self._probe(i, grams)
        node, at, n = self.root, 0, len(grams)
        self._mark(node, i, n)
        while at < n:
            child = node.children.get(int(grams[at]))
            if child is None:
                child = node.children[int(grams[at])] = Node(grams[at:])
                at = n
            else:
                size = min(len(child.label), n - at)
                differs = np.flatnonzero(child.label[:size] != grams[at : at + size])
                shared = int(differs[0]) if len(differs) else size
                if shared < len(child.label):  # the edge is cut in two
                    upper = Node(child.label[:shared])
                    upper.low, upper.high, upper.tag = child.low, child.high, child.tag
                    child.label = child.label[shared:]
                    upper.children[int(child.label[0])] = child
                    node.children[int(grams[at])] = child = upper
                at += shared
            node = child
            self._mark(node, i, n)
        node.sets.append(i)
        return i

    def _mark(self, node: Node, i: int, n: int) -> None:
        node.low, node.high = min(node.low, n), max(node.high, n)
        node.tag = i if node.tag is None or node.tag >= 0 and self.find(node.tag) == self.find(i) else -1

    def _probe(self, i: int, grams: np.ndarray) -> None:
        n, t = len(grams), self.percent
        todo = [(child, 0, 0) for child in self.root.children.values()]
        while todo:
            node, depth, overlap = todo.pop()
            if node.tag >= 0 and self.find(node.tag) == self.find(i):
                continue
            place = np.searchsorted(grams, node.label)
            overlap += int(np.count_nonzero(grams[np.minimum(place, n - 1)] == node.label))
            depth += len(node.label)
            passed = int(place[-1]) + int(place[-1] < n and grams[place[-1]] == node.label[-1])
            # A set of s below shares at most s - (depth - overlap) and n - (passed - overlap) with this one.
            least = -(-(t * n + (100 + t) * (depth - overlap)) // 100)
            most = ((100 + t) * (n - passed + overlap) - t * n) // t
            if max(node.low, least) > min(node.high, most):
                continue
            for j in node.sets:
                if 100 * overlap >= t * (n + depth - overlap):
                    self.join(i, j)
            todo += [(child, depth, overlap) for child in node.children.values()]


def _joining(k: int, percent: int, classes: np.ndarray):
    kept: list[np.ndarray] = []  # one for all groups of a task

    def run(table: pa.Table) -> pa.Table:
        if not kept:
            kept.append(dense(classes))
        trie, sigs, seen, class_of = Trie(percent), [], set(), kept[0]
        wanted = table["sig"].to_numpy()
        members = []
        for i, grams in ngram_sets(table["text"].combine_chunks(), k):
            sig = signature(grams)
            if sig == wanted[i] and sig not in seen:  # else another row with the same key
                seen.add(sig)
                members.append((sig, ordered(grams, class_of)))
        for sig, grams in sorted(members, key=lambda m: (len(m[1]), m[0])):
            trie.add(grams)
            sigs.append(sig)
        root: dict[int, int] = {}
        for i, sig in enumerate(sigs):
            r = trie.find(i)
            root[r] = min(root.get(r, sig), sig)
        links = [(root[trie.find(i)], sig) for i, sig in enumerate(sigs) if root[trie.find(i)] != sig]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the least node that it hangs together with.

    Least labels of neighbours, then the label's label, staged each round, until none changes; rounds are about the
    logarithm of the longest path. Counts come to the driver, never nodes.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near"))
        nearer = labels.join(least, labels.node == least.a).select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), (F.least("near", F.coalesce("far", "near")) != F.col("label")).alias("changed"))
        moved = staged(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels


def in_blocks(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Members (center, sig, ...) of stars that weigh more than `most` dealt into blocks, of which every pair (lo, hi) is a group.

    So any two members of a star meet in some group, and no group weighs much more than twice `most`.
    """
    sizes = members.groupBy("center").agg(F.ceil(weight / F.lit(most)).cast("int").alias("blocks"))
    placed = members.join(sizes, "center").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    return placed.withColumn("pair", F.explode(pairs)).select(*members.columns, "pair.lo", "pair.hi")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, bucket_bytes: int = 12 << 20, block_grams: int = 1_500_000, star_members: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included), class_id
    (equal for documents with equal sets), label (equal for documents of one component) and key (of doc_id and text).

    A text is lower-cased (A-Z), cut into words, and its set has the distinct runs of k words; with fewer words, all of
    them as one. Two link when 100 * intersection >= percent * union. Null and empty texts have empty sets, link with
    nothing and are components of their own; equal and repeated rows link; a null doc_id never is a component's least,
    and a component of null ids alone has a null id; other columns are left out.

    bucket_bytes of text give one bucket of prefix entries; a star of over star_members sets, or later of over
    block_grams n-grams, is dealt into blocks, of which each pair is a group. Sets are told apart by 63-bit signatures.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("key"), text_or_empty().alias("text"))
    survey = staged(texts.mapInArrow(_surveying(k), "doc_id long, key long, n long, sig long, bits binary, slice int, counts binary"), "ngram-survey")
    classes = frequency_classes(survey)
    rows = survey.where("slice IS NULL").select("doc_id", "key", "n", "sig")
    buckets = max(1, -(-utf8_total(docs) // bucket_bytes))
    entries = texts.select("text").mapInArrow(_prefixing(k, percent, classes, buckets), "bucket int, data binary")
    arms = staged(entries.groupBy("bucket").applyInArrow(_starring(percent), "center long, sig long").distinct(), "stars")
    bitmaps = survey.where("n > 0").groupBy("sig").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    stars = arms.unionByName(arms.select("center", F.col("center").alias("sig")).distinct()).join(bitmaps, "sig")
    near = staged(in_blocks(stars, F.count(F.lit(1)), star_members).groupBy("center", "lo", "hi").applyInArrow(_narrowing(percent), "center long, sig long").distinct(), "near-stars")
    # Every member of a star, with the key of one row that has its set.
    chosen = rows.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    members = near.join(chosen, "sig")
    members = staged(in_blocks(members, F.sum("n"), block_grams).select("center", "sig", "key", "lo", "hi"), "star-members")
    # By partitions of the key at every size: members grow with the documents, so they are never broadcast.
    groups = texts.select("key", "text").join(members.hint("merge"), "key").groupBy("center", "lo", "hi")
    links = staged(groups.applyInArrow(_joining(k, percent, classes), "a long, b long"), "ngram-links")
    labels = components(links)
    # One row for each set up to the last join, so that copies are few rows; that join and the one by label need no
    # partitioning after them, so that Spark may split their large partitions.
    sets = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("sig", "set")
    labelled = sets.join(labels, sets.set == labels.node, "left").select("set", "first_id", F.coalesce("label", "set").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("least")).withColumnRenamed("label", "of")
    named = labelled.join(least, F.col("label") == F.col("of")).select("set", "label", "least")
    out = rows.join(named, (F.col("n") > 0) & (F.col("sig") == F.col("set")), "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("sig").alias("class_id"), F.coalesce("label", "sig").alias("label"), "key")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last), then of the least hash of its text.

    Rows without words are no one's copies and stay, but rows with equal doc_id and text are one. Columns stay as they are.
    """
    found = staged(jaccard_components(docs, k, percent, **options), "components")
    chosen = found.where("n_shingles > 0").groupBy("label").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("chosen_key")).select("chosen_key")
    chosen = chosen.unionByName(found.where("n_shingles = 0").select(F.col("key").alias("chosen_key"))).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", text_or_empty()).alias("key"))
    return rows.join(chosen, F.col("key") == F.col("chosen_key"), "left_semi").dropDuplicates(["key"]).select("row.*")
