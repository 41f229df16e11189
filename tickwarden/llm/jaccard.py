"""Similarity join of n-gram sets: the order of all n-grams is cut into fragments, and overlaps are counted in each."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.linking import connect, parity, semi
from tickwarden.llm.words import lower_words
from tickwarden.session import cut

SIMILARITY = (9, 10)
WIDTH = 3
FRAGMENTS = 16  # in which overlaps are counted
ORDER_BITS = 36  # of an n-gram's place in the order of all: 4 for its fragment, 32 inside it
ROWS = 256  # texts held as Python strings at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's different n-grams in order; fewer words are one n-gram, none give none."""
    words = np.fromiter(map(xxhash.xxh64_intdigest, lower_words(text)), dtype="<u8")
    if not len(words):
        return words
    taken = width if len(words) >= width else len(words)
    h = np.full(len(words) - taken + 1, taken, dtype="<u8")
    for i in range(taken):
        h = mix(h + words[i:len(words) - taken + 1 + i])
    return np.unique(h)


class Levels:
    """Sizes fall into classes such that similar sets lie in one class or in two next to each other."""

    def __init__(self, similarity: tuple[int, int], longest: int = 1 << 31) -> None:
        top, bottom = similarity
        self.lowest = [1]
        while self.lowest[-1] <= longest:
            self.lowest.append(self.lowest[-1] * bottom // top + 1)
        largest = [b - 1 for b in self.lowest[1:]]
        # One fragment more than n-grams in which two similar sets, the smaller one of this class, can differ.
        self.cuts = [(bottom - top) * (x + x * bottom // top) // (bottom + top) + 1 for x in largest]

    def of(self, size: int) -> list[int]:
        """The classes under which a set is filed: its own, and the one below for the smaller sets there."""
        own = bisect_right(self.lowest, size) - 1
        return [c for c in (own - 1, own) if c >= 0 and self.cuts[c] > 1]


def _segments(places: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, members) of a set's part in each of `count` equal fragments of the order; places are sorted."""
    inside = (places * np.uint64(count)) >> np.uint64(ORDER_BITS)
    ends = np.searchsorted(inside, np.arange(count + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, "<u8"), np.cumsum(mix(places + np.uint64(1)), dtype="<u8")])
    return sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)


def keys_of(places: np.ndarray, size: int, levels: Levels) -> np.ndarray:
    """Keys of which two similar sets share one at least: some fragment in which they hold the same n-grams.

    Sets that agree in a fragment only because both hold nothing there must also agree in one of a second order.
    """
    keys = []
    for level in levels.of(size):
        count = levels.cuts[level]
        seed = lambda at: mix(np.uint64(level << 32) + at.astype("<u8") + np.uint64(1))
        sums, members = _segments(places, count)
        held = np.flatnonzero(members)
        keys.append(mix(sums[held] ^ seed(held)))
        void = np.flatnonzero(members == 0)
        if len(void):
            second, _ = _segments(np.sort(mix(places + np.uint64(2)) >> np.uint64(64 - ORDER_BITS)), count)
            second = mix(second ^ seed(np.arange(count)))
            keys.append(mix(second[None] + seed(void + (1 << 31))[:, None]).ravel())
    return np.concatenate(keys) if keys else np.zeros(0, "<u8")


def sets_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, set_id, size, bits, fragments) of every row; bits and fragments are null where this task had the set already."""
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("set_id", T.LongType()), T.StructField("size", T.IntegerType()),
        T.StructField("bits", T.BinaryType()), T.StructField("fragments", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])
    inner, borders = pa.list_(pa.int32()), np.arange(FRAGMENTS + 1, dtype="<u8") << np.uint64(32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, sizes, bits, lists, ends, values = [], [], [], [0], [0], []
                none = []
                for t in batch.column(1).slice(at, ROWS).to_pylist():
                    h = grams(t, width)
                    ids.append(xxhash.xxh64_intdigest(h.tobytes()))
                    sizes.append(len(h))
                    new = ids[-1] not in seen and len(h) > 0
                    seen.add(ids[-1])
                    none.append(not new)
                    bits.append(parity(h) if new else None)
                    if new:
                        places = h >> np.uint64(64 - ORDER_BITS)
                        ends += (np.searchsorted(places, borders[1:]) + ends[-1]).tolist()
                        values.append((places & np.uint64(0xFFFFFFFF)).astype("<u4").view("<i4"))
                    lists.append(len(ends) - 1)
                flat = pa.array(np.concatenate(values) if values else np.zeros(0, "<i4"))
                parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                fragments = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), parts, type=pa.list_(inner), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, ROWS), pa.array(np.array(ids, dtype="u8").view("i8")), pa.array(sizes, pa.int32()),
                    pa.array(bits, pa.binary()), fragments], names=schema.names)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(work, schema)


def filings(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(key, set_id): the keys of each set (`keys_of`)."""
    levels = Levels(similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(FRAGMENTS, dtype="<u8") << np.uint64(32)
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, ROWS):
                found = []
                for r in range(at, min(at + ROWS, batch.num_rows)):
                    parts = batch.column(2)[r].values
                    inside = parts.flatten().to_numpy().view("<u4").astype("<u8")
                    found.append(keys_of(inside + np.repeat(base, parts.value_lengths().to_numpy()), int(sizes[r]), levels))
                keys = np.concatenate(found).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids[at:at + ROWS], [len(k) for k in found]))], names=["key", "set_id"])

    return rows.select("set_id", "size", "fragments").filter("fragments is not null").mapInArrow(work, "key long, set_id long")


def overlaps(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, sa, sb, common): common n-grams, counted in each fragment apart and summed per pair."""
    part = held.select("set_id", F.posexplode("fragments").alias("fragment", "part")).filter(F.size("part") > 0)
    side = lambda name: part.select(F.col("set_id").alias(name), "fragment", F.col("part").alias("part_" + name))
    met = pairs.join(side("b"), "b").join(side("a"), ["a", "fragment"])
    partial = met.select("a", "b", "sa", "sb", "fragment", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
    return partial.groupBy("a", "b", "sa", "sb").agg(F.sum("common").alias("common"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id) for every row: texts are linked where the Jaccard similarity of their n-grams is high enough.

    All n-grams have one order, by a hash, which is cut into fragments. Similar sets differ in few n-grams, so of one
    fragment more than these, some holds the same part of both: sets that share such a part are candidates. The number
    of fragments follows the sizes (`Levels`). Of each candidate pair, overlaps are counted in FRAGMENTS wider fragments,
    each apart, and summed. A hash orders n-grams as well as their frequency would: a key is a whole part, not one
    n-gram, so that a common passage alone makes no candidates, and no count of all n-grams must be joined back.

    Equal sets count as one. `linking.connect` leaves out pairs that are connected already, no others. Of the places in
    the order, 36 bits are compared: of two sets of 1,000 n-grams, two different ones coincide in 0.00002 of pairs.

    Fewer words than `width` are one n-gram. Null texts and texts without words have no n-gram, are linked with nothing
    and are their own component. component_id is the smallest key; null keys take no part in it but get it. Repeated rows
    are kept. No rows give no rows.
    """
    rows = cut(sets_of(docs, key, text, width))
    filed = filings(rows, similarity).repartition("key")
    several = filed.groupBy("key").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi").select("key")
    filed = cut(filed.join(several.hint("shuffle_hash"), "key").distinct())
    live = cut(filed.select("set_id").distinct())
    held = cut(semi(rows.filter("fragments is not null"), live, "set_id").groupBy("set_id").agg(
        F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fragments").alias("fragments")))
    top, bottom = similarity

    def verify(pairs: DataFrame) -> DataFrame:
        similar = bottom * F.col("common") >= top * (F.col("sa") + F.col("sb") - F.col("common"))
        return overlaps(pairs, held).filter(similar).select("a", "b")

    roots = connect(filed, held, similarity, verify)
    least = rows.filter("size > 0").groupBy("set_id").agg(F.min("key").alias("least"))
    lowest = roots.join(least, roots["node"] == least["set_id"]).groupBy("root").agg(F.min("least").alias("low"))
    of_set = roots.join(lowest, "root").select(F.col("node").alias("set_id"), "low")
    classes = least.join(of_set, "set_id", "left").select("set_id", F.coalesce("low", "least").alias("component_id"))
    return rows.join(classes, "set_id", "left").select(
        F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
