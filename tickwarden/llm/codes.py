"""Short codes of vectors: each part of a vector is named by its nearest codebook entry, found by slicing and intersecting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.session import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2  # entries of a codebook are the bits of one uint64
SCALE = 256
FARTHEST = 1 << 26  # integers end here, so that sums of squares stay in 64 bits
ROWS = 4096  # vectors compared at a time


class Slices:
    """A codebook of at most 64 points: per dimension its sorted coordinates, with a mask of the entries before each place."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        self.before = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
        self.before[1:] = np.bitwise_or.accumulate(np.uint64(1) << self.order.astype(np.uint64), axis=0)

    def distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.entries[at]
        return np.einsum("ij,ij->i", gap, gap)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A distance within which each point surely has an entry: that to the best of its next ones by single coordinates."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        for j in range(x.shape[1]):
            place = np.minimum(np.searchsorted(self.sorted[:, j], x[:, j]), len(self.entries) - 1)
            least = np.minimum(least, self.distance(x, self.order[place, j]))
        return np.floor(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ by at most the radius in every coordinate, so of all within that distance."""
        masks = np.full(len(x), ~np.uint64(0))
        for j in range(x.shape[1]):
            first = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            last = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            masks &= self.before[last, j] ^ self.before[first, j]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, the lower index of equal ones."""
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64)
        masks, live = self.candidates(x, self.radius(x)), np.arange(len(x))
        while len(live):
            lowest = masks & (~masks + np.uint64(1))
            entry = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            found = self.distance(x[live], entry)
            nearer = found < best[live]
            best[live[nearer]], at[live[nearer]] = found[nearer], entry[nearer]
            masks ^= lowest
            more = masks != 0
            masks, live = masks[more], live[more]
        return at, best


def _parts(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """(rows, parts, positions) of ROWS vectors at a time."""
    for at in range(0, len(column), ROWS):
        values = column.slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield values.reshape(-1, PARTS, width // PARTS)


def whole_numbers(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, v) of the rows whose vector is neither null nor empty and holds finite numbers only."""
    unusable = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(float(-FARTHEST))), F.lit(float(FARTHEST)))).cast("int")
    kept = df.filter(F.col(vector).isNotNull() & ~unusable & (F.size(vector) > 0))
    return kept.select(df[key].alias("key"), df[label].alias("label"), F.transform(vector, whole).alias("v"))


def start(kept: DataFrame) -> np.ndarray | None:
    """(part, entry, position): the parts of the vectors of the ENTRIES smallest keys; None without vectors."""
    smallest = kept.select("key").distinct().orderBy(F.col("key").asc_nulls_last()).limit(ENTRIES)
    chosen = kept.join(F.broadcast(smallest.withColumnRenamed("key", "first")), F.col("key").eqNullSafe(F.col("first")), "left_semi")
    rows = chosen.groupBy("key").agg(F.min("v").alias("v")).orderBy(F.col("key").asc_nulls_last()).collect()
    if not rows or len(rows[0]["v"]) % PARTS:
        return None
    usable = [r["v"] for r in rows if len(r["v"]) == len(rows[0]["v"])]
    return np.array(usable, dtype=np.int64).reshape(len(usable), PARTS, -1).transpose(1, 0, 2)


def improve(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of the means of the parts nearest to them; entries without parts stay.

    Each task adds up its own parts; at most PARTS * ENTRIES sums of a task are shuffled, as many reach the driver.
    """
    parts, entries, size = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for x in _parts(batch.column(0), parts * size):
                for p in range(parts):
                    at, _ = slices[p].nearest(x[:, p])
                    np.add.at(sums[p], at, x[:, p])
                    counts[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(part.astype("i4")), pa.array(entry.astype("i4")), pa.array(counts[part, entry]),
            pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = kept.select("v").mapInArrow(work, "part int, entry int, n long, sums array<bigint>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(size)]).alias("sums"))
    better = books.copy()
    for r in found.collect():
        better[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return better


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector.

    Components become floor(256 * x). A vector is cut into 16 equal parts. Each part position has a codebook, which starts
    with that part of the vectors of the 64 smallest keys and is improved twice (`improve`). code holds, for each part,
    the nearest entry in two hex digits; error is the sum of squared distances, label_error its sum over the vectors of
    equal label (nulls are one label); the checksum is of all entries' numbers in order.

    The nearest entry is exact: the distance to some entry is the radius; in each dimension, the entries within it are a
    range of the sorted coordinates and so the difference of two prefix masks; the masks of all dimensions are ANDed, and
    what is left is measured in full, ties to the lower index.

    Rows are left out if the vector is null, empty or of another length than that of the smallest key, or holds null, NaN
    or infinite numbers. If that length is no multiple of 16, nothing can be cut and no row is returned. Numbers beyond
    2^18 count as 2^18. Null keys come last; of rows that repeat a key all are encoded, and the smallest vector starts the
    codebook. Fewer than 64 keys give fewer entries. No rows give no rows.
    """
    kept = cut(whole_numbers(df, key, vector, label))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                           T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    books = start(kept)
    if books is None:
        return df.sparkSession.createDataFrame([], schema)
    parts, entries, size = books.shape
    kept = kept.filter(F.size("v") == parts * size)
    for _ in range(ROUNDS):
        books = improve(kept, books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            codes, errors = [], [np.zeros(0, dtype=np.int64)]
            for x in _parts(batch.column(2), parts * size):
                found = [slices[p].nearest(x[:, p]) for p in range(parts)]
                codes += [c.tobytes().hex() for c in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
                errors.append(np.sum([f[1] for f in found], axis=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], names=["key", "label", "code", "error"])

    fields = [kept.schema["key"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    coded = cut(kept.select("key", "label", "v").mapInArrow(work, T.StructType(fields)))
    # Sums of labels that hold a hundredth of all rows, at most 100 of them, are broadcast; all others are joined.
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"), F.count("*").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(sums.filter(F.col("n") * 100 >= total).select("of", "all"))
    same = F.col("label").eqNullSafe(F.col("of"))
    told = coded.join(common, same).select("key", "code", "error", "all").union(
        coded.join(common, same, "left_anti").join(sums.filter(F.col("n") * 100 < total), same).select("key", "code", "error", "all"))
    checksum = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return told.select(F.col("key").alias(key), "code", "error", F.least(F.col("all"), F.lit(2**63 - 1)).cast("long").alias("label_error"), F.lit(checksum).alias("codebooks_sha256"))
