"""Near-duplicates by SimHash fingerprints, found through chains of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.graph import components
from tickwarden.llm.linking import connect, parity
from tickwarden.llm.words import lower_words
from tickwarden.session import cut

SEED = 42
BLOCK = 1 << 16  # shingles whose bits are unpacked at a time
ROWS = 256  # texts held as Python strings at a time
PAIRED = 256  # members of a chain key up to which they are compared with each other


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits over the XXH64 hashes of all shingles, repeats included; fewer words make one shingle, none zero."""
    w = lower_words(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(width)])) if len(w) >= width else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, print) with the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("print", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, ROWS):
                found += [fingerprint(t, width) for t in batch.column(1).slice(at, ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype="u8").view("i8"))], names=["key", "print"])

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(work, schema)


RADIUS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, width) on a ring; one more than differing bits


def ring(radius: int) -> tuple[tuple[int, int], ...]:
    """radius + 1 nearly equal segments of 64 bits."""
    if radius == RADIUS:
        return SEGMENTS
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return tuple((lo, hi - lo) for lo, hi in zip(ends, ends[1:]))


def _segment(value: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1))


def chain_ok(difference: Column, radius: int = RADIUS) -> Column:
    """Some start whose chains of 1, 2, ... segments differ in at most length * radius / segments bits."""
    segments = ring(radius)
    count = [F.bit_count(_segment(difference, p)) for p in segments]
    n = len(segments)
    out = F.lit(False)
    for i in range(n):
        sums, ok = F.lit(0), F.lit(True)
        for length in range(1, n + 1):
            sums = sums + count[(i + length - 1) % n]
            ok = ok & (sums <= length * radius // n)
        out = out | ok
    return out


def filings(fp: Column, radius: int = RADIUS) -> Column:
    """array<(key, probe)>: for each start the key of the first two segments, and it with each set bit of the second cleared."""
    segments = ring(radius)

    def of_start(i: int) -> Column:
        first, second = segments[i], segments[(i + 1) % len(segments)]
        own = _segment(fp, second)
        key = _segment(fp, first) * (1 << second[1]) + own + F.lit(i << 50)
        bits = F.filter(F.array(*[F.lit(1 << j) for j in range(second[1])]), lambda b: own.bitwiseAND(b) != 0)
        cleared = F.transform(bits, lambda b: F.struct((key - b).alias("key"), F.lit(1).alias("probe")))
        return F.concat(F.array(F.struct(key.alias("key"), F.lit(0).alias("probe"))), cleared)

    return F.concat(*[of_start(i) for i in range(len(segments))])


def close_pairs(members: DataFrame, radius: int, *by: str) -> DataFrame:
    """(by, a, b): members of one key that pass the chains and lie within the radius. `members`: by, key, probe, print."""
    grouped = members.groupBy(*by, "key").agg(F.collect_list(F.struct("probe", "print")).alias("ms"))

    def partners(x: Column, ms: Column) -> Column:
        difference = lambda y: y["print"].bitwiseXOR(x["print"])
        near = F.filter(ms, lambda y: ((y["probe"] == 1) | (y["print"] > x["print"])) & (y["print"] != x["print"])
                        & chain_ok(difference(y), radius) & (F.bit_count(difference(y)) <= radius))
        return F.transform(near, lambda y: F.struct(x["print"].alias("a"), y["print"].alias("b")))

    filed_here = F.filter("ms", lambda x: x["probe"] == 0)
    return grouped.select(*by, F.inline(F.flatten(F.transform(filed_here, lambda x: partners(x, F.col("ms"))))))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within two bits, or as many of them as connect the same ones.

    The 64 bits fall into three segments on a ring. If two fingerprints differ in at most two bits, then from some
    segment on, every chain of consecutive segments keeps within its proportional budget: the first segment is equal and
    the first two differ in one bit at most. So a fingerprint is filed, for each start, under its first two segments, and
    looked up there with each one of the second segment's set bits cleared; of two that differ in that bit, one has it
    set. Candidates must pass the longer chains before all bits are compared.

    Members of a key with more than PAIRED are not compared with each other. They share two whole segments, so filing
    each under the third with none or one bit flipped links all that lie within two bits through one member each, at a
    cost in proportion to the members.
    """
    fp, n = F.col("print"), len(SEGMENTS)

    rows = prints.select(fp, F.inline(filings(fp))).repartition("key")
    live = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("least")).filter("n > 1 and least = 0").select("key", "n")
    members = cut(rows.join(live, "key"))
    compared = close_pairs(members.filter(F.col("n") <= PAIRED), RADIUS)

    start, zero = F.shiftrightunsigned("key", 50), F.array(F.lit(0).cast("long"))
    rest, flips = F.lit(None).cast("long"), zero
    for i in range(n):
        last = SEGMENTS[(i + 2) % n]
        rest = F.when(start == i, _segment(fp, last)).otherwise(rest)
        flips = F.when(start == i, F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(last[1])])).otherwise(flips)
    flips = F.when(F.col("probe") == 1, zero).otherwise(flips)  # a member that was looked up has spent one bit
    starred = members.filter(F.col("n") > PAIRED).select(fp, F.col("key"), rest.alias("bits"), F.explode(flips).alias("flip"))
    starred = starred.select("print", "key", F.col("bits").bitwiseXOR(F.col("flip")).alias("rest"))
    lowest = starred.groupBy("key", "rest").agg(F.min("print").alias("low"))
    stars = starred.join(lowest, ["key", "rest"]).filter("print <> low").select(F.col("low").alias("a"), F.col("print").alias("b"))
    return compared.union(stars)


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    Fingerprints at two or fewer differing bits are linked; component_id is the smallest key of the component.
    Equal fingerprints are brought together first, so copies cost one row in the search. Null and empty texts, and texts
    of white space, have fingerprint zero and are linked like any other. Null keys take no part in the smallest key but
    get it; where all are null it is null. Repeated rows are kept. No rows give no rows.
    """
    printed = cut(fingerprints(docs, key, text, width))
    prints = cut(printed.groupBy("print").agg(F.min("key").alias("least")))
    roots = cut(components(cut(links(prints.select("print")))))
    linked = roots.join(prints, roots["node"] == prints["print"])
    lowest = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_print = linked.join(lowest, "root").select("print", "component")
    classes = prints.join(of_print, "print", "left").select("print", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return printed.join(classes, "print").select(F.col("key").alias(key), shown.alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, set_id, bands, bits, shingles): of each text the set of its shingles and keys of its MinHash bands.

    shingles: 32-bit hashes of the different shingles, in order; set_id: their XXH64; bits: their parity bitmap. bands are
    BANDS keys of disjoint groups of BAND minima; a text without words has none.
    """
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("set_id", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.IntegerType())),
    ])
    count = BANDS * BAND

    def sketch(t: str | None, factors: np.ndarray, shifts: np.ndarray) -> tuple[int, list[int], bytes, np.ndarray]:
        w = lower_words(t)
        joined = set(map(b" ".join, zip(*[w[i:] for i in range(width)]))) if len(w) >= width else {b" ".join(w)} if w else set()
        hashes = np.unique(np.fromiter((xxhash.xxh32_intdigest(s) for s in joined), dtype="<u4", count=len(joined)))
        least = np.full(count, 2**64 - 1, dtype="<u8")
        for at in range(0, len(hashes), BLOCK // count):
            part = hashes[at:at + BLOCK // count].astype("<u8")
            np.minimum(least, (factors * part + shifts).min(axis=1), out=least)
        bands = (least >> np.uint64(32)).astype("<u4").reshape(BANDS, BAND)
        keys = [xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(bands)] if len(hashes) else []
        return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), keys, parity(hashes.astype("<u8")), hashes.view("<i4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = np.random.default_rng(SEED).integers(0, 2**64, (2, count, 1), dtype="<u8")
        factors, shifts = drawn[0] | np.uint64(1), drawn[1]
        longs = lambda lists: pa.array([np.array(x, dtype="u8").view("i8") for x in lists], pa.list_(pa.int64()))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = [sketch(t, factors, shifts) for t in batch.column(1).slice(at, ROWS).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, ROWS), pa.array(np.array([f[0] for f in found], dtype="u8").view("i8")),
                    longs(f[1] for f in found), pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.list_(pa.int32()))], names=schema.names)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(work, schema)


BAND, BANDS = 5, 24  # minima a key, keys a text: two of similarity 0.8 share a key but for (1 - 0.8^5)^24 = 0.00007 of them


def shared(filed: DataFrame) -> DataFrame:
    """Rows of keys that more than one set has."""
    return filed.join(filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")


def similar_pairs(pairs: DataFrame, held: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The (a, b) whose shingles, compared in full, are similar enough; similarity is a fraction."""
    side = lambda name: held.select(F.col("set_id").alias(name), F.col("shingles").alias("s" + name))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in range(batch.num_rows):
                x, y = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("sa", "sb"))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(similarity[1] * common >= similarity[0] * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(key, component_id) for every row: texts linked where the Jaccard similarity of their shingles is large enough.

    Texts with the same shingles count as one. Others are candidates if they share one of their BANDS keys; a candidate's
    shingles are compared in full unless its parity bitmap rules the similarity out. Members of a key that are connected
    already need no comparison, so that a group of copies costs in proportion to its size; no pair of a key is left out
    otherwise (`linking.connect`).

    Texts of fewer words than a shingle are one shingle; null texts and texts without words are alike. component_id is the
    smallest key of the component; null keys come first where keys are structs and take no part otherwise. Repeated rows
    are kept. No rows give no rows.
    """
    rows = cut(sketches(docs, key, text, width))
    sets = cut(rows.groupBy("set_id").agg(F.min("key").alias("least"), F.first("bands").alias("bands")))
    filed = cut(shared(sets.select("set_id", F.explode("bands").alias("key"))))
    # One row of each set: the one with the set's smallest key.
    chosen = filed.select("set_id").distinct().join(sets.select("set_id", F.col("least").alias("chosen")), "set_id")
    held = rows.join(chosen, "set_id").filter(F.col("key").eqNullSafe(F.col("chosen"))).groupBy("set_id").agg(
        F.first(F.size("shingles")).alias("size"), F.first("bits").alias("bits"), F.first("shingles").alias("shingles"))
    held = cut(held)
    roots = connect(filed.select("key", "set_id"), held.select("set_id", "size", "bits"), similarity, lambda pairs: similar_pairs(pairs, held, similarity))
    linked = roots.join(sets.select("set_id", "least"), roots["node"] == F.col("set_id"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("low"))
    classes = sets.select("set_id", "least").join(linked.join(lowest, "root").select("set_id", "low"), "set_id", "left").select(
        "set_id", F.when(F.col("low").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    return rows.select("key", "set_id").join(classes, "set_id").select(F.col("key").alias(key), "component_id")
