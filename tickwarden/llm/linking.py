"""Classes of similar sets, from keys that similar sets share: few candidates are compared, and no link is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.graph import components
from tickwarden.session import cut

BITS = 2048  # of a set's parity bitmap
BLOCK = 512  # members of a key that one task compares with each other or with as many others
TURNS = 3  # times each member meets one candidate of a key before all that are left are compared
CHUNK = 32  # rows of a block's matrix of differences at a time
SMALL = 500_000  # set ids (8 bytes each) up to which they are broadcast; beyond, they are joined


def parity(hashes: np.ndarray) -> bytes:
    """For each of BITS buckets, whether an odd number of the hashes falls into it.

    Where two sets' bitmaps differ there is an element that only one of them has, so the number of differing bits is at
    most the number of such elements.
    """
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def allowed(x: Column, y: Column, similarity: tuple[int, int]) -> Column:
    """Elements that only one of two sets of these sizes may have; similarity is a fraction (numerator, denominator)."""
    top, bottom = similarity
    return F.floor((bottom - top) * (x.cast("long") + y) / F.lit(bottom + top))


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of `df` whose id is among the different `ids`."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, on, "left_semi")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (key, x, y) after the other; batches come sorted by them."""
    left: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        at = np.stack([now.column(c).to_numpy() for c in ("key", "x", "y")], axis=1)
        ends = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        starts = [0, *ends.tolist()]
        for lo, hi in zip(starts, starts[1:]):
            yield now.slice(lo, hi - lo)
        left = now.slice(starts[-1])
    if left is not None and left.num_rows:
        yield left


def _differing(bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, differing bits of these rows with all) of a block's bitmaps."""
    for at in range(0, len(bits), CHUNK):
        yield at, np.bitwise_count(bits[at:at + CHUNK, None] ^ bits[None]).sum(axis=2, dtype=np.int64)


def candidates(live: DataFrame, sets: DataFrame, similarity: tuple[int, int], everything: bool) -> DataFrame:
    """(a, b): members of one key that lie in different components and whose bitmaps allow the similarity.

    `live`: key, set_id, comp, n (members of the key). Keys of more than BLOCK members are dealt into blocks, and each
    block meets each other one in a task of its own. Unless `everything` is asked for, each member gives one candidate
    only, the smallest one.
    """
    top, bottom = similarity
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", "set_id"), parts).cast("int")
    dealt = live.select("key", "set_id", "comp", parts.alias("parts"), own.alias("own")).select(
        "key", "set_id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.join(sets.select("set_id", "size", "bits"), "set_id").select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "set_id", "comp", "size", "bits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, order = block.column("set_id").to_numpy(), np.argsort(block.column("set_id").to_numpy())
            ids, comp = ids[order], block.column("comp").to_numpy()[order]
            size, own = block.column("size").to_numpy()[order].astype(np.int64), block.column("own").to_numpy()[order]
            bits = np.stack([np.frombuffer(block.column("bits")[i].as_py(), dtype="<u8") for i in order])
            across = block.column("x")[0] != block.column("y")[0]
            found = []
            for at, differing in _differing(bits):
                rows = slice(at, at + CHUNK)
                near = differing <= (bottom - top) * (size[rows, None] + size[None]) // (bottom + top)
                near &= comp[rows, None] != comp[None]
                if across:
                    near &= own[rows, None] != own[None]
                if everything:
                    i, j = np.nonzero(np.triu(near, at + 1))
                else:
                    i = np.flatnonzero(near.any(axis=1))
                    j = near[i].argmax(axis=1)
                found.append(np.stack([np.minimum(i + at, j), np.maximum(i + at, j)], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])

    # Groups are sorted, not gathered: a task holds one block at a time.
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(work, "a long, b long").distinct()


def _sized(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b, sa, sb): the pairs whose bitmaps allow the similarity."""
    side = lambda name: sets.select(F.col("set_id").alias(name), F.col("size").alias("s" + name), F.col("bits").alias("bits_" + name))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            total = batch.column("sa").to_numpy().astype(np.int64) + batch.column("sb").to_numpy()
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (similarity[1] - similarity[0]) * total // (similarity[1] + similarity[0])
            yield batch.select(["a", "b", "sa", "sb"]).filter(pa.array(near))

    return joined.select("a", "b", "sa", "sb", "bits_a", "bits_b").mapInArrow(work, "a long, b long, sa int, sb int")


def connect(filed: DataFrame, sets: DataFrame, similarity: tuple[int, int], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root): components of the sets by all similar pairs that share a key.

    `filed`: different (key, set_id) of keys with two members or more; `sets`: set_id, size, bits. `verify` takes
    (a, b, sa, sb) and returns the (a, b) that are similar. First each key's members meet its smallest one: a group of
    copies is connected at a cost in proportion to its members, and a key of two is settled. Keys whose members then
    still lie in several components go on: bitmaps tell nearly all dissimilar members apart inside a block, without a row
    for each pair; of what they leave, each member meets its smallest candidate, a few times over; at last all candidates
    that still lie in different components are compared. So no similar pair of a key stays unconnected.
    """
    key_sizes = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("hub"))
    placed = cut(filed.join(key_sizes, "key"))
    hubs = placed.filter("set_id <> hub").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()
    done = cut(hubs)
    roots = cut(components(verify(cut(_sized(done, sets, similarity)))))
    members = placed.filter("n > 2").select("key", "n", "set_id")
    for turn in range(TURNS + 1):
        comp = members.join(roots, members["set_id"] == roots["node"], "left").select("key", "n", "set_id", F.coalesce("root", "set_id").alias("comp"))
        comp = cut(comp)
        apart = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        live = cut(comp.join(apart, "key"))
        if live.isEmpty():
            break
        members = live.select("key", "n", "set_id")
        found = cut(candidates(live, sets, similarity, turn == TURNS).join(done, ["a", "b"], "left_anti"))
        edges = cut(verify(cut(_sized(found, sets, similarity))))
        if edges.isEmpty() and turn < TURNS:
            # The smallest candidates are settled: compare whatever else is left.
            done = cut(done.union(found))
            found = cut(candidates(live, sets, similarity, True).join(done, ["a", "b"], "left_anti"))
            edges = cut(verify(cut(_sized(found, sets, similarity))))
            turn = TURNS
        roots = cut(components(edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        if turn == TURNS:
            break
        done = cut(done.union(found))
    return roots
