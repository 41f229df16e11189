"""Exact top-k inner products: vectors in length buckets, pruned by length or by one coordinate, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.session import cut

BUCKET = 4096  # vectors in one block of a length bucket, about
QUERIES = 512  # queries in one block, about
LENGTHS = 64  # length buckets
RANGES = 16  # ranges of the length that queries need
SEEDS = 4096  # longest vectors that give each query its first lower bound
SLACK = 1e-9  # against rounding in the bounds; products themselves are exact
COORDINATE_FROM = 0.2  # local cosine from which a coordinate prunes better than length alone
EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v array<long>, norm): floor(scale * x) of each usable vector, padded with zeros to the longest one."""
    x = F.col("x")
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    rows = rows.select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    rows = cut(rows.withColumn("norm", norm))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.select("id", padded.alias("v"), "norm")


def _part(count: Column, most: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.ceil(count / F.lit(float(most))).cast("long"))


def _bucket(rows: DataFrame, by: str, buckets: int) -> Column:
    """Number of the range of `by` that a row falls into, of up to `buckets` that hold about as many rows each."""
    edges = rows.agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(by))) if edges else F.lit(0)


def vector_blocks(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """(blocks, buckets): vectors of similar length, in blocks of about BUCKET; and each bucket's number, blocks and longest.

    Blocks are keyed by (bucket, part); many vectors of equal length are dealt out by a hash of the id.
    """
    placed = rows.withColumn("bucket", _bucket(rows, "norm", LENGTHS))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top"))
    known = [(r["bucket"], -(-r["n"] // BUCKET), r["top"]) for r in counts.collect()]  # LENGTHS rows at most
    fine = placed.join(counts.select("bucket", "n"), "bucket").withColumn("part", _part(F.col("n"), BUCKET))
    got = fine.groupBy("bucket", "part").agg(F.collect_list(F.struct("id", "v")).alias("r"), F.max("norm").alias("longest"))
    return got.select("bucket", "part", F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"), "longest"), known


def query_blocks(asked: DataFrame) -> DataFrame:
    """(q_ids, q_flat, bounds, need): queries that need similar lengths, in blocks of about QUERIES.

    A block needs what its least demanding query does, so one such query opens blocks for its like only.
    """
    placed = asked.withColumn("range", _bucket(asked, "need", RANGES))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    fine = placed.join(counts, "range").withColumn("part", _part(F.col("n"), QUERIES))
    got = fine.groupBy("range", "part").agg(F.collect_list(F.struct("id", "v", "bound")).alias("r"), F.min("need").alias("need"))
    return got.select(F.col("r.id").alias("q_ids"), F.flatten("r.v").alias("q_flat"), F.col("r.bound").alias("bounds"), "need")


def longest(rows: DataFrame, most: int) -> DataFrame:
    """(id, v) of the `most` longest vectors, ties to the smaller id.

    Every task offers up to `most` rows of its own. They are merged by a task, not by the driver, and only from a length on
    that about `most` vectors reach, so that what is offered does not grow with the number of tasks.
    """
    n = rows.count()
    share = (most + n / 2500) / n if n else 1.0  # percentiles of this accuracy are n / 10000 places off at most
    if share < 1.0:
        least = rows.agg(F.percentile_approx("norm", 1.0 - share, 10000)).first()[0]
        rows = rows.filter(F.col("norm") >= least)
    return cut(rows.orderBy(F.col("norm").desc(), "id").limit(most).select("id", "v"))


def _matrix(ids: pa.ListScalar, flat: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    names = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return names, flat.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(names), -1 if len(names) else 0)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; through double products where they are exact."""
    if queries.size == 0 or vectors.size == 0:
        return np.zeros((len(queries), len(vectors)), dtype=np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if bound < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return np.array(queries.astype(object) @ vectors.astype(object).T, dtype=object).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_block(q_ids, q, bounds, v_ids, v, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the up to k best vectors of the block that reach its lower bound: (place of the query, ids, scores)."""
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    v_len = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-v_len, kind="stable")
    v, v_ids, v_len = v[order], v_ids[order], v_len[order]
    unit = v / np.where(v_len > 0, v_len, 1.0)[:, None]
    longest = v_len[0] if len(v_len) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((bounds > 0) & (q_len > 0) & (longest > 0), bounds / (q_len * longest), -1.0)
    whole = np.flatnonzero(local < COORDINATE_FROM)
    sorted_axis: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def emit(i: int, places: np.ndarray, scores: np.ndarray):
        keep = (scores >= bounds[i]) & (v_ids[places] != q_ids[i])
        places, scores = places[keep], scores[keep]
        top = best(scores, v_ids[places], k)
        return i, v_ids[places[top]], scores[top]

    if len(whole):
        all_scores = products(q[whole], v)
        for at, i in enumerate(whole):
            long_enough = len(v) if local[i] < 0 else int(np.searchsorted(-v_len, -(bounds[i] / q_len[i]) * (1 - SLACK), side="right"))
            yield emit(i, np.arange(long_enough), all_scores[at, :long_enough])
    for i in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + SLACK)):
        cos = max(0.0, min(1.0, local[i] - SLACK))
        axis = int(np.argmax(np.abs(q[i])))
        lead = q[i, axis] / q_len[i]
        spread = np.sqrt(max(0.0, (1 - cos * cos) * (1 - lead * lead)))
        low = -1.0 if lead <= -cos else lead * cos - spread
        high = 1.0 if lead >= cos else lead * cos + spread
        if axis not in sorted_axis:
            by = np.argsort(unit[:, axis], kind="stable")
            sorted_axis[axis] = by, unit[by, axis]
        by, values = sorted_axis[axis]
        places = by[np.searchsorted(values, low - SLACK):np.searchsorted(values, high + SLACK, side="right")]
        places = places[v_len[places] >= (bounds[i] / q_len[i]) * (1 - SLACK)]
        yield emit(i, places, products(q[i:i + 1], v[places])[0])


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on `id`) holds for, its k best others.

    Every query block meets the vector blocks whose length can still reach the bound of one of its queries. Within a
    pair, a query's bound becomes a cosine that the block's longest vector would need: above 1 the block is out; a low
    one prunes by length alone; else the feasible range of the query's largest coordinate picks the candidates. All
    candidates get their exact product, so pruning never changes a result. First bounds come from the SEEDS longest
    vectors, a fixed number that is sent to all tasks.

    Null vectors, vectors with null or non-finite components and rows with a null id take no part. Shorter vectors are
    padded with zeros, an empty one scores 0. Rows that repeat an id count once, with the smallest vector. Ties go to the
    smaller id. Fewer than k others give all of them. Components stay below 2^57 in absolute value, scores within a long.
    """
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, key, vector, scale))
    seeds = longest(rows, SEEDS).collect()
    seed_ids = np.array([r["id"] for r in seeds], dtype=np.int64)
    seed_rows = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), len(seeds[0]["v"]) if seeds else 0)
    sent = spark.sparkContext.broadcast((seed_ids, seed_rows))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seeds_ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                q_ids = part.column("id").to_numpy()
                q = part.column("v").flatten().to_numpy().reshape(len(q_ids), -1)
                scores = products(q, seeds_)
                bounds = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    others = scores[i][ids != q_ids[i]]
                    if len(others) >= k:
                        bounds[i] = np.partition(others, len(others) - k)[len(others) - k]
                q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((bounds > 0) & (q_len > 0), bounds / q_len * (1 - SLACK), -1.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bounds), pa.array(need)], names=["id", "v", "bound", "need"])

    asked = rows.filter(queries).select("id", "v").mapInArrow(first_bounds, "id long, v array<long>, bound double, need double")
    blocks, known = vector_blocks(rows)
    buckets = F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(parts).alias("parts"), F.lit(top).alias("top")) for n, parts, top in known or [(0, 1, 0.0)]])
    # Each query block names the vector blocks of all buckets that reach its need, and meets them by equality.
    near = query_blocks(cut(asked)).withColumn("_b", F.explode(F.filter(buckets, lambda e: e["top"] >= F.col("need"))))
    near = near.select("*", F.col("_b.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("_b.parts") - 1)).alias("part")).drop("_b")
    # Their sizes are told before they are repeated per vector block, so neither side is broadcast by its size.
    pairs = near.hint("merge").join(cut(blocks), ["bucket", "part"]).filter(F.col("need") <= F.col("longest"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q = _matrix(batch.column("q_ids")[r], batch.column("q_flat")[r])
                v_ids, v = _matrix(batch.column("ids")[r], batch.column("flat")[r])
                bounds = batch.column("bounds")[r].values.to_numpy(zero_copy_only=False)
                found = list(search_block(q_ids, q, bounds, v_ids, v, k))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([np.full(len(ids), q_ids[i]) for i, ids, _ in found])),
                        pa.array(np.concatenate([ids for _, ids, _ in found])),
                        pa.array(np.concatenate([s for _, _, s in found]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
