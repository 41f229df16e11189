"""Document chunks, text vectors and top-k similarity."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.functions.text import learning_title, retrieval_question
from tickwarden.operators.series import best_rows

CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
SEPARATORS = ("\n\n", "\n", " ", "")
BATCH = 1024  # questions scored together
SCORED = 2048  # rows scored at a time


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator; each piece keeps the separator it starts with."""
    if separator == "":
        return list(text)
    starts = [0] + [m.start() for m in re.finditer(re.escape(separator), text)]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)]) if b > a]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to `size`, then start again from the last `overlap` characters' pieces."""
    window: deque[str] = deque()
    total = 0
    for piece in pieces:
        if window and total + len(piece) > size:
            yield "".join(window)
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(window.popleft())
        window.append(piece)
        total += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of one document: paragraphs, then lines, words and characters where a piece is still too long."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    fitting: list[str] = []

    def flush():
        out.extend(c for c in (chunk.strip() for chunk in _pack(fitting, size, overlap)) if c)
        fitting.clear()

    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        flush()
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    flush()
    return out


def chunk(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """(key, chunk_no, source, text): whole documents in, every chunk out."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return docs.select(key, "source", F.posexplode(split("text")).alias("chunk_no", "text"))


def chunk_fixed(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, key: str = "doc_id") -> DataFrame:
    """Fixed-stride chunks in column expressions."""
    stride = size - overlap
    last = F.greatest(F.ceil((F.length("text") - overlap) / stride).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), last - 1), lambda n: F.substring(F.col("text"), n * stride + 1, F.lit(size)))
    return docs.where(F.length("text") > 0).select(key, "source", F.posexplode(parts).alias("chunk_no", "text"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and documents per source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


def sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct()


def learning_documents(summaries: DataFrame) -> DataFrame:
    """Resolved incident summaries (doc_id, summary) as documents to chunk."""
    return summaries.select("doc_id", learning_title(F.col("summary")).alias("source"), F.col("summary").alias("text"))


def fit_vectors(chunks: DataFrame, dims: int = 1 << 12) -> PipelineModel:
    """Term frequencies weighted by rarity, unit length."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vector", p=2.0),
    ]).fit(chunks)


def vectors(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add `embedding`; rows keep their other columns."""
    out = model.transform(rows)
    return out.withColumn("embedding", vector_to_array("_vector", "float32")).drop("_words", "_tf", "_idf", "_vector")


def relevance(cosine: np.ndarray) -> np.ndarray:
    """Score of unit vectors from their squared distance."""
    return 1.0 - (2.0 - 2.0 * cosine) / np.sqrt(2.0)


def top_k(questions: DataFrame, corpus: DataFrame, k: int = 3, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The `k` most similar corpus rows per question: (query, key, score, rank). Ties go to the smaller key.

    Questions are dealt by hash into batches of about BATCH; every task scores its rows against one batch after another
    and keeps k rows per question, so only k rows per question and task are shuffled. A batch is all a task holds.
    """
    kinds = dict(questions.dtypes), dict(corpus.dtypes)
    schema = f"`{query}` {kinds[0][query]}, `{key}` {kinds[1][key]}, score double"
    batches = max(1, -(-questions.count() // BATCH))
    found = None
    for n in range(batches):
        asked = questions.where(F.pmod(F.xxhash64(query), F.lit(batches)) == n).select(query, "embedding").collect()
        if asked or n == 0:
            part = corpus.select(key, "embedding").mapInPandas(_score(asked, query, key, k), schema)
            found = part if found is None else found.unionByName(part)
    ranked = best_rows(found, [query], [F.round("score", 9).desc(), F.col(key)], k)
    return ranked.withColumn("score", F.round("score", 4))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _score(asked: list, query: str, key: str, k: int):
    """The task's part of a search: its k best rows for each question of one batch."""
    names = [r[query] for r in asked]
    matrix = _unit(np.array([r["embedding"] for r in asked], dtype=float)) if asked else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, kept = None, None  # (question, place): the best so far, best first
        for pdf in parts if asked else ():
            for at in range(0, len(pdf), SCORED):
                rows = pdf.iloc[at:at + SCORED]
                cosine = matrix @ _unit(np.stack(rows["embedding"].to_numpy()).astype(float)).T
                if keys is None:
                    keys, kept = np.empty((len(names), 0), dtype=rows[key].dtype), np.empty((len(names), 0))
                # Keys of any type are compared by their place among those at hand.
                ordered, places = np.unique(np.concatenate([keys.ravel(), rows[key].to_numpy()]), return_inverse=True)
                held, own = places[:keys.size].reshape(keys.shape), places[keys.size:]
                both = np.concatenate([held, np.broadcast_to(own, cosine.shape)], axis=1)
                kept = np.concatenate([kept, cosine], axis=1)
                order = np.lexsort((both, -kept.round(12)), axis=1)[:, :k]
                keys, kept = ordered[np.take_along_axis(both, order, 1)], np.take_along_axis(kept, order, 1)
        if keys is not None:
            yield pd.DataFrame({query: np.repeat(np.array(names, dtype=object), keys.shape[1]), key: keys.ravel(), "score": relevance(kept).ravel()})

    return run


def incident_questions(anomalies: DataFrame) -> DataFrame:
    """One question per incident, from its first anomaly."""
    first = anomalies.groupBy("incident_id").agg(F.min_by("metric", F.struct("ts", "seq")).alias("metric"))
    return first.select("incident_id", "metric", retrieval_question(F.col("metric")).alias("text"))


def incident_context(anomalies: DataFrame, chunks: DataFrame, model: PipelineModel, k: int = 3) -> DataFrame:
    """Top chunks per incident joined by newline. Questions are asked once per distinct text."""
    asked = incident_questions(anomalies)
    distinct = vectors(model, asked.select("text").distinct().withColumn("query_id", F.col("text")))
    corpus = vectors(model, chunks.withColumn("vec_id", F.concat_ws("/", "doc_id", "chunk_no")))
    hits = top_k(distinct, corpus, k).join(
        chunks.select(F.concat_ws("/", "doc_id", "chunk_no").alias("vec_id"), F.col("text").alias("content")), "vec_id"
    )
    context = hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda e: e["content"]), "\n").alias("context")
    )
    return asked.join(context, asked["text"] == context["query_id"], "left").select("incident_id", "text", "context")
