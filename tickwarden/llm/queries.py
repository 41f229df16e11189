"""The registered queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.llm import codes, html, jaccard, langid, lm, mixing, oracles, packing, phrases, quality, simhash, topk, toxicity, urls
from tickwarden.llm.words import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", oracles.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op2_lm_scores")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lm.held_out(F.col("doc_id"))
    return lm.score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_simhash_clusters")
def simhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.rate(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op5_mix_sources", oracles.MIX)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = mixing.cut(docs.select("doc_id", "source", F.size(mixing.words(docs["text"])).cast("long").alias("size")))
    mixed = mixing.mix(sized, size="size")
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op6_pack_sequences")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_topk_search", oracles.TOP_K)
def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op8_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


# Rules over host and path, and what they say.
PLACE_RULES = [
    urls.place_rule("allow", "com/"), urls.place_rule("block", "example.com/en/"), urls.place_rule("allow", "www.example.com/en/"),
    urls.place_rule("block", "net/es/"), urls.place_rule("block", "net/fr/"),
]


@query("op10_url_filters", oracles.URLS)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), PLACE_RULES + urls.UNWANTED_RULES)


@query("op11_vector_codes", oracles.CODES)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))


@query("op12_phrase_mining", oracles.PHRASES)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@query("op13_jaccard_join", oracles.JACCARD)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))
