"""Queries of the training-data operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsim.llm import (
    bpe,
    chat,
    collocations,
    kmeans,
    langid,
    licences,
    linededup,
    mixing,
    neardup,
    simhash,
    sketch,
    tokencount,
    urlfilter,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    """Register under the function's name."""
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op9_bpe(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return bpe.token_digests(table(spark, sf_dir, "documents"))


@query
def op1_token_counts(spark, sf_dir):
    """Words and greedy longest-match tokens of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark, sf_dir):
    """Size, target and words taken of every document in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


SQL["op8_mixing"] = mixing.MIX_SQL


@query
def op5_chat(spark, sf_dir):
    """Turns, loss mask and length of every formatted conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    rows = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    return chat.conversation_digests(chat.format_records(chat.turn_records(rows)))


SQL["op5_chat"] = chat.CHAT_SQL


@query
def op2_langid(spark, sf_dir):
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict_languages(docs.select("doc_id", "text"), profiles)
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


#: Fixed rules of the url query.
URL_RULES = (
    ("net/", urlfilter.BLOCK),
    ("example.net/en/", urlfilter.ALLOW),
    ("example.com/de/", urlfilter.BLOCK),
    ("org/fr/", urlfilter.ALLOW),
)


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the label of the document that the last number of their path names."""
    labels = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")).alias("bad"))
    )
    number = F.regexp_extract(urlfilter.path_of(F.col("url")), r"([0-9]{1,18})[^/0-9]*/?$", 1)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.nullif(number, F.lit("")).cast("long").alias("shown")
    )
    return pages.join(labels, pages.shown == labels.doc_id, "left").select("page_id", "url", "bad")


@query
def op7_urlfilter(spark, sf_dir):
    """Rule, template and verdict of every page's url."""
    return urlfilter.judge(labelled_pages(spark, sf_dir), URL_RULES)


@query
def op3_neardup(spark, sf_dir):
    """Links and component of every vector at cosine 0.95."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_linededup(spark, sf_dir):
    """Lines of every document that repeat an earlier line, exactly or nearly."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query
def op6_fingerprints(spark, sf_dir):
    """Fingerprint of every document and its likeness to an edited text and a neighbour."""
    return sketch.sketch_edits(table(spark, sf_dir, "documents"))


@query
def op12_centroids(spark, sf_dir):
    """Cluster, distance and inertia of every vector after three rounds over 16 centroids."""
    return kmeans.cluster_report(table(spark, sf_dir, "embeddings"))


SQL["op12_centroids"] = kmeans.CLUSTER_SQL


@query
def op11_licences(spark, sf_dir):
    """Licence phrases, labels and stated expressions of every document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark, sf_dir):
    """The first 2000 phrases of each language by their score."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = collocations.COLLOCATION_SQL
