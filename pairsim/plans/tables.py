"""Pair tables derived from the test tables; every one uses the whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsim.functions import similarity as sim
from pairsim.functions.seeded import let, u01
from pairsim.functions.text import clean
from pairsim.operators.position import with_position
from pairsim.operators.vocab import word_counts
from pairsim.schema import BINARY_LABEL, LABEL, VALUE_COLUMNS
from pairsim.sources.scratch import durable

# Seed and label rules of the derived tables.
SEED = 777
ZERO_SHARE = 0.55
POSITIVE_FROM = 3.0
TRANSLATED_FROM = 0.1
ENTRY_SHARE = 0.5
BLOCK = 6


# Row keys of the test tables.
TABLE_KEYS = {
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
    "events": ["event_id"],
    "labels": ["doc_id"],
    "benchmark": ["item_id"],
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. One with fewer input splits than cores is spread by row key,
    so that a small file does not leave the work to one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(2 * cores, *TABLE_KEYS[name])
    return df


def _lines(text: str = "text") -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of ``documents``."""
    docs = source(spark, sf_dir, "documents")
    out = docs.select("doc_id", "source", "lang", F.posexplode(_lines()).alias("line_no", "text"))
    return out.withColumn("id", F.concat_ws("-", "doc_id", "line_no"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next one of its document; pairs are built inside the row."""
    docs = source(spark, sf_dir, "documents")

    def neighbours(ls: Column) -> Column:
        n = F.greatest(F.size(ls) - 1, F.lit(0))
        return F.arrays_zip(F.slice(ls, F.lit(1), n), F.slice(ls, F.lit(2), n))

    pairs = docs.select(
        "doc_id", "source", "lang", F.posexplode(let(_lines(), neighbours)).alias("line_no", "p")
    )
    return pairs.select(
        F.concat_ws("-", "doc_id", "line_no").alias("id"),
        "doc_id",
        "line_no",
        "source",
        "lang",
        F.col("p.0").alias("sentence_1"),
        F.col("p.1").alias("sentence_2"),
    )


def neighbour_scores(
    spark: SparkSession, sf_dir: str, prepare: Callable[[Column], Column], score: Callable[[Column, Column], Column]
) -> DataFrame:
    """The rows of ``line_pairs`` with ``s``, the ``score`` of what ``prepare`` makes of both
    lines, in place of the sentences. A line is prepared once for the pairs it is in."""
    docs = source(spark, sf_dir, "documents")

    def scores(made: Column) -> Column:
        n = F.greatest(F.size(made) - 1, F.lit(0))
        return F.zip_with(F.slice(made, F.lit(1), n), F.slice(made, F.lit(2), n), score)

    pairs = docs.select(
        "doc_id", "source", "lang", F.posexplode(let(F.transform(_lines(), prepare), scores)).alias("line_no", "s")
    )
    return pairs.select(
        F.concat_ws("-", "doc_id", "line_no").alias("id"), "doc_id", "line_no", "source", "lang", "s"
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the one numbered next."""
    turns = source(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("source"), "text"
    )
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        "source",
        F.col("text").alias("sentence_1"),
        F.col("next").alias("sentence_2"),
    )


def with_overlap_label(df: DataFrame, cleaned: bool = False) -> DataFrame:
    """Label for fitting: word Jaccard of the cleaned sentences on 0..5; ``cleaned`` tells that they are."""
    a, b = (sim.word_set(F.col(c) if cleaned else clean(F.col(c))) for c in ("sentence_1", "sentence_2"))
    return df.withColumn(LABEL, F.bround(5 * sim.jaccard(a, b), 1))


def with_drawn_label(df: DataFrame) -> DataFrame:
    """Skewed label for balancing: over half zeros."""
    label = F.when(u01(SEED, "zero", F.col("id")) < ZERO_SHARE, F.lit(0.0)).otherwise(
        F.floor(u01(SEED, "label", F.col("id")) * 51) / F.lit(10.0)
    )
    return df.withColumn(LABEL, label).withColumn(
        BINARY_LABEL, F.when(F.col(LABEL) >= POSITIVE_FROM, 1.0).otherwise(0.0)
    )


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pairs in the pair schema with the skewed label."""
    return with_drawn_label(line_pairs(spark, sf_dir)).select(*[f"`{c}`" for c in VALUE_COLUMNS])


def block_synonyms(counts: DataFrame) -> DataFrame:
    """A dictionary from ``(word, n)``: half of the words, by hash, have an entry. In
    order of (n descending, word) each ``BLOCK`` of them are one another's synonyms."""
    known = durable(counts.where(u01(SEED, "entry", F.col("word")) < ENTRY_SHARE))
    placed = with_position(known.withColumn("minus", -F.col("n")), ["minus", "word"])
    blocks = placed.groupBy(F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("g")
    )
    each = blocks.select("g", F.explode("g.word").alias("word"))
    others = F.filter(F.transform("g", lambda x: x.word), lambda w: w != F.col("word"))
    return each.select("word", others.alias("synonyms")).where(F.size("synonyms") > 0)


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_synonyms(word_counts(lines(spark, sf_dir), ["text"]))


def back_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in reverse order stand for a translation; a tenth of the texts has none."""
    texts = lines(spark, sf_dir).select("text").distinct()
    return texts.where(u01(SEED, "back", F.col("text")) >= TRANSLATED_FROM).select(
        "text", F.array_join(F.reverse(F.split("text", " ", -1)), " ").alias("back_text")
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs, their events in time order as epochs."""
    events = source(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", "value"
    )
    placed = with_position(events, ["ts", "event_id"], by=["run_id"], name="epoch")
    return placed.select("run_id", "epoch", "value")


def three_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three simple predictions per line pair in long form ``(model, id, prediction)``."""

    def prepare(line: Column) -> Column:
        return let(
            clean(line),
            lambda c: F.struct(
                sim.char_ngrams(c, 2).alias("two"), sim.char_ngrams(c, 3).alias("three"), c.alias("text")
            ),
        )

    def scores(a: Column, b: Column) -> Column:
        made = {
            "char2": sim.jaccard(a.two, b.two),
            "char3": sim.jaccard(a.three, b.three),
            "length": sim.length_ratio(a.text, b.text),
        }
        return F.array(
            *[F.struct(F.lit(m).alias("model"), (5 * v).alias("prediction")) for m, v in made.items()]
        )

    pairs = neighbour_scores(spark, sf_dir, prepare, scores)
    return pairs.select("id", F.inline("s")).select("model", "id", "prediction")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pairs with the overlap label and 5 x character-3-gram Jaccard as prediction."""

    def prepare(line: Column) -> Column:
        return let(
            clean(line),
            lambda c: F.struct(sim.word_set(c).alias("words"), sim.char_ngrams(c, 3).alias("grams")),
        )

    def both(a: Column, b: Column) -> Column:
        return F.struct(
            F.bround(5 * sim.jaccard(a.words, b.words), 1).alias("label"),
            (5 * sim.jaccard(a.grams, b.grams)).alias("prediction"),
        )

    scored = neighbour_scores(spark, sf_dir, prepare, both)
    return scored.select("id", "doc_id", "line_no", "source", "lang", "s.label", "s.prediction")
