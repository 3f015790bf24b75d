"""Every registered query: ``(spark, sf_dir) -> DataFrame`` on the whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsim.functions import losses, postprocess, similarity, text
from pairsim.functions.seeded import draw_hash, draw_index, u01
from pairsim.operators import (
    backtranslate,
    balance,
    eda,
    epochs,
    features,
    history,
    metrics,
    model,
    moments,
    pairs,
    position,
    sampling,
    setops,
    submission,
    subwords,
    vocab,
    wordvectors,
)
from pairsim.operators import synonyms as syn_ops
from pairsim.plans import flows
from pairsim.plans import tables as t
from pairsim.plans.tables import SEED
from pairsim.schema import METRICS, PAIR, ROW_KEY, VALUE_COLUMNS
from pairsim.sources import pairs as io
from pairsim.sources import tables as io_tables
from pairsim.sources.scratch import durable, scratch_path
from pairsim.streaming import history as streams
from pairsim.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PLACE = ["doc_id", "line_no"]
BATCH = 16
VALUES = [f"`{c}`" for c in VALUE_COLUMNS]
FIT_FEATURES = ["char3_jaccard", "length_ratio"]


def query(fn: Query) -> Query:
    """Register under the function's name, less the underscore that keeps it apart
    from a module of the same name."""
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- flagship -------------------------------------------------------------


@query
def pair_quality(spark, sf_dir):
    """Post-processed character-gram score against the overlap label, per language."""
    scored = t.scored_pairs(spark, sf_dir).withColumn(
        "prediction", postprocess.finish_prediction(F.col("prediction"))
    )
    out = metrics.evaluate(scored, by=["lang"])
    return rounded(out, "pearson", "loss_l1", "loss_mse", "loss_huber", "loss_plcc")


# ---- sources and sinks ----------------------------------------------------


@query
def read_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs-csv")
    io.write_csv(t.labelled_pairs(spark, sf_dir), path)
    return io.read_pairs(spark, path)


@query
def read_unlabelled(spark, sf_dir):
    path = scratch_path(spark, "unlabelled-csv")
    io.write_csv(t.turn_pairs(spark, sf_dir), path)
    return io.read_unlabelled(spark, path)


@query
def write_indexed(spark, sf_dir):
    path = scratch_path(spark, "indexed-csv")
    io.write_indexed(t.labelled_pairs(spark, sf_dir), path, ["id"])
    return io.read_indexed(spark, path, PAIR)


@query
def synonym_table(spark, sf_dir):
    path = scratch_path(spark, "synonyms")
    nested = t.synonyms(spark, sf_dir).withColumn("synonyms", F.transform("synonyms", lambda s: F.array(s)))
    nested.write.parquet(path)
    return io_tables.load_synonyms(spark, path)


@query
def metric_log(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    steps = t.metric_history(spark, sf_dir).select(
        F.col("run_id").cast("string"), F.floor(F.col("epoch") / 10).alias("epoch"), "value"
    )
    for name in ("train_loss", "val_loss"):
        io_tables.append_metrics(steps.withColumn("metric", F.lit(name)), path)
    return rounded(metrics.epoch_means(io_tables.read_metrics(spark, path)), "train_loss")


# ---- projections and filters ----------------------------------------------


@query
def model_input(spark, sf_dir):
    """Labelled and unlabelled tables; the latter has NULL targets."""
    labelled = pairs.clean_pairs(t.labelled_pairs(spark, sf_dir))
    unlabelled = pairs.clean_pairs(t.turn_pairs(spark, sf_dir))
    return pairs.model_input(labelled).unionByName(pairs.model_input(unlabelled))


@query
def swap_augment(spark, sf_dir):
    return pairs.swap_augment(t.labelled_pairs(spark, sf_dir))


@query
def label_partition(spark, sf_dir):
    """A twentieth of the labels is NULL and has to stay with the non-zero rows."""
    df = t.labelled_pairs(spark, sf_dir).withColumn(
        "label", F.when(u01(SEED, "null", F.col("id")) >= 0.05, F.col("label"))
    )
    zero, other = pairs.partition_by_label(df)
    tagged = [p.select("id", "label", F.lit(n).alias("part")) for p, n in ((zero, "zero"), (other, "other"))]
    return tagged[0].unionByName(tagged[1])


# ---- position, split, batch -----------------------------------------------


@query
def row_position(spark, sf_dir):
    return position.with_position(t.line_pairs(spark, sf_dir), PLACE).select("id", "pos")


@query
def split_fractions(spark, sf_dir):
    return position.split_fractions(t.line_pairs(spark, sf_dir), PLACE).select("id", "split")


@query
def split_file_order(spark, sf_dir):
    """Rows split by their place in the files, those of train before those of dev."""
    df = t.labelled_pairs(spark, sf_dir)
    dev = u01(SEED, "dev", F.col("id")) < 0.06
    paths = []
    for name, rows in (("train", df.where(~dev)), ("dev", df.where(dev))):
        paths.append(f"{scratch_path(spark, name)}.parquet")
        rows.orderBy(F.desc("id")).write.parquet(paths[-1])
    placed = position.with_position(io.in_file_order(spark, paths, PAIR), io.FILE_ORDER)
    return position.split_positions(placed).select("id", "pos", "split")


@query
def assign_batches(spark, sf_dir):
    placed = position.with_position(t.line_pairs(spark, sf_dir).select("id", *PLACE), PLACE)
    return position.assign_batches(placed, BATCH, drop_last=True).select("id", "pos", "batch_id")


# ---- set operations -------------------------------------------------------


@query
def union_pairs(spark, sf_dir):
    labelled, unlabelled = t.labelled_pairs(spark, sf_dir), t.turn_pairs(spark, sf_dir)
    return setops.union_pairs(labelled, unlabelled).select(*VALUES)


def _both_orders(spark, sf_dir):
    return pairs.swap_augment(t.line_pairs(spark, sf_dir)).select("sentence_1", "sentence_2")


@query
def dedup_rows(spark, sf_dir):
    return setops.dedup_rows(_both_orders(spark, sf_dir))


@query
def rows_occurring_once(spark, sf_dir):
    return setops.rows_occurring_once(_both_orders(spark, sf_dir))


@query
def sample_complement(spark, sf_dir):
    zeros, _ = pairs.partition_by_label(pairs.swap_augment(t.labelled_pairs(spark, sf_dir)))
    sample = sampling.sample_exact(zeros, 0.5, ROW_KEY, SEED, "keep")
    return setops.sample_complement(sample, zeros, VALUE_COLUMNS)


# ---- sampling and shuffling -----------------------------------------------


@query
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(t.line_pairs(spark, sf_dir), 0.5, ["id"], SEED).select("id", "source")


@query
def shuffle_rows(spark, sf_dir):
    return position.shuffle_rows(t.line_pairs(spark, sf_dir), ["id"], SEED).select(
        "id", "sentence_1", "pos"
    )


@query
def epoch_batches(spark, sf_dir):
    """Two epochs; the incomplete tail is dropped in each."""
    df = t.line_pairs(spark, sf_dir).select("id")
    runs = [
        position.epoch_batches(df, ["id"], SEED, e, BATCH, drop_last=True).withColumn("epoch", F.lit(e))
        for e in (1, 2)
    ]
    return runs[0].unionByName(runs[1])


@query
def epoch_places(spark, sf_dir):
    """Two epochs over positions stored once."""
    placed = durable(position.with_position(t.line_pairs(spark, sf_dir).select("id", *PLACE), PLACE))
    n = placed.count()
    each = [
        epochs.epoch_places(placed, n, SEED, e, BATCH, drop_last=True)
        .select("id", "place", "batch_id", F.lit(e).alias("epoch"))
        for e in (1, 2)
    ]
    return each[0].unionByName(each[1])


@query
def seeded_draws(spark, sf_dir):
    return t.lines(spark, sf_dir).select(
        "id",
        draw_hash(SEED, F.col("id"), "h").alias("h"),
        u01(SEED, F.col("id"), "u").alias("u"),
        draw_index(F.lit(10), SEED, F.col("id"), "i").alias("i"),
    )


# ---- text -----------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return pairs.clean_pairs(t.line_pairs(spark, sf_dir)).select("id", "sentence_1", "sentence_2")


@query
def pair_text(spark, sf_dir):
    cleaned = pairs.clean_pairs(t.line_pairs(spark, sf_dir))
    return cleaned.select("id", text.pair_text(F.col("sentence_1"), F.col("sentence_2")).alias("text"))


@query
def words(spark, sf_dir):
    ws = text.words(F.col("text"))
    return t.lines(spark, sf_dir).select("id", ws.alias("ws"), text.join_words(ws).alias("joined"))


@query
def keep_script(spark, sf_dir):
    return t.lines(spark, sf_dir).select(
        "id",
        text.keep_script(F.col("text")).alias("hangul"),
        text.keep_script(F.col("text"), "[^a-z ]").alias("latin"),
    )


@query
def build_vocab(spark, sf_dir):
    return vocab.build_vocab(t.line_pairs(spark, sf_dir))


@query
def encode_pad(spark, sf_dir):
    df = t.line_pairs(spark, sf_dir)
    return vocab.encode_pad(df, durable(vocab.build_vocab(df)), ["id"])


#: Merges that the queries learn; their SQL spells them out.
MERGES = 30


@query
def learn_subwords(spark, sf_dir):
    found = subwords.learn_from_pairs(t.line_pairs(spark, sf_dir), MERGES)
    rows = [(i, *merge) for i, merge in enumerate(found)]
    return spark.createDataFrame(rows, "step long, left string, right string, n long")


@query
def encode_subwords(spark, sf_dir):
    """Pairs cut into learned sub-words, encoded with a vocabulary of those."""
    df = t.line_pairs(spark, sf_dir)
    merges = [(left, right) for left, right, _ in subwords.learn_from_pairs(df, MERGES)]
    cut = durable(subwords.cut_pairs(df, merges))
    return vocab.encode_pad(cut, durable(vocab.build_vocab(cut)), ["id"])


# ---- augmentation ---------------------------------------------------------


@query
def balance_labels(spark, sf_dir):
    return balance.balance_labels(pairs.swap_augment(t.labelled_pairs(spark, sf_dir)), SEED)


def _synonyms(spark, sf_dir):
    return durable(t.synonyms(spark, sf_dir))


@query
def synonym_lookup(spark, sf_dir):
    """Words, known words and synonyms found per line."""
    found = syn_ops.synonym_lookup(t.lines(spark, sf_dir), _synonyms(spark, sf_dir), ["id"], "text")
    return found.groupBy("id").agg(
        F.count("*").alias("n_words"),
        F.count_if(F.size("synonyms") > 0).alias("n_known"),
        F.sum(F.size("synonyms")).alias("n_synonyms"),
        F.max(F.get("synonyms", F.lit(0))).alias("last_first"),
    )


def _edit(spark, sf_dir, edit, table=None):
    out = eda.edit_sentences(t.lines(spark, sf_dir), edit, ["id"], "text", SEED, table, variants=2)
    return out.select("id", "edit_variant", "augmented")


@query
def eda_replace(spark, sf_dir):
    return _edit(spark, sf_dir, "replace", _synonyms(spark, sf_dir))


@query
def eda_insert(spark, sf_dir):
    return _edit(spark, sf_dir, "insert", _synonyms(spark, sf_dir))


@query
def eda_swap(spark, sf_dir):
    return _edit(spark, sf_dir, "swap")


@query
def eda_delete(spark, sf_dir):
    return _edit(spark, sf_dir, "delete")


@query
def eda_sentence(spark, sf_dir):
    table = _synonyms(spark, sf_dir)
    return eda.eda_sentence(t.lines(spark, sf_dir), table, ["id"], "text", SEED)


@query
def eda_pairs(spark, sf_dir):
    return eda.eda_pairs(t.labelled_pairs(spark, sf_dir), _synonyms(spark, sf_dir), ["id"], SEED)


@query
def back_translate(spark, sf_dir):
    table = durable(t.back_texts(spark, sf_dir), compression="zstd")
    out = backtranslate.back_translate(t.line_pairs(spark, sf_dir), table, ["id"])
    return out.select("id", "sentence_1", "sentence_2")


@query
def back_translate_misses(spark, sf_dir):
    table = durable(t.back_texts(spark, sf_dir), compression="zstd")
    return backtranslate.back_translate_misses(t.line_pairs(spark, sf_dir), table, ["id"])


@query
def back_translation(spark, sf_dir):
    table = durable(t.back_texts(spark, sf_dir), compression="zstd")
    df = t.line_pairs(spark, sf_dir).select("id", "source", "sentence_1", "sentence_2")
    return backtranslate.back_translation(df, table, ["id"])


# ---- metrics --------------------------------------------------------------


@query
def label_distribution(spark, sf_dir):
    split = position.split_fractions(t.labelled_pairs(spark, sf_dir), ["id"])
    return rounded(metrics.label_distribution(split), "share")


@query
def pearson(spark, sf_dir):
    r = losses.pearson(F.col("prediction"), F.col("label"))
    return t.scored_pairs(spark, sf_dir).groupBy("source", "lang").agg(F.round(r, 6).alias("pearson"))


@query
def batch_pearson(spark, sf_dir):
    scored = durable(t.scored_pairs(spark, sf_dir).select(*PLACE, "label", "prediction"))
    placed = position.with_position(scored, PLACE)
    out = metrics.batch_pearson(position.assign_batches(placed, BATCH))
    return rounded(out, "mean_pearson", "mean_defined_pearson")


@query
def losses_(spark, sf_dir):
    p, y = F.col("prediction"), F.col("label")
    named = [F.round(losses.loss(n, p, y), 6).alias(n) for n in losses.LOSSES]
    plain = F.round(losses.plcc(p, y, squared=False), 6).alias("plcc_plain")
    return t.scored_pairs(spark, sf_dir).groupBy("source").agg(*named, plain)


# ---- histories ------------------------------------------------------------


@query
def early_stop(spark, sf_dir):
    return history.early_stop(durable(t.metric_history(spark, sf_dir)))


@query
def stream_early_stop(spark, sf_dir):
    """The same history in three parts; the stream starts again after each."""
    rows = durable(t.metric_history(spark, sf_dir)).withColumn("run_id", F.col("run_id").cast("string"))
    source, out, marks = (scratch_path(spark, n) for n in ("metrics-in", "stops", "stops-marks"))
    third = F.floor(F.col("epoch") * 3 / (rows.agg(F.max("epoch")).first()[0] + 1))
    for i in range(3):
        rows.where(third == i).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(rows.schema).parquet(source)
        streams.stream_early_stop(arriving, out, marks).awaitTermination()
    return streams.read_state(spark, out).select(
        F.col("run_id").cast("long").alias("run_id"), "stop_epoch", "epochs"
    )


@query
def top_checkpoints(spark, sf_dir):
    return history.top_checkpoints(t.metric_history(spark, sf_dir))


@query
def best_trial(spark, sf_dir):
    h = durable(t.metric_history(spark, sf_dir))
    low = history.best_trial(h, "minimize").withColumn("goal", F.lit("minimize"))
    return low.unionByName(history.best_trial(h, "maximize").withColumn("goal", F.lit("maximize")))


# ---- post-processing and ensemble -----------------------------------------


@query
def postprocess_(spark, sf_dir):
    """Scores stretched beyond both ends of the label range."""
    preds = t.three_models(spark, sf_dir)
    raw = F.col("prediction") * 1.5 - 1.0
    return preds.select("model", "id", postprocess.finish_prediction(raw).alias("target"))


@query
def submission_(spark, sf_dir):
    """A template and predictions for nine tenths of it, through CSV and back."""
    df = t.scored_pairs(spark, sf_dir)
    template_path, out_path = scratch_path(spark, "template"), scratch_path(spark, "submission")
    io.write_csv(df.select("id", F.lit(0.0).alias("target")), template_path)
    preds = df.where(u01(SEED, "scored", F.col("id")) >= 0.1).select("id", "prediction")
    io.write_csv(submission.build_submission(io.read_template(spark, template_path), preds), out_path)
    return io.read_template(spark, out_path)


@query
def attach_by_position(spark, sf_dir):
    """Predictions without ids, attached by place to a template that is stored in another order."""
    scored = durable(t.scored_pairs(spark, sf_dir).select("id", *PLACE, "prediction"))
    placed = position.with_position(scored, PLACE)
    template, preds = scratch_path(spark, "template"), scratch_path(spark, "predictions")
    placed.select("id", *PLACE).repartition(5, "id").write.parquet(template)
    placed.select("pos", "prediction").repartition(3, "prediction").write.parquet(preds)
    return submission.attach_by_position(spark.read.parquet(template), spark.read.parquet(preds), PLACE, ["pos"])


@query
def missing_predictions(spark, sf_dir):
    """Template rows without a prediction, where a tenth has none."""
    df = t.scored_pairs(spark, sf_dir)
    preds = df.where(u01(SEED, "scored", F.col("id")) >= 0.1).select("id", "prediction")
    return submission.missing_predictions(submission.build_submission(df.select("id"), preds))


@query
def ensemble_weighted(spark, sf_dir):
    preds = t.three_models(spark, sf_dir)
    out = submission.ensemble_weighted(preds, {"char2": 0.2, "char3": 0.5, "length": 0.3})
    return rounded(out, "prediction")


# ---- features and models --------------------------------------------------


@query
def pair_features(spark, sf_dir):
    df = pairs.clean_pairs(t.line_pairs(spark, sf_dir))
    names = features.ROW_FEATURES
    return rounded(features.pair_features(df).select("id", *names), *names)


@query
def tfidf_cosine(spark, sf_dir):
    df = pairs.clean_pairs(t.line_pairs(spark, sf_dir))
    table = durable(features.document_frequencies(df))
    return rounded(features.tfidf_cosine(df, ["id"], frequencies=table), "tfidf_cosine")


@query
def sentence_cosine(spark, sf_dir):
    """Line pairs by vectors learned from them."""
    df = durable(t.line_pairs(spark, sf_dir).select("id", "sentence_1", "sentence_2"))
    vectors = durable(wordvectors.word_vectors(df, SEED))
    return rounded(wordvectors.sentence_cosine(df, vectors, ["id"]), "sentence_cosine")


@query
def embedding_cosine(spark, sf_dir):
    """Each vector with the one numbered next."""
    a = t.source(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cos = similarity.vector_cosine(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cos, 6).alias("cosine"))


def _featured(spark, sf_dir):
    """Line pairs with the overlap label, fitting features and split; written once
    because a fit reads its rows several times."""
    df = t.with_overlap_label(pairs.clean_pairs(t.line_pairs(spark, sf_dir)), cleaned=True)
    feats = features.pair_features(df, FIT_FEATURES).select("id", *PLACE, "label", *FIT_FEATURES)
    return position.split_fractions(durable(feats), PLACE)


def _train(df):
    return df.where("split = 'train'")


#: Rounds of reweighting in the query; its SQL spells them out.
FIT_ROUNDS, FIT_DECAY = 8, 0.001


@query
def fit_similarity(spark, sf_dir):
    """All four losses fitted on train and evaluated on validation."""
    df = durable(_featured(spark, sf_dir))
    out = None
    for name in losses.LOSSES:
        settings = {"weight_decay": FIT_DECAY, "rounds": FIT_ROUNDS} if name in model.ROBUST else {}
        fitted = model.fit_similarity(_train(df), FIT_FEATURES, name, **settings)
        rows = model.evaluate_model(fitted, df.where("split = 'validation'")).withColumn("fit", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "pearson", "loss_l1", "loss_mse", "loss_huber", "loss_plcc", digits=4)


@query
def fit_log(spark, sf_dir):
    """Mean train loss before each round of both robust fits, as a metric log read back."""
    df = _train(durable(_featured(spark, sf_dir)))
    path = scratch_path(spark, "fit-log")
    for name in model.ROBUST:
        _, values = moments.fit_robust(df, FIT_FEATURES, name, FIT_DECAY, FIT_ROUNDS)
        rows = [(name, i, "train_loss", v) for i, v in enumerate(values)]
        io_tables.append_metrics(spark.createDataFrame(rows, METRICS), path)
    return rounded(io_tables.read_metrics(spark, path).select(*METRICS.names), "value", digits=5)


@query
def split_moments(spark, sf_dir):
    """Moments of each split, merged from those of each split and source document's last digit."""
    df = _featured(spark, sf_dir).withColumn("part", F.col("doc_id") % 10)
    columns = [*FIT_FEATURES, "label"]
    merged = moments.merge_moments(moments.moments(df, columns, ["split", "part"]), ["split"])
    return rounded(merged, *[c for c in merged.columns if c.startswith("s") and c != "split"], digits=4)


@query
def score_pairs(spark, sf_dir):
    """Least-squares scores for every pair, from a saved and reloaded model."""
    df = _featured(spark, sf_dir)
    fitted = model.fit_similarity(_train(df), FIT_FEATURES, "MSE")
    path = model.save_model(fitted, scratch_path(spark, "models"), "mse")
    return rounded(model.score_pairs(model.load_model(path), df).select("id", "prediction"), "prediction")


@query
def score_with_function(spark, sf_dir):
    """A user scorer over Arrow batches: five times the length ratio."""

    def load():
        def score(batch: pd.DataFrame) -> pd.Series:
            a, b = batch.sentence_1.str.len(), batch.sentence_2.str.len()
            longer = a.where(a > b, b)
            return (5.0 * a.where(a < b, b) / longer.where(longer > 0, 1)).where(longer > 0, 5.0)

        return score

    df = model.score_with(t.line_pairs(spark, sf_dir), load)
    return rounded(df.select("id", "prediction"), "prediction")


@query
def evaluate(spark, sf_dir):
    df = _featured(spark, sf_dir)
    fitted = model.fit_similarity(_train(df), FIT_FEATURES, "MSE")
    out = model.evaluate_model(fitted, df)
    return rounded(out, "pearson", "loss_l1", "loss_mse", "loss_huber", "loss_plcc")


#: Weight decays of the search.
DECAYS = (0.0, 0.001, 0.01, 0.1, 1.0)


@query
def tune_similarity(spark, sf_dir):
    """Metric log of a seeded random search over weight decays, and the chosen trial."""
    df = durable(_featured(spark, sf_dir))
    log, _ = model.tune_ridge(
        _train(df), df.where("split = 'validation'"), FIT_FEATURES, DECAYS, trials=6, seed=SEED
    )
    path = scratch_path(spark, "trials")
    io_tables.append_metrics(log, path)
    stored = io_tables.read_metrics(spark, path)
    best = history.best_trial(stored.where("metric = 'val_loss'")).select(
        F.col("run_id"), F.lit(0).cast("long").alias("epoch"), F.lit("best_val_loss").alias("metric"), "value"
    )
    return rounded(stored.unionByName(best).select(*METRICS.names), "value", digits=5)


@query
def ensemble_fitted(spark, sf_dir):
    """Two models blended with the weights of least squared error on the train split."""
    df = durable(_featured(spark, sf_dir))
    df = df.select("id", "split", "label", *[(5 * F.col(c)).alias(c) for c in FIT_FEATURES])
    weights = moments.fit_blend(_train(df), FIT_FEATURES)
    preds = df.select("id", F.expr(f"stack({len(FIT_FEATURES)}, " + ", ".join(f"'{c}', {c}" for c in FIT_FEATURES) + ") as (model, prediction)"))
    return rounded(submission.ensemble_weighted(preds, weights), "prediction", digits=5)


# ---- flows ----------------------------------------------------------------


@query
def training_table(spark, sf_dir):
    return flows.training_table(t.labelled_pairs(spark, sf_dir), SEED)


@query
def encoded_epochs(spark, sf_dir):
    table = flows.training_table(t.labelled_pairs(spark, sf_dir), SEED)
    return flows.encoded_epochs(table, SEED, [1, 2], BATCH)


def _reverser():
    """A stand-in translator: words in reverse order; a tenth of the texts fails."""

    def translate(text: str) -> str:
        draw = hashlib.md5(f"{SEED}|back|{text}".encode()).hexdigest()
        if int(draw[:8], 16) / 4294967296 < t.TRANSLATED_FROM:
            raise ValueError("no translation")
        return " ".join(reversed(text.split(" ")))

    return translate


@query
def back_translated_table(spark, sf_dir):
    """All three outputs as they are read again."""
    paths = flows.back_translated_table(
        t.labelled_pairs(spark, sf_dir),
        _reverser,
        scratch_path(spark, "memo"),
        "first",
        scratch_path(spark, "back-translated"),
    )
    read = [
        io.read_indexed(spark, path, PAIR).select("index", *VALUES, F.lit(name).alias("split"))
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, read)


@query
def augmented_training_table(spark, sf_dir):
    table = _synonyms(spark, sf_dir)
    return flows.augmented_training_table(t.labelled_pairs(spark, sf_dir), table, SEED)


def _ratio_score(df):
    return df.withColumn(
        "prediction", 5 * similarity.length_ratio(F.col("sentence_1"), F.col("sentence_2"))
    )


@query
def prediction_run(spark, sf_dir):
    unlabelled = t.turn_pairs(spark, sf_dir)
    return flows.prediction_run(unlabelled, unlabelled.select("id"), _ratio_score)


@query
def stream_targets(spark, sf_dir):
    """The same scores over a stream of CSV files."""
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    io.write_csv(t.turn_pairs(spark, sf_dir), source)
    targets = scoring.stream_targets(scoring.stream_unlabelled(spark, source), _ratio_score)
    scoring.write_targets(targets, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)
