"""Every operator as a query over the given tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moderata.functions import arrays as ar
from moderata.functions import labels as lb
from moderata.functions import text as tx
from moderata.operators import (
    chunking,
    classify,
    curate,
    encode,
    evaluate,
    logistic,
    preferences,
    ranking,
    retrieval,
    terms,
)
from moderata.plans import flows
from moderata.session import new_folder, settle, spread
from moderata.sources import index_store, metrics, model_store, registry
from moderata.sources.tables import page_documents, read_table, read_tsv
from moderata.streaming import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

METADATA = ("lang", "source")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _null_if(column: str, value: str) -> Column:
    return F.nullif(F.col(column), F.lit(value))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"), "doc_id")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_documents(spread(read_table(spark, folder, "pages"), "page_id"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels").select(
        "doc_id", lb.as_int(F.col("toxic")).alias("label")
    )
    return _documents(spark, folder).select("doc_id", "text", "lang").join(labels, "doc_id")


def _joined(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), " ")


# Filters, labels and projections


@query
def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).select("doc_id", "text", "label")


@query
def filter_not_null(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", _null_if("lang", "de").alias("lang"))
    return curate.filter_not_null(docs, "lang")


@query
def dropna_then_project(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    holes = docs.withColumn("lang", _null_if("lang", "de")).withColumn("source", _null_if("source", "src8"))
    return curate.project(curate.drop_any_null(holes), {"doc_id": "doc_id", "text": "text"})


@query
def binarize_sum(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels")
    ai = F.nullif("quality", F.lit(0)).cast("double") * F.lit(3.0)
    human = F.col("toxic").cast("double") * F.lit(3.0)
    return labels.select("doc_id", lb.sum_above(ai, human).alias("label"))


def _scored_events(spark: SparkSession, folder: str) -> DataFrame:
    score = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "signup", F.lit(None))
        .otherwise(F.col("value"))
    )
    return read_table(spark, folder, "events").select("event_id", "event_type", score.alias("score"))


@query
def binarize_threshold(spark: SparkSession, folder: str) -> DataFrame:
    events = _scored_events(spark, folder)
    return events.select("event_id", lb.above(F.col("score"), 50.0).alias("label"))


@query
def binarize_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", lb.differs(_null_if("lang", "fr"), "en").alias("label"))


@query
def concat_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", F.lit("train").alias("split")
    )
    turns = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    items = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.lit("test").alias("split")
    )
    return curate.concat_tagged({"documents": docs, "conversations": turns, "benchmark": items})


# Datasets of the registry, on stand-in sources with nulls put in


def _tagged(pair: registry.Pair, *columns: str) -> DataFrame:
    return curate.concat_tagged({"train": pair[0], "test": pair[1]}, "split").select(*columns, "split")


@query
def dataset_toxigen(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels")
    docs = read_table(spark, folder, "documents").join(labels, "doc_id")
    train = docs.select(
        _null_if("lang", "de").alias("prompt"),
        F.col("text").alias("generation"),
        F.col("toxic").alias("prompt_label"),
    )
    annotated = docs.select(
        "text",
        (F.nullif("quality", F.lit(0)).cast("double") * F.lit(3.0)).alias("toxicity_ai"),
        (F.col("toxic").cast("double") * F.lit(3.0)).alias("toxicity_human"),
    )
    return _tagged(registry.toxigen(train, annotated), "text", "label")


@query
def dataset_twitter(spark: SparkSession, folder: str) -> DataFrame:
    tweets = _labelled(spark, folder).select(
        "doc_id",
        F.col("text").alias("tweet"),
        F.col("label").cast("string").alias("label"),
        _null_if("lang", "fr").alias("lang"),
    )
    return _tagged(registry.twitter(tweets, "doc_id"), "text", "label", "lang")


@query
def dataset_berkeley(spark: SparkSession, folder: str) -> DataFrame:
    comments = _scored_events(spark, folder).select(
        "event_id",
        F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", "event_id")).alias("text"),
        (F.col("score") / F.lit(100.0)).alias("hate_speech_score"),
    )
    return _tagged(registry.berkeley(comments, "event_id"), "text", "label")


@query
def dataset_gender(spark: SparkSession, folder: str) -> DataFrame:
    docs = _labelled(spark, folder).select(
        "lang", F.col("text").alias("Text"), F.nullif("label", F.lit(0)).alias("Label")
    )
    english = F.col("lang").eqNullSafe("en")
    return _tagged(registry.gender(docs.where(english), docs.where(~english)), "text", "label")


def _write_tsv(df: DataFrame, path: str) -> None:
    writer = df.write.option("sep", "\t").option("header", True)
    writer.option("quoteAll", True).option("escape", '"').csv(path)


@query
def dataset_cad(spark: SparkSession, folder: str) -> DataFrame:
    """Three tab-separated files are written to the shared folder and loaded from there."""
    base = new_folder(spark, "tsv")
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.when(F.col("lang") == "en", F.lit(lb.NEGATIVE_CATEGORY)).otherwise(_null_if("lang", "fr")).alias("labels"),
        "lang",
    )
    part = F.when(F.col("lang") == "de", "dev").when(F.col("lang") == "es", "test").otherwise("train")
    for name in ("train", "dev", "test"):
        _write_tsv(docs.where(part == name).drop("lang"), f"{base}/{name}.tsv")
    return _tagged(registry.load(spark, "cad", base), "text", "label")


@query
def tsv_concat(spark: SparkSession, folder: str) -> DataFrame:
    base = new_folder(spark, "tsv")
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("labels")
    )
    english = F.col("labels").eqNullSafe("en")
    _write_tsv(docs.where(english), f"{base}/train.tsv")
    _write_tsv(docs.where(~english), f"{base}/dev.tsv")
    frames = [read_tsv(spark, f"{base}/{n}.tsv", registry.CATEGORY_FILE) for n in ("train", "dev")]
    return curate.concat(frames).drop("id").withColumnsRenamed({"labels": "label"})


def _preference_source(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations")
    rows = preferences.with_heads(preferences.turn_pairs(turns), turns)
    return rows.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"),
        "prompt",
        F.col("completion").alias("generation"),
        (F.pmod("turn", F.lit(4)) == 1).cast("int").alias("prompt_label"),
        F.coalesce("system", "first_user").alias("extra"),
    )


@query
def preference_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = registry.toxigen_preference(_preference_source(spark, folder))
    both = curate.concat_tagged({"train": train, "test": test}, "split")
    return curate.filter_not_null(both, "prompt").select("prompt", "completion", "label", "split")


# Order, splits and batches


@query
def shuffle_order(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.shuffle_positions(read_table(spark, folder, "documents"), "doc_id")


@query
def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id")
    for size, name in ((0.2, "test_20"), (0.05, "test_05")):
        docs = ranking.with_split(docs, "doc_id", size, name=name)
    return docs


@query
def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder).select("doc_id", "label")
    return ranking.with_stratified_split(rows, "doc_id", "label", 0.2)


@query
def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id")
    return ranking.with_batch(docs, ["doc_id"], 32)


# Text, vocabulary and encoding


@query
def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.length_stats(read_table(spark, folder, "documents"), ["lang"])


@query
def vocab_build(spark: SparkSession, folder: str) -> DataFrame:
    return encode.build_vocabulary(_documents(spark, folder))


@query
def encode_fixed(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = encode.build_vocabulary(_documents(spark, folder))
    items = encode.encode(read_table(spark, folder, "benchmark"), vocabulary, "item_id", max_length=64)
    return items.select(
        "item_id",
        _joined(F.col("input_ids")).alias("input_ids"),
        _joined(F.col("attention_mask")).alias("attention_mask"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"),
    )


@query
def encode_budget(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = settle(encode.build_vocabulary(_documents(spark, folder)))
    items = read_table(spark, folder, "benchmark")
    modes = []
    for rag, length in ((False, encode.PLAIN_LENGTH), (True, encode.RETRIEVAL_LENGTH)):
        encoded = encode.encode(items, vocabulary, "item_id", max_length=length)
        modes.append(
            encoded.select(
                "item_id",
                F.lit(rag).alias("rag"),
                F.size("input_ids").alias("width"),
                F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"),
            )
        )
    length, batch = encode.budget(F.col("rag"))
    return curate.concat(modes).withColumn("max_length", length).withColumn("batch_size", batch)


@query
def chat_render(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations")
    system = F.when(F.col("role") == "system", F.col("text"))
    return turns.select(
        "conv_id",
        "turn",
        tx.chat_message(F.col("role"), F.col("text")).alias("rendered"),
        tx.chat_message("user", F.col("text"), add_generation_prompt=True).alias("asked"),
        tx.system_prefix(system).alias("system"),
    )


@query
def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder)


@query
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(_documents(spark, folder))


@query
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    chunks = chunking.chunk(docs).select("doc_id", "pos", "node_id")
    return chunking.attach_metadata(chunks, docs, METADATA)


# Retrieval


@query
def tfidf_index(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    entries = terms.term_table(docs, "doc_id")
    idf = settle(retrieval.idf_table(entries, ["terms"]))
    vectors = retrieval.tfidf_vectors(entries, "doc_id", idf, ["terms"])
    pairs = F.explode(F.arrays_zip("terms", "weights"))
    return vectors.select("doc_id", pairs.alias("e")).select(
        "doc_id", F.col("e.terms").alias("term"), F.round("e.weights", 6).alias("weight")
    )


@query
def topk_dense(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return retrieval.top_k_dense(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("node_id"), "embedding"),
        k=3,
    )


@query
def topk_sparse(spark: SparkSession, folder: str) -> DataFrame:
    entries = terms.term_table(_documents(spark, folder), "doc_id")
    idf = settle(retrieval.idf_table(entries, ["terms"]))
    vectors = retrieval.tfidf_vectors(entries, "doc_id", idf, ["terms"])
    nodes = settle(vectors.withColumnRenamed("doc_id", "node_id"))
    return retrieval.retrieve(read_table(spark, folder, "benchmark"), "item_id", nodes, idf, k=3)


@query
def rag_augment(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    index = index_store.build_index(docs, new_folder(spark, "index"), METADATA)
    items = read_table(spark, folder, "benchmark")
    hits = retrieval.retrieve(items, "item_id", index.vectors, index.idf, k=2)
    return retrieval.augment(items, "item_id", hits, index.chunks)


@query
def page_nodes(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    return chunking.chunk(pages, carry=["url"])


@query
def index_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The index is written to the shared folder and opened again."""
    path = new_folder(spark, "index")
    index_store.open_index(spark, path, _documents(spark, folder), METADATA)
    index = index_store.open_index(spark, path)
    # The stored number of terms, so that the terms themselves are not read and joined.
    return index.nodes.select("node_id", "doc_id", "n_words", "lang", "n_terms")


@query
def manifest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """JSON manifests of a hundred documents each are written to the shared folder and read again."""
    path = new_folder(spark, "manifest")
    chunks = chunking.chunk(_documents(spark, folder))
    part = F.concat(F.lit("part"), F.floor(F.col("doc_id") / 100).cast("string"))
    index_store.write_json_manifest(chunks, path, part)
    return index_store.read_json_manifest(spark, path, whole=False)


@query
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    props = F.from_json("props", "map<string,bigint>")
    return read_table(spark, folder, "events").select(
        "event_id",
        F.array_join(F.map_keys(props), ",").alias("keys"),
        props["k"].alias("k"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k_path"),
    )


# Preferences


def _unpaired(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations")
    rows = preferences.with_heads(preferences.turn_pairs(turns), turns)
    labelled = rows.withColumn("label", (F.pmod("turn", F.lit(4)) == 1).cast("int"))
    return preferences.unpaired(labelled, system="system", carry=["conv_id", "turn"])


@query
def kto_examples(spark: SparkSession, folder: str) -> DataFrame:
    return _unpaired(spark, folder)


@query
def kto_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = _unpaired(spark, folder)
    return rows.select("conv_id", "turn", "label", preferences.weights(F.col("label"), 1.0, 0.5).alias("weight"))


@query
def kto_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = preferences.with_lengths(_unpaired(spark, folder), max_prompt_length=32, max_length=64)
    return rows.select("conv_id", "turn", "prompt_len", "completion_len", "truncated")


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations")
    answers = preferences.with_heads(turns.where(F.col("role") == "assistant"), turns)
    rows = answers.select(
        F.col("first_user").alias("prompt"),
        F.col("text").alias("completion"),
        (F.pmod("turn", F.lit(4)) == 1).alias("label"),
        "conv_id",
        "turn",
    )
    return preferences.pair(rows, ["conv_id", "turn"])


@query
def dpo_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.render_paired(_paired(spark, folder))


@query
def kto_from_dpo(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.unpair(_paired(spark, folder))


# Classifiers and accuracy


def _holdout(spark: SparkSession, folder: str) -> registry.Pair:
    return ranking.split(_labelled(spark, folder), "doc_id", 0.2)


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _holdout(spark, folder)
    model = settle(classify.train_naive_bayes(train))
    return classify.score_naive_bayes(test, model, "doc_id", carry=["lang", "label"])


@query
def nb_train(spark: SparkSession, folder: str) -> DataFrame:
    model = classify.train_naive_bayes(_holdout(spark, folder)[0])
    return model.withColumn("lp0", F.round("lp0", 6)).withColumn("lp1", F.round("lp1", 6))


@query
def nb_predict(spark: SparkSession, folder: str) -> DataFrame:
    scored = _predictions(spark, folder)
    return scored.select(
        "doc_id", F.get("logits", F.lit(0)).alias("l0"), F.get("logits", F.lit(1)).alias("l1"), "pred"
    )


@query
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The trained parameters are written to the shared folder, loaded and applied."""
    train, test = _holdout(spark, folder)
    path = new_folder(spark, "model")
    model_store.save_naive_bayes(classify.train_naive_bayes(train), path)
    model = model_store.load_naive_bayes(spark, path)
    return classify.score_naive_bayes(test, model, "doc_id").select("doc_id", "pred")


@query
def lr_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression on TF-IDF features, with the idf of the training rows."""
    rows = terms.term_table(_labelled(spark, folder), "doc_id", carry=["label"])
    train, test = ranking.split(rows, "doc_id", 0.2)
    idf = logistic.inverse_frequencies(train, "terms")
    weights = logistic.train(train, "doc_id", "terms", idf=idf)
    return logistic.score(test, weights, "doc_id", "terms", carry=["label"], idf=idf)


@query
def argmax_logits(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    nested = F.flatten(F.array(F.col("embedding")))
    return vectors.select("vec_id", ar.argmax(nested).alias("pred"))


@query
def accuracy_overall(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy(_predictions(spark, folder))


@query
def accuracy_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy taken while the scored rows are written."""
    return evaluate.observed_accuracy(_predictions(spark, folder), settle)[1]


@query
def accuracy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.accuracy_rollup(_predictions(spark, folder).withColumnRenamed("lang", "dataset"))


@query
def accuracy_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes plain and on retrieval prompts from the pages, and the majority label."""
    rows = terms.term_table(_labelled(spark, folder), "doc_id", carry=["text", "lang", "label"])
    train, test = ranking.split(rows, "doc_id", 0.2)
    model = settle(classify.train_naive_bayes(train, "terms"))
    pages = _pages(spark, folder)
    index = index_store.build_index(pages, new_folder(spark, "index"), ["url"])
    hits = retrieval.retrieve(test, "doc_id", index.vectors, index.idf, k=1, text="terms")
    augmented = retrieval.augment(test, "doc_id", hits, index.chunks)

    keep = ["lang", "label"]
    scored = {
        ("naive_bayes", False): classify.score_naive_bayes(test, model, "doc_id", "terms", carry=keep),
        ("naive_bayes", True): classify.score_naive_bayes(augmented, model, "doc_id", carry=keep),
        ("majority", False): classify.score_majority(test, train),
    }
    rows = [
        df.select(F.lit(m).alias("model_id"), F.lit(r).alias("rag"), F.col("lang").alias("dataset"), "label", "pred")
        for (m, r), df in scored.items()
    ]
    return evaluate.accuracy_cube(curate.concat(rows))


@query
def metrics_log(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy rows are appended to a metrics table and read back."""
    path = new_folder(spark, "metrics")
    rates = accuracy_rollup(spark, folder)
    metrics.append_evaluation(rates, path, "naive_bayes")
    return metrics.read_metrics(spark, path)


# Whole jobs on stored datasets


def _stored_sets(spark: SparkSession, folder: str, *names: str) -> dict[str, str]:
    """The given tables written in the stored layout of the named datasets."""
    base = new_folder(spark, "sets")
    docs = _labelled(spark, folder)
    comments = _scored_events(spark, folder).select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", "event_id")).alias("text"),
        (F.col("score") / F.lit(100.0)).alias("hate_speech_score"),
        F.lit("train").alias("split"),
    )
    side = F.when(F.col("lang").eqNullSafe("en"), "train").otherwise("test")
    quality = read_table(spark, folder, "labels").select("doc_id", "quality")
    layouts = {
        "twitter": lambda: docs.select(
            F.col("doc_id").alias("row_id"),
            F.col("text").alias("tweet"),
            F.col("label").cast("string").alias("label"),
            _null_if("lang", "fr").alias("lang"),
            F.lit("train").alias("split"),
        ),
        "gender": lambda: docs.select(
            F.col("text").alias("Text"), F.nullif("label", F.lit(0)).alias("Label"), side.alias("split")
        ),
        "berkeley": lambda: comments,
        "toxigen_human": lambda: docs.join(quality, "doc_id").select(
            "text",
            (F.nullif("quality", F.lit(0)).cast("double") * F.lit(3.0)).alias("toxicity_ai"),
            (F.col("label").cast("double") * F.lit(3.0)).alias("toxicity_human"),
            F.when(side == "train", "train").otherwise("test").alias("split"),
        ),
    }
    folders = {}
    for name in names:
        folders[name] = f"{base}/{name}"
        path = f"{folders[name]}/annotated" if name == "toxigen_human" else folders[name]
        layouts[name]().write.partitionBy("split").parquet(path)
    return folders


@query
def job_training_set(spark: SparkSession, folder: str) -> DataFrame:
    """Four stored datasets loaded by name, harmonised, split, concatenated and stored."""
    folders = _stored_sets(spark, folder, "twitter", "gender", "berkeley", "toxigen_human")
    return _tagged(flows.prepare(spark, folders, new_folder(spark, "prepared")), "dataset", "text", "label")


@query
def job_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Two models trained on a prepared set and measured on its held-out side, plain and on retrieval prompts."""
    folders = _stored_sets(spark, folder, "twitter", "gender")
    train, val = flows.prepare(spark, folders, new_folder(spark, "prepared"))
    path = new_folder(spark, "index")
    index = index_store.open_index(spark, path, build_from=_pages(spark, folder), metadata=["url"])
    models = {
        "naive_bayes": settle(classify.train_naive_bayes(train)),
        "majority": lambda rows: classify.score_majority(rows, train),
    }
    return flows.evaluate_models(val, models, index)


@query
def job_preference_set(spark: SparkSession, folder: str) -> DataFrame:
    """Preference rows of stored conversations, split and stored."""
    base = new_folder(spark, "sets")
    _preference_source(spark, folder).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(f"{base}/train")
    return _tagged(flows.preference_set(spark, base, new_folder(spark, "preferences")), "prompt", "completion", "label")


# Training log


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("epoch"), "ts", "event_id", F.col("value").alias("loss")
    )


@query
def epoch_loss(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.epoch_loss(_log(spark, folder))


@query
def epoch_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.epoch_elapsed(_log(spark, folder))


@query
def progress_rows(spark: SparkSession, folder: str) -> DataFrame:
    steps = evaluate.with_step(_log(spark, folder), ["ts", "event_id"])
    return evaluate.progress_rows(steps).select("epoch", "step", "steps", "loss", "shown")


@query
def log_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows due every 100 steps are appended to a table and read back."""
    path = new_folder(spark, "log")
    steps = evaluate.with_step(_log(spark, folder), ["ts", "event_id"])
    metrics.append_log(steps.withColumn("run", F.lit("events")), path, steps=100)
    return metrics.read_metrics(spark, path).select("run", "epoch", "step", "loss")


# Streams


@query
def stream_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The events file as a stream through the threshold rule, appended to a table."""
    schema = read_table(spark, folder, "events").schema
    path = new_folder(spark, "stream-out")

    def label(df: DataFrame) -> DataFrame:
        return df.select("event_id", lb.above(F.col("value"), 50.0).alias("label"))

    events = files.read_stream(spark, folder, schema, "events.parquet")
    files.append_stream(events, path, label).awaitTermination()
    return spark.read.parquet(path)


@query
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test texts arrive in files and are scored batch by batch; the first batch is replayed."""
    train, test = _holdout(spark, folder)
    model = settle(classify.train_naive_bayes(train))
    arriving, path = new_folder(spark, "arriving"), new_folder(spark, "scores")
    test.select("doc_id", "text").repartition(4, "doc_id").write.parquet(arriving)
    batches = []

    def score(batch: DataFrame) -> DataFrame:
        scored = classify.score_naive_bayes(batch, model, "doc_id").select("doc_id", "pred")
        batches.append(settle(scored))
        return batches[-1]

    stream = files.read_stream(spark, arriving, spark.read.parquet(arriving).schema, max_files=1)
    files.merge_batches(stream, path, score).awaitTermination()
    files.merge_batch(batches[0], 0, path)
    return spark.read.parquet(path).select("doc_id", "pred")
