"""The batch build as jobs: extract, preprocess, vectorize, learn, predict, eval, reduce, bundle, infer, check.

Each job reads what the one before it wrote and replaces its own output, so a job can run
again.  ``python -m slotloom.plans.jobs PHASE --o FOLDER [--c CORPUS]``.
"""

from __future__ import annotations

import argparse
import concurrent.futures
import contextlib
import datetime
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.functions import text, types
from slotloom.operators import datapoints, encoder, evaluate, extract, features, filters, infer, knn, labels, reduce, training, typecheck
from slotloom.plans import bundle
from slotloom.sources import corpus

# Defaults of training and inference; a JSON file with the same keys overrides them.
PARAMETERS = {"epochs": 25, "lr": 0.002, "dropout": 0.25, "batch_size": 2536, "margin": 2.0, "hidden_size": 512, "layers": 1, "output_size": 1536, "k": 10, "top_n_hints": 1024, "dimensions": 256, "vector_size": 100, "w2v_epochs": 20}


def parameters(path: str | None = None) -> dict:
    return PARAMETERS | (json.loads(Path(path).read_text()) if path else {})


@contextlib.contextmanager
def logged(spark: SparkSession, out: str, phase: str):
    """Appends a row to ``<out>/logs``: the phase, when it began, how long it took, and its error if it failed."""
    began, error = time.time(), None
    try:
        yield
    except BaseException as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        row = [(phase, datetime.datetime.fromtimestamp(began, datetime.UTC), round(time.time() - began, 3), error)]
        spark.createDataFrame(row, "phase string, began timestamp, seconds double, error string").coalesce(1).write.mode("append").json(f"{out}/logs")


def requests_at_once(call: Callable[[int], object], n: int = 25) -> float:
    """Seconds that ``n`` concurrent calls take, as a service would get them; their errors are raised."""
    began = time.time()
    with concurrent.futures.ThreadPoolExecutor(n) as pool:
        for done in [pool.submit(call, i) for i in range(n)]:
            done.result()
    return time.time() - began


def extract_job(spark: SparkSession, corpus_dir: str, out: str, limit: int | None = None, duplicates: str | None = None) -> DataFrame:
    """Slots of all sources of a corpus, one row each, and what each source imports.

    ``limit``: so many repositories, in the order of their names; ``duplicates``: a text file of files that are left out.
    """
    sources = corpus.source_files(spark, corpus_dir)
    if duplicates:
        sources = corpus.without_duplicates(sources, spark.read.text(duplicates).withColumnRenamed("value", "file"))
    if limit is not None:
        sources = sources.join(F.broadcast(corpus.repositories(sources).orderBy("author", "repo").limit(limit)), ["author", "repo"], "left_semi")
    sources.write.mode("overwrite").parquet(f"{out}/sources")
    sources = spark.read.parquet(f"{out}/sources").select("file", "text")
    extract.extracted(sources).write.mode("overwrite").parquet(f"{out}/slots")
    infer.imported(sources).write.mode("overwrite").parquet(f"{out}/imports")
    return spark.read.parquet(f"{out}/slots")


def preprocess_job(spark: SparkSession, out: str, seed: int = 0, params: dict = PARAMETERS, random_hints: bool = False) -> DataFrame:
    """Typed slots as datapoints: normalised labels, codes, hints and splits, partitioned by task and split.

    With ``random_hints`` a row's hint comes from what its file imports, each match kept by a seeded coin,
    else from its type.
    """
    slots = spark.read.parquet(f"{out}/slots").where("error is null and annotation <> ''")
    rows = slots.withColumn("type", types.reduce_depth(types.normalised(F.col("annotation")))).where("type is not null")
    rows = rows.where(~F.col("type").isin("", *filters.NO_ARGUMENT))
    rows = rows.where(F.col("kind").isin("Parameter", "Return") | ~F.col("type").isin(*filters.TRIVIAL_VARIABLES))
    function = F.element_at(F.split("scope", r"\."), -1)
    rows = filters.filter_functions(rows.withColumn("function", function), column="function")
    codes = labels.encoded(rows.select("type"))
    codes.write.mode("overwrite").parquet(f"{out}/codes")
    codes = spark.read.parquet(f"{out}/codes")
    corpus.write_frequencies(rows.select("type"), spark.read.parquet(f"{out}/imports").select(F.explode("imports").alias("type")), f"{out}/frequencies", params["top_n_hints"])
    ranked = labels.top_types(rows.select("type"), params["top_n_hints"])
    coded = labels.with_codes(rows, "type", codes, "label")
    if random_hints:
        visible = spark.read.parquet(f"{out}/imports").select(F.col("file").alias("imported_by"), F.array_join("imports", " ").alias("aval_types"))
        coded = labels.random_hint_codes(coded.join(visible, F.col("file") == F.col("imported_by"), "left").withColumn("aval_types", F.coalesce("aval_types", F.lit(""))), ranked, seed=seed)
    else:
        coded = coded.join(labels.hint_codes(rows, ranked), "type")
    coded = infer.with_arguments(coded)
    final = datapoints.with_split(coded, seed).select(F.col("kind").alias("task"), "split", "file", "scope", "name", "line", "place", "function", "arguments", "occurrences", "type", "label", "hint")
    corpus.write_datapoints(final, f"{out}/datapoints")
    return spark.read.parquet(f"{out}/datapoints")


def sentences(points: DataFrame) -> DataFrame:
    """The token lists that the word model learns from: the six sentence columns of the training split."""
    train = points.where("split = 'train'")
    plain = lambda c: text.split_identifier(F.col(c))
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    params = train.where("task = 'Parameter'").select(joined("occurrences").alias("arg_occur"), plain("function").alias("func_name"))
    returns = train.where("task = 'Return'").select(joined("occurrences").alias("return_expr_str"), text.split_identifier(joined("arguments")).alias("arg_names_str"))
    variables = train.where("task = 'Variable'").select(plain("name").alias("var_name"), joined("occurrences").alias("var_occur"))
    return features.token_stream(params, returns, variables)


def vectorize_job(spark: SparkSession, out: str, params: dict = PARAMETERS, parity: bool = False) -> DataFrame:
    """Matrices of word vectors for identifiers (31 places) and code tokens (21 places), by one word model."""
    points = spark.read.parquet(f"{out}/datapoints").withColumn("kind", F.col("task")).withColumn("id", infer.slot_id()).drop("kind")
    model = features.train_word_vectors(sentences(points), params["vector_size"], params.get("min_count", features.MIN_COUNT), params["w2v_epochs"])
    model.write().overwrite().save(f"{out}/word_model")
    model.getVectors().select("word", _as_floats("vector").alias("vector")).write.mode("overwrite").parquet(f"{out}/words")
    infer.placed(points, parity).select("id", "task", "split", "label", "hint", "identifiers", "tokens").write.mode("overwrite").parquet(f"{out}/places")
    matrices = infer.matrices(spark.read.parquet(f"{out}/places"), spark.read.parquet(f"{out}/words"), params["vector_size"])
    matrices.write.mode("overwrite").partitionBy("split").parquet(f"{out}/features")
    return spark.read.parquet(f"{out}/features")


def learn_job(spark: SparkSession, out: str, params: dict = PARAMETERS, variant: str = "complete", validation: bool = False, seed: int = 0, workers: int = training.WORKERS, synchronous: bool = False) -> tuple[encoder.Encoder, list[dict]]:
    """Trains the encoder on triplets of the training split; labels need their support in each split for itself.

    ``synchronous``: the steps of a single trainer, by ``workers`` tasks at once.
    """
    rows = spark.read.parquet(f"{out}/features")
    part = lambda split: labels.supported(rows.where(F.col("split") == split), "label")
    model = encoder.Encoder.random(params["vector_size"], params["hidden_size"], params["top_n_hints"], params["output_size"], variant, seed)
    model, history = training.train(model, part("train"), params, part("valid") if validation else None, params["top_n_hints"], seed, workers, synchronous)
    bundle.save_blob(spark, f"{out}/encoder", bundle.encoder_bytes(model))
    spark.createDataFrame([(h["epoch"], h["loss"], h.get("validation")) for h in history], "epoch int, loss double, validation double").coalesce(1).write.mode("overwrite").parquet(f"{out}/history")
    return model, history


def _as_floats(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column, "float32")


def clusters(spark: SparkSession, out: str, vocabulary_limit: int | None = None) -> DataFrame:
    """The embedded rows (vec_id, embedding, label) of the training and validation splits whose label is in the vocabulary."""
    table = spark.read.parquet(f"{out}/embedded").where("split <> 'test'")
    counts = labels.frequencies(table.select(F.col("label").cast("string").alias("type")))
    kept = counts.orderBy(F.desc("n"), "type").limit(vocabulary_limit) if vocabulary_limit else labels.without_last(counts)
    return table.join(kept.select(F.col("type").cast("long").alias("label")), "label", "left_semi").select("vec_id", "embedding", "label")


def predict_job(spark: SparkSession, out: str, model: encoder.Encoder, params: dict = PARAMETERS, vocabulary_limit: int | None = None, dimensions: int | None = None) -> DataFrame:
    """Type clusters of the train and valid splits, and ranked predictions for the test split."""
    rows = spark.read.parquet(f"{out}/features")
    embedded = encoder.embedded(rows, model, params["top_n_hints"])
    table = embedded.join(rows.select("id", "task", "split", "label"), "id").withColumnRenamed("id", "vec_id")
    if dimensions:
        projection = reduce.projection_of(reduce.fit_pca(table.where("split <> 'test'"), dimensions))
        table = reduce.projected(table, projection)
    table.write.mode("overwrite").partitionBy("split").parquet(f"{out}/embedded")
    table = spark.read.parquet(f"{out}/embedded")
    index = knn.InvertedFile.build(clusters(spark, out, vocabulary_limit))
    index.save(f"{out}/index")
    found = knn.InvertedFile.load(spark, f"{out}/index").search(table.where("split = 'test'"), params["k"])
    votes = knn.vote(found)
    codes = spark.read.parquet(f"{out}/codes").select(F.col("code").cast("int").alias("label"), "type")
    named = votes.join(codes, "label").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "score"))), lambda x: F.struct(x["type"].alias("type"), x["score"].alias("score"))).alias("predictions"))
    truth = table.where("split = 'test'").select("vec_id", "task", F.col("label").cast("int").alias("label")).join(codes, "label")
    result = truth.join(named, truth.vec_id == named.query_id).select("task", F.col("type").alias("original_type"), "predictions", types.is_parametric(F.col("type")).alias("is_parametric"))
    corpus.write_predictions(result, f"{out}/predictions")
    return spark.read.schema(result.schema).json(f"{out}/predictions")


def eval_job(spark: SparkSession, out: str, top_n: int = evaluate.TOP_N) -> DataFrame:
    """Metrics per task and combined; common types are those of the training split."""
    kind = "task string, original_type string, predictions array<struct<type:string,score:double>>, is_parametric boolean"
    predictions = spark.read.schema(kind).json(f"{out}/predictions")
    train = spark.read.parquet(f"{out}/datapoints").where("split = 'train'").select("type")
    return evaluate.report(evaluate.judged(predictions, labels.common_types(labels.supported(train, "type")), top_n))


def reduce_job(spark: SparkSession, out: str, dimensions: int = PARAMETERS["dimensions"], vocabulary_limit: int | None = None) -> DataFrame:
    """Principal components of all cluster vectors, saved, and the index of the reduced clusters."""
    rows = clusters(spark, out, vocabulary_limit)
    projection = reduce.projection_of(reduce.fit_pca(rows, dimensions))
    bundle.save_matrix(spark, f"{out}/projection", projection)
    knn.InvertedFile.build(reduce.projected(rows, projection)).save(f"{out}/reduced_index")
    return spark.read.parquet(f"{out}/reduced_index/rows")


def bundle_job(spark: SparkSession, out: str, path: str, params: dict = PARAMETERS, reduced: bool = False) -> bundle.Bundle:
    """What inference needs, in one folder."""
    index = knn.InvertedFile.load(spark, f"{out}/reduced_index" if reduced else f"{out}/index")
    projection = bundle.read_matrix(spark, f"{out}/projection") if reduced else None
    made = bundle.Bundle(bundle.encoder_from(bundle.read_blob(spark, f"{out}/encoder")), spark.read.parquet(f"{out}/words"), spark.read.parquet(f"{out}/codes"), index, projection, params["k"], params["top_n_hints"], params["vector_size"])
    bundle.save(made, path)
    return bundle.load(spark, path)


def infer_job(spark: SparkSession, sources: DataFrame, path: str, out: str, filter_types: bool = True) -> DataFrame:
    """Ranked predictions of all slots of (file, text), as a table and as a document per file."""
    infer.predicted(sources, bundle.load(spark, path), filter_types).write.mode("overwrite").parquet(f"{out}/inferred")
    found = spark.read.parquet(f"{out}/inferred")
    infer.module_documents(found).write.mode("overwrite").json(f"{out}/documents")
    return found


def check_job(spark: SparkSession, sources: DataFrame, out: str, command: tuple[str, ...] = typecheck.COMMAND["mypy"]) -> DataFrame:
    """Type-checks the saved predictions of ``infer_job`` in their sources: ratios per kind; verdicts and typed sources are saved."""
    found = spark.read.parquet(f"{out}/inferred").where("error is null and size(predictions) > 0")
    slots = extract.extracted(sources).where("error is null").select("file", "scope", "kind", "name", "annotation", "level", "owner", "at", "place")
    keys = ["file", "scope", "kind", "name"]
    if "place" in found.columns:
        joined = found.select(*keys, "place", "predictions").join(slots, [*keys, "place"])
    else:
        # Saved without places: the first definition of a name.
        joined = found.select(*keys, "predictions").join(slots.groupBy(*keys).agg(F.min_by(F.struct("annotation", "level", "owner", "at", "place"), "place").alias("s")).select(*keys, "s.*"), keys)
    rows = joined.select("file", "place", F.col("annotation").alias("truth"), typecheck.trial_order().alias("trial"), F.transform("predictions", lambda p: p["type"]).alias("predictions"))
    plain = sources.select("file", "text")
    typecheck.slot_verdicts(plain, rows, command).write.mode("overwrite").parquet(f"{out}/verdicts")
    verdicts = spark.read.parquet(f"{out}/verdicts")
    typecheck.applied(plain, verdicts).write.mode("overwrite").parquet(f"{out}/typed")
    return typecheck.ratios(verdicts)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("phase", choices=["extract", "preprocess", "vectorize", "learn", "predict", "eval", "reduce", "bundle", "infer", "check"])
    parser.add_argument("--o", required=True, help="output folder")
    parser.add_argument("--c", help="corpus folder (extract, infer, check)")
    parser.add_argument("--p", help="JSON file with parameters")
    parser.add_argument("--b", help="bundle folder (bundle, infer)")
    parser.add_argument("--m", help="npz file with encoder weights (predict); without it those that learn saved")
    parser.add_argument("--l", type=int, help="vocabulary limit (predict, reduce) or number of repositories (extract)")
    parser.add_argument("--dup", help="text file of files to leave out (extract)")
    parser.add_argument("--rvth", action="store_true", help="random visible types (preprocess)")
    parser.add_argument("--dt", choices=sorted(encoder.VARIANTS), default="complete", help="model variant (learn)")
    parser.add_argument("--v", action="store_true", help="validation loss (learn)")
    parser.add_argument("--w", type=int, help="tasks that take each training step together (learn)")
    parser.add_argument("--d", type=int, help="reduced dimensions (predict, reduce)")
    parser.add_argument("--r", action="store_true", help="reduced clusters (bundle)")
    parser.add_argument("--tp", type=int, default=evaluate.TOP_N, help="top-n of the metrics (eval)")
    a = parser.parse_args()
    spark, params = SparkSession.builder.appName(f"slotloom-{a.phase}").getOrCreate(), parameters(a.p)
    sources = corpus.source_files(spark, a.c).select("file", "text") if a.phase in ("infer", "check") else None
    phases = {
        "extract": lambda: extract_job(spark, a.c, a.o, a.l, a.dup),
        "preprocess": lambda: preprocess_job(spark, a.o, params=params, random_hints=a.rvth),
        "vectorize": lambda: vectorize_job(spark, a.o, params),
        "learn": lambda: learn_job(spark, a.o, params, a.dt, a.v, workers=a.w or training.WORKERS, synchronous=a.w is not None),
        "predict": lambda: predict_job(spark, a.o, load_encoder(a.m) if a.m else bundle.encoder_from(bundle.read_blob(spark, f"{a.o}/encoder")), params, a.l, a.d),
        "eval": lambda: eval_job(spark, a.o, a.tp).show(truncate=False),
        "reduce": lambda: reduce_job(spark, a.o, a.d or params["dimensions"], a.l),
        "bundle": lambda: bundle_job(spark, a.o, a.b, params, a.r),
        "infer": lambda: infer_job(spark, sources, a.b, a.o),
        "check": lambda: check_job(spark, sources, a.o).show(truncate=False),
    }
    with logged(spark, a.o, a.phase):
        phases[a.phase]()


def save_encoder(model: encoder.Encoder, path: str) -> None:
    Path(path).write_bytes(bundle.encoder_bytes(model))


def load_encoder(path: str) -> encoder.Encoder:
    return bundle.encoder_from(Path(path).read_bytes())


if __name__ == "__main__":
    main()
