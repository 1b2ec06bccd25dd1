"""A trained model as one folder: parameters, word vectors, encoder, label codes, projection and index of type clusters."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from slotloom.operators.encoder import Encoder
from slotloom.operators.knn import InvertedFile


@dataclass
class Bundle:
    encoder: Encoder
    words: DataFrame
    codes: DataFrame
    index: InvertedFile
    projection: np.ndarray | None = None
    k: int = 10
    n_hints: int = 1024
    vector_size: int = 100
    probes: int | None = None


def save_blob(spark: SparkSession, path: str, raw: bytes) -> None:
    spark.createDataFrame([(raw,)], "raw binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_blob(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(path).first().raw)


def save_matrix(spark: SparkSession, path: str, matrix: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, matrix)
    save_blob(spark, path, out.getvalue())


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return np.load(io.BytesIO(read_blob(spark, path)))


def encoder_bytes(model: Encoder) -> bytes:
    out = io.BytesIO()
    np.savez(out, variant=model.variant, weight=model.weight, bias=model.bias, **{f"id_{k}": v for k, v in model.identifiers.items()}, **{f"tok_{k}": v for k, v in model.tokens.items()})
    return out.getvalue()


def encoder_from(raw: bytes) -> Encoder:
    with np.load(io.BytesIO(raw)) as z:
        part = lambda p: {k.removeprefix(p): z[k] for k in z.files if k.startswith(p)}
        return Encoder(part("id_"), part("tok_"), z["weight"], z["bias"], str(z["variant"]))


def save(bundle: Bundle, path: str) -> None:
    """Every part is a Parquet table, so any file system that Spark knows will do."""
    spark = bundle.words.sparkSession
    save_blob(spark, f"{path}/encoder", encoder_bytes(bundle.encoder))
    save_blob(spark, f"{path}/parameters", json.dumps({"k": bundle.k, "n_hints": bundle.n_hints, "vector_size": bundle.vector_size, "probes": bundle.probes, "projected": bundle.projection is not None}).encode())
    bundle.words.write.mode("overwrite").parquet(f"{path}/words")
    bundle.codes.write.mode("overwrite").parquet(f"{path}/codes")
    bundle.index.save(f"{path}/index")
    if bundle.projection is not None:
        save_matrix(spark, f"{path}/projection", bundle.projection)


def load(spark: SparkSession, path: str) -> Bundle:
    found = json.loads(read_blob(spark, f"{path}/parameters"))
    projection = read_matrix(spark, f"{path}/projection") if found.pop("projected") else None
    return Bundle(encoder_from(read_blob(spark, f"{path}/encoder")), spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/codes"), InvertedFile.load(spark, f"{path}/index"), projection, **found)
