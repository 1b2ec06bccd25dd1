"""Gradients against finite differences, and training on a made-up corpus."""

import numpy as np
import pytest

from slotloom.operators import encoder, training


def inputs(rng, n, hints):
    hot = np.zeros((n, hints))
    hot[np.arange(n), rng.integers(0, hints, n)] = 1
    return rng.normal(size=(n, 4, 3)), rng.normal(size=(n, 3, 3)), hot


@pytest.mark.parametrize("variant", sorted(encoder.VARIANTS))
def test_gradients(variant):
    rng = np.random.default_rng(0)
    model = encoder.Encoder.random(3, 2, 4, 5, variant)
    model = training.with_weights(model, {k: v.astype(np.float64) for k, v in training.weights_of(model).items()})
    x = inputs(rng, 9, 4)
    _, gradients = training.loss_and_gradients(model, *x)
    weights = training.weights_of(model)
    assert set(gradients) == set(weights)
    for name, w in weights.items():
        for at in rng.integers(0, w.size, 4):
            values = []
            for step in (1e-6, -1e-6):
                changed = w.copy()
                changed.reshape(-1)[at] += step
                values.append(training.loss_and_gradients(training.with_weights(model, weights | {name: changed}), *x)[0])
            assert np.isclose((values[0] - values[1]) / 2e-6, gradients[name].reshape(-1)[at], rtol=1e-4, atol=1e-6), name


def test_forward_agrees_with_the_encoder():
    rng = np.random.default_rng(1)
    model = encoder.Encoder.random(3, 2, 4, 5)
    a, b, c = (x.astype(np.float32) for x in inputs(rng, 6, 4))
    out = model.forward(a, b, c)
    d = lambda i, j: np.linalg.norm(out[i] - out[j], axis=1)
    want = np.maximum(d(slice(0, 2), slice(2, 4)) - d(slice(0, 2), slice(4, 6)) + 2, 0).mean()
    assert np.isclose(training.loss_and_gradients(model, a, b, c)[0], want, rtol=1e-4)


def made_up(spark, n=240, seed=0):
    """Rows whose label shows in their vectors, under noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = i % 3
        matrix = lambda length: (rng.normal(size=(length, 4)) + np.eye(4)[label]).astype(float).tolist()
        rows.append((i, matrix(5), matrix(4), int(rng.integers(0, 4)), label))
    return spark.createDataFrame(rows, "id long, identifiers array<array<float>>, tokens array<array<float>>, hint int, label long")


def test_loss_falls(spark):
    features, valid = made_up(spark), made_up(spark, 60, 1)
    params = {"epochs": 5, "lr": 0.02, "batch_size": 32, "margin": 2.0, "dropout": 0.1}
    start = encoder.Encoder.random(4, 6, 4, 8)
    model, history = training.train(start, features, params, valid, n_hints=4, workers=2)
    assert history[-1]["loss"] < 0.5 * history[0]["loss"]
    assert history[-1]["validation"] < 0.7 * training.validation_loss(start, valid, 4)
    again = training.from_bytes(training.to_bytes(training.weights_of(model)))
    assert all((again[k] == v).all() for k, v in training.weights_of(model).items())


def plain_training(rows, start, epochs, lr, batch, dropout, seed):
    """One trainer that takes the batches one after the other."""
    import pandas as pd
    from pyspark.sql import functions as F

    model, adam, losses = start, training.Adam(lr), []
    for epoch in epochs:
        table = rows[epoch].withColumn("h", F.xxhash64("anchor", F.lit(seed + epoch))).orderBy("h", "anchor").toPandas()
        table["number"], seen = range(len(table)), []
        for at in range(0, len(table), batch):
            part = table.iloc[at : at + batch]
            loss, gradients = training.exact_gradients(model, training._arrays(pd.DataFrame(part), 4, dropout, seed + epoch))
            model = training.with_weights(model, adam.update(training.weights_of(model), gradients))
            seen += [loss] * len(part)
        losses.append(np.mean(seen))
    return model, losses


@pytest.mark.parametrize("workers", [1, 3])
def test_any_number_of_tasks_takes_the_steps_of_one(spark, workers):
    """Two epochs with dropout and Adam's state between them, against a plain loop."""
    from pyspark.sql import functions as F

    from slotloom.operators.triplets import mined

    features = made_up(spark, 90)
    labelled = features.select(F.col("id").alias("vec_id"), "label")
    rows = {e: training.triplet_features(mined(labelled, 7 + e), features) for e in (1, 2)}
    start = encoder.Encoder.random(4, 6, 4, 8)
    want, losses = plain_training(rows, start, (1, 2), 0.02, 32, 0.2, 7)
    model, history = training.train(start, features, {"epochs": 2, "lr": 0.02, "batch_size": 32, "margin": 2.0, "dropout": 0.2}, n_hints=4, seed=7, workers=workers, synchronous=True)
    assert all(np.allclose(v, training.weights_of(want)[k], atol=1e-5) for k, v in training.weights_of(model).items())
    assert np.allclose([h["loss"] for h in history], losses, atol=1e-5)
    assert not np.allclose(model.weight, start.weight, atol=1e-3)


def test_synchronous_training_without_triplets(spark):
    start = encoder.Encoder.random(4, 6, 4, 8)
    model, history = training.train(start, made_up(spark, 1), {"epochs": 1, "lr": 0.1, "batch_size": 8, "margin": 2.0, "dropout": 0.0}, n_hints=4, workers=2, synchronous=True)
    assert history == [{"epoch": 1, "loss": 0.0}] and (model.weight == start.weight).all()


def test_no_triplets_leave_the_model(spark):
    start = encoder.Encoder.random(4, 6, 4, 8)
    model, history = training.train(start, made_up(spark, 1), {"epochs": 1, "lr": 0.1, "batch_size": 8, "margin": 2.0, "dropout": 0.0}, n_hints=4, workers=1)
    assert history == [{"epoch": 1, "loss": 0.0}] and (model.weight == start.weight).all()


@pytest.mark.parametrize("variant", sorted(encoder.VARIANTS))
def test_exported_model(variant):
    from slotloom.operators import onnx_export

    model = encoder.Encoder.random(10, 6, 5, 8, variant)
    raw = onnx_export.exported(model, (4, 3))
    onnx_export.checked(model, raw, (4, 3))
    onnx_export.checked(model, raw, (4, 3), batch=1, seed=3)
    other = encoder.Encoder.random(10, 6, 5, 8, variant, seed=9)
    with pytest.raises(AssertionError):
        onnx_export.checked(other, raw, (4, 3))
