"""Training of the sequence encoder on triplets: margin loss, gradients in numpy, Adam.

An epoch is one pass over the triplets.  Each of at most ``WORKERS`` tasks starts from the
same weights, takes Adam steps over batches of its rows, and returns its weights; their mean,
weighted by rows, starts the next epoch.  The driver adds them up one after the other, so it
holds two sets of weights whatever the data's size is.

``train_synchronously`` takes the steps of a single trainer instead: the rows are numbered, a batch is so many of them
in that order, and the tasks of a barrier stage each take their share of every batch, exchange gradients by ``allGather`` and make the
same Adam step, so any number of tasks gives the weights of one (but for rounding).  Dropout masks are drawn per
row.  Adam's state goes from epoch to epoch.  Gradients pass the driver's coordinator as messages, so a step
moves one set of weights per task; the driver keeps the weights and Adam's two averages of one task.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.operators.encoder import VARIANTS, Encoder, _sigmoid, _tensor
from slotloom.operators.labels import dense_ids
from slotloom.operators.triplets import MARGIN, margin_losses, mean_loss, mined

WORKERS, VALIDATE_EVERY = 64, 5
_BETA, _RARE, _SMALL = 0.9, 0.999, 1e-8


def weights_of(model: Encoder) -> dict[str, np.ndarray]:
    """All trained arrays by name."""
    out = {"weight": model.weight, "bias": model.bias}
    for part, used in zip(("identifiers", "tokens"), VARIANTS[model.variant]):
        if used:
            out |= {f"{part}/{k}": v for k, v in getattr(model, part).items()}
    return out


def with_weights(model: Encoder, weights: dict[str, np.ndarray]) -> Encoder:
    parts = {p: {k: weights.get(f"{p}/{k}", v) for k, v in getattr(model, p).items()} for p in ("identifiers", "tokens")}
    return Encoder(parts["identifiers"], parts["tokens"], weights["weight"], weights["bias"], model.variant)


def to_bytes(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def from_bytes(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray):
    """The last state of one direction, and what its gradient needs."""
    n, steps, _ = x.shape
    h = c = np.zeros((n, wh.shape[1]), x.dtype)
    pre, kept = x @ wx.T + b, []
    for t in range(steps):
        i, f, g, o = np.split(pre[:, t] + h @ wh.T, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        after = f * c + i * g
        kept.append((h, c, i, f, g, o, np.tanh(after)))
        h, c = o * np.tanh(after), after
    return h, kept


def _back(x: np.ndarray, wh: np.ndarray, kept: list, dh: np.ndarray):
    """Gradients of a direction's weights from that of its last state."""
    gx, gh, gb = 0.0, np.zeros_like(wh), 0.0
    dc = np.zeros_like(dh)
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, g, o, after = kept[t]
        dc = dc + dh * o * (1 - after**2)
        da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g**2), dh * after * o * (1 - o)], 1)
        gx = gx + da.T @ x[:, t]
        gh += da.T @ h
        gb = gb + da.sum(0)
        dh, dc = da @ wh, dc * f
    return gx, gh, gb


def loss_and_gradients(model: Encoder, identifiers: np.ndarray, tokens: np.ndarray, hints: np.ndarray, margin: float = MARGIN) -> tuple[float, dict[str, np.ndarray]]:
    """Mean triplet loss, and its gradients; rows are anchors, then positives, then negatives."""
    use_id, use_tok, use_hint = VARIANTS[model.variant]
    inputs, states, kept = {}, [], {}
    for name, x, used in (("identifiers", identifiers, use_id), ("tokens", tokens, use_tok)):
        if used:
            w = getattr(model, name)
            forward, kept[name, "fw"] = _run(x, w["fw_x"], w["fw_h"], w["fw_b"])
            # The backward direction has seen the last place only.
            backward, kept[name, "bw"] = _run(x[:, -1:], w["bw_x"], w["bw_h"], w["bw_b"])
            inputs[name] = x
            states += [forward, backward]
    if use_hint:
        states.append(hints)
    joined = np.concatenate(states, 1)
    out = joined @ model.weight.T + model.bias
    n = len(out) // 3
    a, p, q = out[:n], out[n : 2 * n], out[2 * n :]
    near, far = a - p, a - q
    d_near, d_far = np.sqrt((near**2).sum(1) + 1e-12), np.sqrt((far**2).sum(1) + 1e-12)
    loss = np.maximum(d_near - d_far + margin, 0)
    on = ((loss > 0) / max(n, 1)).astype(out.dtype)[:, None]
    to_near, to_far = on * near / d_near[:, None], on * far / d_far[:, None]
    d_out = np.concatenate([to_near - to_far, -to_near, to_far]).astype(out.dtype)
    gradients = {"weight": d_out.T @ joined, "bias": d_out.sum(0)}
    d_joined, at = d_out @ model.weight, 0
    for name, x in inputs.items():
        w = getattr(model, name)
        for way, seen in (("fw", x), ("bw", x[:, -1:])):
            width = w[f"{way}_h"].shape[1]
            found = _back(seen, w[f"{way}_h"], kept[name, way], d_joined[:, at : at + width])
            gradients |= {f"{name}/{way}_{k}": v for k, v in zip("xhb", found)}
            at += width
    return float(loss.mean()) if n else 0.0, gradients


class Adam:
    def __init__(self, lr: float):
        self.lr, self.step, self.mean, self.square = lr, 0, {}, {}

    def state(self) -> dict[str, np.ndarray]:
        return {"step": np.array(self.step)} | {f"mean/{k}": v for k, v in self.mean.items()} | {f"square/{k}": v for k, v in self.square.items()}

    @classmethod
    def of_state(cls, lr: float, state: dict[str, np.ndarray]) -> Adam:
        out = cls(lr)
        out.step = int(state.get("step", 0))
        for part in ("mean", "square"):
            setattr(out, part, {k.removeprefix(f"{part}/"): v for k, v in state.items() if k.startswith(f"{part}/")})
        return out

    def update(self, weights: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.step += 1
        out = {}
        for k, g in gradients.items():
            self.mean[k] = _BETA * self.mean.get(k, 0) + (1 - _BETA) * g
            self.square[k] = _RARE * self.square.get(k, 0) + (1 - _RARE) * g**2
            step = self.mean[k] / (1 - _BETA**self.step) / (np.sqrt(self.square[k] / (1 - _RARE**self.step)) + _SMALL)
            out[k] = (weights[k] - self.lr * step).astype(np.float32)
        return out


def triplet_features(triplets: DataFrame, features: DataFrame) -> DataFrame:
    """The three inputs of each triplet: structs of identifiers, tokens and hint."""
    inputs = features.select(F.col("id").alias("__id"), F.struct("identifiers", "tokens", "hint").alias("__x"))
    out = triplets
    for name in ("anchor", "positive", "negative"):
        out = out.join(inputs.withColumnsRenamed({"__id": name, "__x": f"{name}_x"}), name)
    return out.select("anchor", "anchor_x", "positive_x", "negative_x")


def _epoch(sent, lr: float, batch: int, margin: float, dropout: float, n_hints: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, adam, rows, total = sent.value, Adam(lr), 0, 0.0
        weights = weights_of(model)
        rng = np.random.default_rng(seed)
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                x = [row for c in ("anchor_x", "positive_x", "negative_x") for row in part[c]]
                drawn = [_tensor(pd.Series([r[c] for r in x])) for c in ("identifiers", "tokens")]
                hints = np.zeros((len(x), n_hints), np.float32)
                hints[np.arange(len(x)), [r["hint"] for r in x]] = 1
                if dropout:
                    drawn = [d * (rng.random(d.shape, np.float32) >= dropout) / np.float32(1 - dropout) for d in drawn]
                    hints = hints * (rng.random(hints.shape, np.float32) >= dropout) / np.float32(1 - dropout)
                loss, gradients = loss_and_gradients(model, *drawn, hints, margin)
                weights = adam.update(weights, gradients)
                model = with_weights(model, weights)
                rows, total = rows + len(part), total + loss * len(part)
        if rows:
            yield pd.DataFrame({"rows": [rows], "loss": [total], "weights": [to_bytes(weights)]})

    return run


def train_epoch(model: Encoder, rows: DataFrame, lr: float, batch: int, margin: float = MARGIN, dropout: float = 0.0, n_hints: int = 1024, seed: int = 0, workers: int = WORKERS) -> tuple[Encoder, float]:
    """(the model after one pass over the rows of ``triplet_features``, the mean loss of the pass)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)
    # Another order of the rows in each epoch.
    dealt = rows.repartition(workers, F.xxhash64("anchor", F.lit(seed)))
    found = dealt.mapInPandas(_epoch(sent, lr, batch, margin, dropout, n_hints, seed), "rows long, loss double, weights binary")
    total, loss, sums = 0, 0.0, {}
    for r in found.toLocalIterator():
        for k, v in from_bytes(bytes(r.weights)).items():
            sums[k] = sums.get(k, 0) + v.astype(np.float64) * r.rows
        total, loss = total + r.rows, loss + r.loss
    sent.destroy()
    if not total:
        return model, 0.0
    return with_weights(model, {k: (v / total).astype(np.float32) for k, v in sums.items()}), loss / total


def _arrays(frame: pd.DataFrame, n_hints: int, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inputs of a batch's rows: anchors, positives, negatives; every row's masks follow from its number."""
    x = [row for c in ("anchor_x", "positive_x", "negative_x") for row in frame[c]]
    drawn = [_tensor(pd.Series([r[c] for r in x])) for c in ("identifiers", "tokens")]
    hints = np.zeros((len(x), n_hints), np.float32)
    hints[np.arange(len(x)), [r["hint"] for r in x]] = 1
    out = [*drawn, hints]
    if dropout:
        n = len(frame)
        for row, number in enumerate(frame["number"].tolist()):
            rng = np.random.default_rng([seed, number])
            for part in range(3):
                for a in out:
                    at = part * n + row
                    a[at] *= (rng.random(a[at].shape, np.float32) >= dropout) / np.float32(1 - dropout)
    return tuple(out)


def exact_gradients(model: Encoder, inputs: tuple[np.ndarray, ...], margin: float = MARGIN) -> tuple[float, dict[str, np.ndarray]]:
    """``loss_and_gradients`` in double precision: Adam divides by a gradient's size, so rounding noise would grow to whole steps."""
    wide = with_weights(model, {k: v.astype(np.float64) for k, v in weights_of(model).items()})
    return loss_and_gradients(wide, *(x.astype(np.float64) for x in inputs), margin)


def _exchanged(context, rows: int, loss: float, gradients: dict[str, np.ndarray]) -> tuple[int, float, dict[str, np.ndarray]]:
    """The rows of a batch over all tasks, their mean loss and mean gradients, the same in every task."""
    mine = to_bytes({"rows": np.array(rows), "loss": np.array(loss * rows)} | {f"g/{k}": v for k, v in gradients.items()})
    total, losses, sums = 0, 0.0, {}
    for message in context.allGather(base64.b64encode(mine).decode()):
        theirs = from_bytes(base64.b64decode(message))
        n = int(theirs["rows"])
        total, losses = total + n, losses + float(theirs["loss"])
        for k, v in theirs.items():
            if n and k.startswith("g/"):
                sums[k[2:]] = sums.get(k[2:], 0) + v * n
    return total, losses / max(total, 1), {k: v / total for k, v in sums.items()}


def _synchronous_epoch(sent, steps: int, margin: float, dropout: float, n_hints: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context, (model, lr, state) = BarrierTaskContext.get(), sent.value
        adam, weights = Adam.of_state(lr, from_bytes(state)), weights_of(model)
        held, more, total, losses = None, iter(batches), 0, 0.0

        def share(step: int) -> pd.DataFrame | None:
            """This task's rows of a batch; rows come in the order of their batches."""
            nonlocal held
            while held is None or not len(held) or int(held["step"].iloc[-1]) <= step:
                frame = next(more, None)
                if frame is None:
                    break
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if held is None:
                return None
            mine, held = held[held["step"] == step], held[held["step"] > step]
            return mine if len(mine) else None

        for step in range(steps):
            part = share(step)
            if part is None:
                found = 0, 0.0, {}
            else:
                found = len(part), *exact_gradients(model, _arrays(part, n_hints, dropout, seed), margin)
            rows, loss, gradients = _exchanged(context, *found)
            if gradients:
                weights = adam.update(weights, gradients)
                model = with_weights(model, weights)
            total, losses = total + rows, losses + loss * rows
        if context.partitionId() == 0:
            yield pd.DataFrame({"rows": [total], "loss": [losses], "weights": [to_bytes(weights)], "state": [to_bytes(adam.state())]})

    return run


def synchronous_epoch(model: Encoder, state: bytes, rows: DataFrame, lr: float, batch: int, margin: float = MARGIN, dropout: float = 0.0, n_hints: int = 1024, seed: int = 0, workers: int = 2) -> tuple[Encoder, bytes, float]:
    """(model, Adam's state, mean loss) after one pass over the rows of ``triplet_features`` by ``workers`` tasks that run at once.

    Batches follow the hash of the anchor and the seed, whatever the number of tasks is, which the cluster must have slots for.
    Each anchor is one row.
    """
    spark = rows.sparkSession
    numbered = dense_ids(rows.withColumn("__order", F.struct(F.xxhash64("anchor", F.lit(seed)), F.col("anchor"))), "__order", "number").drop("__order")
    numbered = numbered.withColumn("step", F.floor(F.col("number") / batch))
    steps = (numbered.agg(F.max("step")).first()[0] + 1) if rows.take(1) else 0
    if not steps:
        return model, state, 0.0
    sent = spark.sparkContext.broadcast((model, lr, state))
    dealt = numbered.repartition(workers, "number").sortWithinPartitions("number")
    found = dealt.mapInPandas(_synchronous_epoch(sent, int(steps), margin, dropout, n_hints, seed), "rows long, loss double, weights binary, state binary", barrier=True).collect()[0]
    sent.destroy()
    return with_weights(model, from_bytes(bytes(found.weights))), bytes(found.state), found.loss / max(found.rows, 1)


def validation_loss(model: Encoder, features: DataFrame, n_hints: int, margin: float = MARGIN, seed: int = 0) -> float | None:
    """Mean loss of triplets that are mined among ``features`` (id, identifiers, tokens, hint, label); None without any."""
    from slotloom.operators.encoder import embedded

    table = embedded(features, model, n_hints).join(features.select("id", "label"), "id").withColumnRenamed("id", "vec_id")
    return mean_loss(margin_losses(mined(table, seed), table, margin)).first().loss


def train(model: Encoder, features: DataFrame, params: dict, valid: DataFrame | None = None, n_hints: int = 1024, seed: int = 0, workers: int = WORKERS, synchronous: bool = False) -> tuple[Encoder, list[dict]]:
    """(trained model, losses per epoch) from ``features`` (id, identifiers, tokens, hint, label).

    ``params``: epochs, lr, batch_size, margin, dropout.  Every ``VALIDATE_EVERY``-th epoch has a validation
    loss if there are validation rows.  ``synchronous``: all tasks take each step together (``synchronous_epoch``).
    """
    history, state = [], to_bytes(Adam(params["lr"]).state())
    labelled = features.select(F.col("id").alias("vec_id"), "label")
    for epoch in range(1, params["epochs"] + 1):
        rows = triplet_features(mined(labelled, seed + epoch), features)
        if synchronous:
            model, state, loss = synchronous_epoch(model, state, rows, params["lr"], params["batch_size"], params["margin"], params["dropout"], n_hints, seed + epoch, workers)
        else:
            model, loss = train_epoch(model, rows, params["lr"], params["batch_size"], params["margin"], params["dropout"], n_hints, seed + epoch, workers)
        history.append({"epoch": epoch, "loss": loss})
        if valid is not None and epoch % VALIDATE_EVERY == 0:
            history[-1]["validation"] = validation_loss(model, valid, n_hints, params["margin"])
    return model, history
