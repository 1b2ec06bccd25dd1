"""Sequence encoder: two one-layer bidirectional LSTMs, hint vector, linear layer; forward pass in numpy.

Weights are plain arrays that are broadcast (their size is fixed by the architecture).
Four variants: complete, woi (no identifiers), woc (no code tokens), wov (no hints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

VARIANTS = {"complete": (True, True, True), "woi": (False, True, True), "woc": (True, False, True), "wov": (True, True, False)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def init_lstm(inputs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Gates in the order input, forget, cell, output."""
    bound = 1 / np.sqrt(hidden)
    draw = lambda *shape: rng.uniform(-bound, bound, shape).astype(np.float32)
    return {f"{d}_{n}": draw(*s) for d in ("fw", "bw") for n, s in (("x", (4 * hidden, inputs)), ("h", (4 * hidden, hidden)), ("b", (4 * hidden,)))}


def _direction(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, steps, _ = x.shape
    hidden = wh.shape[1]
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    pre = x @ wx.T + b
    for t in range(steps):
        i, f, g, o = np.split(pre[:, t] + h @ wh.T, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
    return h


def last_states(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Both directions' outputs at the last time step: the backward one has seen only that step."""
    forward = _direction(x, w["fw_x"], w["fw_h"], w["fw_b"])
    backward = _direction(x[:, -1:], w["bw_x"], w["bw_h"], w["bw_b"])
    return np.concatenate([forward, backward], 1)


class Encoder:
    def __init__(self, identifiers: dict, tokens: dict, weight: np.ndarray, bias: np.ndarray, variant: str = "complete"):
        self.identifiers, self.tokens, self.weight, self.bias, self.variant = identifiers, tokens, weight, bias, variant

    @classmethod
    def random(cls, inputs: int = 100, hidden: int = 512, hints: int = 1024, outputs: int = 1536, variant: str = "complete", seed: int = 0) -> Encoder:
        rng = np.random.default_rng(seed)
        use_id, use_tok, use_hint = VARIANTS[variant]
        width = 2 * hidden * (use_id + use_tok) + hints * use_hint
        bound = 1 / np.sqrt(width)
        return cls(init_lstm(inputs, hidden, rng), init_lstm(inputs, hidden, rng), rng.uniform(-bound, bound, (outputs, width)).astype(np.float32), rng.uniform(-bound, bound, outputs).astype(np.float32), variant)

    def forward(self, identifiers: np.ndarray | None, tokens: np.ndarray | None, hints: np.ndarray | None) -> np.ndarray:
        """Type embeddings of a batch; dropout plays no part outside of training."""
        use_id, use_tok, use_hint = VARIANTS[self.variant]
        parts = []
        if use_id:
            parts.append(last_states(identifiers.astype(np.float32), self.identifiers))
        if use_tok:
            parts.append(last_states(tokens.astype(np.float32), self.tokens))
        if use_hint:
            parts.append(hints.astype(np.float32))
        return np.concatenate(parts, 1) @ self.weight.T + self.bias


def _tensor(column: pd.Series) -> np.ndarray:
    return np.array([[np.asarray(row, np.float32) for row in m] for m in column], np.float32)


def embedded(features: DataFrame, encoder: Encoder, n_hints: int = 1024, batch: int = 256) -> DataFrame:
    """(id, embedding) from (id, identifiers, tokens as matrices, hint as an index)."""
    sent = features.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                hints = np.zeros((len(part), n_hints), np.float32)
                hints[np.arange(len(part)), part["hint"].to_numpy()] = 1
                out = sent.value.forward(_tensor(part["identifiers"]), _tensor(part["tokens"]), hints)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": list(out)})

    return features.select("id", "identifiers", "tokens", "hint").mapInPandas(run, "id long, embedding array<float>")
