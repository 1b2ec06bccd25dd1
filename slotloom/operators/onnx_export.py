"""The encoder as an ONNX model, written in the format's own protocol-buffer encoding, so no exporter is needed.

Inputs are ``id``, ``tok`` and ``avl`` (those that the variant uses) with a free batch size, the
output is ``output``.  ``checked`` compares the exported model with the numpy one.
"""

from __future__ import annotations

import numpy as np

from slotloom.operators.encoder import VARIANTS, Encoder

OPSET, IR_VERSION = 14, 8
RTOL, ATOL = 1e-3, 1e-5
# Element types and attribute types of the format.
_FLOAT, _INT64 = 1, 7
_ATTR_INT, _ATTR_STRING, _ATTR_INTS = 2, 3, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """Integers as varints; texts, bytes and messages with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _message(*fields: tuple) -> bytes:
    return b"".join(_field(n, v) for n, v in fields)


def _tensor(name: str, x: np.ndarray) -> bytes:
    kind = _INT64 if x.dtype == np.int64 else _FLOAT
    x = np.asarray(x, "<i8" if kind == _INT64 else "<f4", order="C")
    return _message(*[(1, int(d)) for d in x.shape], (2, kind), (8, name), (9, x.tobytes()))


def _attribute(name: str, value) -> bytes:
    if isinstance(value, int):
        return _message((1, name), (3, value), (20, _ATTR_INT))
    if isinstance(value, str):
        return _message((1, name), (4, value), (20, _ATTR_STRING))
    return _message((1, name), *[(8, int(v)) for v in value], (20, _ATTR_INTS))


def _node(kind: str, inputs: list[str], output: str, **attributes) -> bytes:
    return _message(*[(1, i) for i in inputs], (2, output), (3, f"{kind}_{output}"), (4, kind), *[(5, _attribute(k, v)) for k, v in attributes.items()])


def _value(name: str, shape: list) -> bytes:
    dims = [(1, _message((2, d) if isinstance(d, str) else (1, d))) for d in shape]
    return _message((1, name), (2, _message((1, _message((1, _FLOAT), (2, _message(*dims)))))))


def _gates(w: np.ndarray) -> np.ndarray:
    """From input, forget, cell, output to input, output, forget, cell."""
    i, f, g, o = np.split(w, 4)
    return np.concatenate([i, o, f, g])


def exported(model: Encoder, places: tuple[int, int] = (31, 21)) -> bytes:
    """The model file's bytes; ``places``: the lengths of the identifier and token sequences."""
    nodes, tensors, inputs, joined = [], [], [], []
    for name, w, length, used in (("id", model.identifiers, places[0], VARIANTS[model.variant][0]), ("tok", model.tokens, places[1], VARIANTS[model.variant][1])):
        if not used:
            continue
        hidden = w["fw_h"].shape[1]
        both = lambda k: np.stack([_gates(w[f"{way}_{k}"]) for way in ("fw", "bw")])  # noqa: E731, B023
        bias = both("b")
        tensors += [_tensor(f"{name}_w", both("x")), _tensor(f"{name}_r", both("h")), _tensor(f"{name}_b", np.concatenate([bias, np.zeros_like(bias)], 1)), _tensor(f"{name}_shape", np.array([-1, 2 * hidden], np.int64))]
        inputs.append(_value(name, ["batch_size", length, w["fw_x"].shape[1]]))
        nodes += [
            _node("Transpose", [name], f"{name}_by_step", perm=[1, 0, 2]),
            _node("LSTM", [f"{name}_by_step", f"{name}_w", f"{name}_r", f"{name}_b"], f"{name}_states", direction="bidirectional", hidden_size=hidden),
            _node("Gather", [f"{name}_states", "last"], f"{name}_last", axis=0),
            _node("Transpose", [f"{name}_last"], f"{name}_by_row", perm=[1, 0, 2]),
            _node("Reshape", [f"{name}_by_row", f"{name}_shape"], f"{name}_out"),
        ]
        joined.append(f"{name}_out")
    if VARIANTS[model.variant][2]:
        inputs.append(_value("avl", ["batch_size", model.weight.shape[1] - sum(2 * w["fw_h"].shape[1] for w, used in zip((model.identifiers, model.tokens), VARIANTS[model.variant]) if used)]))
        joined.append("avl")
    tensors += [_tensor("last", np.array(-1, np.int64)), _tensor("weight", model.weight), _tensor("bias", model.bias)]
    nodes += [_node("Concat", joined, "joined", axis=1), _node("Gemm", ["joined", "weight", "bias"], "output", transB=1)]
    graph = _message(*[(1, n) for n in nodes], (2, "encoder"), *[(5, t) for t in tensors], *[(11, i) for i in inputs], (12, _value("output", ["batch_size", model.weight.shape[0]])))
    return _message((1, IR_VERSION), (2, "slotloom"), (7, graph), (8, _message((1, ""), (2, OPSET))))


def checked(model: Encoder, raw: bytes, places: tuple[int, int] = (31, 21), batch: int = 7, seed: int = 0) -> None:
    """Raises if the exported model's output differs from the encoder's on random inputs."""
    import onnxruntime

    session = onnxruntime.InferenceSession(raw, providers=["CPUExecutionProvider"])
    rng = np.random.default_rng(seed)
    size = model.identifiers["fw_x"].shape[1]
    sent = {i.name: i.shape[-1] for i in session.get_inputs()}
    hints = (rng.random((batch, sent["avl"])) < 0.5).astype(np.float32) if "avl" in sent else None
    drawn = {"id": rng.normal(size=(batch, places[0], size)).astype(np.float32), "tok": rng.normal(size=(batch, places[1], size)).astype(np.float32), "avl": hints}
    want = model.forward(drawn["id"], drawn["tok"], hints)
    np.testing.assert_allclose(session.run(None, {k: drawn[k] for k in sent})[0], want, rtol=RTOL, atol=ATOL)
