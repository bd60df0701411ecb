"""Tiny ONNX models written byte by byte, for checks of the inference operator where no trained model is at hand."""

from __future__ import annotations

import struct


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes | str) -> bytes:
    body = body.encode() if isinstance(body, str) else body
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _floats(name: str, shape: list[int], values: list[float]) -> bytes:
    return b"".join(_number(1, d) for d in shape) + _number(2, 1) + _block(8, name) + _block(9, struct.pack(f"<{len(values)}f", *values))


def _value(name: str, shape: list[int | str]) -> bytes:
    dims = b"".join(_block(1, _block(2, d) if isinstance(d, str) else _number(1, d)) for d in shape)
    return _block(1, name) + _block(2, _block(1, _number(1, 1) + _block(2, dims)))


def linear_over_window(weights: list[float], samples: int) -> bytes:
    """Mean over the samples of the weighted sum of channels: one output for each window."""
    channels = len(weights)
    flat = [w / samples for _ in range(samples) for w in weights]
    flatten = _block(1, "x") + _block(2, "f") + _block(4, "Flatten")
    product = _block(1, "f") + _block(1, "w") + _block(2, "y") + _block(4, "MatMul")
    graph = (
        _block(1, flatten) + _block(1, product) + _block(2, "linear") + _block(5, _floats("w", [samples * channels, 1], flat))
        + _block(11, _value("x", ["n", samples, channels])) + _block(12, _value("y", ["n", 1]))
    )
    return _number(1, 7) + _block(7, graph) + _block(8, _number(2, 13))
