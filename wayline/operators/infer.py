"""Pluggable ONNX models over window columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def infer(rows: DataFrame, model: bytes, column: str, into: str, mean: list[float] | None = None, std: list[float] | None = None, out_mean: float = 0.0, out_std: float = 1.0, batch: int = 256, shape: tuple[int, int] | None = (50, 6)) -> DataFrame:
    """Run an ONNX model (float tensor of batch, samples, channels in; batch, outputs out) over an array column.

    The column may also hold each window flat, sample after sample, which is much faster to move. Inputs are standardised by `mean` and `std`, outputs set back by `out_mean` and `out_std`. A window of another shape
    fails the task. The result is a double for one output, else an array. Each worker opens the model once.
    """
    width = _outputs(model)
    kind: T.DataType = T.DoubleType() if width == 1 else T.ArrayType(T.DoubleType())
    schema = T.StructType([*rows.schema.fields, T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for rows in batches:
            found = []
            for at in range(0, len(rows), batch):
                x = _stacked(rows[column].slice(at, batch), shape)
                if mean is not None and std is not None:
                    x = (x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
                y = np.asarray(session.run(None, {name: x.astype(np.float32)})[0], float).reshape(len(x), -1) * out_std + out_mean
                found += y[:, 0].tolist() if width == 1 else y.tolist()
            answers = pa.array(found, pa.float64() if width == 1 else pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, answers], [*rows.schema.names, into])

    return rows.mapInArrow(run, schema)


def _stacked(windows: pa.Array, shape: tuple[int, int] | None) -> np.ndarray:
    """Windows of one shape, of arrays of samples or flat, as (window, sample, channel)."""
    if shape and not pa.types.is_list(windows.type.value_type):
        sizes = np.unique(pc.list_value_length(windows).to_numpy(zero_copy_only=False))
        if windows.null_count or sizes.tolist() != [shape[0] * shape[1]]:
            raise ValueError(f"windows have {sizes.tolist()} numbers, not the shape {shape}")
        return pc.list_flatten(windows).to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(windows), *shape)
    samples = pc.list_flatten(windows)
    sizes = np.unique(pc.list_value_length(windows).to_numpy(zero_copy_only=False)), np.unique(pc.list_value_length(samples).to_numpy(zero_copy_only=False))
    if any(len(s) != 1 for s in sizes) or windows.null_count or shape and (sizes[0][0], sizes[1][0]) != shape:
        raise ValueError(f"windows of another shape: they have {sizes[0].tolist()} samples of {sizes[1].tolist()} channels" + (f", not {shape}" if shape else ""))
    return pc.list_flatten(samples).to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(windows), int(sizes[0][0]), -1)


def _outputs(model: bytes) -> int:
    import onnxruntime

    last = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]).get_outputs()[0].shape[-1]
    return int(last) if isinstance(last, int) else 1
