"""One step of the error-state filter over many rows: each row is a filter of its own.

A state is four columns: position and velocity (vectors), attitude (quaternion), covariance (9 x 9 rows). `filter_core` has
filters that move from row to row; here it serves single steps, such as replaying stored states. Predictions and the usual
updates take a batch of rows as one fleet; `measure` is the update of any measurement as Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import matrix as M
from wayline.functions import quat as Q
from wayline.operators import filter_core as C
from wayline.operators.filter_core import Fleet

STATE = ("position", "velocity", "attitude", "covariance")


def _staged(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Columns one after another, each from those before it; the ones that begin with _f_ go at the end."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop(*[name for name, _ in steps if name.startswith("_f_")])


def start_covariance() -> Column:
    return M.rows(*[M.vector(*[float(v) if i == j else 0.0 for j in range(9)]) for i, v in enumerate(C.START_SD**2)])


def _moved(v: str, by: Column) -> Column:
    return F.zip_with(v, by, lambda x, y: x + y)


def _numbers(column: pa.ChunkedArray, *shape: int) -> np.ndarray:
    """Numbers of nested lists or of a struct, with the row as the last axis."""
    flat = column.combine_chunks()
    if pa.types.is_struct(flat.type):
        return np.stack([f.to_numpy(zero_copy_only=False) for f in flat.flatten()])
    while pa.types.is_list(flat.type):
        flat = pc.list_flatten(flat)
    return np.moveaxis(flat.to_numpy(zero_copy_only=False).reshape(-1, *shape), 0, -1)


def _lists(values: np.ndarray) -> pa.Array:
    """The other way: rows of nested lists."""
    flat, sizes = pa.array(np.ascontiguousarray(np.moveaxis(values, -1, 0)).ravel()), values.shape[:-1]
    for size in reversed(sizes):
        flat = pa.FixedSizeListArray.from_arrays(flat, size).cast(pa.list_(flat.type))
    return flat


def _each(df: DataFrame, change: Callable[[Fleet, Callable[..., np.ndarray]], None], **inputs: Column) -> DataFrame:
    """The states after `change`, a batch of rows as one fleet; it gets the inputs as arrays by name and shape. Rows where a part
    of the state or an input is null keep their state."""
    names = {name: f"_f_{name}" for name in inputs}
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            table = whole.select(df_columns)
            good = np.ones(len(whole), bool)
            for c in [*STATE, *names.values()]:
                good &= whole[c].is_valid().to_numpy()
            rows = whole if good.all() else whole.filter(pa.array(good))
            if len(rows):
                fleet = Fleet(_numbers(rows["position"], 3), _numbers(rows["velocity"], 3), _numbers(rows["attitude"]), _numbers(rows["covariance"], 9, 9).copy())  # its own, as it changes in place
                change(fleet, lambda name, *shape: _numbers(rows[names[name]], *shape))  # noqa: B023
                struct = table["attitude"].type
                new = {
                    "position": _lists(fleet.position), "velocity": _lists(fleet.velocity), "covariance": _lists(fleet.covariance),
                    "attitude": pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in fleet.attitude], names=[f.name for f in struct]),
                }
                for c, value in new.items():
                    value = value.cast(table[c].type)
                    if len(rows) < len(whole):
                        at = pa.array(np.cumsum(good) - 1, mask=~good)
                        value = pc.if_else(pa.array(good), value.take(at), table[c].combine_chunks())
                    table = table.set_column(df_columns.index(c), c, value)
            yield from table.to_batches()

    df_columns = df.columns
    return df.withColumns({names[n]: c for n, c in inputs.items()}).mapInArrow(run, schema)


def predict(df: DataFrame, dt: Column, force: Column, rate: Column) -> DataFrame:
    """The states moved on by dt seconds (nothing if not positive) under a specific force and an angular rate in the body
    frame."""
    return _each(df, lambda fleet, given: fleet.predict(given("dt"), given("force", 3), given("rate", 3)), dt=dt, force=force, rate=rate)


def measure(df: DataFrame, residual: Column, jacobian: Column, noise: Column) -> DataFrame:
    """The states after a Kalman update of 1 to 3 values in Joseph form; as they were where the update has no inverse."""
    gain, error = F.col("_f_gain"), F.col("_f_error")
    done = gain.isNotNull()
    keep = lambda name, new: (name, F.when(done, new).otherwise(F.col(name)))
    return _staged(df, [
        ("_f_residual", residual),
        ("_f_jacobian", jacobian),
        ("_f_noise", noise),
        ("_f_across", M.product(F.col("covariance"), M.transpose(F.col("_f_jacobian")))),
        ("_f_spread", M.plus(M.product(F.col("_f_jacobian"), F.col("_f_across")), F.col("_f_noise"))),
        ("_f_inverse", M.inverse(F.col("_f_spread"))),
        ("_f_gain", F.when(F.col("_f_inverse").isNotNull(), M.product(F.col("_f_across"), F.col("_f_inverse")))),
        ("_f_error", M.times(gain, F.col("_f_residual"))),
        ("_f_turn", Q.from_rotvec(error[6], error[7], error[8])),
        ("_f_keep", M.minus(M.diagonal(9, 1.0), M.product(gain, F.col("_f_jacobian")))),
        ("_f_kept", M.product(F.col("_f_keep"), F.col("covariance"))),
        ("_f_added", M.product(M.product(gain, F.col("_f_noise")), M.transpose(gain))),
        ("_f_joseph", M.plus(M.product(F.col("_f_kept"), M.transpose(F.col("_f_keep"))), F.col("_f_added"))),
        keep("position", _moved("position", F.slice(error, 1, 3))),
        keep("velocity", _moved("velocity", F.slice(error, 4, 3))),
        keep("attitude", Q.normalize(Q.multiply(F.col("_f_turn"), F.col("attitude")))),
        keep("covariance", M.symmetric(F.col("_f_joseph"))),
    ])


def hold_to_track(df: DataFrame, variance: float = C.NHC_VAR) -> DataFrame:
    """A vehicle doesn't move sideways or up in its own frame."""
    return _each(df, lambda fleet, given: fleet.hold_to_track(variance))


def take_speed(df: DataFrame, speed: Column, variance: float = C.SPEED_VAR) -> DataFrame:
    return _each(df, lambda fleet, given: fleet.take_speed(given("speed"), variance), speed=speed.cast("double"))


def take_turn(df: DataFrame, relative: Column, start: Column, variance: float = C.ATTITUDE_VAR) -> DataFrame:
    """A measured rotation since the attitude `start`; q and -q mean the same."""
    return _each(df, lambda fleet, given: fleet.take_turn(given("relative"), given("start"), variance), relative=relative, start=start)


def take_position(df: DataFrame, position: Column, variance: float = C.FIX_VAR) -> DataFrame:
    return _each(df, lambda fleet, given: fleet.take_position(given("position", 3), variance), position=position)
