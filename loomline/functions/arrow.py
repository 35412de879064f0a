"""Row formulas in numpy: nested lists of Arrow columns as arrays of as many axes, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, NumericType, StructType, _parse_datatype_string


def arrays(column: pa.Array, axes: int) -> list[np.ndarray | None]:
    """For each row the array of its nested lists; None for a null row and for one whose lists differ in length. Null numbers are NaN."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    offsets, inner = [], column
    for _ in range(axes):
        offsets.append(inner.offsets.to_numpy())
        inner = inner.values
    values = inner.to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        a, b, shape, even = i, i + 1, [], not missing[i]
        for o in offsets:
            sizes = np.diff(o[a : b + 1])
            shape.append(int(sizes[0]) if len(sizes) else 0)
            even = even and bool((sizes == shape[-1]).all())
            a, b = int(o[a]), int(o[b])
        out.append(values[a:b].astype(float, copy=False).reshape(shape) if even else None)
    return out


def lists(rows: list[np.ndarray | None], axes: int) -> pa.Array:
    """The inverse: None gives null."""
    none = np.zeros((0,) * axes)
    full = [none if r is None else r for r in rows]
    out = pa.array(np.concatenate([np.asarray(r, float).ravel() for r in full]) if full else np.zeros(0), pa.float64())
    for axis in reversed(range(axes)):
        counts = [np.full(int(np.prod(r.shape[:axis])), r.shape[axis]) for r in full]
        ends = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum()
        mask = pa.array([r is None for r in rows], pa.bool_()) if axis == 0 else None
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), out, mask=mask)
    return out


def _axes(kind) -> int:
    """Axes of an array of numbers; 0 for all else."""
    axes = 0
    while isinstance(kind, ArrayType):
        kind, axes = kind.elementType, axes + 1
    return axes if isinstance(kind, NumericType) else 0


def by_row(rows: DataFrame, reads: list[str], writes: str, formula: Callable) -> DataFrame:
    """rows with the columns of the schema `writes` (arrays of doubles, or plain values) that formula(*reads) gives for each row.

    Arrays of numbers reach it as numpy arrays (None where they are null, or lists within one differ in length), all else
    as Python values; it returns a tuple, None for null. No shuffle. Written columns replace those of the same name.
    """
    new: StructType = _parse_datatype_string(writes)
    kept = [c for c in rows.columns if c not in new.names]
    place = {c: i for i, c in enumerate(rows.columns)}
    axes = {c: _axes(rows.schema[c].dataType) for c in reads}
    schema = StructType([rows.schema[c] for c in kept] + new.fields)

    def run(parts):
        for part in parts:
            values = [arrays(part.column(place[c]), axes[c]) if axes[c] else part.column(place[c]).to_pylist() for c in reads]
            told = [formula(*v) for v in zip(*values, strict=True)]
            columns = [part.column(place[c]) for c in kept]
            for k, field in enumerate(new.fields):
                own = [t[k] for t in told]
                columns.append(lists(own, _axes(field.dataType)) if isinstance(field.dataType, ArrayType) else pa.array(own, to_arrow_type(field.dataType)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
