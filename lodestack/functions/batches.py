"""Arrow batches in slices: what rows become as Python objects is held for a few rows at a time, however large the batch is."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Rows that are Python objects at once.
ROWS = 64


def sliced(function: Callable, out: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """``function`` of each row of ``arrays``, as an array of type ``out``."""
    done = []
    for k in range(0, len(arrays[0]), ROWS):
        rows = zip(*(a.slice(k, ROWS).to_pylist() for a in arrays), strict=True)
        done.append(pa.array([function(*r) for r in rows], out))
    return pa.concat_arrays(done) if done else pa.array([], out)
