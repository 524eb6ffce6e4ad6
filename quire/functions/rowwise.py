"""Row-by-row kernels as Arrow functions: one batch of a column in, one batch out, a null first argument gives null."""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

import quire

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(quire)


def rowwise(kernel, returns: str):
    """A column function from a Python one. Only for what built-in functions cannot say."""

    def on(*columns):
        # The type is read when the function is used: reading it needs a session.
        kind = T._parse_datatype_string(returns)
        target = to_arrow_type(kind)

        def run(*arrays: pa.Array) -> pa.Array:
            rows = zip(*(a.to_pylist() for a in arrays), strict=True)
            return pa.array([None if r[0] is None else kernel(*r) for r in rows], target)

        return F.arrow_udf(run, kind)(*columns)

    return on
