"""Arrow kernels as column functions: a Python function over values, run on whole Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DataType, _parse_datatype_string

from .bytesview import Text, col


def _arrow_type(spark_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(_parse_datatype_string(spark_type) if not isinstance(spark_type, DataType) else spark_type)


def per_value(fn, returns: str, *inputs: Text) -> Column:
    """fn(value, ...) for each row; null if the first input is."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if row[0] is None else fn(*row) for row in rows], kind)

    kind = _arrow_type(returns)
    return _udf(run, returns, len(inputs))(*map(col, inputs))


def per_batch(fn, returns: str, *inputs: Text) -> Column:
    """fn(list of values, ...) for each batch; must return as many values. Nulls are passed on."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array(fn(*(c.to_pylist() for c in columns)), kind)

    kind = _arrow_type(returns)
    return _udf(run, returns, len(inputs))(*map(col, inputs))


def _udf(run, returns: str, n: int):
    # The number of arguments and their types are read from the signature.
    if n == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return arrow_udf(one, returns)
    if n == 2:

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return arrow_udf(two, returns)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return arrow_udf(three, returns)
