"""Python functions of whole values as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def make(function: Callable, returns: str):
    """An Arrow UDF that calls function once for each row of a batch; a null first argument gives null. Needs a session."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    def call(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else function(*row) for row in zip(*[c.to_pylist() for c in columns])], kind)

    return F.arrow_udf(call, returnType=returns)


def udf(function: Callable, returns: str) -> Callable[..., Column]:
    """Like make(), but the UDF is made when it is first applied, so modules can name it without a session."""

    def apply(*columns: Column) -> Column:
        return make(function, returns)(*columns)

    apply.function, apply.returns = function, returns
    apply.__doc__ = function.__doc__
    return apply
