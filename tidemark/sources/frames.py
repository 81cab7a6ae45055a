"""Frames from rows of mixed values, by rules that never move a digit."""

from __future__ import annotations

import datetime as dt
import decimal
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EXACT = 2**53


class FrameError(ValueError):
    """Values of one column that no type holds without loss."""


def column_type(values: list) -> T.DataType:
    """Whole numbers are long, fractions double, times stay times, lists and objects JSON text; text is never guessed
    to be a time. Mixes are refused but for whole numbers that a double holds exactly."""
    seen = [v for v in values if v is not None]
    kinds = {bool if isinstance(v, bool) else dt.datetime if isinstance(v, dt.datetime) else dt.date if isinstance(v, dt.date) else list if isinstance(v, list | dict) else type(v) for v in seen}
    if not kinds or kinds <= {str}:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        big = max(abs(v) for v in seen)
        if big < 2**63:
            return T.LongType()
        if big < 10**38:
            return T.DecimalType(38, 0)
        raise FrameError("a whole number has more than 38 digits")
    if kinds == {float} or (kinds == {int, float} and all(abs(v) <= EXACT for v in seen if isinstance(v, int))):
        return T.DoubleType()
    if kinds <= {decimal.Decimal, int}:
        scale = max(max(0, -decimal.Decimal(v).as_tuple().exponent) for v in seen)
        whole = max(len(str(abs(int(v)))) for v in seen)
        return T.DecimalType(38, scale) if whole + scale <= 38 else T.StringType()
    if kinds == {dt.datetime}:
        return T.TimestampType() if all(v.tzinfo for v in seen) else T.TimestampNTZType()
    if kinds == {dt.date}:
        return T.DateType()
    if kinds == {list}:
        return T.StringType()
    raise FrameError(f"a column mixes {sorted(k.__name__ for k in kinds)}")


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    types = {n: column_type([r.get(n) for r in rows]) for n in names}

    def put(n: str, v):
        if v is None:
            return None
        kind = types[n]
        if isinstance(v, list | dict):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(v)
        return str(v) if isinstance(kind, T.StringType) else v

    schema = T.StructType([T.StructField(n, types[n]) for n in names])
    return spark.createDataFrame([tuple(put(n, r.get(n)) for n in names) for r in rows], schema)
