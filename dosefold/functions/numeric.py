"""Column helpers that are stable across engines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snap(value: Column, places: int = 6) -> Column:
    """Round half up on the binary value, the same arithmetic in every engine."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def rows(spark, schema: str, data: list[tuple]) -> DataFrame:
    """A constant table; its size is fixed by the caller's literal list."""
    return spark.createDataFrame(data, schema)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def literal_structs(names: list[str], data: list[tuple]) -> Column:
    """An array literal of structs, for exploding a fixed offset list per row."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in data])


def scan_code(*indices: Column) -> Column:
    """One long that orders grid indices (outermost first, each from 0 to 2^20 - 1; others raise).

    A fixed-width order key keeps max_by and min_by in hash aggregation; a struct
    key would force a sort.
    """
    code, fits = indices[0].cast("long"), indices[0].between(0, 2**20 - 1)
    for index in indices[1:]:
        code = F.shiftleft(code, 20) + index
        fits = fits & index.between(0, 2**20 - 1)
    return F.when(F.coalesce(fits, F.lit(True)), code).otherwise(F.raise_error(F.lit("grid index outside 0 .. 2^20 - 1")).cast("long"))


def fan_out(df: DataFrame, schema: str, data: list[tuple]) -> DataFrame:
    """Every row of `df` with every row of a fixed literal list, as one inline and no join."""
    struct = T._parse_datatype_string(schema)

    def plain(value, kind):
        if isinstance(kind, T.ArrayType) and value is not None:
            return [plain(v, kind.elementType) for v in value]
        if isinstance(kind, T.StructType) and value is not None:
            return {f.name: plain(v, f.dataType) for f, v in zip(kind.fields, value)}
        return value

    text = json.dumps([plain(row, struct) for row in data])
    return df.select("*", F.inline(F.from_json(F.lit(text), T.ArrayType(struct))))
