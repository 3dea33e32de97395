"""Points from files, arrays and tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def read_csv(spark: SparkSession, path: str, columns: int, keep: list[int] | None = None, header: bool = False) -> DataFrame:
    """``(point_id, x, w)`` from comma-separated numbers; only the columns of ``keep`` are parsed into the vector.

    The id is a hash of the row with a number among equal rows, so it does not depend on how the file is split.
    """
    schema = StructType([StructField(f"c{i}", DoubleType()) for i in range(columns)])
    table = spark.read.schema(schema).option("header", header).csv(path)
    names = [f"c{i}" for i in (keep if keep is not None else range(columns))]
    return with_ids(table, names)


def with_ids(table: DataFrame, names: list[str]) -> DataFrame:
    """``(point_id, x, w)`` of numeric columns; ids by content, repeated rows numbered."""
    from pyspark.sql import Window

    own = F.xxhash64(*names)
    place = F.row_number().over(Window.partitionBy(own).orderBy(*names))
    # The first of equal rows has its hash as the id, further ones a hash of hash and number.
    ident = F.when(place == 1, own).otherwise(F.xxhash64(own, place))
    return table.select(ident.alias("point_id"), F.array(*names).alias("x"), F.lit(1.0).alias("w"))


def from_array(spark: SparkSession, x: np.ndarray, w: np.ndarray | None = None) -> DataFrame:
    """``(point_id, x, w)`` from a matrix in memory; ids are row numbers."""
    import pyarrow as pa

    x = np.asarray(x, float)
    rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
    w = np.ones(len(x)) if w is None else np.asarray(w, float)
    return spark.createDataFrame(pa.table({"point_id": np.arange(len(x)), "x": rows, "w": w}))


def random_points(spark: SparkSession, rows: int, dims: int, seed: int = 0) -> DataFrame:
    """Uniform points, made on the executors."""
    return spark.range(rows).select(F.col("id").alias("point_id"), F.array(*[F.rand(seed + d) for d in range(dims)]).alias("x"), F.lit(1.0).alias("w"))


def from_table(table: DataFrame, id_col: str, vector: str | list[str], weight: str | None = None) -> DataFrame:
    """``(point_id, x, w)`` from a vector column or one column per coordinate; only these are read."""
    x = F.col(vector).cast("array<double>") if isinstance(vector, str) else F.array(*[F.col(c).cast("double") for c in vector])
    return table.select(F.col(id_col).alias("point_id"), x.alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
