"""Integer vectors, stored tables and small exact products shared by the vector searches and the whitening."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.session import checkpoint_dir

#: scaled components beyond this size count as this size, so that scores of up to 2^11 dimensions fit a long
LARGEST = 2**26


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again: lost executors cost a read, and small files are merged."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components; an empty one is finite."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    bound = float(LARGEST)
    return F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), v.cast("double") * scale))).cast("int"))


def padded(rows: DataFrame, column: str = "v") -> DataFrame:
    """Every vector as long as the longest, filled up with zeros."""
    width = rows.agg(F.max(F.size(column))).first()[0] or 0
    return rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(0), F.lit(width) - F.size(column))))


def smallest_ids(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """One row per distinct `keys` with its `most` smallest vec_id as `ids`, repeated ones included.

    The rank limit runs before the shuffle too, so a vector that a third of all rows share sends `most` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix of long."""
    rows = column.to_list()
    return np.stack(rows).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose products are exact: double while every partial sum stays below 2^53, else long."""
    top = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(x.shape[-1], 1)
    return (x.astype(np.float64), q.astype(np.float64)) if top < 2**53 else (x, q)
