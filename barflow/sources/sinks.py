"""Writers: ranked tables, reports, position stores, chunk files and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ranked(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """(section_no, row_no, line) as text. A report is a fixed set of short sections, so its lines fit one file."""
    df.repartitionByRange(1, "section_no", "row_no").sortWithinPartitions("section_no", "row_no").select("line").write.mode("overwrite").text(path)


def rewrite_positions(df: DataFrame, new_path: str) -> None:
    """The store is replaced by a new folder: the old one stays readable until readers have moved."""
    df.write.mode("errorifexists").parquet(new_path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Chunks, graph or manifest, one JSON object per line."""
    df.write.mode("overwrite").json(path)


def write_boards(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def partitioned_bars(df: DataFrame, path: str) -> None:
    """Bars laid out for pruning: by level and year, clustered by symbol inside."""
    out = df.withColumn("year", F.year("day"))
    out.repartition("level", "year").sortWithinPartitions("symbol", "day").write.mode("overwrite").partitionBy("level", "year").parquet(path)
