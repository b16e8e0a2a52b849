"""Versioned tables: a data-source writer whose tasks report their files, and manifests that make a version visible at once.

    df.write.format("versioned").option("path", folder).mode("overwrite" or "append").save()
    read_versioned(spark, folder)

A task writes one Parquet file under a name of its own and reports it; the driver's commit lists the files of a whole write in a
manifest with the next number, created only if nobody else has created it. Files of failed tasks and writes are removed, or are
in no manifest and never read. Readers use the newest manifest.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

MANIFEST = "manifest-%08d.json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def versions(uri: str) -> list[int]:
    store, path = _store(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name[9:17]) for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


def manifest(uri: str, version: int) -> dict:
    store, path = _store(uri)
    with store.open_input_stream(f"{path}/{MANIFEST % version}") as fh:
        return json.loads(fh.read())


class VersionedWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, schema, overwrite: bool):
        self.uri, self.schema, self.overwrite = uri, to_arrow_schema(schema), overwrite
        seen = versions(uri)
        self.base = seen[-1] if seen else 0
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.uri)
        store.create_dir(f"{path}/data", recursive=True)
        name, rows, out = f"data/{self.run}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{path}/{name}", self.schema, filesystem=store)
                out.write_batch(batch.cast(self.schema) if batch.schema != self.schema else batch)
                rows += batch.num_rows
        except BaseException:
            if out:
                out.close()
                store.delete_file(f"{path}/{name}")
            raise
        if out:
            out.close()
        return Written(name if out else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.uri)
        new = [{"file": m.file, "rows": m.rows} for m in messages if m and m.file]
        old = [] if self.overwrite or not self.base else manifest(self.uri, self.base)["files"]
        body = json.dumps({"version": self.base + 1, "files": old + new}).encode()
        store.create_dir(path, recursive=True)
        target = f"{path}/{MANIFEST % (self.base + 1)}"
        # the number was free when the write began; if another write took it meanwhile, this one does not become visible
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise RuntimeError(f"version {self.base + 1} of {self.uri} was written by another job")
        part = f"{path}/.{self.run}"
        with store.open_output_stream(part) as fh:
            fh.write(body)
        store.move(part, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.uri)
        for m in messages:
            if m and m.file and store.get_file_info(f"{path}/{m.file}").is_file:
                store.delete_file(f"{path}/{m.file}")


class Versioned(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VersionedWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Versioned)


def write_versioned(df: DataFrame, uri: str, mode: str = "overwrite") -> None:
    register(df.sparkSession)
    df.write.format("versioned").option("path", uri).mode(mode).save()


def read_versioned(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame:
    """The newest version, or an older one whose files are still there."""
    seen = versions(uri)
    if not seen:
        raise FileNotFoundError(f"no version in {uri}")
    files = [f["file"] for f in manifest(uri, version or seen[-1])["files"]]
    return spark.read.parquet(*[f"{uri}/{f}" for f in files])


def merge_versioned(df: DataFrame, uri: str, keys: list[str]) -> None:
    """A new version in which the rows of `df` replace the stored ones with the same keys; of equal keys in `df` one row wins."""
    spark = df.sparkSession
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in df.columns if c not in keys]) if len(keys) < len(df.columns) else None
    one = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n") if w is not None else df.distinct()
    if versions(uri):
        old, new = read_versioned(spark, uri).alias("o"), one.select(*keys).alias("n")
        same = functools.reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
        one = old.join(new, same, "left_anti").unionByName(one)
    write_versioned(one, uri)


def vacuum(uri: str, keep: int = 2) -> int:
    """Delete files that none of the newest `keep` manifests names, and the older manifests; returns how many files went."""
    store, path = _store(uri)
    seen = versions(uri)
    named = {f["file"] for v in seen[-keep:] for f in manifest(uri, v)["files"]}
    gone = 0
    for f in store.get_file_info(fs.FileSelector(f"{path}/data", allow_not_found=True)):
        if f.is_file and f"data/{f.base_name}" not in named:
            store.delete_file(f.path)
            gone += 1
    for v in seen[:-keep]:
        store.delete_file(f"{path}/{MANIFEST % v}")
    return gone
