"""Current-state tables: the newest row of every key, in buckets with versions.

Rows lie in ``data/<id>/bucket=<b>``. A version is a small file under ``_versions`` that says
which folder holds each bucket, and which batch of each writer it contains. An update writes the
touched buckets to a new folder, then the next version file, whose rename makes it visible. So a
reader sees one version whole, an interrupted update leaves the old one in place, a batch that
a version contains already changes nothing, and untouched buckets are never rewritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftlane.operators import ingest

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    files, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def version(spark: SparkSession, path: str) -> dict | None:
    """The newest version: number, n_buckets, buckets, batches, schema; None before the first update."""
    published = [n for n in _names(spark, f"{path}/_versions") if n.endswith(".json")]
    if not published:
        return None
    files, where = _files(spark, f"{path}/_versions/{published[-1]}")
    stream = files.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    """Writes a version file aside and renames it; the rename is the commit."""
    files, draft = _files(spark, f"{path}/_versions/{uuid.uuid4().hex}.draft")
    _, final = _files(spark, f"{path}/_versions/{new['number']:010d}.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"{path} has another writer: version {new['number']} is there already")


def _rows(spark: SparkSession, path: str, at: dict, buckets) -> DataFrame | None:
    folders = [f"{path}/data/{at['buckets'][b]}/bucket={b}" for b in buckets if b in at["buckets"]]
    return spark.read.schema(StructType.fromJson(at["schema"])).parquet(*folders) if folders else None


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows, or None before the first update."""
    at = version(spark, path)
    return None if at is None else _rows(spark, path, at, at["buckets"])


def update(
    rows: DataFrame, path: str, keys: list[str], order: list[str], writer: str = "", batch: int | None = None, buckets: int = BUCKETS
) -> bool:
    """Takes ``rows`` into the table: of each key the last by ``order`` stays, of stored and new rows alike.

    False, and nothing written, if a version has ``batch`` of ``writer`` already. The number of buckets is
    that of the first update. One writer at a time: a second one fails when it publishes.
    """
    spark = rows.sparkSession
    at = version(spark, path) or {"number": 0, "n_buckets": buckets, "buckets": {}, "batches": {}, "schema": None}
    if batch is not None and at["batches"].get(writer, -1) >= batch:
        return False
    name = uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(*keys), F.lit(at["n_buckets"])).cast("int")
    # the new rows are worked out once; the folders written say which buckets they touch
    ingest.latest(rows, keys, order).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/data/{name}-new")
    touched = [n.partition("=")[2] for n in _names(spark, f"{path}/data/{name}-new") if n.startswith("bucket=")]
    if touched:
        new = spark.read.schema(rows.schema).parquet(*[f"{path}/data/{name}-new/bucket={b}" for b in touched])
        old = _rows(spark, path, at, touched)
        merged = new if old is None else ingest.latest(old.unionByName(new, allowMissingColumns=True), keys, order)
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{name}")
        at = at | {"buckets": at["buckets"] | dict.fromkeys(touched, name), "schema": json.loads(merged.schema.json())}
    elif at["schema"] is None:
        at = at | {"schema": json.loads(rows.schema.json())}
    files, staged = _files(spark, f"{path}/data/{name}-new")
    files.delete(staged, True)
    batches = at["batches"] if batch is None else at["batches"] | {writer: batch}
    _publish(spark, path, at | {"number": at["number"] + 1, "batches": batches})
    return True


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Deletes data folders that the newest version does not name, and older versions; no reader or writer may be at work."""
    at = version(spark, path)
    if at is None:
        return []
    used = set(at["buckets"].values())
    gone = [f"data/{n}" for n in _names(spark, f"{path}/data") if n not in used]
    gone += [f"_versions/{n}" for n in _names(spark, f"{path}/_versions") if n != f"{at['number']:010d}.json"]
    for name in gone:
        files, where = _files(spark, f"{path}/{name}")
        files.delete(where, True)
    return gone
