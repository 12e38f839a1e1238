"""Stages that are written once and resumed: tables in the cluster's shared folder, each with a manifest of what it holds."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session of one machine without it gets a temporary one, a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="prudence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder under a name of its own and read it back, so that lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fingerprint(df: DataFrame) -> str:
    """Digest of a file-based table: its schema and the name, length and time of every file. Reads no rows; a table that isn't read from files raises."""
    spark, found = df.sparkSession, []
    files = df.inputFiles()
    if not files:
        raise ValueError("only tables read from files have a fingerprint")
    for f in sorted(files):
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        found.append((f, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), found]).encode()).hexdigest()


class Run:
    """A run of named stages in one folder.

    stage() computes a stage and commits it, rows first and its manifest last, or takes over what an earlier driver has
    committed if inputs and parameters are the same. A table without a manifest, or with another one, is of a run that
    ended early or of other inputs: it is deleted and computed anew. finish() deletes the stages that nothing needs.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.digests: dict[str, str] = {}
        self.computed: list[str] = []

    def path(self, name: str) -> str:
        if not re.fullmatch(r"\w[\w.-]*", name):
            raise ValueError(f"not a name of a stage: {name}")
        return f"{self.folder}/{name}"

    def manifest(self, name: str) -> dict | None:
        """What the stage's table holds, or None if it isn't complete."""
        try:
            row = self.spark.read.schema("value string").text(f"{self.path(name)}/{MANIFEST}").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return json.loads(row[0]) if row else None

    def stage(self, name: str, made: Callable[[], DataFrame], inputs: Iterable[DataFrame | str] = (), params: Mapping | None = None) -> DataFrame:
        """The stage's rows. Inputs are tables read from files, or names of earlier stages of this run."""
        given = [self.digests[x] if isinstance(x, str) else fingerprint(x) for x in inputs]
        digest = hashlib.sha256(json.dumps([name, given, params or {}], sort_keys=True, default=str).encode()).hexdigest()
        path = self.path(name)
        known = self.manifest(name)
        if not known or known["digest"] != digest:
            delete(self.spark, path)
            df = made()
            df.write.parquet(f"{path}/rows")
            rows = self.spark.read.schema(df.schema).parquet(f"{path}/rows").count()
            known = {"stage": name, "digest": digest, "rows": rows, "schema": df.schema.jsonValue()}
            self.spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")
            self.computed.append(name)
        self.digests[name] = digest
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(known["schema"])).parquet(f"{path}/rows")

    def finish(self, keep: Iterable[str]) -> None:
        """Delete every stage of this run but those to keep."""
        for name in set(self.digests) - set(keep):
            delete(self.spark, self.path(name))
            del self.digests[name]
