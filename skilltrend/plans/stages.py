"""Staged folders with a lifetime, and results published all at once.

A run writes many intermediate tables to the shared folder. Each one says how
many later steps read it; the last of them deletes it, and whatever is left goes
when the run ends. Results that others read are published under a target folder:
every table is written to a folder of its own first, then one manifest that
names them all takes the old one's place in a single rename. A reader sees all
tables of one run or all of another, never a mixture.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skilltrend.plans.checkpoints import discard, staged_at

MANIFEST = "manifest.json"


@dataclass
class _Folder:
    frame: DataFrame
    path: str
    readers: int


class Stages:
    """The staged tables of one run.

    Used as a context: at its end every folder but those kept is deleted, after
    an error too. Frames that it gave out must not be read later on.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folders: list[_Folder] = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        for folder in self._folders:
            discard(self._spark, folder.path)
        self._folders.clear()

    def put(self, df: DataFrame, name: str, readers: int = 0, after: Iterable[DataFrame] = ()) -> DataFrame:
        """Write ``df`` now and read it back.

        ``readers`` is how many later calls name it in ``after``; 0 leaves it
        to the end of the run. ``after`` names the staged frames that this write
        was a reader of.
        """
        frame, path = staged_at(df, name)
        self.read(*after)
        return self.adopt(frame, path, readers)

    def adopt(self, frame: DataFrame, path: str, readers: int = 0) -> DataFrame:
        """Take over a folder that was staged elsewhere and that ``frame`` reads."""
        self._folders.append(_Folder(frame, path, readers))
        return frame

    def keep(self, df: DataFrame, name: str, after: Iterable[DataFrame] = ()) -> DataFrame:
        """As ``put`` for a result: its folder outlives the run."""
        frame, _ = staged_at(df, name)
        self.read(*after)
        return frame

    def read(self, *frames: DataFrame) -> None:
        """Note that one reader of each of ``frames`` is through; the last one's folder goes."""
        for frame in frames:
            folder = next((f for f in self._folders if f.frame is frame), None)
            if folder is None:
                raise ValueError("not a staged frame of this run, or deleted already")
            folder.readers -= 1
            if folder.readers == 0:
                discard(self._spark, folder.path)
                self._folders.remove(folder)

    def open_folders(self) -> list[str]:
        """Paths of the folders that are still there."""
        return [folder.path for folder in self._folders]


def _read_manifest(spark: SparkSession, target: str) -> dict | None:
    path = f"{target}/{MANIFEST}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _replace_manifest(spark: SparkSession, target: str, manifest: dict) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(target).getFileSystem(conf)
    # With scheme and authority, whatever the default file system is.
    new, named = (files.makeQualified(hadoop.Path(f"{target}/{name}")) for name in (f".{uuid.uuid4().hex}.{MANIFEST}", MANIFEST))
    stream = files.create(new, True)
    stream.write(bytearray(json.dumps(manifest), "utf-8"))
    stream.close()
    rename = hadoop.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(new, named, overwrite)


def publish(spark: SparkSession, target: str, tables: Mapping[str, DataFrame], layouts: Mapping[str, Iterable[str]] | None = None) -> None:
    """Write ``tables`` below ``target`` and make them its results in one step.

    ``layouts`` names the columns that rows of a table are clustered and sorted
    by, so that a reader's filters on them skip most of its row groups. The run
    before stays readable for those who opened it; older ones are deleted. Two
    publishers at a time both succeed, and the later rename is what readers see.
    """
    version = uuid.uuid4().hex
    entries = {}
    for name, df in tables.items():
        path = f"{target}/{version}/{name}"
        keys = list((layouts or {}).get(name, ()))
        ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        ordered.write.parquet(path)
        entries[name] = {"path": f"{version}/{name}", "schema": df.schema.json()}
    before = _read_manifest(spark, target)
    manifest = {"version": version, "tables": entries, "before": before["version"] if before else None}
    _replace_manifest(spark, target, manifest)
    if before and before["before"]:
        discard(spark, f"{target}/{before['before']}")


def published(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables of the run that was published last."""
    manifest = _read_manifest(spark, target)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published below {target}")
    return {
        name: spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{target}/{entry['path']}")
        for name, entry in manifest["tables"].items()
    }
