"""Schema versions of a store of Parquet tables, and steps from one to the next.

A store's tables lie in folders named by what wrote them; a manifest (one small JSON file a version) says which folder each
table's rows are in. A step reads the tables of the version before, writes only those it changes to new folders, and then
publishes a manifest under the next number. Publishing is one rename to a name that must not exist yet, so readers see the
old version or the new one, a step that breaks leaves the old one as it was, and of two writers that take the same step one
wins and the other is told so. Steps that the store has behind it are not run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.sources import store

Tables = dict[str, DataFrame]
Step = Callable[[Tables], Tables]


class Store:
    """The tables of one folder, by the newest manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, files = self._place("versions")
        if not files.exists(place):
            return []
        names = [f.getPath().getName() for f in files.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """(version, folder of each table); version 0 without tables for a new store."""
        known = self.versions()
        if not known:
            return 0, {}
        at = known[-1] if version is None else version
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/versions/{at}.json").head()
        return at, json.loads(text["value"])

    def tables(self, version: int | None = None) -> Tables:
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self.manifest(version)[1].items()}

    def publish(self, version: int, changed: Tables) -> None:
        """Write ``changed`` beside what is there and make it, with the unchanged tables, version ``version``."""
        before, folders = self.manifest()
        if version != before + 1:
            raise ValueError(f"version {version} cannot follow version {before}")
        for name, df in changed.items():
            folder = f"tables/{name}-{version}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            folders[name] = folder
        draft, files = self._place(f"versions/.{version}-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        final, _ = self._place(f"versions/{version}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise ValueError(f"version {version} was published by another writer")

    def migrate(self, steps: dict[int, Step]) -> list[int]:
        """Take the steps that the store does not have yet, in order; the versions that were added."""
        done = []
        for version in sorted(steps):
            now, _ = self.manifest()
            if version <= now:
                continue
            self.publish(version, steps[version](self.tables()))
            done.append(version)
        return done


def _added(table: str, **columns: tuple[str, object]) -> Step:
    """A step that gives a table columns it lacks: name to (type, value of the rows there are)."""

    def run(tables: Tables) -> Tables:
        df = tables[table]
        lacking = {k: F.lit(value).cast(kind) for k, (kind, value) in columns.items() if k not in df.columns}
        return {table: df.withColumns(lacking)} if lacking else {}

    return run


def _first(spark: SparkSession) -> Step:
    return lambda tables: {name: spark.createDataFrame([], schema) for name, schema in store.SCHEMAS.items() if name not in tables}


def steps(spark: SparkSession) -> dict[int, Step]:
    """The store's own history: its tables, marks of how readings came about, the run's settings, baselines."""
    return {
        1: _first(spark),
        2: _added("provider_outputs", enhancement_strategy=("string", ""), cache_hit=("boolean", False)),
        3: _added("runs", total_cost_usd=("double", 0.0)),
        4: _added("provider_outputs", question_marker_rate=("double", None)),
        5: _added("runs", model_version=("string", None), iam_partition=("string", None), norm_flags=("string", None), vocab_hints_off=("boolean", False)),
        6: _added("runs", is_baseline=("boolean", False)),
    }
