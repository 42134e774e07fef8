"""Committed versions of a catalogue in a shared folder.

A table is a list of parts, plain Parquet folders under ``parts/<table>/``.
A commit writes new parts first and then one mark, ``commits/version=<n>``: a
single small file that lists the parts of every table. Readers take the last
mark, so they see all changes of a command or none; a command that died half
way left parts that no mark names. Inserts add a part. Deletes rewrite only
the parts that hold a deleted row. Unchanged tables keep their parts. The mark
may carry the name of its command: a command that is sent again after its
commit changes nothing.

One writer at a time; any number of readers. A reader keeps the version it
loaded until ``expire`` removes it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Catalog
from ..operators.integrity import PRIMARY_KEYS
from ..plans.materialize import written

MARK = "table string, part string, command string, version long"


class CatalogStore:
    """The versions under ``root``, a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading ---------------------------------------------------------------
    def _marks(self) -> DataFrame:
        from pyspark.errors import AnalysisException
        try:
            return self.spark.read.schema(MARK).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MARK)

    def versions(self) -> list[int]:
        """Committed versions that have not expired, oldest first."""
        return sorted(r["version"] for r in self._marks().select("version").distinct().collect())

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """The parts of every table of a version (the last one by default)."""
        have = self.versions()
        if not have:
            return {}
        rows = self._marks().where(F.col("version") == (have[-1] if version is None else version)).where("table is not null").collect()
        out: dict[str, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["table"], r["part"])):
            out.setdefault(r["table"], []).append(r["part"])
        return out

    def _read(self, parts: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/parts/{p}") for p in parts])

    def load(self, version: int | None = None) -> Catalog:
        """The catalogue of a version; each table is opened when it is first read."""
        parts = self.parts(version)
        return Catalog(**{t: (lambda p=p: self._read(p)) for t, p in parts.items() if t in Catalog.TABLES})

    def results(self, version: int) -> DataFrame | None:
        """What the command of a version answered (statuses, new ids)."""
        parts = self.parts(version).get("results")
        return self._read(parts) if parts else None

    def committed(self, command: str) -> int | None:
        """The version that a named command made, if it did."""
        return self._marks().where(F.col("command") == command).agg(F.max("version")).first()[0]

    # -- writing ---------------------------------------------------------------
    def _write_part(self, table: str, version: int, rows: DataFrame) -> str:
        part = f"{table}/{version}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/parts/{part}")
        return part

    def create(self, catalog: Catalog) -> int:
        """The first version: all tables of ``catalog``."""
        if self.versions():
            raise ValueError(f"{self.root} holds versions already")
        return self.commit(inserts=catalog.tables())

    def commit(self, inserts: dict[str, DataFrame] | None = None, deletes: dict[str, DataFrame] | None = None,
               results: DataFrame | None = None, command: str | None = None) -> int:
        """Add the rows of ``inserts`` and drop the rows that ``deletes`` names by
        primary key (more columns are ignored), in one step; returns the version. Deletes
        act on the version before; a table may have both."""
        if command is not None and (done := self.committed(command)) is not None:
            return done
        have = self.versions()
        version = have[-1] + 1 if have else 1
        parts = {t: list(p) for t, p in self.parts().items() if t != "results"}
        for table, gone in (deletes or {}).items():
            parts[table] = self._without(table, version, parts.get(table, []), gone)
        for table, rows in (inserts or {}).items():
            if table not in Catalog.TABLES:
                raise ValueError(f"no such table: {table}")
            parts.setdefault(table, []).append(self._write_part(table, version, rows))
        if results is not None:
            parts["results"] = [self._write_part("results", version, results)]
        named = [(t, p, command) for t, ps in parts.items() for p in ps] or [(None, None, command)]
        mark = self.spark.createDataFrame(named, "table string, part string, command string").coalesce(1)
        # one file, renamed into place: it is there or it is not; a leftover of a dead commit is replaced
        mark.write.mode("overwrite").parquet(f"{self.root}/commits/version={version}")
        return version

    def _without(self, table: str, version: int, parts: list[str], gone: DataFrame) -> list[str]:
        """``parts`` with those that hold a deleted row rewritten as one."""
        key = PRIMARY_KEYS[table]
        if not parts:
            return []
        gone = written(gone.select(*key).distinct(), "gone")  # read to find the parts and to rewrite them
        each = [self.spark.read.parquet(f"{self.root}/parts/{p}").select(*key).withColumn("_part", F.lit(p)) for p in parts]
        hit = {r["_part"] for r in reduce(DataFrame.unionByName, each).join(gone, key, "left_semi").select("_part").distinct().collect()}
        if not hit:
            return parts
        columns = self.spark.read.parquet(f"{self.root}/parts/{parts[0]}").columns
        left = self._read([p for p in parts if p in hit]).join(gone, key, "left_anti").select(*columns)
        return [p for p in parts if p not in hit] + [self._write_part(table, version, left)]

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions: their marks first, then every
        part that no kept mark names, those of dead commits included. Returns
        the removed parts."""
        have = self.versions()
        kept = have[-max(1, keep):]
        named = {f"{p}" for v in kept for ps in self.parts(v).values() for p in ps}
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(conf)
        for status in fs.listStatus(path(f"{self.root}/commits")) if have else []:
            name = status.getPath().getName()
            if name.startswith("version=") and int(name[8:]) not in kept:
                fs.delete(status.getPath(), True)
        removed = []
        if not fs.exists(path(f"{self.root}/parts")):
            return removed
        for table in fs.listStatus(path(f"{self.root}/parts")):
            for part in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{part.getPath().getName()}"
                if name not in named:
                    fs.delete(part.getPath(), True)
                    removed.append(name)
        return sorted(removed)
