"""The document store on a folder of Parquet parts.

A run writes what changed as one part: the new rows of each table, and the keys whose older rows they replace. It
publishes by appending a manifest row last, which names the parts that each table is read from, so a reader sees the
store before the run or after it, never a mixture; a failed run leaves a part that nothing names. A run without
changes writes the manifest row alone. Tables of more than ``most_parts`` parts are written anew as one.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from scriptorium import schema as S

TABLES = {"rfc_sections": S.SECTIONS, "indexed_rfcs": S.DOCUMENTS, "normative_occurrences": S.KEYWORD_HITS, "rfc_abnf_blocks": S.GRAMMAR_BLOCKS, "rfc_errata": S.ERRATA, "postings": S.POSTINGS}
KEYS = {name: "errata_id" if name == "rfc_errata" else "rfc_number" for name in TABLES}
MANIFEST = T.StructType([*S.MANIFEST.fields, T.StructField("snapshot", T.StringType())])
Layout = dict[str, list[str]]


class Store:
    def __init__(self, spark: SparkSession, path: str, most_parts: int = 8) -> None:
        self.spark, self.path, self.most_parts = spark, path.rstrip("/"), most_parts

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/index_manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def layout(self) -> Layout:
        """For each table the parts that hold its rows, for each key (``gone:key``) those that replace older rows."""
        row = self.manifest().where("snapshot is not null").orderBy(F.col("created_at").desc(), F.col("id").desc()).first()
        return json.loads(row["snapshot"]) if row else {}

    def table(self, name: str, layout: Layout | None = None) -> DataFrame:
        """A table of the published parts, or of a layout that isn't published yet; empty before the first run."""
        layout = self.layout() if layout is None else layout
        kind, key, parts = TABLES[name], KEYS[name], layout.get(name, [])
        if not parts:
            return self.spark.createDataFrame([], kind)
        each = [self.spark.read.schema(kind).parquet(f"{self.path}/{part}/{name}").withColumn("_part", F.lit(part)) for part in parts]
        rows = reduce(DataFrame.unionByName, each)
        later = [part for part in layout.get(f"gone:{key}", []) if part > parts[0]]
        if later:
            # part names ascend with the runs; a row counts unless a later part replaces its key
            gone = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/{part}/gone-{key}").select(key, F.lit(part).alias("_gone")) for part in later))
            rows = rows.join(gone.groupBy(key).agg(F.max("_gone").alias("_gone")), key, "left").where("_gone is null or _part >= _gone")
        return rows.select(*kind.fieldNames())

    def write(self, new: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, afresh: bool = False) -> Layout:
        """Write a part of new rows that replace all rows of the keys ``gone``; the layout with it, not yet visible.
        With ``afresh`` the new tables are all there is."""
        before = {} if afresh else self.layout()
        numbers = [int(part[:8]) for parts in before.values() for part in parts]
        part = f"{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex}"
        after = {name: list(parts) for name, parts in before.items()}
        for name, frame in new.items():
            self._save(frame, name, part)
            after.setdefault(name, []).append(part)
        for key, frame in (gone or {}).items():
            frame.select(key).distinct().write.parquet(f"{self.path}/{part}/gone-{key}")
            after.setdefault(f"gone:{key}", []).append(part)
        for key in set(KEYS.values()):
            mine = [name for name in TABLES if KEYS[name] == key and after.get(name)]
            if max((len(after[name]) for name in mine), default=0) > self.most_parts:
                whole = part[:8] + "z" + part[9:]  # after the part itself
                for name in mine:
                    self._save(self.table(name, after), name, whole)
                after |= {name: [whole] for name in mine} | {f"gone:{key}": []}
        return after

    def _save(self, frame: DataFrame, name: str, part: str) -> None:
        frame = frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))
        if name == "postings":
            frame = frame.repartitionByRange("lexeme", "id").sortWithinPartitions("lexeme", "id")
        frame.write.parquet(f"{self.path}/{part}/{name}")

    def publish(self, layout: Layout | None = None, **run: object) -> None:
        """One manifest row a run, the run's last write, also if nothing changed."""
        row = {f.name: run.get(f.name) for f in MANIFEST.fields}
        self.publish_runs(self.spark.createDataFrame([tuple(row[f.name] for f in MANIFEST.fields)], MANIFEST).withColumn("created_at", F.current_timestamp()), layout)

    def publish_runs(self, runs: DataFrame, layout: Layout | None = None) -> None:
        """S22 for rows of runs; each gets an id of its own and the layout, the present one if none is given."""
        at = json.dumps(self.layout() if layout is None else layout)
        named = runs.withColumn("id", F.expr("uuid()")).withColumn("snapshot", F.lit(at))
        named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST.fields)).coalesce(1).write.mode("append").parquet(f"{self.path}/index_manifest")

    def backup(self, target: str) -> None:
        """Copy the published tables to another folder."""
        for name in TABLES:
            self.table(name).write.parquet(f"{target.rstrip('/')}/{name}")

    def restore(self, source: str, **run: object) -> None:
        """Publish the tables of a backup in place of all that is there."""
        tables = {name: self.spark.read.schema(kind).parquet(f"{source.rstrip('/')}/{name}") for name, kind in TABLES.items()}
        self.publish(self.write(tables, afresh=True), **run)
