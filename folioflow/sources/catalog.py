"""A catalog: one Parquet table for every entity in a folder.

State changes are whole new tables, written beside the old and named by version. A
version counts once Spark has committed it (its _SUCCESS file is there), so a reader
never sees half of one and a catalog opened again, in whatever session, finds what was
written last. A version is never written over; there is one writer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.schemas import SCHEMA_VERSION, TABLES, TOPICS, UPLOAD_EXTENSIONS
from folioflow.sources.scratch import shared_dir  # noqa: F401  as it was here before


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    path: str

    def read(self, table: str) -> DataFrame:
        """The table as last committed, in its fixed schema; empty if it was never written. Topics that are missing from a stored table are there again."""
        versions = self.versions(table)
        stored = self.spark.read.schema(TABLES[table]).parquet(self._at(table, versions[-1])) if versions else self.spark.createDataFrame([], TABLES[table])
        return add_missing(stored, self.seeds(), "slug") if table == "topics" else stored

    def write(self, table: str, rows: DataFrame) -> Catalog:
        """The table's next version; rows may come from its last. Columns that rows don't have are null."""
        had = set(rows.columns)
        shown = [(F.col(f.name) if f.name in had else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]]
        version = max(self._listed(table), default=-1) + 1
        rows.select(*shown).write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._at(table, version))
        return self

    def migrate(self, now: Column) -> Catalog:
        """Applied schema versions, each once, and the topics."""
        wanted = self.spark.range(1, SCHEMA_VERSION + 1).select(F.col("id").alias("version"), now.alias("applied_at"))
        self.write("migrations", add_missing(self.read("migrations"), wanted, "version"))
        return self.write("topics", self.read("topics"))

    def seeds(self) -> DataFrame:
        return self.spark.createDataFrame([(slug, label, color, k) for k, (slug, label, color) in enumerate(TOPICS)], TABLES["topics"])

    def versions(self, table: str) -> list[int]:
        """The committed versions, oldest first, by one listing of the table's folder."""
        return sorted(v for v, done in self._listed(table).items() if done)

    def forget(self, table: str, keep: int = 2) -> None:
        """Delete all committed versions but the last ones; readers of older ones must be done."""
        for version in self.versions(table)[: -keep or None]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(table, version))
            self._files(path).delete(path, True)

    def _at(self, table: str, version: int) -> str:
        return f"{self.path}/{table}/v{version}"

    def _files(self, path):
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, table: str) -> dict[int, bool]:
        """The versions there are, and whether they are committed."""
        found = self._files(pattern := self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/v*/*")).globStatus(pattern)
        places = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in found or ()]
        return {int(v[1:]): any(w == v and name == "_SUCCESS" for w, name in places) for v, _ in places}


def add_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and the new ones whose key they don't have."""
    fresh = new.join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def check_rows(rows: DataFrame, rules: dict) -> DataFrame:
    """The rows that break a rule, with the broken rules' names in an array."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("broken", F.array_compact(F.array(*broken))).where(F.size("broken") > 0)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: path, mime guess by extension, bytes and SHA-256 of the content."""
    files = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for pair in UPLOAD_EXTENSIONS.items() for x in pair]), extension)
    return files.select("path", extension.alias("extension"), mime.alias("mime"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
