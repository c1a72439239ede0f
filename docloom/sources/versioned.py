"""Tables in generations: a change rewrites the parts it touches and commits them with one small file.

Rows belong to a part by the hash of their key. ``commits/`` has a file for each generation, which names the folder of every part and counts what
was done; the file appears by an atomic rename that fails where another writer was first. Data files are never
changed or removed, so a reader goes on with the generation it opened, and a job that dies before its commit leaves
only folders that nothing names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.session import cut_lineage

PARTS = 64  # of a table; the commit file has a line for each


class Conflict(RuntimeError):
    """Another writer committed the generation first."""


@dataclass(frozen=True)
class Generation:
    number: int
    key: list[str]
    parts: int
    schema: dict
    folders: dict[str, str]
    counts: dict[str, int]


class Versioned:
    """A keyed table below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        commits = self._path("commits")
        if not self._files().exists(commits):
            return []
        names = [status.getPath().getName() for status in self._files().listStatus(commits)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def generation(self, number: int | None = None) -> Generation:
        """A commit, the newest by default."""
        if number is None:
            number = self.generations()[-1]
        text = self.spark.read.text(f"{self.folder}/commits/{number:012d}.json", wholetext=True).first()[0]
        return Generation(**json.loads(text))

    def _commit(self, made: Generation) -> Generation:
        jvm = self.spark.sparkContext._jvm
        begun, done = self._path("commits", f"_{uuid.uuid4().hex}"), self._path("commits", f"{made.number:012d}.json")
        out = self._files().create(begun, True)
        out.write(bytearray(json.dumps(made.__dict__).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(begun, done, none)
        except Exception as error:
            self._files().delete(begun, False)
            raise Conflict(f"generation {made.number} of {self.folder} exists") from error
        return made

    def _part(self, key: list[str], parts: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("_part")

    def create(self, rows: DataFrame, key: list[str], parts: int = PARTS) -> Generation:
        """The first generation; of rows with an equal key any one stays."""
        place = f"data/{uuid.uuid4().hex}"
        placed = rows.dropDuplicates(key).select(self._part(key, parts), "*").repartition("_part")
        placed.write.partitionBy("_part").parquet(f"{self.folder}/{place}")
        filled = self._filled(place)
        return self._commit(Generation(0, key, parts, rows.schema.jsonValue(), filled, {"written": self.spark.read.parquet(f"{self.folder}/{place}").count() if filled else 0, "deleted": 0, "failed": 0}))

    def _filled(self, place: str) -> dict[str, str]:
        """Folder of each part that a write made."""
        found = [status.getPath().getName() for status in self._files().listStatus(self._path(place))]
        return {name[len("_part="):]: f"{place}/{name}" for name in found if name.startswith("_part=")}

    def read(self, number: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """All rows of a generation, or those of some parts; folders of other generations are not read."""
        made = self.generation(number)
        schema = StructType.fromJson(made.schema)
        folders = [f"{self.folder}/{f}" for p, f in sorted(made.folders.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, error: str | None = None) -> Generation:
        """Put in or replace ``rows`` by key and take out the keys of ``gone``, as one generation.

        Where ``error`` names a column of rows, those with an error are counted and leave what is stored as it is. A key in both
        rows and gone is put in. Of rows with an equal key any one stays.
        """
        old = self.generation()
        columns = [field["name"] for field in old.schema["fields"]]
        part = self._part(old.key, old.parts)
        failed = rows.where(F.col(error).isNotNull()).count() if rows is not None and error else 0
        new = rows.where(F.col(error).isNull()) if rows is not None and error else rows
        new = self.spark.createDataFrame([], StructType.fromJson(old.schema)) if new is None else new.select(columns)
        new = cut_lineage(new.dropDuplicates(old.key).withColumn("_part", part))
        keys = new.select("_part", *old.key)
        if gone is not None:
            keys = keys.unionByName(gone.select(part, *old.key))
        keys = cut_lineage(keys.distinct())
        touched = [str(r[0]) for r in keys.select("_part").distinct().collect()]  # at most as many as the table has parts
        stored = self.read(old.number, touched).withColumn("_part", part)
        kept = stored.join(keys, ["_part", *old.key], "left_anti")
        place = f"data/{uuid.uuid4().hex}"
        kept.unionByName(new).repartition("_part").write.partitionBy("_part").parquet(f"{self.folder}/{place}")
        folders = {p: f for p, f in old.folders.items() if p not in touched} | self._filled(place)
        deleted = stored.join(keys.join(new, ["_part", *old.key], "left_anti"), ["_part", *old.key], "left_semi").count()
        return self._commit(Generation(old.number + 1, old.key, old.parts, old.schema, folders, {"written": new.count(), "deleted": deleted, "failed": failed}))
