"""A cache table that is written to: versions named by a manifest, upserts by key, readers that see one version whole.

A version is a list of folders, the later ones holding what was put in later; of rows with one key the last written
holds. An upsert writes its rows to a folder of their own and then makes them visible by a manifest, which is written
beside its place and put there by a rename that fails if another writer was first. A writer that ends between the two
leaves a folder that no reader looks at. A version of more than ``FOLDERS`` folders is written anew as one.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS, ATTEMPTS = 8, 5


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


class Versions:
    """The cache in the folder ``path``, on any file system that Spark writes to; ``schema`` has the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema)
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.log = self.hadoop.Path(f"{self.path}/_log")
        self.files = self.log.getFileSystem(spark._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The newest version, 0 before the first."""
        if not self.files.exists(self.log):
            return 0
        names = [f.getPath().getName() for f in self.files.listStatus(self.log)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def folders(self, number: int | None = None) -> list[str]:
        """The folders of a version, oldest first."""
        number = self.number() if number is None else number
        if not number:
            return []
        told = self.spark.read.text(f"{self.path}/_log/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(told)["folders"]

    def read(self, number: int | None = None) -> DataFrame:
        """One version; what is written meanwhile doesn't show. No version yet: no rows."""
        return self._rows(self.folders(number))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}") for f in folders]
        if len(parts) == 1:
            return parts[0]
        rows = reduce(DataFrame.union, [p.withColumn("__turn", F.lit(k)) for k, p in enumerate(parts)])
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "__turn").alias("__row"))
        return last.select("__row.*")

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Put rows in; of rows with one key that of the greatest ``order`` (any of them, if none is named). The version's number.

        Rows with a null key are left out. If another writer was first, the manifest is made again on top of its version.
        """
        rows = rows.where(F.col(self.key).isNotNull()).select(*self.schema.names, *([order] if order and order not in self.schema.names else []))
        one = F.max_by(F.struct(*self.schema.names), order) if order else F.max(F.struct(*self.schema.names))
        folder = self._written(rows.groupBy(self.key).agg(one.alias("__row")).select("__row.*"))
        for _ in range(ATTEMPTS):
            number = self.number()
            folders = [*self.folders(number), folder]
            if len(folders) > FOLDERS:
                folders = [self._written(self._rows(folders))]
            try:
                return self._commit(number + 1, folders)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} times another writer was first")

    def _written(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, number: int, folders: list[str]) -> int:
        beside, place = (self.hadoop.Path(f"{self.path}/_log/{n}") for n in (f".{uuid.uuid4().hex}", f"{number:012d}.json"))
        out = self.files.create(beside, True)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, place, never_over)
        except Py4JJavaError as e:
            self.files.delete(beside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {number} is there") from None
            raise
        return number

    def cleared(self, keep: int = 2) -> int:
        """Remove folders that none of the newest ``keep`` versions has, and their manifests; how many folders went."""
        number = self.number()
        kept = {f for n in range(max(1, number - keep + 1), number + 1) for f in self.folders(n)}
        gone = [f for f in self.files.listStatus(self.hadoop.Path(self.path)) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in kept]
        for f in gone:
            self.files.delete(f.getPath(), True)
        for n in range(1, number - keep + 1):
            self.files.delete(self.hadoop.Path(f"{self.path}/_log/{n:012d}.json"), False)
        return len(gone)
