"""Append-only tables of Parquet files with a small log of schemas and generations."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .files import Files


class TableMissing(LookupError):
    """The table isn't there, and mustn't be created."""


def merged(a: T.DataType, b: T.DataType, name: str = "") -> T.DataType:
    """One type for both: structs get the members of either, everything else must be equal."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        there = {f.name: f for f in b}
        out = [T.StructField(f.name, merged(f.dataType, there[f.name].dataType, f.name) if f.name in there else f.dataType, True) for f in a]
        return T.StructType(out + [T.StructField(f.name, f.dataType, True) for f in b if f.name not in a.names])
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or a == b or a.simpleString() == b.simpleString():
        return a
    raise TypeError(f"column {name}: stored as {a.simpleString()}, now {b.simpleString()}")


class ParquetTable:
    """<path>/log/NNNNNNNN.json has the generation's folder and the schema; data is in <path>/<folder>/<part>/.

    A part is a feature version, so that reading one version opens its folder alone. Appends add files and
    a log entry; one that finds its generation replaced meanwhile writes its rows again to the new one,
    so they may be there twice, but never lost. Rewriting writes a folder of its own and then its log entry; it
    fails if anything was appended meanwhile, and can be tried again. The generation before stays for
    its readers until the next rewrite. The schema comes from the log: no file is opened to plan a read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def _log(self) -> tuple[int, dict] | None:
        names = [n for n in self.files.list(f"{self.path}/log") if re.fullmatch(r"\d{8}\.json", n)]
        return (int(names[-1][:8]), json.loads(self.files.read(f"{self.path}/log/{names[-1]}"))) if names else None

    def _commit(self, at: int, entry: dict) -> bool:
        return self.files.create(f"{self.path}/log/{at:08d}.json", json.dumps(entry))

    @property
    def exists(self) -> bool:
        return self._log() is not None

    @property
    def schema(self) -> T.StructType:
        log = self._log()
        if log is None:
            raise TableMissing(self.path)
        return T.StructType.fromJson(log[1]["schema"])

    def read(self, part: str | None = None) -> DataFrame:
        log = self._log()
        if log is None:
            raise TableMissing(self.path)
        schema = T.StructType.fromJson(log[1]["schema"])
        at = f"{self.path}/{log[1]['folder']}"
        parts = [part] if part is not None else self.files.list(at)
        paths = [f"{at}/{p}" for p in parts if self.files.exists(f"{at}/{p}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame, part: str | None, *, create: bool = True) -> None:
        """Add rows to a part; without one each row goes to that of its feature version, by one write."""
        df = C.typed(df)
        done = None
        while True:
            log = self._log()
            if log is None and not create:
                raise TableMissing(f"{self.path} isn't there, and this store doesn't create tables")
            number, entry = log or (-1, {"folder": "g0", "schema": T.StructType([]).jsonValue()})
            schema = merged(T.StructType.fromJson(entry["schema"]), df.schema)
            if done != entry["folder"]:
                self._put(df, f"{self.path}/{entry['folder']}", part)
                done = entry["folder"]
            if self._commit(number + 1, entry | {"schema": schema.jsonValue()}):
                return

    def _put(self, df: DataFrame, folder: str, part: str | None) -> None:
        if part is not None:
            df.write.mode("append").parquet(f"{folder}/{part}")
            return
        # a column of the folder's name, which isn't stored; the folders are then named by the versions alone
        staged = f"{folder}-{uuid.uuid4().hex}"
        df.withColumn("__part__", F.coalesce(C.col(C.FEATURE_VERSION), F.lit("none"))).write.partitionBy("__part__").parquet(staged)
        for name in self.files.list(staged):
            if name.startswith("__part__="):
                self.files.move_into(f"{staged}/{name}", f"{folder}/{name[len('__part__='):]}")
        self.files.delete(staged)

    def rewrite(self, keep) -> None:
        """Replace the contents by keep(part's rows), part by part, as a new generation."""
        log = self._log()
        if log is None:
            raise TableMissing(self.path)
        number, entry = log
        folder = f"g{number + 1}-{uuid.uuid4().hex}"
        for part in self.files.list(f"{self.path}/{entry['folder']}"):
            keep(self.read(part)).write.parquet(f"{self.path}/{folder}/{part}")
        if not self._commit(number + 1, entry | {"folder": folder, "before": entry["folder"]}):
            self.files.delete(f"{self.path}/{folder}")
            raise RuntimeError(f"{self.path} was changed by another writer; try again")
        if "before" in entry:
            self.files.delete(f"{self.path}/{entry['before']}")

    def drop(self) -> None:
        self.files.delete(self.path)


class FormatTable:
    """The same over a table format whose package the session has: delta or iceberg."""

    def __init__(self, spark: SparkSession, name: str, kind: str):
        self.spark, self.name, self.kind = spark, name, kind

    @property
    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @property
    def schema(self) -> T.StructType:
        return self.read().schema

    def read(self, part: str | None = None) -> DataFrame:
        if not self.exists:
            raise TableMissing(self.name)
        df = self.spark.table(self.name)
        return df.where(C.col(C.FEATURE_VERSION) == part) if part is not None and C.FEATURE_VERSION in df.columns else df

    def append(self, df: DataFrame, part: str | None, *, create: bool = True) -> None:
        if not self.exists and not create:
            raise TableMissing(self.name)
        df = C.typed(df)
        w = df.write.format(self.kind).option("mergeSchema", "true").mode("append")
        w.saveAsTable(self.name)

    def delete_where(self, condition: str) -> None:
        self.spark.sql(f"DELETE FROM {self.name} WHERE {condition}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, lazily; filters and columns are pushed into it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a table of a database; structs and maps go as JSON text."""
    flat = [F.to_json(C.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StructType | T.MapType | T.ArrayType) else C.col(f.name) for f in df.schema]
    df.select(*flat).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
