"""Tables and columns of a Spark catalog (no session state is changed)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from ..errors import ExecutionBackendError

_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table_names(spark: SparkSession, db: str | None) -> list[str]:
    try:
        found = spark.catalog.listTables(db) if db else spark.catalog.listTables()
    except Exception as e:
        raise ExecutionBackendError(f"database {db} cannot be listed", cause=e) from None
    return [t.name for t in found if db is None or not t.isTemporary]


def column_names(spark: SparkSession, db: str | None, table: str) -> list[str]:
    quoted = ".".join("`" + x.replace("`", "``") + "`" for x in (db, table) if x)
    return spark.table(quoted).columns


class Schema(Mapping):
    """Columns of each table of a database, looked up when asked for."""

    def __init__(self, spark: SparkSession, db: str | None):
        self._spark, self._db, self._found = spark, db, dict.fromkeys(table_names(spark, db))

    def __getitem__(self, table: str) -> list[str]:
        if self._found[table] is None:
            self._found[table] = column_names(self._spark, self._db, table)
        return self._found[table]

    def __iter__(self):
        return iter(self._found)

    def __len__(self) -> int:
        return len(self._found)


def schema(spark: SparkSession, db: str | None) -> Schema:
    return Schema(spark, db)


def load_views(spark: SparkSession, folder: str, tables) -> None:
    """Parquet tables of a folder as temporary views; their schemas are read
    once a session."""
    for t in tables:
        path = f"{folder}/{t}.parquet"
        key = (spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = spark.read.parquet(path).schema
        spark.read.schema(_SCHEMAS[key]).parquet(path).createOrReplaceTempView(t)
