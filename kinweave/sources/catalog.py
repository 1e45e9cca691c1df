"""Tables by name: reading, writing, statements, and checks before a stage starts. The session is given, never made here."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = ("app_id", "url", "user", "password", "database", "schema", "warehouse", "role", "format", "path")
SECRET = ("user", "password")
VERBS = {"drop": "dropped", "update": "updated", "insert": "inserted into", "delete": "deleted from", "truncate": "truncated"}


class Catalog:
    """A data folder (Parquet by default) and the session's tables behind one interface. procedures: Python callables by name."""

    def __init__(self, spark: SparkSession, root: str | None = None, **options: str):
        self.spark, self.root = spark, root
        self._options = dict.fromkeys(OPTIONS)
        self.procedures: dict[str, Callable[..., object]] = {}
        for k, v in options.items():
            self.set_option(k, v)

    def __repr__(self) -> str:
        shown = {k: "***" if k in SECRET else v for k, v in self._options.items() if v is not None}
        return f"Catalog(root={self.root!r}, {shown})"

    def option(self, name: str) -> str | None:
        return self._options[name]

    def set_option(self, name: str, value: str) -> None:
        if name not in self._options:
            raise NameError(f"no option {name!r}; there are {', '.join(OPTIONS)}")
        self._options[name] = value

    def path(self, table: str) -> str:
        return f"{self.root}/{table}.parquet"

    def read(self, query: str) -> DataFrame:
        """A table by name, or the rows of a select; column names in lower case."""
        if "select" in query.lower():
            df = self.spark.sql(query)
        elif self.spark.catalog.tableExists(query):
            df = self.spark.table(query)
        elif self.root:
            df = self.spark.read.format(self._options["format"] or "parquet").load(self.path(query))
        else:
            raise ValueError(f"no table {query}")
        return df.toDF(*[c.lower() for c in df.columns])

    def write(self, df: DataFrame, table: str, mode: str = "overwrite") -> None:
        """A managed table; or Parquet under the root, where there is one."""
        if self.root:
            df.write.mode(mode).parquet(self.path(table))
        else:
            df.write.mode(mode).saveAsTable(table)

    def call(self, procedure: str, *args: object) -> object:
        """A registered callable, else a stored procedure of the session's catalogs."""
        if procedure in self.procedures:
            return self.procedures[procedure](*args)
        return self.spark.sql(f"CALL {procedure}({', '.join(map(literal, args))})")

    def alter(self, statement: str) -> None:
        self.spark.sql(statement)

    def run(self, statement: str, table: str) -> str:
        """Runs a statement and says what became of the table; ValueError if it fails."""
        verb = statement.split(None, 1)[0].lower() if statement.strip() else ""
        try:
            self.alter(statement)
        except Exception as e:
            raise ValueError(f"{table}: {verb or 'empty'} statement failed: {e}") from e
        return f"{table} {VERBS.get(verb, 'created')}"

    def check_exists(self, table: str) -> str:
        try:
            empty = self.read(table).isEmpty()
        except Exception as e:
            raise ValueError(f"{table} cannot be read") from e
        if empty:
            raise ValueError(f"{table} is empty")
        return f"{table} exists and has rows"

    def is_fresh(self, table: str, column: str = "") -> bool:
        """Whether its latest update is of today; the column is the first whose name has last_update_ts unless one is given."""
        df = self.read(table)
        column = column or next((c for c in df.columns if "last_update_ts" in c), "")
        if not column:
            raise ValueError(f"{table} has no column with last_update_ts")
        return bool(fresh(df, column).first()[0])

    def materialize(self, df: DataFrame, table: str) -> DataFrame:
        """df written and read again: the end of a stage."""
        self.write(df, table)
        return self.read(table)

    def truncate(self, table: str) -> None:
        # Read fully before its files are replaced: an empty frame of the same columns has nothing to read.
        self.write(self.spark.createDataFrame([], self.read(table).schema), table)

    def append(self, df: DataFrame, table: str) -> None:
        self.write(df, table, "append")

    def view(self, df: DataFrame, name: str) -> None:
        df.createOrReplaceTempView(name)

    def model(self, path: str):
        from pyspark.ml import PipelineModel

        return PipelineModel.load(path)


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    raise TypeError(f"a {type(value).__name__} has no SQL literal")


def fresh(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.to_date(F.max(F.col(column).cast("timestamp"))) >= F.current_date(), F.lit(False)).alias("is_fresh"))


def empty(spark: SparkSession, *columns: str) -> DataFrame:
    """No rows of string columns."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def dimension(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A lookup table for broadcast, checked to be small; a larger one comes back as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
