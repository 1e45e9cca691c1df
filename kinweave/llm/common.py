"""Small helpers that the operators of this subpackage share.

Bytes travel as Arrow binary columns, so that a text is encoded once, in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.shared import remove, written  # noqa: F401

#: Rows in one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 256

#: Words are runs of anything but the space and the five ASCII controls from tab to carriage return; bytes.split() agrees.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with short Arrow batches set for what is read from it."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def rows_told_apart(docs: DataFrame, id_col: str, sized: str | None = None, **columns: Column) -> tuple[DataFrame, dict]:
    """id, row and the columns of docs, and what is known of the whole: whether ids tell rows apart, the least and greatest, and the
    bytes, in all and of the longest, of the column that sized names.

    row is a long of its own for each row. Where all ids are there and differ, counted over the whole table, it is the id.
    Otherwise the rows are written once with numbers, so that rows with no id, or with one id, stay rows of their own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in columns.items()])
    by = rows.select("id", (F.octet_length(sized).cast("long") if sized else F.lit(0)).alias("n")).groupBy("id").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.max("n").alias("longest"))
    known = by.agg(F.max("rows").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"), F.sum("bytes").alias("bytes"), F.max("longest").alias("longest"), F.min("id").alias("least"), F.max("id").alias("greatest")).first().asDict()
    known["by_id"] = not known["nulls"] and (known["most"] or 0) < 2
    if known["by_id"]:
        return rows.withColumn("row", F.col("id")), known
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "rows"), known


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: str) -> DataFrame:
    """mapInArrow over column lists. make() runs once a task and returns what maps the lists of a batch to new lists."""
    names = [f.split()[0] for f in schema.split(", ")]
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], wanted.field(n).type) for n in names], schema=wanted)

    return df.mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([pa.field(f.split()[0], ARROW[f.split()[1]]) for f in schema.split(", ")])
