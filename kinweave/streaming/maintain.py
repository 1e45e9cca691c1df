"""The insert-only tables fed from a stream: each micro-batch of accounts is worked on like an increment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from kinweave.operators.identity import insert_unseen


def insert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], columns: list[str], identify: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that gives each batch its ids and appends the cards that the full table does not have. A batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        full = read()
        new = insert_unseen(full.limit(0), identify(df.join(full.select("card_nbr"), "card_nbr", "left_anti")), columns)
        write(new.dropDuplicates(["card_nbr"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
