"""Written intermediate tables, and joins with sides whose size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evertally.session import fresh_folder

#: A side of at most this many rows of a few dozen bytes is sent to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def written(rows: DataFrame, name: str) -> DataFrame:
    """`rows`, computed once into the shared folder: lost executors don't lose it, and lineage ends here."""
    spark = rows.sparkSession
    path = fresh_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def small_side(rows: DataFrame, counted: int) -> DataFrame:
    """Marks a written side for broadcast if its row count shows it small."""
    return F.broadcast(rows) if counted <= BROADCAST_ROWS else rows


def in_training_part(doc_id: str = "doc_id"):
    """Rows from which labels may be learned; the rest is held out."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id", parts: int = 4):
    """crc32 of the id as text, modulo `parts`, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 2


def fresh_name(taken: list[str], name: str) -> str:
    """`name`, with underscores in front until no column has it."""
    lower = {column.lower() for column in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
