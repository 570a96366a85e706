"""Shared pieces: table rows as the operators see them, tables in the shared folder, free column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so others cannot clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder and read back, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_groups(values: Iterable[str | None], most_bytes: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in groups of limited size, so what a task holds beside its batch stays small; null is empty."""
    group, size = [], 0
    for x in values:
        x = x or ""
        if group and size + len(x) > most_bytes:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
