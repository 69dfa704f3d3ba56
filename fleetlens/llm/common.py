"""Pieces that several text operators share: words, splits, stored intermediates, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.graph import components
from fleetlens.session import checkpoint_dir, materialize

__all__ = ["let", "spaced", "words_of", "held_out", "read", "small_batches", "materialize", "stored", "components"]


def stored(df: DataFrame) -> DataFrame:
    """Like ``materialize``, as a compressed Parquet table in the shared folder, for wider rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """Texts can be long: keep the Arrow batches of Python operators short."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text (null: empty) with each of the six white-space characters U+0009-U+000D as a space."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """All matches of ``[^\\x20\\x09-\\x0D]+``, in order."""
    return F.array_remove(F.split(spaced(text), " "), "")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model sees: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
