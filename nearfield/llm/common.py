"""Shared plumbing of the operators: schemas, and hash sampling for training."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def extended(schema: StructType, **more: str) -> StructType:
    """``schema`` with further columns, as a new object."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def release() -> None:
    """Gives memory that a task has freed back to the machine: a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int, fold: int = 1) -> DataFrame:
    """A bounded sample of labelled rows to fit a classifier on: (doc_id, text, label).

    Only rows whose ``crc32(doc_id as text) mod 3`` is not ``fold`` take part. The ``max_rows`` rows with the smallest
    xxhash64 of doc_id are taken, texts of over ``max_chars`` characters and rows with nulls left out; so at most
    ``max_rows * max_chars`` characters reach whoever fits.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != fold))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")
