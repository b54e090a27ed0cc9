"""Rows to PDF files: a batch function that writes each row's file as a binary column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows to every core where there are fewer partitions than that, as with one small file.

    Larger inputs come in more partitions than cores and are left as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def to_pdf(rows: DataFrame, key: str, make: Callable[..., bytes]) -> DataFrame:
    """key and content: ``make`` gets a row's other columns, in order, and returns the file's bytes."""
    kind = dict(rows.dtypes)[key]
    columns = [key, *[c for c in rows.columns if c != key]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values = zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)
                files = pa.array([make(*v) for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), files], names=[key, "content"])

    return spread(rows.select(*columns)).mapInArrow(run, f"{key} {kind}, content binary")


def to_pdfs(rows: DataFrame, key: str, make: Callable[..., list[bytes]]) -> DataFrame:
    """key, part and content: as ``to_pdf``, where ``make`` returns several files, numbered from zero."""
    kind = dict(rows.dtypes)[key]
    columns = [key, *[c for c in rows.columns if c != key]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [make(*v) for v in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
                which = pa.array([i for i, files in enumerate(made) for _ in files], pa.int64())
                numbers = pa.array([n for files in made for n in range(len(files))], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), numbers, pa.array([f for files in made for f in files], pa.binary())], names=[key, "part", "content"])

    return spread(rows.select(*columns)).mapInArrow(run, f"{key} {kind}, part int, content binary")


def pages_of(text: str | None, size: int = 40) -> list[str]:
    """A text cut into pages of ``size`` lines."""
    lines = (text or "").split("\n")
    return ["\n".join(lines[i : i + size]) for i in range(0, len(lines), size)]
