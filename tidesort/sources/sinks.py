"""Where ordered rows go: an iterator, a visitor, a partition sink, or files."""

from __future__ import annotations

import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class SortSourceError(Exception):
    """Reading the ordered rows failed."""


class SortSinkError(Exception):
    """The consumer of the ordered rows failed."""


def iterate(df: DataFrame, prefetch: bool = False) -> Iterator[Row]:
    """Rows in order, one partition in the driver's memory at a time; failures of the plan are SortSourceError."""
    rows = None
    try:
        rows = df.toLocalIterator(prefetchPartitions=prefetch)
        while True:
            try:
                row = next(rows)
            except StopIteration:
                return
            yield row
    except GeneratorExit:
        raise
    except Exception as e:
        raise SortSourceError(str(e)) from e


def visit(df: DataFrame, consume: Callable[[Row], None]) -> int:
    """Calls ``consume`` on each row in order; stops at its first error, which comes back as SortSinkError."""
    count = 0
    for row in iterate(df):
        try:
            consume(row)
        except Exception as e:
            raise SortSinkError(str(e)) from e
        count += 1
    return count


def visit_partitions(df: DataFrame, consume: Callable[[Iterator[Row]], None]) -> None:
    """Runs ``consume`` on each partition's rows on the executors: ordered within partitions, partitions in any order."""
    try:
        df.foreachPartition(consume)
    except Exception as e:
        raise SortSinkError(str(e)) from e


@dataclass
class _Done(WriterCommitMessage):
    partition: int
    report: Any


def write_with(df: DataFrame, open_sink: Callable[[int], Any]) -> list[Any]:
    """Writes through sinks of the user's own, as a data source: ``open_sink(partition)`` is called on the executors.

    The sink has ``write(row)`` and ``close()``, and ``abort()`` if it can take back what it wrote.  Rows come in order, partitions
    are numbered in order.  What the tasks' ``close()`` returned comes back in order of partition; an attempt that failed or
    was repeated is not among them.
    """
    name = f"tidesort_sink_{uuid.uuid4().hex}"
    reports = tempfile.mkdtemp(prefix="tidesort-")  # on the driver, where the commit runs

    class Writer(DataSourceWriter):
        def write(self, rows: Iterator[Row]) -> _Done:
            partition = TaskContext.get().partitionId()
            sink = open_sink(partition)
            try:
                for row in rows:
                    sink.write(row)
                return _Done(partition, sink.close())
            except BaseException:
                if hasattr(sink, "abort"):
                    sink.abort()
                raise

        def commit(self, messages: list) -> None:
            done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
            (Path(reports) / "done").write_bytes(pickle.dumps([m.report for m in done]))

        def abort(self, messages: list) -> None:
            pass

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return Writer()

    df.sparkSession.dataSource.register(Sink)
    try:
        df.write.format(name).mode("append").save()
        return pickle.loads((Path(reports) / "done").read_bytes())
    except Exception as e:
        raise SortSinkError(str(e)) from e
    finally:
        shutil.rmtree(reports, ignore_errors=True)


def write_to(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "error", **options: str) -> None:
    """Files in order: one for each range partition, sorted inside, named in the order of their contents."""
    df.write.format(file_format).mode(mode).options(**options).save(path)
