"""Helpers for jobs whose tasks stream Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a batch that are turned into Python objects at a time.
SLICE = 100
# Rows and bytes of a batch where memory is short.
FEW_ROWS, FEW_BYTES = 1_000, 8 << 20


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the id and the text as UTF-8 bytes, so that other columns can neither clash nor be read."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
        *[column.alias(name) for name, column in more.items()],
    )


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, a bounded slice at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield from zip(*[part.column(name).to_pylist() for name in names])
    # A worker process lives on for other tasks; what this one has freed goes back to the machine.
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Held:
    """A broadcast object as tasks see it; a worker process unpacks it once for all its tasks."""

    def __init__(self, held):
        self.held = held

    @property
    def value(self):
        if not hasattr(self.held, "unpacked"):
            self.held.unpacked = cloudpickle.loads(self.held.value)
            # The worker would keep the packed form as long as the broadcast lives.
            del self.held._value
        return self.held.unpacked


class Shared(Held):
    """A broadcast object whose class travels with it, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        super().__init__(spark.sparkContext.broadcast(cloudpickle.dumps(value)))
        if _SCOPES:
            _SCOPES[-1].append(self)

    def __reduce__(self):
        return Held, (self.held,)

    def close(self) -> None:
        """Give the object back, on the driver and on all executors; what needs it must be stored by then."""
        self.held.destroy()


_SCOPES: list[list[Shared]] = []


@contextmanager
def small_batches(spark: SparkSession):
    """Batches between Spark and its Python workers stay small inside; jobs have to be run inside as well."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": FEW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": FEW_BYTES}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def given_back():
    """Closes what is shared inside, at the end; results that need it have to be stored inside as well."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for shared in _SCOPES.pop():
            shared.close()


class Output:
    """Collects rows and turns them into batches of the given Spark schema."""

    def __init__(self, schema: str, size: int = 2000):
        self.schema = arrow_schema(schema)
        self.size = size
        self.rows: list[tuple] = []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema
            )
            self.rows = []


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow form of a flat schema text; tasks have no session that could parse it."""
    fields = []
    for part in schema.split(","):
        name, kind = part.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(_TYPES[inner]) if inner != kind else _TYPES[kind]))
    return pa.schema(fields)


def record_batch(schema: str, *columns) -> pa.RecordBatch:
    """A batch of the given Spark schema from whole columns."""
    fields = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def map_rows(df: DataFrame, names: list[str], one: Callable[..., tuple], schema: str) -> DataFrame:
    """One row out for each row in; ``one`` gets the values of the named columns."""

    def run(batches):
        out = Output(schema)
        for row in rows(batches, *names):
            yield from out.add(*one(*row))
        yield from out.flush()

    return df.select(*names).mapInArrow(run, schema)
