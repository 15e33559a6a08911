"""What the operators share: written intermediate tables, free column names, words, shipping the package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space, the separators of words: space and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}
_SCRATCH: ContextVar[str | None] = ContextVar("tidewatch_scratch", default=None)
_KEPT: dict = {}
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is missing, a local session (tests) gets a temporary folder; a cluster is an error,
    since no machine-local folder would do there. Within scratch() it lies in the folder of that.
    """
    if outer := _SCRATCH.get():
        return f"{outer}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tidewatch-')}")
    return f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: cuts lineage and gives the optimizer its size."""
    path = f"{shared_folder(frame.sparkSession)}/{name}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for what is written within; it is removed at the end, when all results must have been stored elsewhere."""
    folder = shared_folder(spark)
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """name, with underscores added until no frame has such a column in any case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text that is not null: runs without ASCII white space."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN, -1))


def word_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, BLANK_RUN, -1))).cast("long")


def positive_hash(*columns: Column) -> Column:
    """63 hash bits as a long that is not negative; nulls are allowed."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def arrow_schema(kind: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a schema string; the driver's session parses it, so not for use in tasks."""
    return to_arrow_schema(T.StructType.fromDDL(kind) if isinstance(kind, str) else kind)


class Held:
    """A broadcast value with a number to know it by in Python workers."""

    def __init__(self, broadcast: Broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self) -> object:
        return self.broadcast.value


def kept(owner: str, key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: one operator's things at a time, the last one's."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def prepare(spark: SparkSession) -> None:
    """Give the executors this package, installed there or not, and hold Arrow batches small.

    A batch is held whole on both sides and texts may be long, so a session that leaves the number of rows
    at its default gets BATCH_ROWS.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_tidewatch_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._tidewatch_shipped = True
