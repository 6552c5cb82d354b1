"""Shared pieces of the corpus operators: scratch tables, word rules, sorted-group streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, so that joined pieces give back a text's beginning.
WORD_WITH_LEAD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"

#: Bytes of a batch that goes to Python in the pipeline, about, and the session's setting of it.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCAL_SCRATCH: dict[str, str] = {}
#: Tables that this process wrote.
_WRITTEN: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).  Where it is unset a local session gets a temporary
    folder; any other is refused, since executors would write to disks of their own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="evigraph-")
    return _LOCAL_SCRATCH[app]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python by some ``BATCH`` bytes instead of 10,000 rows, unless the session has a setting of its own: an
    executor holds a batch a task, in the JVM and in Python, each some times over.  The setting stays, as it counts when
    a plan runs; results don't depend on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared scratch folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/evigraph-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`materialize` wrote, once no later plan reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/evigraph-" in folder:
            _delete(df.sparkSession, folder)


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns as a table of its own; the tables that were written on the way are deleted."""
    before = len(_WRITTEN)
    out = materialize(make(), tag)
    for path in _WRITTEN[before:-1]:
        _delete(out.sparkSession, path)
    del _WRITTEN[before:-1]
    return out


def boxed(docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """The columns ``used`` (those that are there) of ``docs``, and all others in one struct ``box``, under made-up names:
    whatever they are called, they clash with nothing."""
    others = [F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("box"))


def unboxed(df: DataFrame, docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """The columns of ``docs``, as :func:`boxed` put them away, from ``df``."""
    return df.select(*[F.col(c) if c in used else F.col(f"box.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col(_quoted(name))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], at_least: int = 1
) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``: tables of whole key groups with ``at_least`` rows where possible.

    A group is never cut; memory holds one batch and the groups not yet passed on.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        whole = int(np.argmax(last)) if last[-1] else table.num_rows
        if whole:
            yield table.slice(0, whole)
            rest = table.slice(whole).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def ragged(start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places start[i] to start[i] + size[i] - 1 for every i of ``which``, one after another."""
    k = size[which]
    ends = np.cumsum(k)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    return np.repeat((start[which] - (ends - k)).astype(kind), k) + np.arange(total, dtype=kind)


def fixed_matrix(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    """Binary values of one equal length as the rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), width)
