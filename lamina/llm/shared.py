"""What the operators share: the folder for written tables, shipping of this package, names of
columns, row keys, and passes over texts."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []
#: Rows and bytes that Arrow sends to Python at a time; a longer text goes alone.
SENT_ROWS, SENT_BYTES = 500, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a new folder is made and set, on a local master only.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    _OWN.append(folder)
    sc.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            break
    for folder in _OWN:
        shutil.rmtree(folder, ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and lost
    executors can't take it away."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, and bounds what Arrow sends them at a time
    where the session has no bound of its own (Spark reads it when a query runs, so it stays set)."""
    for bound, most in (("maxRecordsPerBatch", SENT_ROWS), ("maxBytesPerBatch", SENT_BYTES)):
        if not spark._jsparkSession.sessionState().conf().contains(f"spark.sql.execution.arrow.{bound}"):
            spark.conf.set(f"spark.sql.execution.arrow.{bound}", str(most))
    sc = spark.sparkContext
    if getattr(sc, "_lamina_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp()
    target = os.path.join(folder, "lamina_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lamina").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(target)
    shutil.rmtree(folder, ignore_errors=True) if not sc.master.startswith("local") else _OWN.append(folder)
    sc._lamina_shipped = True


def give_back() -> None:
    """At the end of a task: freed memory goes back to the system, for the worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Between steps: the executors' heaps are collected whole, after which a JVM gives back what it
    doesn't need. One task a core, so each executor has some."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("_done")).write.format("noop").mode("overwrite").save()


def named(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(named(column).cast("string"), F.lit(""))


def place(docs: DataFrame, name: str) -> str:
    """What numbered(docs) calls the column of this name."""
    names = docs.columns
    return f"c{names.index(name) if name in names else [x.lower() for x in names].index(name.lower())}"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with their columns called c0, c1, ...: no name that an operator adds, or that has a
    dot, gets in the way. `.toDF(*docs.columns)` gives the names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """The rows without columns that have the names of results: those replace them."""
    taken = {x.lower() for x in names}
    return docs.select(*[named(c) for c in docs.columns if c.lower() not in taken])


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by its values; that a value is null is hashed too, as a
    null alone would leave a hash as it is. Rows with equal values share a key, so they must get
    equal results."""
    cols = [v for c in columns for v in (named(c).isNull(), named(c))]
    return [F.xxhash64(F.lit(11), *cols).alias("_r1"), F.xxhash64(F.lit(29), *reversed(cols), F.lit(3)).alias("_r2")]


def bit_lists(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """(keys, name): for each key the places `at`, whole numbers from 0, as a list of (_w, _bits), 64
    places in each. Bits are put together before rows move, so millions of places of one text are
    some bytes each and no set of objects."""
    bit = F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    words = rows.groupBy(*keys, F.shiftright(at, 6).cast("int").alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    return words.groupBy(*keys).agg(F.collect_list(F.struct("_w", "_bits")).alias(name))


def listed_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each bit of an Arrow column of bit_lists, in the order of rows."""
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    word, bits = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
    at, bit = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return row[at], word[at].astype(np.int64) * 64 + bit


def over_texts(docs: DataFrame, keep: list[str], text_column: str, more: str, of_texts: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The columns `keep` and those of the schema `more`, which of_texts makes from the texts of a
    batch. Texts cross over to Python once, whether they are kept or not."""
    ship(docs.sparkSession)
    at = keep.index(text_column) if text_column in keep else len(keep)
    extra = [named(text_column).cast("string").alias("_text")] if at == len(keep) else []
    source = docs.select(*map(named, keep), *extra)
    names = [*keep, *[x.split()[0] for x in more.split(", ")]]
    kinds = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in source.schema.fields[: len(keep)])

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            made = of_texts(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)
        give_back()

    return source.mapInArrow(run, kinds + more)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
