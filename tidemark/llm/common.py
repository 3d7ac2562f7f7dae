"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.storage import cut, ensure_checkpoint_dir, importable, remove, shared_folder  # noqa: F401

#: Rows that an operator works on at once inside a Python worker, whatever the size of the Arrow batch.
CHUNK_ROWS = 512
#: Seconds that a child process may take.
CHILD_SECONDS = 3600


def map_rows(df: DataFrame, cols: list[str], fn: Callable[[list[list]], dict], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to lists of column values, chunk by chunk, and return the columns it makes.

    ``fn`` receives one list for each of ``cols`` and returns a dict of equally long lists: of any length,
    or, if columns of ``carry`` are to stand before them as they are, one value for each row.  Only
    ``cols`` and ``carry`` are read, so further columns of ``df`` never clash with the outputs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    made_fields = df.sparkSession.createDataFrame([], schema).schema
    fields = StructType([df.schema[c] for c in carry] + made_fields.fields)
    arrow, sent = to_arrow_schema(fields), list(dict.fromkeys([*cols, *carry]))
    names, inputs, carried = made_fields.fieldNames(), [sent.index(c) for c in cols], [sent.index(c) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                made = fn([part.column(i).to_pylist() for i in inputs])
                arrays = [part.column(i) for i in carried] + [pa.array(made[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)
        release()

    importable(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, fields)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and labels to fit a classifier on (``id``, ``text``, ``y``), at most ``per_class`` of either label.

    The rows come from all that are not held out, in the order of a hash of their ids; texts over
    ``max_chars`` are passed over and of several texts of one id the least counts, so the sample's size is
    bounded by the two parameters.  Only ids that were chosen are broadcast.  Null ids, labels and texts take no part.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.lit(3), "id"), F.col("id")]
    chosen = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit_sample(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object], max_total: int) -> object:
    """The model that ``fit`` makes of a labelled sample, in one task of an executor; only the model reaches the driver.

    Texts come in the order of a hash of their ids, copies once, until ``max_total`` characters of either label
    are reached, so that the task's memory is bounded whatever the texts.  A lost executor repeats the task.
    """
    import pickle

    def made(batches: list[pa.RecordBatch]) -> bytes:
        import xxhash

        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[1]))
        kept, room = {}, [max_total, max_total]
        for _, text, y in rows:
            if (text, y) not in kept and room[y > 0] >= len(text):
                kept[text, y] = None
                room[y > 0] -= len(text)
        del rows
        return pickle.dumps(fit(list(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([in_child(lambda held=list(batches): made(held))], pa.binary())], names=["model"])
        release()

    importable(sample.sparkSession)
    model = sample.select("id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if model is None else pickle.loads(model["model"])


def in_child(work: Callable[[], bytes]) -> bytes:
    """What ``work`` returns, done in a child of this process, so that its memory goes with it.

    A child that fails or hangs fails the task, which Spark repeats.
    """
    import os
    import select
    import signal

    out, into = os.pipe()
    child = os.fork()
    if child == 0:
        status = 1
        try:
            os.close(out)
            with os.fdopen(into, "wb") as f:
                f.write(work())
            status = 0
        finally:
            if status:
                import traceback

                traceback.print_exc()
            os._exit(status)
    os.close(into)
    with os.fdopen(out, "rb") as f:
        late = not select.select([f], [], [], CHILD_SECONDS)[0]
        if late:
            os.kill(child, signal.SIGKILL)
        made = f.read()
    if os.waitpid(child, 0)[1]:
        raise RuntimeError(f"the child process took over {CHILD_SECONDS} s" if late else "the work in the child process failed; its error is in the log")
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of the shared storage, removed with the application."""
    import atexit
    import uuid

    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            remove(spark, folder)

    atexit.register(gone)
    return folder


def release() -> None:
    """Give freed memory back to the system; workers stay for later tasks, and what they hold counts all the while."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
