"""Recorded sound: files of 16-bit samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import importable


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Files of PCM samples: ``path, rate, channels, frames, rms``, samples being from -1 to 1; files that are none have nulls.

    A file is decoded where it is read, in parts, and only its figures leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("16-bit samples only")
                        total = 0.0
                        while part := w.readframes(1 << 20):
                            x = np.frombuffer(part, "<i2").astype(np.float64) / 32768
                            total += float(x @ x)
                        n = w.getnframes() * w.getnchannels()
                        out.append((name, w.getframerate(), w.getnchannels(), w.getnframes(), (total / n) ** 0.5 if n else 0.0))
                except (wave.Error, EOFError):
                    out.append((name, None, None, None, None))
            cols = zip(*out, strict=True)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "rate", "channels", "frames", "rms"])

    importable(spark)
    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInArrow(run, "path string, rate int, channels int, frames long, rms double")
