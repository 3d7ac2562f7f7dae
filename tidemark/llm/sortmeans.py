"""Centroid clustering by sort-means, in exact integers.

Each round puts the other centroids of every centroid in the order of their distance from it.  A vector looks at them
in the order that belongs to its last centroid and stops at the first that lies strictly beyond twice its own
distance: no centroid from there on can be nearer, nor as near.  Vectors keep their assignment between rounds in
the shared folder; a round's sums are made by task first, so a cluster of a third of all rows is no burden.  Only
centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

#: Scaled components of this size or more give distances that a long may not hold.
TOO_LARGE = 1 << 26


def integers(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """``id, v``: the vectors of ``dims`` finite components, each turned into floor(scale * x)."""
    fields = StructType([StructField("id", df.schema[id_col].dataType), StructField("v", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
            x = np.floor(scale * flat.reshape(-1, dims))
            good = (np.abs(x) < TOO_LARGE).all(axis=1)  # NaN is not
            v = x[good].astype("i8").reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(good.sum() + 1) * dims, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), lists], names=["id", "v"])

    common.importable(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")).filter(F.size("v") == dims).mapInArrow(run, fields)


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were taken.

    ``was`` is the centroid that each vector starts from.  Vectors of one start are put in the order of falling
    distance, so those that still look on are always the first few.
    """
    label, best, taken = np.empty(len(x), "i4"), np.empty(len(x), "i8"), 0
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    for c in np.unique(was):
        mine = np.flatnonzero(was == c)
        own = ((x[mine] - centroids[c]) ** 2).sum(axis=1)
        falling = np.argsort(-own, kind="stable")
        mine, own = mine[falling], own[falling]
        points, near, at = x[mine], own.copy(), np.full(len(mine), c, "i4")
        taken += len(mine)
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            # Squared: beyond twice the distance is beyond four times its square.
            n = int(np.searchsorted(-4 * own, -between[c, other], "right"))
            if not n:
                break
            d = ((points[:n] - centroids[other]) ** 2).sum(axis=1)
            taken += n
            nearer = (d < near[:n]) | ((d == near[:n]) & (other < at[:n]))
            near[:n][nearer], at[:n][nearer] = d[nearer], other
        label[mine], best[mine] = at, near
    return label, best, taken


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with their nearest centroid, looked for from the one they have."""
    dims = centroids.shape[1]
    fields = StructType([vectors.schema["id"], vectors.schema["v"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, d, _ = nearest(_matrix(batch.column(1), dims), batch.column(2).to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label), pa.array(d)], names=["id", "v", "cluster", "distance"])

    return vectors.select("id", "v", "cluster").mapInArrow(run, fields)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; those without any stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), "i8"), np.zeros(k, "i8")
        for batch in batches:
            x, label = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            for c in np.unique(label):
                mine = x[label == c]
                sums[c] += mine.sum(axis=0)
                n[c] += len(mine)
        held = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dims, pa.int32()), pa.array(sums[held].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype("i4")), pa.array(n[held]), lists], names=["cluster", "n", "s"])

    parts = vectors.select("v", "cluster").mapInArrow(run, "cluster int, n long, s array<long>")
    summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("s"))
    out = centroids.copy()
    for r in summed.collect():  # a row a centroid
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Cluster all vectors: ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``<seed>:<id>``; equal hashes go by
    components.  Null vectors, those of another length and those with null or non-finite components take no part, nor
    do those with a scaled component of 2**26 or more, whose distances a long can't hold.  Rows without an id are
    clustered, but are no first centroids; repeated rows count as often as they stand; with fewer than ``k`` rows there
    are fewer centroids, with none the result is empty.  Ties go to the smaller number.  Other columns are not read.
    """
    spark = df.sparkSession
    out = StructType([StructField(id_col, df.schema[id_col].dataType), *spark.createDataFrame([], "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").schema.fields])
    folder = common.scratch(spark, "sortmeans")
    integers(df, id_col, vec_col, dims, scale).withColumn("cluster", F.lit(0)).write.parquet(f"{folder}/0")
    vectors = spark.read.parquet(f"{folder}/0")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.filter(F.col("id").isNotNull()).select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([r["v"] for r in first], "i8")
    for i in range(rounds + 1):
        if i:
            centroids = _moved(vectors, centroids)
        _assigned(vectors, centroids).write.parquet(f"{folder}/{i + 1}")
        common.remove(spark, f"{folder}/{i}")
        vectors = spark.read.parquet(f"{folder}/{i + 1}")
    sums = {r["cluster"]: int(r["s"]) for r in vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, whole, sha[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), *out.fieldNames()[1:])
