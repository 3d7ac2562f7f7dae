"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances on the unit sphere by one added coordinate, so that one bucket width
suits all data.  Each table hashes a vector by Gaussian projections cut into slots.  A query visits its own
bucket and those reached by moving to neighbouring slots, in the order of estimated success: perturbations are sets
of borders to cross, made in the order of their expected cost and then sorted by the query's own squared
distances to the borders.  The candidates of all tables are merged and ranked by their exact inner products.

Vectors and probes are dealt by table and bucket, each probe to the one group that holds its bucket; buckets of
many vectors are salted over several groups.  In a group the buckets that come first in the order of the
queries are visited first, so that of later ones only vectors better than a query's present ``k``-th are kept.
How fine the buckets are and how many of them are visited is set by the recall measured on a bounded sample.  A query
that finds too few candidates is searched again in all buckets.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TABLES, SEED = 6, 17
#: Projections of a table and the width of their slots, from coarse to fine; probes of a table at most.
SHAPES, PROBES = ((6, 2.0), (8, 2.25), (10, 2.5), (12, 2.5), (14, 2.75), (16, 3.0), (18, 3.25)), 800
#: The fitting sample (rows, queries among them) and the recall aimed at on it.
SAMPLE, SAMPLE_QUERIES, RECALL = 20_000, 120, 0.93
#: Groups of a table at least, vectors of a group on average at most, and buckets that may be salted at most.
GROUPS, GROUP_ROWS, HOT = 4, 100_000, 10_000
#: Queries worked on at once in a group, pairs held at once, and probes of the first round.
CHUNK, PAIRS, FIRST = 4096, 2_000_000, 16


@lru_cache(maxsize=16)
def perturbations(hashes: int, count: int) -> np.ndarray:
    """The first ``count`` sets of borders to cross, by expected cost, as places in the order of a query's distances.

    Of the ``2 * hashes`` distances to borders, sorted, the j-th from below and the j-th from above are of one
    projection, so no set holds both.  Rows are padded with ``2 * hashes``, which stands for no border.
    """
    m = hashes
    cost = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[1], (1,))]
    while heap and len(found) < count:
        s, borders = heapq.heappop(heap)
        if all(2 * m + 1 - j not in borders for j in borders):
            found.append(borders)
        last = borders[-1]
        if last < 2 * m:
            heapq.heappush(heap, (s - cost[last] + cost[last + 1], (*borders[:-1], last + 1)))
            heapq.heappush(heap, (s + cost[last + 1], (*borders, last + 1)))
    out = np.full((len(found), max(1, *map(len, found))) if len(found) > 1 else (1, 1), 2 * m)
    for row, borders in zip(out, found, strict=True):
        row[: len(borders)] = [j - 1 for j in borders]
    return out


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are hashed; ``hot`` has the buckets that are salted, sorted, and their salts."""

    dim: int
    longest: float
    rows: int
    hashes: int = SHAPES[0][0]
    width: float = SHAPES[0][1]
    probes: int = PROBES
    hot: tuple[tuple[int, int], ...] = ()
    seed: int = SEED

    @property
    def groups(self) -> int:
        """Groups of one table."""
        return max(GROUPS, -(-self.rows // GROUP_ROWS))

    @property
    def limit(self) -> int:
        """Vectors of a bucket that is not salted; no more than ``HOT`` buckets hold more."""
        return max(self.rows // (2 * self.groups), TABLES * self.rows // HOT, 500)

    def positions(self, vectors: np.ndarray, table: int, query: bool) -> np.ndarray:
        """Where vectors lie among the slots of a table; the added coordinate makes inner products distances."""
        rng = np.random.default_rng((self.seed, table))
        a, b = rng.normal(size=(self.dim + 1, self.hashes)), rng.uniform(0, self.width, size=self.hashes)
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        scaled = vectors / (norm if query else np.full_like(norm, self.longest))[:, None]
        added = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        return (np.hstack([scaled, added[:, None]]) @ a + b) / self.width

    def factors(self, table: int) -> np.ndarray:
        return np.random.default_rng((self.seed, table, 1)).integers(1, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The buckets of vectors, each named by a hash of its slots that is linear in them."""
        slots = np.floor(self.positions(vectors, table, False)).astype(np.int64).astype(np.uint64)
        return (slots * self.factors(table)).sum(axis=1, dtype=np.uint64)

    def probe_keys(self, queries: np.ndarray, table: int) -> np.ndarray:
        """The buckets that queries visit, in the order of estimated success (queries x probes)."""
        at = self.positions(queries, table, True)
        floor = np.floor(at)
        down = at - floor
        factors = self.factors(table)
        home = (floor.astype(np.int64).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
        apart, n = np.concatenate([down, 1 - down], axis=1), len(queries)
        order = np.argsort(apart, axis=1)
        moves = np.concatenate([np.uint64(0) - factors, factors])
        cost = np.concatenate([np.take_along_axis(apart, order, axis=1) ** 2, np.zeros((n, 1))], axis=1)
        move = np.concatenate([moves[order], np.zeros((n, 1), np.uint64)], axis=1)
        sets = perturbations(self.hashes, 2 * self.probes)
        total, to = np.zeros((n, len(sets))), np.repeat(home[:, None], len(sets), axis=1)
        for places in sets.T:
            total += cost[:, places]
            to += move[:, places]
        probes = min(self.probes, len(sets))
        first = np.argpartition(total, probes - 1, axis=1)[:, :probes]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(total, first, axis=1), axis=1, kind="stable"), axis=1)
        return np.take_along_axis(to, first, axis=1)

    def group_of(self, keys: np.ndarray, table: int, salt: np.ndarray | int = 0) -> np.ndarray:
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return (table * self.groups + (mixed.astype(np.int64) + salt) % self.groups).astype(np.int64)

    def salts(self, keys: np.ndarray) -> np.ndarray:
        """Over how many groups each bucket is dealt."""
        out = np.ones(len(keys), np.int64)
        if self.hot:
            names, many = np.array([k for k, _ in self.hot], np.uint64), np.array([m for _, m in self.hot])
            at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
            out = np.where(names[at] == keys, many[at], out)
        return out


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and all of its components finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


class Group:
    """The vectors of some buckets of one table."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> None:
        same = np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, of = np.unique(same, return_inverse=True)
        order = np.lexsort((ids, of.ravel(), keys))
        # Of equal vectors more than k + 1 can't be among the k best but for the query itself: those of least id stay.
        new = np.r_[True, (np.diff(of.ravel()[order]) != 0) | (np.diff(keys[order].view(np.int64)) != 0)]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[place <= k]
        self.ids, self.vectors, self.k = ids[order], vectors[order].astype(np.float64), k
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, probes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and exact score of each query's best candidates here; no probes stand for all buckets."""
        n, turned = len(queries), np.ascontiguousarray(queries.T)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, row, score
        least = np.full(n, -np.inf)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = 0

        def settle() -> None:
            """Rank what is held by exact scores and keep the best of each query."""
            nonlocal best, held, pairs
            if not held:
                return
            q, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held, pairs = [], 0
            other = self.ids[row] != query_ids[q]
            q, row = q[other], row[other]
            score = np.concatenate([(self.vectors[row[a : a + 65_536]] * queries[q[a : a + 65_536]]).sum(axis=1) for a in range(0, len(q), 65_536)] or [np.zeros(0)])
            q, row, score = (np.concatenate(x) for x in zip(best, (q, row, score), strict=True))
            order = np.lexsort((self.ids[row], -score, q))
            q, row, score = q[order], row[order], score[order]
            first = np.searchsorted(q, np.arange(n))
            place = np.arange(len(q)) - first[q]
            keep = place < self.k
            last = place == self.k - 1
            least[q[last]] = score[last] - 1e-9 * (1 + np.abs(score[last]))
            best = (q[keep], row[keep], score[keep])

        def visit(buckets: np.ndarray, of: np.ndarray) -> None:
            """Visit each bucket for the queries that reach it; ``buckets`` are sorted."""
            nonlocal pairs
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for a, z in itertools.pairwise([0, *cuts.tolist(), len(buckets)]):
                if a == z:
                    continue
                who, b = of[a:z], buckets[a]
                step = max(1, PAIRS // len(who))
                for lo in range(self.starts[b], self.ends[b], step):
                    hi = min(lo + step, self.ends[b])
                    row, j = np.nonzero(self.vectors[lo:hi] @ turned[:, who] >= least[who])
                    if len(row):
                        held.append((who[j], row + lo))
                        pairs += len(row)
                        if pairs > PAIRS:
                            settle()

        if probes is None:
            every = np.arange(n)
            for b in range(len(self.keys)):
                visit(np.full(n, b), every)
            settle()
        else:
            for part in (probes[:, :FIRST], probes[:, FIRST:]):
                at = np.minimum(np.searchsorted(self.keys, part), len(self.keys) - 1)
                q, place = np.nonzero(self.keys[at] == part)
                at = at[q, place]
                order = np.argsort(at, kind="stable")
                visit(at[order], q[order])
                settle()
        return best[0], self.ids[best[1]], best[2]


def fit(sample: np.ndarray, plan: Plan, k: int, recall: float) -> Plan:
    """The shape and number of probes that reach ``recall`` on a sample and visit the fewest vectors; else the most probes of the coarsest."""
    n = len(sample)
    queries = sample[: min(SAMPLE_QUERIES, n)]
    k = min(k, n - 1)
    if k < 1:
        return plan
    exact = queries @ sample.T
    exact[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    cheapest, chosen = np.inf, plan
    for hashes, width in SHAPES:
        shape = replace(plan, hashes=hashes, width=width, probes=PROBES)
        found, visits = None, 0
        for table in range(TABLES):
            keys, probes = shape.keys(sample, table), shape.probe_keys(queries, table)
            names, counts = np.unique(keys, return_counts=True)
            at = np.minimum(np.searchsorted(names, probes), len(names) - 1)
            visits = visits + np.cumsum(np.where(names[at] == probes, counts[at], 0), axis=1).mean(axis=0)
            # At which probe each true neighbour is met.
            rank = np.full(best.shape, PROBES)
            for i, (row, want) in enumerate(zip(probes, keys[best], strict=True)):
                order = np.argsort(row, kind="stable")
                j = np.minimum(np.searchsorted(row[order], want), len(row) - 1)
                rank[i] = np.where(row[order][j] == want, order[j], PROBES)
            found = rank if found is None else np.minimum(found, rank)
        enough = np.flatnonzero(np.cumsum(np.bincount(found.ravel(), minlength=PROBES + 1)[: len(visits)]) >= recall * best.size)
        # A probe costs about as much as the look at a few vectors, whatever it finds.
        cost = visits + 4 * TABLES * np.arange(1, len(visits) + 1) * n / max(plan.rows, n)
        if len(enough) and cost[enough[0]] < cheapest:
            cheapest, chosen = cost[enough[0]], replace(shape, probes=int(enough[0]) + 1)
    return chosen


def _plan(vectors: DataFrame, plan: Plan, k: int, recall: float) -> Plan:
    """Fit on a sample by a hash of the ids, in one task of an executor, and find the buckets to be salted."""
    rows = vectors.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(SAMPLE).select("v").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([_matrix(b.column(0), plan.dim) for b in batches])
        yield pa.RecordBatch.from_arrays([pa.array([common.in_child(lambda: pickle.dumps(fit(x, plan, k, recall)))], pa.binary())], names=["plan"])

    fitted: Plan = pickle.loads(rows.mapInArrow(run, "plan binary").first()["plan"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), plan.dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([fitted.keys(x, t).view(np.int64) for t in range(TABLES)]))], names=["key"])

    hot = vectors.select("v").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > fitted.limit).collect()  # HOT rows at most
    return replace(fitted, hot=tuple(sorted((r["key"] & (1 << 64) - 1, min(fitted.groups, -(-r["n"] // fitted.limit))) for r in hot)))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _dealt(vectors: DataFrame, plan: Plan, query: bool, everywhere: bool) -> DataFrame:
    """Vectors in the groups of their buckets (``g, kind, id, key, v``), queries in those that they probe."""
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, x, n = part.column(0).to_numpy(), _matrix(part.column(1), plan.dim), part.num_rows
                tables = range(1 if everywhere else TABLES)
                for t in tables:
                    if everywhere and query:
                        rows, g, key = np.repeat(np.arange(n), plan.groups), np.tile(np.arange(plan.groups), n), np.zeros(n * plan.groups, np.int64)
                    elif query:
                        keys = plan.probe_keys(x, t)
                        who = np.repeat(np.arange(n), keys.shape[1])
                        salts = plan.salts(keys.ravel())
                        where = [np.unique(who[salts > s] * plan.groups + plan.group_of(keys.ravel()[salts > s], t, s) - t * plan.groups) for s in range(salts.max())]
                        both = np.unique(np.concatenate(where))
                        rows, g = both // plan.groups, both % plan.groups + t * plan.groups
                        key = np.zeros(len(rows), np.int64)
                    else:
                        keys = plan.keys(x, t)
                        salt = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % plan.salts(keys)
                        rows, g, key = np.arange(n), plan.group_of(keys, t, salt), keys.view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g), pa.array(np.full(len(rows), int(query), np.int32)), pa.array(ids[rows]), pa.array(key), part.column(1).take(pa.array(rows))], names=["g", "kind", "id", "key", "v"]
                    )

    common.importable(vectors.sparkSession)
    return vectors.select("id", "v").mapInArrow(run, f"g long, kind int, id long, key long, v {kind}")


def _search(index: DataFrame, queries: DataFrame, plan: Plan, k: int, everywhere: bool) -> DataFrame:
    """``query_id, best``: up to ``k`` structs (-score, vec_id) of each query in order."""
    met = _dealt(index, plan, False, everywhere).unionByName(_dealt(queries, plan, True, everywhere)).repartition("g").sortWithinPartitions("g", "kind")
    tops = pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group, now = None, None
        for batch in batches:
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.nonzero((np.diff(g) != 0) | (np.diff(kind) != 0))[0] + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(g)]):
                if lo == hi:
                    continue
                if g[lo] != now:
                    held, group, now = [], None, g[lo]
                ids = batch.column(2).to_numpy()[lo:hi]
                x = batch.column(4).slice(lo, hi - lo)
                if kind[lo] == 0:
                    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, plan.dim)
                    held.append((ids.copy(), batch.column(3).to_numpy()[lo:hi].view(np.uint64).copy(), flat.copy()))
                    continue
                if group is None:
                    group = Group(*(np.concatenate(c) for c in zip(*held, strict=True)), k) if held else False
                    held = []
                if not group:
                    continue
                vectors = _matrix(x, plan.dim)
                for at in range(0, len(ids), CHUNK):
                    mine, own = vectors[at : at + CHUNK], ids[at : at + CHUNK]
                    q, found, score = group.nearest(own, mine, None if everywhere else plan.probe_keys(mine, int(now) // plan.groups))
                    values = pa.StructArray.from_arrays([pa.array(-score), pa.array(found)], names=["neg", "vec_id"])
                    starts = np.searchsorted(q, np.arange(len(own) + 1)).astype("i4")
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(starts), values).cast(tops)], names=["query_id", "top"])

    found = met.mapInArrow(run, "query_id long, top array<struct<neg:double,vec_id:long>>")
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("top")))), 1, k).alias("best"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """Of each query row the ``k`` other rows of largest inner product that are found: ``query_id, rank, vec_id, score``.

    Scores are double-precision inner products of the vectors as they are; ties go to the smaller id.
    Vectors that are null, zero or not finite take no part, nor do null ids; vectors of different lengths have no
    inner product, so each meets those of its own length.  Equal rows count once, and a query never finds its
    own id.  Empty tables give no rows.  Columns not named are not read.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    common.importable(vectors.sparkSession)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("_q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    if good.schema["v"].dataType.simpleString() != "array<float>":
        good = good.withColumn("v", F.col("v").cast("array<double>"))
    # Equal rows are one before the search, where each would take a place; every pass reads what was looked at once.
    good = common.cut(good.groupBy("id", "v").agg(F.max("_q").alias("_q")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = vectors.sparkSession.createDataFrame([], schema)
    for of in good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.max("_q").alias("asked")).orderBy("dim").collect():
        if not of["asked"] or of["n"] < 2:
            continue
        index = good.filter(F.size("v") == of["dim"])
        plan = _plan(index, Plan(of["dim"], of["longest"], of["n"]), k, recall)
        queries = index.filter("_q")
        found = common.cut(_search(index, queries, plan, k, False))
        short = found.filter(F.size("best") < min(k, plan.rows - 1)).select("query_id").unionByName(queries.select(F.col("id").alias("query_id")).join(found, "query_id", "left_anti").select("query_id")).distinct()
        if not short.isEmpty():
            again = queries.join(short, F.col("id") == F.col("query_id"), "left_semi")
            found = found.join(short, "query_id", "left_anti").unionByName(_search(index, again, plan, k, True))
        out = out.unionByName(found.select("query_id", F.posexplode("best").alias("_p", "b")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score")))
    return out
