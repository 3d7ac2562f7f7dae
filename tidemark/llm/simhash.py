"""SimHash near duplicates with bit-sliced comparison.

Fingerprints are majority bits over shingle hashes.  Copies collapse to one fingerprint, and
fingerprints are compared only within groups that every pair to be linked must share.  In a group the
bits stand in vertical planes: one machine word holds one bit of 64 fingerprints.  For a lag ``d`` the
planes against themselves shifted by ``d`` give the differing bits of 64 pairs at once; carry-save
counters that start at ``2**k - 1 - radius`` overflow where a pair exceeds the radius, and words whose
pairs have all overflowed are dropped.  A group yields the star of each of its components, not its pairs.

The near copies of the pipeline are found so too: candidates by bit-sliced fingerprints, then an exact check by whole sets.

Groups over ``LIMIT`` are dealt with exactly: first by the bits that remain, or by the sizes of sets,
then in pairs of chunks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components, own_exchange

from . import common

#: Fingerprints compared with each other in one group before it is split.
LIMIT = 2048
#: Shingles of the sets that are compared with each other in one group before it is split.
WEIGHT = 2_000_000
#: Rows sorted into groups at once by a worker, and the bytes from which on fewer are.
ROWS_AT_ONCE, BYTES_AT_ONCE = 65_536, 12_000_000
SEED = 42


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of a text, A-Z lowered, words apart by ASCII white space; the whole sequence if shorter."""
    words = text.encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [joined[s : e - 1] for s, e in zip([0, *ends[:-1]], ends[size - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(parts: list[bytes], seed: int = SEED) -> int:
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, seed) for p in parts], dtype="<u8"))


class Groups:
    """Finds the links within groups of rows sorted by group."""

    def __init__(self, group: np.ndarray, lanes: list[np.ndarray], radius: int) -> None:
        self.n = len(group)
        self.group, self.radius = group, radius
        self.words = -(-self.n // 64)
        pad = (self.words + 1) * 64 - self.n
        self.planes = []
        for lane in lanes:
            bits = np.unpackbits(np.concatenate([lane, np.zeros(pad, lane.dtype)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            self.planes.append(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8"))
        self.planes = np.concatenate(self.planes)  # bits x words

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each lag, the row indices of the pairs within the radius and in how many bits they differ."""
        lag = 0
        k = max(1, int(self.radius).bit_length())
        start = (1 << k) - 1 - self.radius
        while True:
            lag += 1
            same = np.zeros((self.words + 1) * 64, np.uint8)
            if lag >= self.n:
                return
            same[: self.n - lag] = self.group[lag:] == self.group[: self.n - lag]
            live = np.packbits(same, bitorder="little").view("<u8")[: self.words]
            at = np.nonzero(live)[0]
            if not len(at):
                return
            live = live[at]
            over, lag_words, lag_bits = np.zeros_like(live), lag // 64, np.uint64(lag % 64)
            counters = [np.full_like(live, np.uint64(0xFFFFFFFFFFFFFFFF) if start >> i & 1 else np.uint64(0)) for i in range(k)]
            for b in range(0, len(self.planes), 16):
                mine = self.planes[b : b + 16][:, at]
                hi_at = np.minimum(at + lag_words, self.words)
                theirs = self.planes[b : b + 16][:, hi_at] >> lag_bits
                if lag % 64:
                    theirs |= self.planes[b : b + 16][:, np.minimum(hi_at + 1, self.words)] << (np.uint64(64) - lag_bits)
                for x in mine ^ theirs:
                    for i in range(k):
                        carry = counters[i] & x
                        counters[i] ^= x
                        x = carry
                    over |= x
                keep = (live & ~over) != 0
                if not keep.all():
                    at, live, over = at[keep], live[keep], over[keep]
                    counters = [c[keep] for c in counters]
                    if not len(at):
                        break
            if len(at):
                hits = np.unpackbits((live & ~over).view(np.uint8), bitorder="little").reshape(len(at), 64)
                w, j = np.nonzero(hits)
                i = at[w] * 64 + j
                differ = sum((c[w] >> j.astype(np.uint64) & np.uint64(1)).astype(np.int64) << b for b, c in enumerate(counters)) - start
                yield i, i + lag, differ

    def forest(self, tree: list[tuple[int, int]] | None = None) -> np.ndarray:
        """The first row of each row's component; the pairs that join components go into ``tree``."""
        up = np.arange(self.n)
        for i, j, _ in self.links():
            apart = up[i] != up[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                if x != y:
                    up[max(x, y)] = min(x, y)
                    if tree is not None:
                        tree.append((a, b))
            while (up[up] != up).any():
                up = up[up]
        return up


def alike_forest(sets: list[np.ndarray], similarity: float, near: Iterable[tuple[int, int]] = ()) -> np.ndarray:
    """The first row of each row's component, rows being linked whose sets are that similar: exact for every input.

    ``sets`` hold distinct hashes.  Pairs that are ``near`` already, by their fingerprints, are checked first and joined if
    their sets are alike.  Then a component grows from row to row: each of its rows is held against all rows that
    are in none yet, so that rows which are linked already are not compared with each other.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    values, ids = len(values), ids.astype(np.int32)
    ends = np.cumsum(sizes)
    own = [ids[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    marked = np.zeros(values, np.int32)
    up, members = np.arange(n), [[i] for i in range(n)]
    for i, j in near:
        x, y = sorted((int(up[i]), int(up[j])))
        if x == y or not sizes[i] or not sizes[j]:
            continue
        marked[own[i]] = 1
        shared = int(marked[own[j]].sum())
        marked[own[i]] = 0
        if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
            up[members[y]] = x
            members[x] += members[y]
    root = up.copy()
    left, flat = np.flatnonzero(sizes > 0), ids  # rows in no component yet, in order, and their sets end to end
    while len(left):
        first = int(left[0])
        found = up[left] == up[first]
        todo = members[int(up[first])].copy()
        while True:
            root[left[found]] = first
            flat = flat[np.repeat(~found, sizes[left])]
            left = left[~found]
            found = np.zeros(len(left), bool)
            while todo and len(left) and not found.any():
                x = todo.pop()
                marked[own[x]] = 1
                shared = np.add.reduceat(marked[flat], np.cumsum(sizes[left]) - sizes[left])
                marked[own[x]] = 0
                found = shared >= similarity * (sizes[left] + sizes[x] - shared) - 1e-9
            if not found.any():
                break
            # What is linked brings along what its fingerprint has joined it to.
            joined = np.unique(up[left[found]])
            todo += [m for r in joined.tolist() for m in members[r]]
            found = np.isin(up[left], joined)
    return root


def _stars(rows: DataFrame, group: list[str], values: list[str], forest: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Edges ``a``, ``b`` from each node to the first one of its component within its group.

    ``forest`` gets the group and the ``values`` of rows sorted by group, and returns the first row of each row's component.
    """
    picked = rows.select(*group, "node", *values)
    dealt = picked.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            n = len(cols[0])
            new = np.zeros(n, bool)
            for c in cols[: len(group)]:
                new[1:] |= c[1:] != c[:-1]
            key = np.cumsum(new)
            many = np.bincount(key)[key] > 1
            if not many.any():
                return None
            node = cols[len(group)][many]
            root = forest(key[many], [c[many] for c in cols[len(group) + 1 :]])
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"]) if linked.any() else None

        rows_held = bytes_held = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                rows_held, bytes_held = rows_held + batch.num_rows, bytes_held + batch.nbytes
                if rows_held < ROWS_AT_ONCE and bytes_held < BYTES_AT_ONCE:
                    continue
            if not held:
                return
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            until = len(cols[0])
            if batch is not None:  # the last group may go on
                last = np.ones(until, bool)
                for c in cols[: len(group)]:
                    last &= c == c[-1]
                until = int(np.argmax(last))
            if until:
                made = solve([c[:until] for c in cols])
                if made is not None:
                    yield made
            held = [[c[until:] for c in cols]] if until < len(cols[0]) else []
            rows_held, bytes_held = len(cols[0]) - until, bytes_held * (len(cols[0]) - until) // len(cols[0])
        common.release()

    common.importable(rows.sparkSession)
    return dealt.mapInArrow(run, "a long, b long")


def _edges(rows: DataFrame, group: list[str], lanes: list[str], radius: int) -> DataFrame:
    """The stars of components of nodes whose lanes differ in at most ``radius`` bits within a group."""
    return _stars(rows, group, lanes, lambda key, cols: Groups(key, [np.ascontiguousarray(c).view("<u8") for c in cols], radius).forest())


def _alike(rows: DataFrame, group: list[str], sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """The stars of components of nodes whose whole ``sets`` (``node``, ``set``, and their fingerprint ``fp``) are that similar within a group.

    Fingerprints are compared bit-sliced first; pairs within ``radius`` are checked by their sets, which then find what no
    fingerprint did.
    """

    def forest(key: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        near: dict[int, list[tuple[int, int]]] = {}
        tree: list[tuple[int, int]] = []
        Groups(key, [np.ascontiguousarray(cols[1]).view("<u8")], radius).forest(tree)
        for i, j in tree:
            a = int(starts[np.searchsorted(starts, i, "right") - 1])
            near.setdefault(a, []).append((i - a, j - a))
        return np.concatenate([a + alike_forest([np.frombuffer(x, "<u8") for x in cols[0][a:b]], similarity, near.get(a, ())) for a, b in itertools.pairwise([*starts.tolist(), len(key)])])

    whole = sets.select(own_exchange("node").alias("k"), "set", "fp")
    met = rows.select(*group, "node").withColumn("k", own_exchange("node")).join(whole, "k")
    return _stars(met, group, ["set", "fp"], forest)


def _split(rows: DataFrame, group: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups within the limits of rows and of ``weight``, and of larger ones with the number ``m`` of chunks that are."""
    chunks = F.ceil(F.greatest(F.count("*") / max(limit // 2, 1), F.sum("weight") / (WEIGHT // 2)))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("weight").alias("w"), chunks.cast("int").alias("m")).filter((F.col("n") > limit) | (F.col("w") > WEIGHT))
    keyed = rows.withColumn("_k", own_exchange(F.xxhash64(*group)))
    hot = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], "m", own_exchange(F.xxhash64(*group)).alias("_h"))
    same = (F.col("_k") == F.col("_h")) & F.lit(True)
    for c in group:
        same &= F.col(c) == F.col(f"_{c}")
    met = keyed.join(hot, same, "left").drop("_k", "_h", *[f"_{c}" for c in group])
    return met.filter("m IS NULL").drop("m"), met.filter("m IS NOT NULL")


def _linked(rows: DataFrame, group: list[str], finer: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame, list[str]], DataFrame], limit: int) -> DataFrame:
    """Edges within groups; ``finer`` deals rows of large groups into finer ones that each linked pair still shares."""
    small, large = _split(rows, group, limit)
    large = common.cut(large)
    if large.isEmpty():
        return edges(small, group)
    fine = [*group, "s"]
    middle, hot = _split(finer(large.drop("m")), fine, limit)
    # What is still large is compared whole, chunk against chunk.
    chunk = F.pmod(F.xxhash64(F.lit(6), "node"), F.col("m")).cast("int")
    crossed = hot.withColumn("_c", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    crossed = crossed.withColumn("i", F.least("_c", "_o")).withColumn("j", F.greatest("_c", "_o"))
    return edges(small, group).unionByName(edges(middle, fine)).unionByName(edges(crossed, [*fine, "i", "j"]))


def _masks(radius: int) -> list[tuple[int, list[int]]]:
    """Bit groups for 64-bit fingerprints: any two within ``radius`` agree on one of these masks.

    Of ``radius + 2`` blocks two agree.  With each mask come finer ones: of the bits that it leaves
    ``radius + 1`` blocks, one of which agrees.
    """
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    found = []
    for two in itertools.combinations(blocks, 2):
        mask = sum(two)
        rest = [b for b in range(64) if not mask >> b & 1]
        cuts = np.linspace(0, len(rest), radius + 2).round().astype(int)
        found.append((mask, [mask | sum(1 << b for b in rest[lo:hi]) for lo, hi in itertools.pairwise(cuts)]))
    return found


def link_fingerprints(fps: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """Components of distinct 64-bit fingerprints (column ``fp``, bigint) linked at ``radius`` or fewer differing bits.

    Returns ``node``, ``root`` for those that are not alone or first; exact for every input.
    """
    masks = _masks(radius)
    coarse = F.array(*[F.lit(signed(m)) for m, _ in masks])
    fine = F.array(*[F.array(*[F.lit(signed(x)) for x in xs]) for _, xs in masks])
    rows = fps.select(F.col("fp").alias("node"), F.col("fp").alias("f0"), F.posexplode(coarse).alias("t", "m")).withColumn("g", F.col("f0").bitwiseAND(F.col("m"))).drop("m").withColumn("weight", F.lit(0).cast("long"))

    def finer(large: DataFrame) -> DataFrame:
        dealt = large.select("*", F.posexplode(F.element_at(fine, F.col("t") + 1)).alias("u", "m"))
        return dealt.withColumn("s", F.xxhash64("u", F.col("f0").bitwiseAND(F.col("m")))).drop("u", "m")

    return components(_linked(rows, ["t", "g"], finer, lambda part, group: _edges(part, group, ["f0"], radius), limit))


def simhash_components(df: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row: ``id_col, fingerprint, component_id``.

    Null texts count as empty; texts without words have fingerprint zero and are linked like any other.
    Equal fingerprints are linked, so repeated rows share a component.  The component's id is the least id
    in it (null only if all are).  An empty table gives an empty result.
    """

    def fn(cols: list[list]) -> dict:
        return {id_col: cols[0], "fp": [signed(fingerprint(shingles(t or "", size))) for t in cols[1]]}

    made = common.cut(common.map_rows(df.select(F.col(id_col).cast("long").alias(id_col), text_col), [id_col, text_col], fn, f"{id_col} long, fp long"))
    least = common.cut(made.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = link_fingerprints(least.select("fp"), radius)
    rooted = least.withColumn("k", own_exchange("fp")).join(roots.select(own_exchange("node").alias("k"), "root"), "k", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.withColumn("k", own_exchange("root")).join(named.select(own_exchange("root").alias("k"), "component_id"), "k").select(own_exchange("fp").alias("k"), "component_id")
    out = made.withColumn("k", own_exchange("fp")).join(by_fp, "k")
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: words of a shingle, the similarity of shingle sets, keys that a document is grouped by, and the bits by which fingerprints of candidates differ at most.
WORDS, SIMILARITY, KEYS, RADIUS = 5, 0.8, 10, 8


def size_class(n: int, similarity: float) -> int:
    """Sets of that similarity are in the same class or in neighbouring ones."""
    return n if similarity >= 1 or n < 1 else int(math.log(n) / -math.log(similarity) + 1e-9)


def _grouped(texts: DataFrame) -> DataFrame:
    """Texts (``node``, ``class``, ``keys``) by each key ``g`` that two or more of like size share; of keys that the same texts share one stays.

    Sets that are alike are of one class of sizes or of neighbouring ones, so texts that no other text of a key comes
    near in size need not be compared there.  What texts share a key is told by their number and 128 bits of hash, so
    that copies, which share most of their keys, are compared in one group and not in one for each key.
    """
    keyed = texts.select("node", "class", "weight", F.explode("keys").alias("g"))
    many = keyed.groupBy("g", "class").agg(F.count("*").alias("n"))
    near = many.select("g", F.explode(F.array(*[F.struct((F.col("class") + d).alias("class"), F.col("n"), F.lit(d == 0).alias("own")) for d in (0, -1, 1)])).alias("x")).select("g", "x.*")
    met = near.groupBy("g", "class").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own")).filter("own AND n > 1").select(own_exchange("g").alias("k"), F.col("class").alias("_class"))
    shared = keyed.withColumn("k", own_exchange("g")).join(met.withColumnRenamed("k", "_k"), (F.col("k") == F.col("_k")) & (F.col("class") == F.col("_class")), "left_semi")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (1, 2)]
    shared = common.cut(shared.select("node", "class", "weight", "g"))
    kept = shared.groupBy("g").agg(F.count("*").alias("n"), *marks).groupBy("n", "x1", "x2").agg(F.min("g").alias("g"))
    return common.cut(shared.withColumn("k", own_exchange("g")).join(kept.select(own_exchange("g").alias("k")), "k", "left_semi").drop("k"))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Groups of exact and near copies: ``r1, r2, id, root`` for every row, ``r1`` and ``r2`` being ``row_key()``.

    Texts that share one of the ``KEYS`` least hashes of their shingles are compared by their fingerprints, majority bits over
    all their shingles, in bit-sliced planes; those within ``radius`` bits are checked by their whole sets of shingles.  An
    exact comparison of whole sets follows for all that is not joined by then; sets of ``similarity`` or more link.  At 0.8 and ten keys no pair of sets of up to
    49 shingles is missed; of larger ones at 0.8 exactly 6 in ten thousand million have no key in common if each side has
    as many shingles of its own, and 1 in ten million if one set holds the other.
    Texts with the same words are one node, so copies are compared once; texts without words,
    null ones too, form one group.  Rows and texts are told apart by 128 bits of hash.  An empty table gives an empty result.
    """

    def hashes(text: str | None) -> np.ndarray:
        return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in set(shingles(text or "", words))], dtype="<u8"))

    def fn(cols: list[list]) -> dict:
        out: dict = {"t1": [], "t2": [], "keys": [], "class": [], "weight": []}
        for t in cols[0]:
            made = hashes(t)
            for n, v in zip(("t1", "t2"), text_key(t), strict=True):
                out[n].append(v)
            out["keys"].append([signed(int(x)) for x in made[:KEYS]])
            out["class"].append(size_class(len(made), similarity))
            out["weight"].append(len(made))
        return out

    def whole(cols: list[list]) -> dict:
        made = [hashes(t) for t in cols[0]]
        return {"set": [x.tobytes() for x in made], "fp": [signed(majority(x)) for x in made]}

    source = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    made = common.cut(common.map_rows(source, ["_t"], fn, "t1 long, t2 long, keys array<long>, class long, weight long", ("r1", "r2", "id")))
    texts = made.groupBy("t1", "t2").agg(F.first("keys").alias("keys"), F.first("class").alias("class"), F.first("weight").alias("weight"), F.min(F.struct("r1", "r2")).alias("row"))
    texts = common.cut(texts.withColumn("node", F.monotonically_increasing_id()))
    rows = _grouped(texts)
    # Only texts that share a key are read again.
    compared = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("row.r1").alias("r1"), F.col("row.r2").alias("r2"))
    again = source.join(compared, ["r1", "r2"]).select("r1", "r2", "node", "_t").dropDuplicates(["r1", "r2"])
    sets = common.cut(common.map_rows(again, ["_t"], whole, "set binary, fp long", ("node",)))

    def finer(large: DataFrame) -> DataFrame:
        return large.select("*", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("s"))

    roots = components(_linked(rows, ["g"], finer, lambda part, group: _alike(part, group, sets, similarity, radius), limit))
    rooted = texts.select("t1", "t2", "node").join(roots, "node", "left").select(own_exchange("t1").alias("k"), F.col("t2").alias("_t2"), F.coalesce("root", "node").alias("root"))
    found = made.select("r1", "r2", "id", "t1", "t2").withColumn("k", own_exchange("t1")).join(rooted, ["k"]).filter("t2 = _t2")
    return found.select("r1", "r2", "id", "root")


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of exact and near copies, that of least id; all columns stay, whatever their names.

    Null ids come after others; of rows with the same id and text one stays.  Null texts and texts without words
    are copies of each other.  An empty table stays empty.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*plain)
    id_at, text_at = plain[docs.columns.index(id_col)], plain[docs.columns.index(text_col)]
    found = common.cut(near_copies(renamed, words, similarity, id_col=id_at, text_col=text_at))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("r1"), F.col("r2"))
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    met = found.withColumn("k", own_exchange("root")).join(first.select(own_exchange("root").alias("k"), "first"), "k")
    losers = met.filter((F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2"))).select("r1", "r2").distinct()
    keyed = renamed.select("*", *row_key(id_at, text_at))
    kept = keyed.join(losers, ["r1", "r2"], "left_anti")
    twice = common.cut(found.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not twice.isEmpty():
        kept = kept.join(twice, ["r1", "r2"], "left_anti").unionByName(kept.join(twice, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]))
    return kept.select(*plain).toDF(*docs.columns)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of hash of a row's id and text, as ``r1`` and ``r2``."""
    return [F.xxhash64(F.lit(i), F.col(id_col), F.col(text_col)).alias(f"r{i}") for i in (1, 2)]


def text_key(text: str | None) -> tuple[int, int]:
    """128 bits of hash of a text's words as shingles see them."""
    made = xxhash.xxh3_128_intdigest(b" ".join((text or "").encode().lower().split()), 7)
    return signed(made >> 64), signed(made & (1 << 64) - 1)
