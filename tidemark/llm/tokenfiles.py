"""Token files compressed by grammar: Re-Pair over the ids of each shard, with random access.

Documents are put in the order of their ids by range partitions; each partition is encoded and cut, at document
borders, into shards of about ``BLOCK`` ids.  Within a shard frequent pairs of neighbouring ids are replaced by new
symbols again and again, each a rule of two symbols; what is stored is the sequence left, the rules, and how many ids
each rule expands to.  The lengths say where in the sequence an id stands, so a stretch is decoded without what stands
before it.  Spark's writer commits the files, so a lost executor's half-written ones never count.

A file is Parquet with a row for each shard:

``part, shard``     the range partition, and the shard's number in it
``at, n_tokens``    ids of the partition before it, and ids in it
``docs``            its documents in order: ``doc`` (the id) and ``n`` (ids, end id included)
``payload``         ``RPR1``, then little-endian unsigned 32-bit numbers: the first new symbol, the number R of rules, the
                    number of symbols; the rules' left symbols, their right symbols, their lengths; the symbols
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import common
from .packing import token_array

#: Ids of a shard, at least, unless its partition ends; a longer document is a shard of its own.
BLOCK = 1 << 20
#: Times that a pair must stand in a shard, rounds of replacing, and the share of the greatest count that is replaced in a round.
LEAST, ROUNDS, SHARE = 4, 8, 16
MAGIC = b"RPR1"
_MIX = np.int64(-7046029254386353131)


class Grammar:
    """The sequence and the rules of a shard."""

    def __init__(self, first: int, left: np.ndarray, right: np.ndarray, spans: np.ndarray, symbols: np.ndarray) -> None:
        self.first, self.left, self.right, self.spans, self.symbols = first, left, right, spans, symbols

    def to_bytes(self) -> bytes:
        head = np.array([self.first, len(self.left), len(self.symbols)], "<u4")
        return MAGIC + b"".join(x.astype("<u4").tobytes() for x in (head, self.left, self.right, self.spans, self.symbols))

    @classmethod
    def from_bytes(cls, payload: bytes) -> Grammar:
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        words = np.frombuffer(payload, "<u4", offset=4)
        first, r, n = (int(x) for x in words[:3])
        if len(words) != 3 + 3 * r + n:
            raise ValueError("a shard of token ids is torn")
        ends = 3 + np.array([0, r, 2 * r, 3 * r, 3 * r + n])
        return cls(first, *(words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)))

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), "i8")
        made = symbols >= self.first
        out[made] = self.spans[symbols[made] - self.first]
        return out

    def _unfolded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: each pass replaces all new symbols by the two of their rules."""
        seq = symbols.astype("i8")
        while (made := seq >= self.first).any():
            width = made + 1
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), "i8")
            out[at] = seq
            out[at[made]], out[at[made] + 1] = self.left[seq[made] - self.first], self.right[seq[made] - self.first]
            seq = out
        return seq.astype("<u4")

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: rules are unfolded once, and each symbol copies what its rule stands for."""
        made = symbols >= self.first
        rules = symbols[made] - self.first
        seen = np.zeros(len(self.spans), bool)
        seen[rules] = True
        used = np.flatnonzero(seen)
        spans = self.spans[used].astype("i8")
        copied = np.concatenate([self._unfolded(used + self.first), symbols.astype("<u4")])
        n, begin, at = self.lengths(symbols), np.arange(len(symbols)) + int(spans.sum()), np.zeros(len(self.spans), "i8")
        at[used] = np.cumsum(spans) - spans
        begin[made] = at[rules]
        # From one id to the next a step of one, but where a symbol begins.
        steps = np.ones(int(n.sum()), "i8")
        if len(steps):
            steps[0], steps[np.cumsum(n)[:-1]] = begin[0], begin[1:] - (begin[:-1] + n[:-1] - 1)
        return copied[np.cumsum(steps, out=steps)]

    def tokens(self, start: int = 0, length: int | None = None) -> np.ndarray:
        """``length`` ids from ``start`` on, decoding only the symbols that hold them."""
        ends = np.cumsum(self.lengths(self.symbols))
        total = int(ends[-1]) if len(ends) else 0
        start = min(max(start, 0), total)
        until = total if length is None else min(start + max(length, 0), total)
        if start >= until:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, [start, until - 1], "right")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expanded(self.symbols[a : b + 1])[skip : skip + until - start]


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs * _MIX) >> np.int64(64 - bits)) & ((1 << bits) - 1)


def re_pair(ids: np.ndarray, least: int = LEAST, rounds: int = ROUNDS, share: int = SHARE) -> Grammar:
    """The grammar of a sequence of ids.

    Each round replaces all pairs that stand at least as often as one ``share``-th of the most frequent one, ``least``
    times at any rate.  Of pairs that overlap the one further left is taken.  A table of hashed counts says which are
    too rare to be looked at.
    """
    seq = np.asarray(ids).astype("i8")
    first = made = int(seq.max()) + 1 if len(seq) else 0
    bits = min(20, max(8, len(seq).bit_length()))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    spans: list[np.ndarray] = [np.zeros(0, "i8")]
    for _ in range(rounds):
        if len(seq) < 2:
            break
        pairs = (seq[:-1] << 32) | seq[1:]
        slots = _slots(pairs, bits)
        counts = np.bincount(slots, minlength=1 << bits)
        often = max(least, int(counts.max()) // share)
        at = np.flatnonzero((counts >= often)[slots])
        found = np.sort(pairs[at])
        begins = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, "i8")
        n = np.diff(np.append(begins, len(found)))
        known = found[begins[n >= often]]
        if not len(known):
            if often == least:
                break
            share *= 4  # the greatest count was of pairs that share a slot
            continue
        # Of frequent pairs that share a slot one is taken now.
        owner = np.full(1 << bits, -1, "i4")
        owner[_slots(known, bits)] = np.arange(len(known))
        which = owner[slots[at]]
        mine = (which >= 0) & (known[which] == pairs[at])
        at, which = at[mine], which[mine]
        # Neighbouring places overlap: of each stretch of them every other one is taken.
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        taken = ((at - np.maximum.accumulate(np.where(begins, at, 0))) & 1) == 0
        at, which = at[taken], which[taken]
        kept = np.bincount(which, minlength=len(known)) > 2  # a rule that stands once or twice saves nothing
        if not kept.any():
            break
        name = np.cumsum(kept) - 1 + made
        at, which = at[kept[which]], which[kept[which]]
        a, b = known[kept] >> 32, known[kept] & 0xFFFFFFFF
        done = np.concatenate(spans)
        span = lambda s, done=done: np.where(s < first, 1, done[np.maximum(s - first, 0)] if len(done) else 1)
        left, right, spans, made = [*left, a], [*right, b], [done, span(a) + span(b)], made + int(kept.sum())
        seq[at] = name[which]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
    every = lambda x: np.concatenate(x) if x else np.zeros(0, "i8")
    return Grammar(first, every(left), every(right), np.concatenate(spans), seq)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all whole texts and write their shards to ``path``, in the order of their ids.

    Null and empty texts give the end id alone; null ids come first; rows of one id stand in the order of their
    texts' hashes, so an id with many rows is dealt over partitions, and repeated rows are written as often as they
    stand.  An empty table writes no shard.  A document of any length is whole in its shard.  Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    doc = StructType([StructField("doc", kind), StructField("n", LongType())])
    fields = StructType([
        StructField("part", IntegerType()), StructField("shard", IntegerType()), StructField("at", LongType()), StructField("n_tokens", LongType()),
        StructField("docs", ArrayType(doc)), StructField("payload", BinaryType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, at = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list = []
        n = 0

        def shut() -> pa.RecordBatch:
            nonlocal shard, at, held, names, n
            rows = [{"doc": k, "n": len(x)} for k, x in zip(names, held, strict=True)]
            payload = re_pair(np.concatenate(held)).to_bytes()
            made = [[part], [shard], [at], [n], [rows], [payload]]
            shard, at, held, names, n = shard + 1, at + n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.append(token_array(batch.column(1)[i].as_py() or "", tokenizer), np.uint32(end_id))
                held.append(ids)
                names.append(batch.column(0)[i].as_py())
                n += len(ids)
                if n >= block:
                    yield shut()
        if held:
            yield shut()
        common.release()

    common.importable(docs.sparkSession)
    order = [F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))]
    ranged = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, fields).write.mode("overwrite").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all documents before them.

    The sums over partitions go by way of the driver, as in numbering the rows of a frame: one number a partition.
    """
    made = spark.read.parquet(path)
    sums = sorted(tuple(r) for r in made.groupBy("part").agg(F.sum("n_tokens")).collect())
    before = np.cumsum([0, *(n for _, n in sums)])[:-1].tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before, strict=True)], "part int, base long")
    return made.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("at")).drop("base")


def _per_document(spark: SparkSession, path: str, id_col: str, column: str, kind: str, value: Callable[[np.ndarray], object]) -> DataFrame:
    found = shards(spark, path)
    doc = found.schema["docs"].dataType.elementType["doc"].dataType
    fields = StructType([StructField(id_col, doc), StructField("start", LongType()), StructField("n_tokens", LongType()), *spark.createDataFrame([], f"{column} {kind}").schema.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, payload = (batch.column(c)[i].as_py() for c in range(3))
                ids, at = Grammar.from_bytes(payload).tokens(), 0
                rows: list[list] = [[], [], [], []]
                for d in docs:
                    for col, v in zip(rows, (d["doc"], start + at, d["n"], value(ids[at : at + d["n"]])), strict=True):
                        col.append(v)
                    at += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow, strict=True)], schema=arrow)
        common.release()

    common.importable(spark)
    return found.select("start", "docs", "payload").mapInArrow(run, fields)


def documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files: ``id_col, start, n_tokens, ids``, the end id included."""
    return _per_document(spark, path, id_col, "ids", "array<int>", lambda ids: ids.astype("i4"))


def checksums(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files by the CRC of their ids: ``id_col, start, n_tokens, ids_crc32``."""
    return _per_document(spark, path, id_col, "ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes()))


def stretches(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Random access: for each row ``start, length`` of ``wanted``, counted over all files, the ids there (``ids``).

    A stretch is joined to the shards it touches, by the number of the block that each begins in, and only the symbols
    that hold it are decoded; what stands behind the end is left out, and a stretch wholly behind it isn't returned.
    """
    found = shards(spark, path)
    spark = found.sparkSession
    cells = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.greatest(F.col("n"), F.lit(1)) - 1) / BLOCK))).alias("cell")
    asked = wanted.select(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("n")).filter("start >= 0 AND n > 0").distinct()
    held = found.select(F.col("start"), F.col("n_tokens").alias("n"), "part", "shard").filter("n > 0")
    places = held.select("part", "shard", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"), cells)
    met = asked.select("start", "n", cells).join(places, "cell").filter("start < to AND start + n > from").select("start", "n", "part", "shard", "from").distinct()
    whole = met.join(found.select("part", "shard", "payload"), ["part", "shard"])
    fields = "start long, length long, from long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            ids = []
            for start, n, origin, payload in zip(rows["start"], rows["n"], rows["from"], rows["payload"], strict=True):
                a = max(start - origin, 0)
                ids.append(Grammar.from_bytes(payload).tokens(a, start + n - origin - a).astype("i4"))
            yield pa.RecordBatch.from_arrays([pa.array(rows["start"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["from"], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["start", "length", "from", "ids"])

    common.importable(spark)
    parts = whole.select("start", "n", "from", "payload").mapInArrow(run, fields)
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "ids"))), lambda p: p["ids"]))
    return parts.groupBy("start", "length").agg(joined.alias("ids"))
