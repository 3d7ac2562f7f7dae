"""Best-fit packing of documents into fixed-length sequences, improved by local search.

Each document becomes its ids followed by an end id; only documents longer than a sequence are cut,
into full pieces after a first piece that takes the remainder.  Full pieces fill a sequence each and are
numbered where they are made.  The other pieces are dealt evenly by a hash over partitions and packed
there in blocks of a fixed number of pieces: best fit by falling length gives a start, then local search
exchanges one piece for one, two for one, or moves one between underfull bins whenever the sum of
squared fills rises, until no exchange helps.  A block wastes about one sequence at most beyond
what its lengths force, whatever the number of blocks.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import SPLIT, byte_alphabet, codec, read_spec

#: Tokens of a sequence, and pieces packed together.
SEQUENCE, BLOCK = 2048, 65_536
#: Runs on which the fast encoder recurses or takes time by their square.
LONG_RUN = re.compile(r"\s{2000}|\S{2000}")
#: Rounds of local search over the underfull bins of a block.
ROUNDS = 20

PIECES = "piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, tuple[str, ...]]:
    """A fast encoder with the merges of a byte-level tokenizer file (tests hold it against the file's own library)."""
    spec = read_spec(path)
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` is found.  A run would hold a whole block of 1,000, so only texts with a block of one word or none are searched."""
    blocks = (text[i : i + 1000] for i in range(0, len(text) - 999, 1000))
    return len(text) >= 2000 and any(len(b.split(None, 1)) < 2 for b in blocks) and LONG_RUN.search(text) is not None


def token_ids(text: str, path: str) -> list[int]:
    """The ids of a text of any length; the automaton takes texts with runs that the fast encoder has no room for."""
    if long_run(text):
        return np.frombuffer(codec(path).encode(text), "<u4").tolist()
    enc, special = encoder(path)
    return enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)


def token_array(text: str, path: str) -> np.ndarray:
    """``token_ids`` as an array, without a list between."""
    enc, special = encoder(path)
    if long_run(text):
        return np.frombuffer(codec(path).encode(text), "<u4")
    return enc.encode_to_numpy(text, allowed_special="all" if any(s in text for s in special) else set(), disallowed_special=())


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: each piece by falling length goes where the least room remains."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: a bin has room r
    for i in order:
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, k = size, len(bins)
            bins.append([])
        bins[k].append(i)
        if room > n:
            by_room[room - n].append(k)
            open_rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int, rounds: int = ROUNDS) -> list[list[int]]:
    """Exchange pieces between underfull bins while squared fill rises; empty bins go.

    A fuller bin takes from an emptier one: a piece for none (move), a longer for a shorter one, or two
    for one.  Each raises the sum of squared fills, so the search ends.  Bins to take from are looked up
    by piece length, not tried one by one.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = {k for k in range(len(bins)) if 0 < fill[k] < size}
    if len(under) < 2:
        return [b for b in bins if b]
    held: dict[int, set[int]] = defaultdict(set)  # piece length -> underfull bins that hold one
    for k in under:
        for i in bins[k]:
            held[lengths[i]].add(k)
    known = sorted(held)

    def take(k: int, n: int) -> int:
        at = next(x for x, i in enumerate(bins[k]) if lengths[i] == n)
        i = bins[k].pop(at)
        fill[k] -= n
        if not any(lengths[x] == n for x in bins[k]):
            held[n].discard(k)
        return i

    def put(k: int, i: int) -> None:
        bins[k].append(i)
        fill[k] += lengths[i]
        if lengths[i] not in held or not held[lengths[i]]:
            at = bisect_left(known, lengths[i])
            if at == len(known) or known[at] != lengths[i]:
                insort(known, lengths[i])
        held[lengths[i]].add(k)

    def donor(k: int, n: int) -> int | None:
        """An emptier bin with a piece of length ``n``; of a few looked at, the emptiest."""
        found, looked = None, 0
        for d in held[n]:
            if d != k and fill[d] <= fill[k] and fill[d] < size and (found is None or fill[d] < fill[found]):
                found = d
            looked += 1
            if looked >= 32:
                break
        return found

    def improve(k: int) -> bool:
        room = size - fill[k]
        for n in reversed(known[: bisect_right(known, room)]):  # move
            d = donor(k, n)
            if d is not None:
                put(k, take(d, n))
                return True
        for x in sorted({lengths[i] for i in bins[k]}):  # one for one: the longest gain first
            for n in reversed(known[bisect_right(known, x) : bisect_right(known, x + room)]):
                d = donor(k, n)
                if d is not None:
                    i, j = take(k, x), take(d, n)
                    put(k, j)
                    put(d, i)
                    return True
        for x in sorted({lengths[i] for i in bins[k]}):  # two for one
            lowest, highest = bisect_right(known, x // 2), bisect_right(known, x + room)
            for n in reversed(known[lowest:highest]):
                d = donor(k, n)
                if d is None:
                    continue
                rest = sorted(lengths[i] for i in bins[d])
                rest.remove(n)
                at = bisect_right(rest, x + room - n) - 1
                if at >= 0 and n + rest[at] > x:
                    i, j, m = take(k, x), take(d, n), take(d, rest[at])
                    put(k, j)
                    put(k, m)
                    put(d, i)
                    return True
        return False

    for _ in range(rounds):
        changed = False
        for k in sorted(under, key=lambda k: -fill[k]):
            while 0 < fill[k] < size and improve(k):
                changed = True
        under = {k for k in under if 0 < fill[k] < size}
        if not changed or len(under) < 2:
            break
    return [b for b in bins if b]


def pieces(df: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every whole text, with the length and CRC of their ids.

    Null and empty texts give the end id alone, repeated rows repeated pieces, an empty table none; texts of any
    length are taken whole; other columns are not read.
    """

    def fn(cols: list[list]) -> dict:
        out: dict = {n: [] for n in (id_col, "piece", "start", "length", "ids_crc32")}
        for key, text in zip(*cols, strict=True):
            ids = np.array([*token_ids(text or "", path), end_id], dtype="<u4")
            at, k = 0, 0
            until = len(ids) % size or min(size, len(ids))
            while at < len(ids):
                for n, v in zip(out, (key, k, at, until - at, zlib.crc32(ids[at:until].tobytes())), strict=True):
                    out[n].append(v)
                at, until, k = until, until + size, k + 1
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_rows(df, [id_col, text_col], fn, f"{id_col} {kind}, {PIECES}")


def pack(df: DataFrame, path: str, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Pack all texts: per piece ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts give one piece that holds the end id alone.  Repeated rows are packed as often as
    they stand.  An empty table gives an empty result.  Only the narrow piece rows are shuffled.
    """
    made = pieces(df, path, end_id, size, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {PIECES}, sequence_id long, offset long"
    mixed = F.xxhash64(F.lit(20), id_col, "piece")
    ready = made.repartition(mixed).sortWithinPartitions(mixed, id_col, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        made_bins, waiting, rows = 0, [], 0

        def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made_bins
            lengths = batch.column(3).to_pylist()
            full = [[i] for i, n in enumerate(lengths) if n >= size]
            part = [i for i, n in enumerate(lengths) if n < size]
            sizes = [lengths[i] for i in part]
            bins = full + [[part[i] for i in b] for b in local_search(best_fit(sizes, size), sizes, size)]
            seq, off = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
            for k, b in enumerate(bins):
                at = 0
                for i in b:
                    seq[i], off[i] = first + made_bins + k, at
                    at += lengths[i]
            made_bins += len(bins)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], names=[*batch.schema.names, "sequence_id", "offset"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=1 << 31)[0]

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - rows)
                waiting.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == block:
                    yield packed(joined())
                    waiting, rows = [], 0
        if rows:
            yield packed(joined())

    common.importable(df.sparkSession)
    return ready.mapInArrow(run, schema)
