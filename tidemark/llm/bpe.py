"""BPE encoding and decoding through a tokenization automaton.

The merge list is compiled, merge by merge, into a deterministic automaton over *tokens* whose
accepted token sequences are exactly the ones that BPE produces.  It starts as one state with a
self-loop for each byte.  The gadget of a merge ``(a, b) -> c``

* gives ``a`` a target state of its own, a copy of its former one without the arc ``b`` (an ``a`` can
  no longer stand before a ``b``), and
* adds an arc ``c`` to every state that has an arc ``a``, leading where ``b`` led.

All arcs of one label lead to one state, so a state is named by its label and holds a link to the
state it was copied from plus the arc cut out of it.  An arc ``y`` leaves the state of ``x`` unless one
of the gadgets cut it: a gadget ``(x', y')`` did so if ``x'`` is ``x`` or a state that ``x`` was copied from
after the cut, and ``y'`` is ``y`` or the first part that ``y`` got its arcs from after the cut.  Arcs are
tabulated when first asked for.

Encoding follows the automaton over a pre-split word from left to right.  Because every prefix has
exactly one accepted sequence, one label for each byte offset suffices.  Decoding emits the byte
strings on the arcs.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from . import common

# The public byte-level pre-split pattern, and the rule of its byte alphabet.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Words and arcs held at once by a worker; both tables start anew when full.
WORD_CACHE = 600_000
ARC_CACHE = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(other)}


class Automaton:
    """The compiled merges of one tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int]) -> None:
        alphabet = byte_alphabet()
        spelled = lambda s: bytes(alphabet[c] for c in s)
        top = max([*vocab.values(), *special.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * top
        for s, i in vocab.items():
            self.labels[i] = spelled(s)
        for s, i in special.items():
            self.labels[i] = s.encode()
        never = len(merges)
        self.copied_from = [-1] * top  # the state that a label's state was copied from
        self.first = [-1] * top  # the label that a label got its arcs from
        self.made = [-1] * top  # the merge whose gadget made the label
        self.cuts: dict[int, int] = {}  # (a, b) -> the merge whose gadget cut arc b from the state of a
        self.width = top
        words: dict[bytes, int] = {}
        for s, i in vocab.items():
            if len(self.labels[i]) == 1:
                words[self.labels[i]] = i
        for rank, m in enumerate(merges):
            left, right = m if isinstance(m, (list, tuple)) else m.split(" ", 1)
            self._gadget(vocab[left], vocab[right], vocab[left + right], rank)
            words[self.labels[vocab[left + right]]] = vocab[left + right]
        self.never = never
        self.special = dict(special)
        self.arcs: dict[int, dict[int, bool]] = {}  # tabulated arcs of a label's state
        self.tabulated = 0
        self.trie: dict = {}  # labels byte by byte; the label itself under -1
        for w, i in words.items():
            node = self.trie
            for b in w:
                node = node.setdefault(b, {})
            node[-1] = i

    def _gadget(self, a: int, b: int, c: int, rank: int) -> None:
        if self.made[c] >= 0:
            return
        self.cuts[a * self.width + b] = rank
        self.copied_from[c], self.first[c], self.made[c] = b, a, rank

    def arc(self, x: int, y: int) -> bool:
        """Whether the state of label ``x`` has an arc ``y``; tabulated for the next time."""
        if self.tabulated >= ARC_CACHE:
            self.arcs.clear()
            self.tabulated = 0
        self.tabulated += 1
        known = self.arcs.setdefault(x, {})[y] = self._tabulate(x, y)
        return known

    def _tabulate(self, x: int, y: int) -> bool:
        cuts, width = self.cuts, self.width
        until_x = self.never
        while x >= 0:
            part, until_y = y, self.never
            while part >= 0:
                when = cuts.get(x * width + part, self.never)
                # A gadget cuts before it adds arcs, so of its own cut (a == b) the new label knows.
                if when < until_x and when <= until_y:
                    return False
                until_y = min(until_y, self.made[part]) if self.made[part] >= 0 else until_y
                part = self.first[part]
            until_x = min(until_x, self.made[x]) if self.made[x] >= 0 else until_x
            x = self.copied_from[x]
        return True

    def word(self, w: bytes) -> list[int]:
        """The labels along the accepted path that spells ``w``."""
        n = len(w)
        last = [-1] * (n + 1)
        trie, rows = self.trie, self.arcs
        node = trie
        for j in range(n):
            node = node.get(w[j])
            if node is None:
                break
            y = node.get(-1)
            if y is not None:
                last[j + 1] = y
        for i in range(1, n):
            x = last[i]
            if x < 0:
                continue
            row, node, j = rows.get(x) or rows.setdefault(x, {}), trie, i
            while j < n:
                node = node.get(w[j])
                if node is None:
                    break
                j += 1
                if last[j] < 0:
                    y = node.get(-1)
                    if y is not None:
                        ok = row.get(y)
                        if ok is None:
                            ok = self.arc(x, y)
                            row = rows[x]
                        if ok:
                            last[j] = y
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        out.reverse()
        return out


def read_spec(path: str) -> dict:
    """A tokenizer file of the kind that this module encodes as its library does; any other is refused.

    That is byte-level BPE with the public pre-split pattern, without normalizer, prefix space, dropout or the like, and
    with added tokens that are found as they stand.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = [n for n in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(n)]
    odd += [f"pre_tokenizer.{n}" for n, v in plain.items() if split.get(n, True if n == "use_regex" else None) != v]
    odd += [n for n in ("normalizer",) if spec.get(n)] + [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(n) for n in ("single_word", "lstrip", "rstrip"))]
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        odd.append("decoder")
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer: {', '.join(odd) or model.get('type')}")
    return spec


class Codec:
    """Encodes whole texts to little-endian unsigned 32-bit ids and back."""

    def __init__(self, path: str) -> None:
        spec = read_spec(path)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = Automaton(spec["model"]["vocab"], spec["model"]["merges"], special)
        self.find = regex.compile(SPLIT).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        automaton = self.automaton

        class Words(dict):
            def __missing__(self, w: str) -> bytes:
                if len(self) >= WORD_CACHE:
                    self.clear()
                ids = np.array(automaton.word(w.encode()), dtype="<u4").tobytes()
                if len(w) <= 64:
                    self[w] = ids
                return ids

        self.words = Words()

    def encode(self, text: str) -> bytes:
        special = self.automaton.special
        if self.special_split and any(s in text for s in special):
            parts = self.special_split.split(text)
            return b"".join(np.array([special[p]], dtype="<u4").tobytes() if p in special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> str:
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each tokenizer file and worker."""
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: ``id_col``, ``ids array<int>``.

    Null texts count as empty and give no ids.  Repeated rows give repeated results; other columns
    are not read.  An empty table gives an empty table.  Texts of any length are taken whole.
    """

    def fn(cols: list[list]) -> dict:
        enc = codec(path).encode
        return {id_col: cols[0], "ids": [np.frombuffer(enc(t or ""), dtype="<u4").astype("i4") for t in cols[1]]}

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_rows(df, [id_col, text_col], fn, f"{id_col} {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode id lists by emitting arc labels: ``id_col``, ``text``.

    Null lists and null ids count as none.  Repeated rows give repeated results; an empty table gives an empty table;
    lists of any length are taken whole; other columns are not read.
    """

    def fn(cols: list[list]) -> dict:
        dec = codec(path).decode
        return {id_col: cols[0], "text": [dec(np.array([i for i in x or [] if i is not None], dtype="<u4").tobytes()) for x in cols[1]]}

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_rows(df, [id_col, ids_col], fn, f"{id_col} {kind}, text string")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Null texts count as empty.  The ids never leave the worker, which keeps the result narrow.
    """

    def fn(cols: list[list]) -> dict:
        c = codec(path)
        out: dict = {id_col: cols[0], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in cols[1]:
            ids = c.encode(t or "")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_rows(df, [id_col, text_col], fn, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
