"""Encoding texts with a public byte-level BPE vocabulary through a pair occurrence index.

Texts of a partition are gathered into chunks. The distinct pre-tokens of a chunk lie one after another in one array of
symbols, with a separator between them, linked to their neighbours. An index maps each pair, named by the rank of its
merge, to all its positions in the chunk. Active ranks are applied in ascending order, each to all its positions at once;
a merge changes only the pairs to its left and right, whose index entries are updated. A merged pair can only take part in
merges of a higher rank, so one ascending pass gives each pre-token exactly its own BPE encoding.

The index is kept by blocks of ranks: an entry of a later block is only the rank stored at its position, and the lists of
positions of a block are made when the pass reaches it.
"""

from __future__ import annotations

import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every executor.
TOKENIZERS = "/opt/tokenizers"

#: The public pre-token pattern of byte-level BPE vocabularies.
PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Bytes of text that are encoded together, bounding the memory of a task whatever the partition's size.
CHUNK = 6_000_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """Letters of a vocabulary file to bytes: printable Latin-1 stands for itself, the rest for 256 upwards in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a vocabulary as arrays: by rank, and by token the merges it begins or ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        self.size = max(ids.values()) + 1
        self.sep = self.size
        letters = byte_letters()
        self.byte_id = np.zeros(256, np.int32)
        for x, b in letters.items():
            self.byte_id[b] = ids[x]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int32)
        right = np.array([ids[b] for _, b in pairs], np.int32)
        self.n, self.left, self.right = len(pairs), left, right
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.same = left == right
        self.begins, self.ends = self._by(left, right), self._by(right, left)
        self.first = np.full((257, 257), NONE, np.int32)
        byte_of = np.full(self.size + 1, -1, np.int32)
        byte_of[self.byte_id] = np.arange(256)
        both = (byte_of[left] >= 0) & (byte_of[right] >= 0)
        self.first[byte_of[left[both]], byte_of[right[both]]] = np.flatnonzero(both)
        self.scratch = np.full(self.size + 1, NONE, np.int32)
        self.blocks = [min(64, self.n)]
        while self.blocks[-1] < self.n:
            self.blocks.append(min(self.n, self.blocks[-1] + max(64, self.blocks[-1] // 8)))

    def _by(self, key: np.ndarray, other: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(key, kind="stable")
        ks, starts = np.unique(key[order], return_index=True)
        return {int(k): (other[part], part.astype(np.int32)) for k, part in zip(ks, np.split(order, starts[1:]))}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum()) + len(words) + 1
        raw = np.full(n, 256, np.int32)
        # a separator before each word and one at the end
        at = np.ones(n, bool)
        seps = np.concatenate(([0], np.cumsum(lens + 1)))
        at[seps] = False
        raw[at] = np.frombuffer(b"".join(words), np.uint8)
        sym = np.append(self.byte_id, np.int32(self.sep))[raw]
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        del raw, at
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        alive = np.ones(n, bool)
        for hi in self.blocks:
            own = np.flatnonzero(rank < hi).astype(np.int32)
            if len(own):
                self._block(hi, own, sym, rank, nxt, prv, alive)
        ids = sym[alive]
        ends = np.flatnonzero(ids == self.sep)
        return ids[ids != self.sep], np.diff(ends) - 1

    def _block(self, hi: int, own: np.ndarray, sym: np.ndarray, rank: np.ndarray, nxt: np.ndarray, prv: np.ndarray, alive: np.ndarray) -> None:
        r = rank[own]
        order = np.argsort(r, kind="stable")
        own, r = own[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        heads = r[np.concatenate(([0], cuts))].tolist()
        index: dict[int, list[np.ndarray]] = {k: [p] for k, p in zip(heads, np.split(own, cuts))}
        heap = list(index)
        heapq.heapify(heap)
        scratch = self.scratch
        while heap:
            k = heapq.heappop(heap)
            lists = index.pop(k)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[rank[p] == k]  # entries that another merge has changed since
            if self.same[k] and len(p) > 1:
                p = self._apart(p, nxt)
            if not len(p):
                continue
            new = int(self.merged[k])
            q = nxt[p]
            after = nxt[q]
            sym[p] = new
            alive[q] = False
            rank[q] = NONE
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            for table, near, at in ((self.begins, after, p), (self.ends, before, before)):
                got = table.get(new)
                if got is None:
                    rank[at] = NONE
                    continue
                scratch[got[0]] = got[1]
                nr = scratch[sym[near]]
                scratch[got[0]] = NONE
                rank[at] = nr
                low = nr < hi
                if low.any():
                    at, nr = at[low], nr[low]
                    for x in np.unique(nr).tolist():
                        if x in index:
                            index[x].append(at[nr == x])
                        else:
                            index[x] = [at[nr == x]]
                            heapq.heappush(heap, x)

    @staticmethod
    def _apart(p: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of pairs of one symbol with itself, every second one of a run from its left."""
        starts = np.ones(len(p), bool)
        starts[1:] = nxt[p[:-1]] != p[1:]
        i = np.arange(len(p))
        first = np.maximum.accumulate(np.where(starts, i, 0))
        return p[(i - first) % 2 == 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of ids of each text)."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    of, n_words = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = PATTERN.findall(t)
        n_words[i] = len(w)
        of.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    if not number:
        return np.zeros(0, np.int32), n_words
    ids, per = v.encode_words([w.encode() for w in number])
    return gather(np.concatenate(of), n_words, ids, per)


def gather(word: np.ndarray, n_words: np.ndarray, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of words from the ids of the distinct ones."""
    starts = np.concatenate(([0], np.cumsum(per)[:-1]))
    lens = per[word]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    pos = np.arange(total) + np.repeat(starts[word] - (ends - lens), lens)
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_words)))]
    return ids[pos], np.diff(bounds)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes, from smaller and larger ones."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(b.num_rows, b.num_rows * size // max(1, b.nbytes)))
        for s in range(0, b.num_rows, step):
            part = b.slice(s, step)
            held.append(part)
            n += b.nbytes * part.num_rows // b.num_rows
            if n >= size:
                yield joined(held)
                held, n = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    return t.to_batches(max_chunksize=t.num_rows)[0]


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, counts_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """`key`, the columns of `carry` and ids array<int> of each text without special tokens, or n_tokens with counts_only.

    Null and empty texts keep their row with an empty list (n_tokens 0). Marker-like strings are ordinary text. Repeated
    rows stay repeated. Other columns are ignored, whatever their names. No shuffle; a text of any length is encoded whole.
    """
    path = os.path.join(folder, tokenizer)
    kinds = dict(df.dtypes)
    out = "n_tokens" if counts_only else "ids"
    keys = (key, *carry)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{out} {'bigint' if counts_only else 'array<int>'}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in chunks(batches, CHUNK):
            ids, n = encode_texts(v, [t or "" for t in b.column(len(keys)).to_pylist()])
            if counts_only:
                got: pa.Array = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*keys, out])
                continue
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            got = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            for s in range(0, b.num_rows, 2000):
                yield pa.RecordBatch.from_arrays([c.slice(s, 2000) for c in (*b.columns[:-1], got)], [*keys, out])

    cols: list[Column] = [F.col(f"`{k}`") for k in keys]
    return df.select(*cols, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
