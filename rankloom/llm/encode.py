"""Encoding a whole corpus with a public byte-level BPE tokenizer (problem 6).

Method: merge replay over a corpus slice. Texts are cut into words by the
tokenizer's own pattern; every distinct word of the slice is laid out once as a chain
of byte symbols; an inverted index leads from each adjacent symbol pair to the
positions where it stands; the merges are then applied in rank order, each one to all
of its positions at once, and only the two neighbours of a merged position are
looked up again and put under their new pair. A slice is what one task
reads, cut at a bound on symbols, so nothing is shuffled and memory stays bounded.

Words are independent of each other, so replaying slices instead of one global
vocabulary gives the same ids and saves shuffling every token of the corpus twice.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import ship

TOKENIZER = "byte_bpe_50k"
TOKENIZER_DIR = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the word pattern of byte_bpe_50k.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(-1)
SLICE_SYMBOLS = 1_500_000
SLICE_CHARS = 6_000_000
CACHE_WORDS = 300_000
CACHE_WORD_BYTES = 24


def printable_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as character -> byte.

    Bytes that print stand for themselves; the others take code points from 256 on, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """The merges of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, byte_ids: np.ndarray, codes: np.ndarray, ranks: np.ndarray, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.byte_ids, self.codes, self.ranks = byte_ids, codes, ranks
        self.left, self.right, self.made = left, right, made

    @classmethod
    def from_file(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        byte_ids = np.zeros(256, dtype=np.int32)
        for ch, b in printable_bytes().items():
            byte_ids[b] = vocab[ch]
        born = {int(t): r for r, t in enumerate(made)}
        if any(max(born.get(int(a), -1), born.get(int(b), -1)) >= r for r, (a, b) in enumerate(zip(left, right, strict=True))):
            raise ValueError("a merge uses a token that a later merge makes; replay in rank order would not be exact")
        codes = left << 20 | right
        order = np.argsort(codes)
        return cls(byte_ids, codes[order], order.astype(np.int32), left.astype(np.int32), right.astype(np.int32), made.astype(np.int32))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair (a, b); -1 where there is none."""
        want = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.codes, want)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == want, self.ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(sizes.sum())
        if n == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        token = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        ends = ends[sizes > 0]
        after[ends - 1] = NONE
        before[ends[:-1]] = NONE
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def post(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Enter positions in the inverted index under the rank of their pair."""
            keep = ranks >= 0
            positions, ranks = positions[keep], ranks[keep]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(queue, rank)

        at = np.flatnonzero(after >= 0).astype(np.int32)
        post(at, self.rank_of(token[at], token[after[at]]))
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank)
            pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            nxt = after[pos]
            ok = alive[pos] & (token[pos] == a) & (nxt >= 0)
            ok[ok] = token[nxt[ok]] == b
            pos, nxt = pos[ok], nxt[ok]
            if a == b and len(pos) > 1:
                # In a run of one symbol, pairs are taken from the left without overlap.
                chained = np.concatenate(([False], nxt[:-1] == pos[1:]))
                place = np.arange(len(pos))
                start = np.maximum.accumulate(np.where(chained, 0, place))
                free = (place - start) % 2 == 0
                pos, nxt = pos[free], nxt[free]
            if not len(pos):
                continue
            alive[nxt] = False
            token[pos] = new
            far = after[nxt]
            after[pos] = far
            joined = far >= 0
            before[far[joined]] = pos[joined]
            lead = before[pos]
            lead = lead[lead >= 0]
            touched = np.concatenate((lead, pos[joined]))
            if len(touched):
                post(touched, self.rank_of(token[touched], token[after[touched]]))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        counts = np.zeros(len(words), dtype=np.int64)
        filled = sizes > 0
        counts[filled] = np.add.reduceat(alive.astype(np.int64), starts[filled])
        return token[alive], counts


class CorpusEncoder:
    """Encodes texts slice by slice; short words are remembered between slices up to a bound."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.find = regex.compile(WORD_PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts: all ids, and the number of ids of each of its texts."""
        known, new, refs, sizes, symbols, chars = self.seen, [], [], [], 0, 0
        for text in texts:
            words = self.find(text) if text else ()
            sizes.append(len(words))
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(self.count) + len(new)
                    new.append(w.encode("utf-8", "replace"))
                    symbols += len(new[-1])
                refs.append(i)
            chars += len(text) if text else 0
            if symbols >= SLICE_SYMBOLS or chars >= SLICE_CHARS:
                yield self._flush(new, refs, sizes)
                known, new, refs, sizes, symbols, chars = self.seen, [], [], [], 0, 0
        if sizes:
            yield self._flush(new, refs, sizes)

    def _flush(self, new: list[bytes], refs: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if new:
            ids, count = self.table.replay(new)
            start = len(self.flat) + np.concatenate(([0], np.cumsum(count)[:-1]))
            self.flat = np.concatenate((self.flat, ids))
            self.start = np.concatenate((self.start, start))
            self.count = np.concatenate((self.count, count))
        ref = np.array(refs, dtype=np.int64)
        per_word = self.count[ref] if len(ref) else np.zeros(0, dtype=np.int64)
        total = int(per_word.sum())
        offset = np.concatenate(([0], np.cumsum(per_word)))
        where = np.repeat(self.start[ref] - offset[:-1], per_word) + np.arange(total) if total else np.zeros(0, dtype=np.int64)
        ids = self.flat[where]
        cuts = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
        per_text = offset[cuts[1:]] - offset[cuts[:-1]]
        self._forget()
        return ids, per_text

    def _forget(self) -> None:
        """Keep only short words, and none once there are too many."""
        if len(self.seen) > CACHE_WORDS:
            self._reset()
            return
        long = [w for w in self.seen if len(w) > CACHE_WORD_BYTES]
        if len(long) * 4 < len(self.seen):
            return
        for w in long:
            del self.seen[w]
        kept = np.fromiter(self.seen.values(), dtype=np.int64, count=len(self.seen))
        start, count = self.start[kept], self.count[kept]
        offset = np.concatenate(([0], np.cumsum(count)))
        where = np.repeat(start - offset[:-1], count) + np.arange(int(offset[-1]))
        self.flat, self.start, self.count = self.flat[where], offset[:-1], count
        self.seen = {w: i for i, w in enumerate(self.seen)}


_encoders: dict[str, CorpusEncoder] = {}


def encoder(path: str) -> CorpusEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = CorpusEncoder(MergeTable.from_file(path))
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER, folder: str | None = None) -> str:
    return f"{folder or TOKENIZER_DIR}/{name}.json"


def _slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, ids, ids per text) of each slice; slices may join or split Arrow batches."""
    enc = encoder(path)
    keys: list[pa.Array] = []

    def texts() -> Iterator[str | None]:
        for b in batches:
            keys.append(b.column(0))
            yield from b.column(1).to_pylist()

    done = 0
    for ids, per_text in enc.encode(texts()):
        held = pa.chunked_array(keys) if len(keys) > 1 else pa.chunked_array([keys[0]])
        yield held.slice(done, len(per_text)).combine_chunks(), ids, per_text
        done += len(per_text)
        while keys and done >= len(keys[0]) and len(keys) > 1:
            done -= len(keys[0])
            keys.pop(0)


def encode_corpus(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``.

    One row out for each row in, repeated ids and null ids included. A null or empty text
    has an empty list; a blank text is encoded as it is; strings that look like special
    tokens are ordinary text; there is no limit on length. Other columns are ignored,
    whatever their names. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    path = tokenizer_path(tokenizer, folder)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, per_text in _slices(batches, path):
            offsets = np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            table = pa.RecordBatch.from_arrays([keys, lists], names=["doc_id", "ids"])
            for at in range(0, table.num_rows, 20_000):
                yield table.slice(at, 20_000)

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, by the same encoding as :func:`encode_corpus`."""
    ship(docs.sparkSession)
    path = tokenizer_path(tokenizer, folder)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, per_text in _slices(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array(per_text)], names=["doc_id", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
