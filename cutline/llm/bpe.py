"""Byte-level BPE encoding and decoding by merge replay (operator 1).

The distinct pre-tokens of a slice of the corpus are laid out, some thousands at a time, as
one linked array of symbols.  An inverted index maps every mergeable pair, named by the rank of the token it
makes, to the positions where it stands.  Ranks are replayed in order over the whole
slice at once; a merge rewrites its position and re-indexes only the two touched
neighbours.  Words are independent of each other, so the lowest rank of the slice is also
the lowest of its word, and the result is that of encoding every word alone.  Encoded
words are kept in a bounded table while a task runs, hence a task replays a word about once.

Nothing is shuffled: every task needs the rank file only, whose path is a parameter.

Edge cases: a null or empty text encodes to no ids and decodes to the empty string; a null
id is kept; repeated rows give repeated results; an empty table gives an empty table; only
the id and the text column are read, so extra columns and clashing names do no harm.  A
long text without breaks is one word of n symbols and costs n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from cutline.llm.common import give_back, ragged_take, read, slices, strings, texts

TABLE_WORDS = 300_000
REPLAY_WORDS = 8192
SHIFT = 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Ranks of one vocabulary and the words encoded so far."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.byte_id = np.array(single, np.int64)
        # rank of the token that two neighbouring tokens make
        self.pairs = {
            ranks[t[:k]] << SHIFT | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        # ... that two neighbouring bytes make, or -1
        self.byte_pair = np.array(
            [[self.pairs.get(a << SHIFT | b, -1) for b in single] for a in single], np.int64)
        self.token_len = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_len[list(ranks.values())] = [len(t) for t in ranks]
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.word_id: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int64)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words joined, ids per word) after every merge in rank order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.int64), size
        end = np.cumsum(size)
        last = np.zeros(n, bool)
        last[end[size > 0] - 1] = True
        pair = np.concatenate([self.byte_pair[data[:-1], data[1:]], [-1]])
        pair[last] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        heap, cuts = np.unique(pair[at], return_index=True)
        index = {r: p.tolist() for r, p in zip(heap.tolist(), np.split(at, cuts[1:]))}
        heap = heap.tolist()  # sorted, hence a heap
        sym = self.byte_id[data].tolist()
        step = np.arange(1, n + 1)
        step[last] = -1
        nxt, prv = step.tolist(), np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(n) - 1).tolist()
        makes = pair.tolist()  # rank of the pair that starts here now
        rank_of, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, p in enumerate(places):
                if makes[p] != rank:
                    continue  # a neighbour was merged since
                q = nxt[p]
                after, before = nxt[q], prv[p]
                sym[p], sym[q], makes[q], nxt[p] = rank, -1, -1, after
                lowest = rank
                if after >= 0:
                    prv[after] = p
                    makes[p] = r = rank_of(rank << SHIFT | sym[after], -1)
                    if r >= 0:
                        if r < lowest:
                            lowest = r
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(heap, r)
                else:
                    makes[p] = -1
                if before >= 0:
                    makes[before] = r = rank_of(sym[before] << SHIFT | rank, -1)
                    if r >= 0:
                        if r < lowest:
                            lowest = r
                        if r in index:
                            index[r].append(before)
                        else:
                            index[r] = [before]
                            push(heap, r)
                if lowest < rank and k + 1 < len(places):
                    # the new pair comes first in its word: resume this rank afterwards
                    index[rank] = places[k + 1:]
                    push(heap, rank)
                    break
        out = np.array(sym, np.int64)
        alive = out >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return out[alive], kept[end] - kept[end - size]

    def _learn(self, words: list[str]) -> None:
        """Replay the words not in the table and add them."""
        ids, lens = self.replay([w.encode("utf-8", "surrogatepass") for w in words])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        first = len(self.starts)
        self.word_id.update(zip(words, range(first, first + len(words))))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += len(ids)

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, ids per text)."""
        if len(self.word_id) > TABLE_WORDS:
            self.clear()
        split = [self.split(t) for t in docs]
        known = self.word_id
        new = list(set(chain.from_iterable(split)).difference(known))
        for k in range(0, len(new), REPLAY_WORDS):
            self._learn(new[k:k + REPLAY_WORDS])
        words = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        starts, lens = self.starts, self.lens
        ids = ragged_take(self.flat, starts[words], lens[words])
        per_word = np.concatenate([[0], np.cumsum(lens[words])])
        end = np.cumsum([len(ws) for ws in split])
        stop = per_word[end]
        return ids, np.diff(stop, prepend=0)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of every list of ids; `ids` holds them joined."""
        size = self.token_len[ids]
        data = ragged_take(self.token_bytes, self.token_at[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(lens)].tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without special tokens."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        coder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lens = coder.encode(strings(part, "text"))
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))],
                    names=["doc_id", "ids"],
                )
        coder.clear()
        give_back()

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; a null list is empty, bytes that are no UTF-8 become U+FFFD."""
    ranks_path = ranks_path or default_ranks()
    pattern = default_pattern()

    def run(batches):
        coder = _encoder(ranks_path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                lists = pc.fill_null(part.column(1), pa.scalar([], part.column(1).type))
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                found = coder.decode(ids, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d.decode("utf-8", "replace") for d in found], pa.string())], names=["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded again.

    The digests are of the ids as little-endian 32-bit integers and of the decoded bytes.
    """
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        coder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lens = coder.encode(strings(part, "text"))
                lists = np.split(ids.astype("<u4"), np.cumsum(lens)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lens, pa.int64()),
                     pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in lists]),
                     pa.array([hashlib.sha256(d).hexdigest() for d in coder.decode(ids, lens)])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.clear()
        give_back()

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, decode the ids, and give the digests of both."""
    return round_trip(read(spark, sf_dir, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLE: dict[str, str] = {}
