"""Token counts by rank-synchronous array merging (operator 6).

The distinct pre-tokens of a slice are held as ragged numpy arrays: one flat array of
symbols and a sequence number for each.  In every round each sequence finds its own
lowest-rank pair and all sequences merge theirs at the same time; the symbols that survive
are counted.  Counts of pre-tokens are kept in a bounded per-process table.

A sentencepiece BPE model is read through its library for pieces and scores only.  Spaces
become U+2581, one is put in front, and a text is cut into pre-tokens where no piece of
the vocabulary spans the cut: before a U+2581 that follows another character, and around
line breaks (checked against the vocabulary when it is loaded; else the text stays whole).
A surviving symbol outside the vocabulary counts its UTF-8 bytes.

A round merges all occurrences of a sequence's pair at once, left to right.  That equals
the one-at-a-time order unless a merge makes a pair that ranks no later than the one being
merged; such sequences (runs of spaces, whose pieces share one score) are found by that
test and merged with a priority queue instead.

Edge cases: null and empty texts count 0 tokens and 0 bytes; a null id is kept; repeated
rows give repeated results; an empty table gives an empty table; other columns are not
read, so clashing names do no harm.  A text without any cut is one sequence.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cutline.llm.common import Ids, read, segment_sums, slices, strings, texts

TABLE_WORDS = 600_000
MARK = "▁"
NONE = np.int64(1) << 40


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """One vocabulary and the pre-tokens counted so far."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.bytes_fallback = any(sp.is_byte(i) for i in range(size))
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}  # equal scores share a rank
        self.symbol = Ids()  # text of a symbol -> number
        for p in score:
            self.symbol[p]
        self.pieces = len(self.symbol)
        ids = self.symbol
        keys, ranks, made = [], [], []
        for p in score:
            for k in range(1, len(p)):
                if p[:k] in score or k == 1:
                    if p[k:] in score or len(p) - k == 1:
                        keys.append((ids[p[:k]], ids[p[k:]]))
                        ranks.append(self.rank[p])
                        made.append(ids[p])
        key = np.array([a << 32 | b for a, b in keys], np.int64)
        at = np.argsort(key)
        self.key = key[at]
        self.key_rank, self.key_made = np.array(ranks, np.int64)[at], np.array(made, np.int64)[at]
        inner = any(MARK in p.lstrip(MARK) for p in score)
        lines = any("\n" in p and len(p) > 1 for p in score)
        self.split = (re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
                      if not inner and not lines else lambda t: [t])
        self.clear()

    def clear(self) -> None:
        self.words = Ids()
        self.counts = np.empty(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged symbol) of neighbouring symbols."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[at] == want
        return np.where(hit, self.key_rank[at], NONE), self.key_made[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols per pre-token."""
        text = "".join(words)
        total = np.zeros(len(words), np.int64)
        if not text:
            return total
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        sym = self.symbol.of([chr(c) for c in chars.tolist()])[back]
        seq = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        odd = np.zeros(len(words), bool)
        while True:
            join = np.flatnonzero(seq[1:] == seq[:-1])
            rank = np.full(len(sym), NONE)
            made = np.zeros(len(sym), np.int64)
            if len(join):
                rank[join], made[join] = self._pairs(sym[join], sym[join + 1])
            # lowest rank per sequence; sequences are consecutive runs
            head = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.concatenate([head, [len(seq)]]))
            active = np.repeat(low < NONE, size)
            if not active.all():  # finished sequences are counted and leave
                done = ~active
                total += np.bincount(seq[done], self._weight(sym[done]), len(words)).astype(np.int64)
                sym, seq, rank, made = sym[active], seq[active], rank[active], made[active]
                low, size = low[low < NONE], size[low < NONE]
                if not len(sym):
                    break
            low = np.repeat(low, size)
            at = np.flatnonzero(rank == low)
            # of overlapping occurrences take every other one, from the left
            run = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            new, own = made[at], rank[at]
            # pairs the merges make, against neighbours before and after their own merge
            merged = sym.copy()
            merged[at] = new
            right, left = at + 2, at - 1
            left_sym = merged[np.maximum(left, 0)]
            taken = np.zeros(len(sym), bool)
            taken[at + 1] = True
            behind = np.maximum(at - 2, 0)
            left_sym = np.where((left >= 0) & taken[np.maximum(left, 0)], merged[behind], left_sym)
            for neighbour, other in ((right, sym), (right, merged)):
                ok = np.flatnonzero((neighbour < len(sym)) & (seq[np.minimum(neighbour, len(seq) - 1)] == seq[at]))
                early = self._pairs(new[ok], other[neighbour[ok]])[0] <= own[ok]
                odd[seq[at[ok[early]]]] = True
            ok = np.flatnonzero((left >= 0) & (seq[np.maximum(left, 0)] == seq[at]))
            early = self._pairs(left_sym[ok], new[ok])[0] <= own[ok]
            odd[seq[at[ok[early]]]] = True
            keep = ~taken
            keep &= ~odd[seq]
            sym, seq = merged[keep], seq[keep]
            if not len(sym):
                break
        for k in np.flatnonzero(odd):
            total[k] = self._queue(words[k])
        return total

    def _weight(self, sym: np.ndarray) -> np.ndarray:
        """Tokens of a surviving symbol: 1, or its bytes if it is no piece."""
        out = np.ones(len(sym))
        if self.bytes_fallback:
            for k in np.flatnonzero(sym >= self.pieces).tolist():
                out[k] = len(self.symbol.order[sym[k]].encode("utf-8", "surrogatepass"))
        return out

    def _queue(self, word: str) -> int:
        """The same for one pre-token, one merge at a time, equal ranks from the left."""
        text, n = list(word), len(word)
        nxt, prv = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap: list = []

        def push(a, b):
            if a >= 0 and b >= 0 and (r := self.rank.get(text[a] + text[b])) is not None:
                heapq.heappush(heap, (r, a, b, len(text[a]), len(text[b])))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, b, m, k = heapq.heappop(heap)
            if len(text[a]) != m or len(text[b]) != k:
                continue
            text[a] += text[b]
            text[b] = ""
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prv[nxt[b]] = a
            push(prv[a], a)
            push(a, nxt[a])
        left = [t for t in text if t]
        return sum(1 if t in self.rank or not self.bytes_fallback else len(t.encode("utf-8", "surrogatepass"))
                   for t in left)

    def count_texts(self, docs: list[str]) -> np.ndarray:
        if len(self.words) > TABLE_WORDS:
            self.clear()
        known = len(self.words)
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in docs]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        ids = self.words.of([w for ws in split for w in ws])
        if len(self.words) > known:
            self.counts = np.concatenate([self.counts, self.count(self.words.order[known:])])
        if len(self.symbol) > self.pieces + 500_000:
            self.symbol = Ids()
            for p in self.rank:
                self.symbol[p]
        return segment_sums(self.counts[ids], lens)


@lru_cache(maxsize=2)
def _counter(model_path: str) -> Counter:
    return Counter(model_path)


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    model_path = model_path or default_model()

    def run(batches):
        counter = _counter(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = strings(part, "text")
                n = counter.count_texts(rows)
                size = [len(t.encode("utf-8", "surrogatepass")) for t in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the 32k piece model."""
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
