"""Runs of periodic words, found on a grammar of the text (operator 13).

A run is a stretch of words with smallest period q, at least max(least, 2 q) words long, that
no neighbouring word extends.

1. Grammar.  The word ids of all texts of a slice are compressed by Re-Pair.  A round counts
   the pairs of neighbours that may still repeat and replaces the most frequent one, and with
   it every pair that outranks both neighbours where it stands (ties by a hash, so a round
   replaces a share of all places; in a streak of equal symbols every other pair).  Words are
   distinct between texts, so a pair never spans two.  When no pair repeats, what is left of
   a text is folded in twos to one symbol.  Every replaced place is a derivation position.
2. Crossing runs.  A nonterminal stands for equal words wherever it is derived, so its first
   place is searched alone.  A run that crosses the boundary of its two parts contains the last
   word c of the left one, and c has a partner q words before or after it.  Long enough runs
   match three words up to or from c, so partners come from a sorted index of triples; how
   far they match to both sides is a binary search on hashes of prefixes, within the nonterminal.
   Of partners with one extent the smallest is the period.
3. Translation.  The runs of a nonterminal are moved to all its derivation positions.  Each run
   of the text crosses a boundary of the lowest nonterminal that holds it; what higher
   ones extend lies within their runs of that period and is merged into them: the intervals
   that no interval of the same period contains are the result.

Hashes only propose: every reported run is compared word by word, with its neighbours; if one
fails, its text is searched by brute force.

Each task reads slices of a few megabytes, or one long text, whole; nothing is shuffled.

Edge cases: a null or empty text has no words and no run; a null id is kept (in the query it
changes no words); repeated rows give repeated results; an empty table gives an empty table;
only the id and the text are read, so extra columns and clashing names do no harm.  Ties for
the longest run go to the smallest start, then the smallest period.  A very long text is
compressed whole, in memory in proportion to its words; candidates are worked on in blocks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cutline.llm.common import crc32_sql, raw, read, slices, texts
from cutline.llm.windows import mix

LEAST = 12
BLOCK = 1 << 21
PRIMES = (2_147_483_647, 2_147_483_629)


class Places:
    """(symbol, from, middle, to) of every replaced pair of `least` words or more."""

    def __init__(self, least: int):
        self.least, self.parts = least, []

    def add(self, symbol, first, middle, last):
        big = last - first >= self.least
        if big.any():
            self.parts.append(np.stack([symbol[big], first[big], middle[big], last[big]]))

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts, axis=1) if self.parts else np.empty((4, 0), np.int64)


def grammar(words: np.ndarray, lens: np.ndarray, least: int) -> np.ndarray:
    """Derivation positions of the nonterminals of a Re-Pair grammar of texts with `lens` words.

    Equal numbers in `words` are equal words of one text.
    """
    n = len(words)
    places = Places(least)
    sym, at = words.astype(np.int64), np.arange(n)
    end = at + 1
    fresh = int(sym.max(initial=-1)) + 1
    base = np.int64(fresh + n + 1)
    live = np.ones(n, bool)  # may the pair that starts here repeat?
    live[-1:] = False
    while True:
        spot = np.flatnonzero(live)
        key, pair, count = np.unique(sym[spot] * base + sym[spot + 1], return_inverse=True, return_counts=True)
        often = count[pair] > 1
        live[spot[~often]] = False
        spot, pair = spot[often], pair[often]
        if not len(spot):
            break
        order = count << 32 | (mix(key.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        rank, kind = np.full(len(sym) + 2, -1), np.full(len(sym) + 2, -1)
        rank[spot + 1], kind[spot + 1] = order[pair], pair
        here, same = spot + 1, kind[spot] == pair
        wins = ((rank[here] > rank[here - 1]) | same) & (rank[here] >= rank[here + 1])
        streak = np.maximum.accumulate(np.where(same, 0, spot))
        pick = wins & ((spot - streak) % 2 == 0)
        spot, pair = spot[pick], pair[pick]
        kinds, name = np.unique(pair, return_inverse=True)
        name = name + fresh
        fresh += len(kinds)
        places.add(name, at[spot], end[spot], end[spot + 1])
        sym[spot], end[spot] = name, end[spot + 1]
        live[spot] = True
        live[np.maximum(spot - 1, 0)] = True
        keep = np.ones(len(sym), bool)
        keep[spot + 1] = False
        sym, at, end, live = sym[keep], at[keep], end[keep], live[keep]
        live[-1:] = False
    stop = np.cumsum(lens)
    doc = np.searchsorted(stop, at, side="right")
    while len(doc) and (doc[1:] == doc[:-1]).any():
        first = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(len(doc)), 0))
        even = (np.arange(len(doc)) - first) % 2 == 0
        left = np.flatnonzero(even[:-1] & (doc[1:] == doc[:-1]))
        places.add(fresh + np.arange(len(left)), at[left], end[left], end[left + 1])
        fresh += len(left)
        end[left] = end[left + 1]
        keep = np.ones(len(doc), bool)
        keep[left + 1] = False
        at, end, doc = at[keep], end[keep], doc[keep]
    return places.all()


class Matches:
    """How far words match at two positions, by hashes of prefixes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.powers = [], []
        for p, b in zip(PRIMES, (1_000_003, 69_069_031)):
            power = np.ones(n + 1, np.int64)
            have = 1
            while have <= n:
                power[have:2 * have] = power[:min(have, n + 1 - have)] * pow(b, have, p) % p
                have *= 2
            value = (mix(words.astype(np.uint64) + np.uint64(b)) % np.uint64(p)).astype(np.int64)
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:n] % p) % p]))

    def equal(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """words[x:x+size] == words[y:y+size], where x < y."""
        same = np.ones(len(x), bool)
        for p, power, total in zip(PRIMES, self.powers, self.sums):
            one, two = (total[x + size] - total[x]) % p, (total[y + size] - total[y]) % p
            same &= one * power[y - x] % p == two
        return same

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest k <= most with equal words in k places from (before, if back) x and y."""
        have = np.zeros_like(x)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            more = np.flatnonzero(have + step <= most)
            size = have[more] + step
            shift = size if back else 0
            have[more] += step * self.equal(x[more] - shift, y[more] - shift, size)
            step >>= 1
        return have


def crossing(words: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """(symbol, from, to, period) of runs over the boundary of each nonterminal, from its start."""
    n = len(words)
    symbol, first = np.unique(places[0], return_index=True)
    lo, mid, hi = places[1:, first]
    triple = mix(mix(mix(words[:-2].astype(np.uint64)) + words[1:-1].astype(np.uint64)) + words[2:].astype(np.uint64))
    kind, count = np.unique(triple, return_inverse=True, return_counts=True)[1:]
    order = np.argsort(kind, kind="stable")
    order = order[count[kind[order]] > 1]
    index = kind[order] * np.int64(n) + order
    c = mid - 1
    node, start, size, shift = [], [], [], []
    for anchor, off in ((c - 2, 2), (c, 0)):
        ok = np.flatnonzero((anchor >= lo) & (anchor + 3 <= hi))
        ok = ok[count[kind[anchor[ok]]] > 1]
        key = kind[anchor[ok]] * np.int64(n)
        a, b = np.searchsorted(index, key + lo[ok]), np.searchsorted(index, key + hi[ok] - 2)
        node.append(ok), start.append(a), size.append(b - a), shift.append(np.full(len(ok), off))
    node, start, size, shift = map(np.concatenate, (node, start, size, shift))
    many = size > 1  # the anchor itself is always there
    node, start, size, shift = node[many], start[many], size[many], shift[many]
    hashes = Matches(words) if len(node) else None
    found = []
    step = 0
    total = np.cumsum(size)
    while step < len(node):
        stop = max(step + 1, int(np.searchsorted(total, total[step] - size[step] + BLOCK, side="right")))
        part = np.repeat(np.arange(step, stop), size[step:stop])
        within = np.arange(len(part)) - np.repeat(np.cumsum(size[step:stop]) - size[step:stop], size[step:stop])
        who, partner = node[part], order[start[part] + within] + shift[part]
        step = stop
        q = np.abs(partner - c[who])
        use = (q > 0) & (2 * q <= hi[who] - lo[who]) & (partner < hi[who])
        pair = np.unique(np.stack([who[use], np.minimum(partner, c[who])[use], q[use]]), axis=1) if use.any() else np.empty((3, 0), np.int64)
        who, x, q = pair
        y = x + q
        back = hashes.reach(x, y, x - lo[who], True)
        on = hashes.reach(x, y, hi[who] - y, False)
        s, e = x - back, y + on
        good = (e - s >= np.maximum(least, 2 * q)) & (s < mid[who]) & (e > mid[who])
        found.append(np.stack([who, s, e, q])[:, good])
    if not found:
        return np.empty((4, 0), np.int64)
    who, s, e, q = np.concatenate(found, axis=1)
    by = np.lexsort((q, e, s, who))
    who, s, e, q = who[by], s[by], e[by], q[by]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return np.stack([symbol[who], s - lo[who], e - lo[who], q])[:, new]


def maximal(runs: np.ndarray) -> np.ndarray:
    """(from, to, period) without those that one of the same period contains, by start and period."""
    s, e, q = runs
    by = np.lexsort((-e, s, q))
    s, e, q = s[by], e[by], q[by]
    lift = np.unique(q, return_inverse=True)[1] * (int(e.max(initial=0)) + 1)
    reach = np.maximum.accumulate(e + lift)
    keep = np.ones(len(s), bool)
    keep[1:] = (e + lift)[1:] > reach[:-1]
    s, e, q = s[keep], e[keep], q[keep]
    by = np.lexsort((q, s))
    return np.stack([s[by], e[by], q[by]])


def brute_force(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(from, to, period) of all runs of one text, every period alone: n squared."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate([[0], words[q:] == words[:-q], [0]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(same))
        for s, e in zip(turn[::2].tolist(), (turn[1::2] + q).tolist()):
            if e - s >= max(least, 2 * q) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, lens: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (from, to, period) of each text, by start and period; `words` as for `grammar`."""
    out: list[list] = [[] for _ in lens]
    stop = np.cumsum(lens)
    if len(words) < 3:
        return [brute_force(words[b - n:b], least) for n, b in zip(lens.tolist(), stop.tolist())]
    places = grammar(words, lens, least)
    if not places.shape[1]:
        return out
    symbol, s, e, q = crossing(words, places, least)
    by = np.argsort(places[0], kind="stable")
    names, where = places[0][by], places[1][by]
    a, b = np.searchsorted(names, symbol), np.searchsorted(names, symbol, side="right")
    k = np.repeat(np.arange(len(symbol)), b - a)
    at = where[np.arange(len(k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[k]]
    runs = maximal(np.stack([at + s[k], at + e[k], q[k]]))
    doc = np.searchsorted(stop, runs[0], side="right")
    first = stop - lens
    wrong = set()
    for d, s, e, q in zip(doc.tolist(), *runs.tolist()):
        lo, hi = int(first[d]), int(stop[d])
        whole = (np.array_equal(words[s:e - q], words[s + q:e])
                 and not (s > lo and words[s - 1] == words[s - 1 + q])
                 and not (e < hi and words[e] == words[e - q]))
        if not whole:
            wrong.add(d)
        out[d].append((s - lo, e - lo, q))
    for d in wrong:  # two hashes were equal by chance
        out[d] = brute_force(words[first[d]:stop[d]], least)
    return out


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, e, q in runs:
        edge[s + q] += 1
        edge[e] -= 1
    return np.cumsum(edge[:-1]) == 0


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original words the query's words are, or None for all of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    k = np.arange(n)
    k[a:] = a + (k[a:] - a) % p
    return k


def _found(docs: DataFrame, emit, schema: str, least: int, planted: bool, id_col: str, text_col: str) -> DataFrame:
    """emit(words, runs) -> a row without the id, for every document."""
    names, types = zip(*(c.split() for c in schema.split(", ")))
    arrow = [pa.int64() if t == "long" else pa.string() for t in types]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_pylist()
                split = [t.split() for t in raw(part, "text")]
                if planted:
                    for k, i in enumerate(ids):
                        index = _planted(i, len(split[k]))
                        if index is not None:
                            split[k] = [split[k][j] for j in index.tolist()]
                lens = np.fromiter(map(len, split), np.int64, len(split))
                known: dict[bytes, int] = {}
                flat = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64)
                own = np.repeat(np.arange(len(split)), lens) * len(known) + flat
                own = np.unique(own, return_inverse=True)[1] if len(own) else own
                rows = [emit(ws, r) for ws, r in zip(split, runs_of(own, lens, least))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow[1:])]], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, text): the text's words, joined by blanks, of which every run keeps its first period."""
    def emit(words, runs):
        stay = kept(len(words), runs)
        return len(runs), b" ".join([w for w, k in zip(words, stay) if k]).decode("utf-8", "replace")

    return _found(docs, emit, "doc_id long, n_runs long, text string", least, False, id_col, text_col)


def digests(docs: DataFrame, least: int = LEAST, planted: bool = False,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its runs counted, the longest, and digests of all runs and of the text without repeats.

    With `planted` some documents, chosen by their id, are first made periodic.
    """
    def emit(words, runs):
        listing = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        stay = words
        if runs:
            stay = [w for w, k in zip(words, kept(len(words), runs)) if k]
        s, e, q = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2])) if runs else (None,) * 3
        top = (None,) * 4 if s is None else (s, e - s, q, 1000 * (e - s) // q)
        return (len(runs), *top, hashlib.sha256(listing.encode()).hexdigest(),
                hashlib.sha256(b" ".join(stay)).hexdigest())

    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    return _found(docs, emit, schema, least, planted, id_col, text_col)


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents."""
    return digests(read(spark, sf_dir, "documents"), planted=True)


QUERIES = {"op13_period_runs": op13_period_runs}
#: A run matches itself q words on in six places or more: equal 6-word shingles of one text and
#: one distance, at consecutive places, are its matches.
ORACLE = {"op13_period_runs": f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS given,
    {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
shifted AS (SELECT *, len(given) AS n, (h // 10) % greatest(len(given), 1) AS a, (h // 10) % 8 AS r FROM docs),
texts AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END])
    ELSE given END AS words FROM shifted),
shingles AS (SELECT rid, i, array_to_string(words[i + 1:i + 6], ' ') AS w FROM texts, LATERAL unnest(range(n - 5)) AS t(i)),
matches AS (SELECT x.rid, x.i, y.i - x.i AS q FROM shingles x JOIN shingles y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM matches),
stretches AS (SELECT rid, q, min(i) AS s, max(i) + 6 + q AS e FROM islands GROUP BY rid, q, island),
runs AS (SELECT rid, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest({LEAST}, 2 * q) GROUP BY rid, s, e),
listed AS (
  SELECT rid, count(*) AS n_runs, arg_min({{'s': s, 'e': e, 'q': q}}, (s - e, s, q)) AS top,
    string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listing
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, e)) AS i FROM runs),
stay AS (
  SELECT t.rid, string_agg(words[k.i + 1], ' ' ORDER BY k.i) AS kept
  FROM texts t, LATERAL unnest(range(n)) AS k(i) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.rid = t.rid AND g.i = k.i)
  GROUP BY t.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.e - top.s AS length, top.q AS period,
  1000 * (top.e - top.s) // top.q AS exponent_milli,
  sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (rid) LEFT JOIN stay USING (rid)"""}
