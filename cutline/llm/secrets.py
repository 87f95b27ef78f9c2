"""Secrets in texts: fixed rules, and sliding-window entropy per character class (operator 12).

Everything is DataFrame expressions: no Python workers, no shuffle, one pass over the texts.

1. Rules.  `assign` (a keyword, a sign, a value), `access` (a key id) and `hex` (a run) are
   regular expressions.  The matches of a text and the pieces between them (`split`) give
   code point positions by prefix sums, made in blocks so that a text with very many matches
   costs about n rather than n squared.
2. Entropy.  Candidates are long strings of key characters.  Each belongs to the first class
   of `CLASSES` whose alphabet holds it; a class has a window and a least entropy.  A fold
   over the characters keeps the counts of the window and S = sum f(count), with
   f(c) = round(10^6 c log2 c): one character enters and one leaves, so two counts change
   and S by four table values.  The entropy is log2(window) - S / window, hence the test is
   an integer comparison.  Windows that pass and touch are one span of kind `entropy`.
3. Allow-list.  Candidates that match one of `ALLOW` are no secrets (letters only, digits
   only, words joined by signs, UUIDs, integrity hashes, keyboard and alphabet rows,
   placeholders).  Spans that overlap a rule's span are not reported twice.  The list never
   takes a rule's span away.

Edge cases: a null or empty text has no spans; a null id is kept; repeated rows give
repeated results; an empty table gives an empty table; only the id and the text are read, so
extra columns and clashing names do no harm.  Spans are ordered by start, ties by the order
of the kinds, so the order is total within a kind.  A very long text is worked on whole:
matches cost n (see 1), a candidate of m characters m table steps, and the overlap test
the product of a text's two kinds of spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import read, texts

# The rules, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_VALUE = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: (alphabet of the class, window in characters, least bits per character)
CLASSES = [
    (r"^[0-9A-Fa-f]+$", 20, 3.0),
    (r"^[A-Za-z0-9]+$", 20, 3.75),
    (r"^[A-Za-z0-9+/_=-]+$", 20, 3.9),
]
ALLOW = [
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z]*([+/_=-]+[A-Za-z]*)*$",
    r"^[0-9]*([+/_=-]+[0-9]*)*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^sha(1|256|384|512)-",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your[_-]",
]
BLOCK = 256
UNIT = 1_000_000


def weight(count: int) -> int:
    """round(10^6 c log2 c), what a character with this count adds to S."""
    return round(UNIT * count * math.log2(count)) if count > 1 else 0


def limit(window: int, bits: float) -> int:
    """The largest S of a window whose entropy is at least `bits`."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def _running(values: Column) -> Column:
    """Inclusive prefix sums of an array, in blocks."""
    def totals(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    zero = F.lit(0).cast("int")
    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    before = totals(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(
        F.arrays_zip(blocks.alias("block"), F.slice(before, 1, F.size(blocks)).alias("base")),
        lambda z: F.slice(totals(z["block"], z["base"]), F.lit(2), F.size(z["block"]))))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def _starts(text: Column, pattern: str, hits: Column) -> Column:
    """Code point position of every match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), F.size(hits) - 1), F.length)),
        lambda g, h: g + h)
    return F.when(F.size(hits) > 0, _running(steps)).otherwise(F.array().cast("array<int>"))


def _rule(kind: str, hits: Column, starts: Column) -> Column:
    rank = KINDS.index(kind)
    return F.zip_with(hits, starts, lambda h, s: F.struct(
        s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(h)).alias("end")))


def hot_windows(string: Column, window: int, most: int) -> Column:
    """Merged stretches (from, to) of `string` whose windows have S of at most `most`."""
    table = F.array(*[F.lit(weight(c)).cast("long") for c in range(window + 1)])
    letters = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    none = F.array().cast("array<struct<from:int,to:int>>")
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("s"),
        F.lit(0).alias("i"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), none.alias("done"))

    def f(count: Column) -> Column:
        return F.element_at(table, count + 1)

    def step(acc: Column, letter: Column, codes: Column) -> Column:
        i = acc["i"]
        full = i >= window
        gone = F.when(full, F.element_at(codes, F.greatest(i - window, F.lit(0)) + 1)).otherwise(-1)
        n_in = F.element_at(acc["counts"], letter + 1)
        n_out = F.element_at(acc["counts"], F.greatest(gone, F.lit(0)) + 1)
        s = F.when(gone == letter, acc["s"]).otherwise(
            acc["s"] + f(n_in + 1) - f(n_in) + F.when(full, f(n_out - 1) - f(n_out)).otherwise(0))
        counts = F.transform(
            acc["counts"], lambda n, k: n + (k == letter).cast("int") - (k == gone).cast("int"))
        start = i - (window - 1)
        hot = (start >= 0) & (s <= most)
        fresh = hot & ((acc["to"] < 0) | (start > acc["to"]))
        return F.struct(
            counts.alias("counts"), s.alias("s"), (i + 1).alias("i"),
            F.when(fresh, start).otherwise(acc["from"]).alias("from"),
            F.when(hot, i + 1).otherwise(acc["to"]).alias("to"),
            F.when(fresh & (acc["to"] >= 0), F.concat(acc["done"], F.array(_stretch(acc)))).otherwise(acc["done"]).alias("done"))

    def finish(acc: Column) -> Column:
        return F.when(acc["to"] >= 0, F.concat(acc["done"], F.array(_stretch(acc)))).otherwise(acc["done"])

    # the letters are bound once, as the only element of an array
    return F.element_at(
        F.transform(F.array(letters), lambda codes: F.aggregate(codes, state, lambda a, x: step(a, x, codes), finish)), 1)


def _stretch(acc: Column) -> Column:
    return F.struct(acc["from"].alias("from"), acc["to"].alias("to"))


def _entropy(candidates: Column, classes) -> Column:
    """Spans of the candidates (string, start) that pass the test of their class."""
    none = F.array().cast("array<struct<from:int,to:int>>")

    def spans(c: Column) -> Column:
        found = none
        for alphabet, window, bits in reversed(classes):
            found = F.when(
                c["string"].rlike(alphabet),
                F.when(F.length(c["string"]) >= window, hot_windows(c["string"], window, limit(window, bits))).otherwise(none),
            ).otherwise(found)
        return F.transform(found, lambda w: F.struct(
            (c["start"] + w["from"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"),
            (c["start"] + w["to"]).alias("end")))

    return F.flatten(F.transform(candidates, spans))


def find(docs: DataFrame, classes=CLASSES, allow=ALLOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (start, rank, end), rank counting `KINDS`; see the module."""
    text = F.col("text")
    found = texts(docs, id_col, text_col).select(
        "doc_id", "text",
        _matches(text, ASSIGN).alias("assign"), _matches(text, ASSIGN, 2).alias("value"),
        _matches(text, ACCESS).alias("access"), _matches(text, HEX).alias("hex"),
        _matches(text, CANDIDATE).alias("string"))
    placed = found.select(
        "doc_id", "assign", "value", "access", "hex", "string",
        *[_starts(text, p, F.col(k)).alias(f"{k}_at") for k, p in
          (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("string", CANDIDATE))])
    assign = F.filter(
        F.arrays_zip(_rule("assign", F.col("assign"), F.col("assign_at")).alias("span"), F.col("value")),
        lambda z: F.length(z["value"]) >= LEAST_VALUE)
    rules = F.concat(
        F.transform(assign, lambda z: z["span"]),
        *[_rule(k, F.col(k), F.col(f"{k}_at")) for k in ("access", "hex")])
    listed = F.filter(
        F.zip_with("string", "string_at", lambda h, s: F.struct(h.alias("string"), s.alias("start"))),
        lambda c: ~F.greatest(F.lit(False), *[c["string"].rlike(p) for p in allow]))
    base = placed.select("doc_id", F.array_sort(rules).alias("base"), listed.alias("listed"))
    hot = base.select("doc_id", "base", _entropy(F.col("listed"), classes).alias("hot"))
    clear = F.filter("hot", lambda h: ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    return hot.select("doc_id", "base", F.array_sort(clear).alias("added"))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in all documents."""
    found = find(read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches_sql(rank: int, pattern: str, value: int = 0) -> str:
    """Rows (rid, rank, start, string, value) of one rule; positions from the pieces between the matches."""
    p = _quoted(pattern)
    return f"""
    SELECT rid, {rank} AS rank, hits[i] AS string, vals[i] AS value,
      CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT rid, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {value}) AS vals,
            string_split_regex(text, {p}) AS gaps FROM docs) m, LATERAL unnest(range(1, len(hits) + 1)) AS t(i)"""


def _sql() -> str:
    classes = " ".join(
        f"WHEN regexp_matches(string, {_quoted(a)}) THEN {{'w': {w}, 'most': {limit(w, b)}}}" for a, w, b in CLASSES)
    table = [weight(c) for c in range(max(w for _, w, _ in CLASSES) + 1)]
    allow = " OR ".join(f"regexp_matches(string, {_quoted(p)})" for p in ALLOW)
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join([_matches_sql(0, ASSIGN, 2), _matches_sql(1, ACCESS), _matches_sql(2, HEX)])}),
base AS (SELECT rid, rank, start, start + length(string) AS stop FROM found WHERE rank > 0 OR length(value) >= {LEAST_VALUE}),
listed AS (SELECT rid, start, string, CASE {classes} END AS c FROM ({_matches_sql(3, CANDIDATE)}) f WHERE NOT ({allow})),
parts AS (SELECT rid, start, c, k, substr(string, CAST(k + 1 AS INTEGER), c.w) AS part
  FROM listed, LATERAL unnest(range(0, length(string) - c.w + 1)) AS t(k)),
hot AS (SELECT rid, start, k, c.w AS w FROM parts WHERE list_sum(list_transform(list_distinct(string_split(part, '')),
    lambda x: {table}[length(part) - length(replace(part, x, '')) + 1])) <= c.most),
steps AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY rid, start ORDER BY k) + w THEN 0 ELSE 1 END AS fresh FROM hot),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, start ORDER BY k) AS run FROM steps),
hits AS (SELECT rid, 3 AS rank, start + min(k) AS start, start + max(k) + max(w) AS stop FROM runs GROUP BY rid, runs.start, run),
spans AS (SELECT *, 1 AS ruled FROM base UNION ALL SELECT *, 0 FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.rid = h.rid AND b.start < h.stop AND h.start < b.stop)),
named AS (SELECT *, {KINDS}[rank + 1] AS kind FROM spans)
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
  count(*) FILTER (rank = 2) AS n_hex, sha256({joined.replace("),", ") FILTER (ruled = 1),")}) AS base_sha256, {joined} AS spans
FROM docs LEFT JOIN named USING (rid) GROUP BY rid, doc_id"""


QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLE = {"op12_secret_scan": _sql()}
