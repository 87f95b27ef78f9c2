"""Quality rules by distribution divergence (operator 7).

Every document gives two histograms: character classes and common words.  Their sums per
language label are the references.  A document whose histograms lie too far from the
reference of its label, by Jensen-Shannon distance, is rejected.  Two further rules, too
few words and too many repeated 3-word windows, hold whatever the distances are.

One pass in Python turns texts into counts; references and distances are column
expressions.  A reference is one row of about a hundred numbers per label, summed on the
map side, so a label with a third of all rows costs no more than another.

Guards: no distance is judged for a document with fewer than `min_words` words, nor for
one with fewer than `min_common` common words (common-word histogram), nor against a
reference made of fewer than `min_reference` words.

Edge cases: null and empty texts have no words, fail the base rule and are not kept; a
null label is a label of its own; repeated rows are judged alike; an empty table gives an
empty table; the operator reads id, text and label only, `keep` returns the given columns
whatever their names are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import raw, read, slices

# Frequent function words of English, French, German and Spanish.
COMMON = """
the of and to in is it that for was on as with be by at this from or are an he not
de la le et les des en un une du que est pour dans qui sur au par avec ce il pas
der die das und zu den von mit ist im für auf dem nicht ein eine als auch es sich
el los las por con del se no su al lo como más o pero sus y a
""".split()
COMMON_WORDS = list(dict.fromkeys(COMMON))
_COMMON_ID = {w.encode(): k for k, w in enumerate(COMMON_WORDS)}

CLASSES = ["lower", "upper", "digit", "blank", "stop", "symbol", "punct", "other"]
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int64)  # bytes of characters beyond ASCII
    for b in range(128):
        c = chr(b)
        table[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace()
                    else 4 if c in ".,;:'\"-" else 5 if b in SYMBOLS else 6)
    return table


_CLASS = _class_table()


def base_counts(data: bytes) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and both histograms."""
    words = data.split()
    n = len(words)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # code points are bytes without UTF-8 continuations; words leave out the six blanks
    word_chars = int(by_byte.sum() - by_byte[128:192].sum() - by_byte[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(by_byte[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k:n - 2 + k] |= hit
        repeats = int(cover.sum())
    classes = np.bincount(_CLASS, by_byte, len(CLASSES)).astype(np.int64)
    common = np.zeros(len(COMMON_WORDS), np.int64)
    for w, c in Counter(words).items():
        k = _COMMON_ID.get(w.lower().strip(b".,;:!?"))
        if k is not None:
            common[k] += c
    return n, word_chars, symbols, dup_lines, repeats, classes, common


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """(doc_id, lang, base counts, histograms and their totals) of every whole text.

    With `carry` also the columns of `docs`, as c0, c1, ...
    """
    carried = [f"c{k}" for k in range(len(docs.columns))] if carry else []
    types = [f"{c} {f.dataType.simpleString()}" for c, f in zip(carried, docs.schema.fields)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [base_counts(t) for t in raw(part, "text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2),
                     *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)),
                     pa.array([r[5] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[6] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[5].sum() for r in rows], pa.int64()),
                     pa.array([r[6].sum() for r in rows], pa.int64()), *part.columns[3:]],
                    names=["doc_id", "lang", *BASE, "classes", "common", "class_total", "common_total", *carried],
                )

    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"), *(F.col(c).alias(n) for c, n in zip(docs.columns, carried)))
    counts = [*(f"{c} long" for c in BASE), "classes array<long>", "common array<long>", "class_total long",
              "common_total long"]
    return plain.mapInArrow(run, ", ".join(["doc_id long", "lang string", *counts, *types]))


def js_distance(counts: Column, total: Column, reference: Column, ref_total: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; null if one is empty."""

    def part(p, m):  # p log2(p/m), 0 at p = 0
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def add(acc, x):
        m = (x["p"] + x["q"]) / 2
        return acc + (part(x["p"], m) + part(x["q"], m)) / 2

    shares = F.zip_with(counts, reference, lambda p, q: F.struct(
        F.try_divide(p, total).alias("p"), F.try_divide(q, ref_total).alias("q")))
    div = F.aggregate(shares, F.lit(0.0), add)
    return F.when((total > 0) & (ref_total > 0), F.sqrt(F.greatest(div, F.lit(0.0))))


def references(feats: DataFrame) -> DataFrame:
    """One row per language label: summed histograms and words."""
    return feats.groupBy("lang").agg(
        F.sum("n_words").alias("ref_words"),
        F.array(*(F.sum(F.col("classes")[k]) for k in range(len(CLASSES)))).alias("ref_classes"),
        F.array(*(F.sum(F.col("common")[k]) for k in range(len(COMMON_WORDS)))).alias("ref_common"),
        F.sum("class_total").alias("ref_class_total"), F.sum("common_total").alias("ref_common_total"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_class: float = 0.25, max_common: float = 0.75, slack: float = 0.6, min_words: int = 50,
          min_common: int = 20, min_reference: int = 2000, carry: bool = False) -> DataFrame:
    """Base counts, both distances, base_failed and kept for every row of `docs`.

    A histogram of few words strays from its reference by chance, hence both limits are
    raised by slack / sqrt(n_words).  With `carry` the columns of `docs` follow as c0, c1, ...
    """
    feats = features(docs, id_col, text_col, lang_col, carry)
    ref = references(features(docs, id_col, text_col, lang_col)).withColumnRenamed("lang", "ref_lang")
    fair = (F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference)
    room = slack / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))

    def near(name, limit):
        return F.col(name).isNull() | (F.col(name) <= limit + room)

    return (
        feats.join(ref, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
        .withColumn("class_distance", F.when(fair, js_distance(
            F.col("classes"), F.col("class_total"), F.col("ref_classes"), F.col("ref_class_total"))))
        .withColumn("common_distance", F.when(fair & (F.col("common_total") >= min_common), js_distance(
            F.col("common"), F.col("common_total"), F.col("ref_common"), F.col("ref_common_total"))))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & near("class_distance", max_class) & near("common_distance", max_common))
        .select("doc_id", *BASE, "base_failed", "kept", "class_distance", "common_distance",
                *(f"c{k}" for k in range(len(docs.columns)) if carry))
    )


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` the rules keep."""
    return judge(docs, carry=True, **options).where("kept").select(
        *(F.col(f"c{k}") for k in range(len(docs.columns)))).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents; distances to six places."""
    return judge(read(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("class_distance", "common_distance")})


QUERIES = {"op7_quality_rules": op7_quality_rules}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLASS_SQL = ["[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x09-\x0D\x1C-\x20]", r"[^.,;:''\x22-]", r"[^#*$%&|<>]"]
_SIZES = ", ".join(f"length(regexp_replace(t, '{c}', '', 'g')) AS k{k}" for k, c in enumerate(_CLASS_SQL))
_WORD_LIST = ", ".join(f"({k}, '{w}')" for k, w in enumerate(COMMON_WORDS))

ORACLE = {"op7_quality_rules": rf"""
    WITH docs AS MATERIALIZED (
        SELECT doc_id, lang, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    words AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
    threes AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS again
               FROM (SELECT doc_id, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words
                     WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE c IS NOT NULL),
    covered AS (SELECT doc_id, count(*) AS n_repeat_words
                FROM (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM threes WHERE again) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    sizes AS (SELECT doc_id, lang, strlen(t) AS bytes, length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS plain,
                     len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_SIZES}
              FROM docs),
    class_counts AS (
        SELECT doc_id, lang, unnest(range(8)) AS k,
               unnest([k0, k1, k2, k3, k4, k5, plain - k0 - k1 - k2 - k3 - k4 - k5, bytes - plain]) AS c FROM sizes),
    listed(k, word) AS (VALUES {_WORD_LIST}),
    met AS (SELECT doc_id, k, count(*) AS c
            FROM words JOIN listed ON word = trim(translate(w, '{_UPPER}', '{_LOWER}'), '.,;:!?') GROUP BY doc_id, k),
    common_counts AS (SELECT d.doc_id, d.lang, l.k, coalesce(m.c, 0) AS c
                      FROM docs d CROSS JOIN listed l LEFT JOIN met m ON m.doc_id = d.doc_id AND m.k = l.k),
    counts AS MATERIALIZED (SELECT 'class' AS kind, * FROM class_counts UNION ALL SELECT 'common', * FROM common_counts),
    refs AS MATERIALIZED (SELECT kind, lang, k, sum(c) AS rc FROM counts GROUP BY kind, lang, k),
    shares AS (
        SELECT doc_id, kind, c::DOUBLE / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0) AS p,
               rc::DOUBLE / nullif(sum(rc) OVER (PARTITION BY doc_id, kind), 0) AS q,
               sum(c) OVER (PARTITION BY doc_id, kind) AS total
        FROM counts JOIN refs USING (kind, k) WHERE counts.lang IS NOT DISTINCT FROM refs.lang),
    far AS (
        SELECT doc_id, kind, min(total) AS total, sqrt(greatest(0, sum(
                   CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                   + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
        FROM shares WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY doc_id, kind),
    ref_words AS (SELECT lang, sum(n_words) AS n FROM sizes GROUP BY lang),
    judged AS (
        SELECT s.doc_id, s.n_words, CAST(s.word_chars AS BIGINT) AS word_chars, s.k5 AS n_symbols,
               coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
               s.n_words < 50 OR 100 * coalesce(c.n_repeat_words, 0) > 50 * s.n_words AS base_failed,
               CASE WHEN s.n_words >= 50 AND r.n >= 2000 THEN a.d END AS class_distance,
               CASE WHEN s.n_words >= 50 AND r.n >= 2000 AND b.total >= 20 THEN b.d END AS common_distance
        FROM sizes s JOIN ref_words r ON r.lang IS NOT DISTINCT FROM s.lang
             LEFT JOIN lines l ON l.doc_id = s.doc_id LEFT JOIN covered c ON c.doc_id = s.doc_id
             LEFT JOIN far a ON a.doc_id = s.doc_id AND a.kind = 'class'
             LEFT JOIN far b ON b.doc_id = s.doc_id AND b.kind = 'common')
    SELECT * REPLACE (round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance),
           NOT base_failed AND coalesce(class_distance, 0) <= 0.25 + 0.6 / sqrt(n_words)
           AND coalesce(common_distance, 0) <= 0.75 + 0.6 / sqrt(n_words) AS kept
    FROM judged"""}
