"""Text, posts and page metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.text import ASCII, fuzzy_score, odd_characters, replaced
from cutline.plans.stage import stage


def fuzzy_scores(df: DataFrame, query: str, cols: Sequence[str]) -> DataFrame:
    """Adds score, the best over `cols`."""
    each = [fuzzy_score(query, c) for c in cols]
    return df.withColumn("score", each[0] if len(each) == 1 else F.greatest(*each))


def fuzzy_search(
    df: DataFrame, query: str, cols: Sequence[str], order: str, k: int | None = None
) -> DataFrame:
    """Matching rows, best first, ties in `order`; optionally only the top k."""
    out = fuzzy_scores(df, query, cols).where("score >= 0").orderBy(F.desc("score"), order)
    return out if k is None else out.limit(k)


def unencodable_chars(docs: DataFrame, allowed: str = ASCII, show: int = 8) -> DataFrame:
    """Distinct characters outside the set per document, and the first few of them."""
    odd = F.array_distinct(F.split(odd_characters("text", allowed), ""))
    odd = F.filter(odd, lambda c: c != "")
    return docs.select(
        "doc_id", F.size(odd).alias("n_odd"),
        F.array_join(F.slice(odd, 1, show), "").alias("shown"),
    )


def sanitize_text(docs: DataFrame, allowed: str = ASCII) -> DataFrame:
    """Text with unencodable characters replaced by "?", and how many were.

    The count is the number of question marks gained, cheaper than a second regex.
    """
    def marks(col: str) -> Column:
        return F.length(col) - F.length(F.replace(F.col(col), F.lit("?"), F.lit("")))

    return docs.select("doc_id", "text", replaced("text", allowed).alias("clean")).select(
        "doc_id", F.col("clean").alias("text"), (marks("clean") - marks("text")).alias("n_replaced")
    )


def post_index(posts: DataFrame, separator: str = "\n\n") -> DataFrame:
    """posts(path, front, body), newest first: date, title, link and excerpt."""
    pattern = r"_posts/(\d{4})-(\d{2})-(\d{2})-(.+)\.\w+$"
    part = [F.regexp_extract("path", pattern, i) for i in range(1, 5)]
    day = F.make_date(*[p.cast("int") for p in part[:3]])
    return (
        posts.where(F.col("path").rlike(pattern))
        .select(
            "path", day.alias("date"), F.date_format(day, "MMMM dd, yyyy").alias("shown_date"),
            F.coalesce(F.col("front")["title"], part[3]).alias("title"),
            F.concat(F.lit("/"), F.array_join(F.array(*part), "/"), F.lit(".html")).alias("url"),
            F.substring_index("body", separator, 1).alias("excerpt"),
        )
        .orderBy(F.desc("date"), "path")
    )


def apply_defaults(pages: DataFrame, scopes: Sequence[dict]) -> DataFrame:
    """pages(path, type, front) with the values of all matching scopes filled in.

    A scope is {"path": prefix, "type": type or None, "values": {...}}.  Longer
    prefixes beat shorter ones, a named type beats none, later entries win ties and
    a page's own front matter beats every scope.  Scopes are configuration, so they
    become expressions and pages are not joined.
    """
    ranked = sorted(
        enumerate(scopes), key=lambda s: (len(s[1].get("path", "")), bool(s[1].get("type")), s[0])
    )
    wanted: dict[str, list[Column]] = {}
    for _, scope in ranked:
        fits = F.col("path").startswith(scope.get("path", ""))
        if scope.get("type"):
            fits = fits & (F.col("type") == scope["type"])
        for key, value in scope["values"].items():
            wanted.setdefault(key, []).insert(0, F.when(fits, str(value)))
    values = {k: F.coalesce(F.col("front")[k], *cols) for k, cols in wanted.items()}
    filled = F.map_from_arrays(
        F.array(*[F.lit(k) for k in values]), F.array(*values.values())
    )
    own = F.map_filter("front", lambda k, _: ~k.isin(list(values)))
    return pages.withColumn("front", F.map_concat(own, filled))


def apply_default_table(pages: DataFrame, scopes: DataFrame) -> DataFrame:
    """As `apply_defaults`, for any number of scopes in a table (path, type, ord, key, value).

    A page's path is expanded to its prefixes, of the lengths that scopes have, and these are
    joined by hash with the scopes of that path: no page meets a scope that does not match it.
    Of the values found for a key the most specific wins.  Pages of one path and type are
    looked up once.
    """
    named = F.when(F.col("type") != "", F.col("type"))
    rules = scopes.select(
        F.coalesce("path", F.lit("")).alias("scope"), named.alias("only"), "key", "value",
        F.struct(F.length(F.coalesce("path", F.lit(""))).alias("n"), named.isNotNull().alias("typed"), "ord").alias("rank"))
    rules = stage(rules.groupBy("scope", "only", "key").agg(
        F.max_by("value", "rank").alias("value"), F.max("rank").alias("rank")), "rules")
    sizes = sorted(r[0] for r in rules.select(F.length("scope")).distinct().collect())  # no more than the longest path
    if not sizes:
        return pages
    kinds = pages.select("path", "type").distinct()
    size = F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("path"))).alias("n")
    prefixes = kinds.select("path", "type", size).select("path", "type", F.substring("path", F.lit(1), F.col("n")).alias("scope"))
    hits = prefixes.join(rules, "scope").where(F.col("only").isNull() | (F.col("only") == F.col("type")))
    best = hits.groupBy("path", "type", "key").agg(F.max_by("value", "rank").alias("value"))
    filled = best.groupBy("path", "type").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__filled"))
    filled = filled.withColumnsRenamed({"path": "__path", "type": "__type"})
    none = F.create_map().cast("map<string,string>")
    own, more = F.coalesce("front", none), F.coalesce("__filled", none)
    front = F.map_concat(
        F.map_filter(own, lambda k, v: v.isNotNull() | ~F.map_contains_key(more, k)),
        F.map_filter(more, lambda k, _: F.get(F.array(own[k]), F.lit(0)).isNull()))
    joined = pages.join(
        filled, F.col("path").eqNullSafe(F.col("__path")) & F.col("type").eqNullSafe(F.col("__type")), "left")
    return joined.withColumn("front", front).select(*pages.columns)


def canonical_url(pages: DataFrame, base: str = "", host: str = "", col: str = "url") -> DataFrame:
    """Adds canonical: the path without index.html below host and base."""
    return pages.withColumn(
        "canonical", F.concat(F.lit(host + base), F.replace(F.col(col), F.lit("index.html"), F.lit("")))
    )


def html_title(col: str) -> Column:
    return F.regexp_extract(col, r"(?is)<title>(.*?)</title>", 1)


def page_title(pages: DataFrame, suffix: str, site_title: str, title: Column) -> DataFrame:
    """Adds shown_title: the page's own title with a suffix, else the site's."""
    own = F.when(F.length(title) > 0, title)
    return pages.withColumn(
        "shown_title", F.coalesce(F.concat(own, F.lit(suffix)), F.lit(site_title))
    )


def exclude_paths(pages: DataFrame, excluded: DataFrame, col: str = "url") -> DataFrame:
    """Pages whose path is not listed."""
    return pages.join(excluded.select(col), col, "left_anti")
