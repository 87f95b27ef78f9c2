"""Registered queries of the text family with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline import fixtures as X
from cutline.operators import text as I
from cutline.sources import posts

QUERY = "sae"
SCOPES = [
    {"path": "", "type": "posts", "values": {"layout": "posts", "comments": "true"}},
    {"path": "", "values": {"layout": "default"}},
    {"path": "_posts/2016-", "type": "posts", "values": {"comments": "false"}},
]
HOST, BASE = "https://site.example", "/home"


def _parts(s, d):
    return X.table(s, d, "part").select("p_partkey", "p_name", "p_type")


def _posts(s, d):
    return posts.front_matter(X.posts(s, d))


def _a4(s, d):
    front = F.col("front")
    return _posts(s, d).select(
        "path", front["title"].alias("title"), front["lang"].alias("lang"),
        F.size("front").alias("n_keys"), F.md5(F.col("body").cast("binary")).alias("body_md5"),
    )


def _i5(s, d):
    mine = _posts(s, d).select("path", F.lit("posts").alias("type"), "front")
    web = X.table(s, d, "pages").select(
        F.col("url").alias("path"), F.lit("pages").alias("type"),
        F.create_map(F.lit("id"), F.col("page_id").cast("string")).alias("front"),
    )
    out = I.apply_defaults(mine.unionByName(web), SCOPES)
    front = F.col("front")
    return out.select(
        "path", "type", front["layout"].alias("layout"), front["comments"].alias("comments"),
        front["lang"].alias("lang"),
    )


def _i5_table(s, d):
    """The same scopes as a table, with one more for every month that posts have."""
    mine = _posts(s, d).select("path", F.lit("posts").alias("type"), "front")
    rows = [(o["path"], o.get("type"), k, key, value) for k, o in enumerate(SCOPES) for key, value in o["values"].items()]
    fixed = s.createDataFrame(rows, "path string, type string, ord int, key string, value string")
    month = F.substring("path", 1, 14)
    months = mine.select(month.alias("path")).distinct().select(
        "path", F.lit(None).cast("string").alias("type"), F.lit(9).alias("ord"), F.lit("month").alias("key"),
        F.substring("path", 8, 7).alias("value"))
    front = F.col("front")
    return I.apply_default_table(mine, fixed.unionByName(months)).select(
        "path", front["layout"].alias("layout"), front["comments"].alias("comments"), front["month"].alias("month"))


def _i6(s, d):
    ended = X.table(s, d, "pages").select("page_id", F.concat("url", F.lit("/index.html")).alias("url"))
    return I.canonical_url(ended, BASE, HOST)


def _i7(s, d):
    pages = X.table(s, d, "pages").select("page_id", "html")
    docs = X.table(s, d, "documents").select(
        (-1 - F.col("doc_id")).alias("page_id"), F.col("text").alias("html")
    )
    both = pages.unionByName(docs)
    return I.page_title(both, " - Site", "Site", I.html_title("html")).select("page_id", "shown_title")


def _i8(s, d):
    pages = X.table(s, d, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % 5 == 0).select("url").distinct()
    return I.exclude_paths(pages, listed)


QUERIES = {
    "i1_fuzzy_score": lambda s, d: I.fuzzy_scores(_parts(s, d), QUERY, ["p_name", "p_type"]).select(
        "p_partkey", "score"
    ),
    "i1_fuzzy_search": lambda s, d: I.fuzzy_search(
        _parts(s, d), QUERY, ["p_name", "p_type"], "p_partkey", k=25
    ).select("p_partkey", "score"),
    "i2_unencodable_chars": lambda s, d: I.unencodable_chars(X.table(s, d, "documents")),
    "i3_sanitize_text": lambda s, d: I.sanitize_text(X.table(s, d, "documents")),
    "i4_post_index": lambda s, d: I.post_index(_posts(s, d), "\n"),
    "i5_apply_defaults": _i5,
    "i5_default_table": _i5_table,
    "i6_canonical_url": _i6,
    "i7_page_title": _i7,
    "i8_exclude_paths": _i8,
    "a4_front_matter": _a4,
}

_SCORES = f"""
    names AS (SELECT p_partkey, lower(p_name) AS s FROM part
              UNION ALL SELECT p_partkey, lower(p_type) FROM part),
    walk AS (
        SELECT p_partkey, s, 0 AS i, 0 AS hits, 0 AS score, -2 AS prev FROM names
        UNION ALL
        SELECT p_partkey, s, i + 1,
               CASE WHEN s[i + 1] = '{QUERY}'[hits + 1] THEN hits + 1 ELSE hits END,
               CASE WHEN s[i + 1] = '{QUERY}'[hits + 1]
                    THEN score + CASE WHEN i = prev + 1 THEN 2 ELSE 1 END + CASE WHEN i = 0 THEN 3 ELSE 0 END
                    ELSE score END,
               CASE WHEN s[i + 1] = '{QUERY}'[hits + 1] THEN i ELSE prev END
        FROM walk WHERE i < len(s) AND hits < {len(QUERY)}),
    scored AS (SELECT p_partkey, max(CASE WHEN hits = {len(QUERY)} THEN score ELSE -1 END) AS score
               FROM walk GROUP BY p_partkey)"""

ORACLE = {
    "i1_fuzzy_score": f"WITH RECURSIVE {_SCORES.strip()} SELECT p_partkey, score FROM scored",
    "i1_fuzzy_search": f"""WITH RECURSIVE {_SCORES.strip()}
        SELECT p_partkey, score FROM scored WHERE score >= 0 ORDER BY score DESC, p_partkey LIMIT 25""",
    "i2_unencodable_chars": r"""
        WITH odd AS (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x7F]', '', 'g'), '') AS l FROM documents),
        uniq AS (SELECT doc_id, list_filter(l, lambda c, i: c <> '' AND list_position(l, c) = i) AS u FROM odd)
        SELECT doc_id, CAST(len(u) AS INTEGER) AS n_odd, coalesce(array_to_string(u[1:8], ''), '') AS shown FROM uniq""",
    "i3_sanitize_text": r"""
        SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text,
               CAST(len(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS INTEGER) AS n_replaced FROM documents""",
    "i4_post_index": """
        SELECT '_posts/' || strftime(date, '%Y-%m-%d') || '-' || doc_id || '.md' AS path, date,
               strftime(date, '%B %d, %Y') AS shown_date, 'Entry ' || doc_id AS title,
               '/' || strftime(date, '%Y/%m/%d') || '/' || doc_id || '.html' AS url,
               string_split(text, chr(10))[1] AS excerpt
        FROM (SELECT *, CAST(DATE '2016-01-01' + CAST(doc_id % 900 AS INTEGER) AS DATE) AS date FROM documents)""",
    "i5_apply_defaults": X.with_tables("posts", """
        SELECT path, 'posts' AS type, 'posts' AS layout,
               CASE WHEN path LIKE '\\_posts/2016-%' ESCAPE '\\' THEN 'false' ELSE 'true' END AS comments,
               regexp_extract(content, 'lang: (.*)', 1) AS lang
        FROM posts
        UNION ALL SELECT url, 'pages', 'default', NULL, NULL FROM pages"""),
    "i5_default_table": X.with_tables("posts", """
        SELECT path, 'posts' AS layout, CASE WHEN path LIKE '\\_posts/2016-%' ESCAPE '\\' THEN 'false' ELSE 'true' END AS comments,
               substr(path, 8, 7) AS month
        FROM posts"""),
    "i6_canonical_url": f"""
        SELECT page_id, url || '/index.html' AS url, '{HOST}{BASE}' || url || '/' AS canonical FROM pages""",
    "i7_page_title": """
        SELECT page_id, CASE WHEN t <> '' THEN t || ' - Site' ELSE 'Site' END AS shown_title
        FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t
              FROM (SELECT page_id, html FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents))""",
    "i8_exclude_paths": """
        SELECT page_id, url FROM pages p
        WHERE NOT EXISTS (SELECT 1 FROM pages x WHERE x.page_id % 5 = 0 AND x.url = p.url)""",
    "a4_front_matter": X.with_tables("posts", """
        SELECT '_posts/' || strftime(DATE '2016-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d')
                   || '-' || doc_id || '.md' AS path, 'Entry ' || doc_id AS title, lang,
               2 AS n_keys, md5(text) AS body_md5 FROM documents"""),
}
