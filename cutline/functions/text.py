"""Text expressions: fuzzy scores and character sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII = r"\x00-\x7F"


def fuzzy_score(query: str, col: str) -> Column:
    """Greedy subsequence score of a case-folded query in a column.

    A hit counts 2 right after the previous hit, else 1, plus 3 at index 0.  An
    incomplete match is -1 and an empty query 0.
    """
    q = query.lower()
    if not q:
        return F.lit(0)
    wanted = "array(" + ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in q) + ")"
    return F.expr(
        f"""aggregate(split(lower({col}), ''),
            named_struct('hits', 0, 'score', 0, 'prev', -2, 'i', 0),
            (s, c) -> if(c = get({wanted}, s.hits),
                named_struct('hits', s.hits + 1,
                    'score', s.score + if(s.i = s.prev + 1, 2, 1) + if(s.i = 0, 3, 0),
                    'prev', s.i, 'i', s.i + 1),
                named_struct('hits', s.hits, 'score', s.score, 'prev', s.prev, 'i', s.i + 1)),
            s -> if(s.hits = {len(q)}, s.score, -1))"""
    )


def odd_characters(col: str, allowed: str = ASCII) -> Column:
    """The text without line breaks and allowed characters (a regex class)."""
    return F.regexp_replace(col, f"[{allowed}\\n\\r]+", "")


def replaced(col: str, allowed: str = ASCII) -> Column:
    """The text with every other character turned into a question mark."""
    return F.regexp_replace(col, f"[^{allowed}\\n\\r]", "?")
