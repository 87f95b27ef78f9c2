"""Personal data by rules and a semi-Markov conditional random field (operator 2).

The rules find email addresses, IP addresses, card and phone numbers of fixed shapes; what
they find stays.  The semi-Markov model adds spans the shapes miss (a phone number without
its plus, an address written with "(at)").  It scores whole candidate segments: features
look at the complete span, its digit groups, check digits and neighbours.  Dynamic
programming over the tokens near a digit or an at-sign, with entities of at most
`MAX_TOKENS` tokens, chooses boundaries and kinds of all spans together.

Weights are trained by gradient ascent on the conditional likelihood.  The training text is
a bounded sample of short passages around the first digit or at-sign of a document (at most
`sample` passages of `SNIPPET` characters, those with the smallest hash of the id), labelled
by the rules; some phone numbers and addresses in it are rewritten into looser forms, which
keep their label.

Edge cases: null and empty texts have no spans; a null id is kept; repeated rows give
repeated results; a sample without spans gives a model that adds none; an empty table gives
an empty table; `redact` keeps all other columns whatever their names are.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline.llm.common import read, slices, strings, texts

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 24
MAX_CHARS = 80
SNIPPET = 300

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed shapes, by kind and start.  Linear in the text."""
    out = []
    done = 0  # an address begins at the leftmost local character behind the last one
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                out.append((0, start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    if _NUMBER.search(text) is None:
        return out
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = list(_NUMBER.finditer(run.group()))
        for k in range(0, len(parts) - 3, 4):  # matches follow each other without overlap
            four = parts[k:k + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                out.append((1, run.start() + four[0].start(), run.start() + four[3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _only_digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_only_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- candidate segments -------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]+|[\[(]at[\])]", re.I)
_TOKEN = re.compile(r"[\[(](?:at|dot)[\])]|[^\W\d_]+|[0-9]+|\s+|.", re.I | re.S)
_AT = re.compile(r"@|[\[(]at[\])]", re.I)
_DOT = re.compile(r"[\[(]dot[\])]", re.I)
_STRICT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")


def regions(text: str, before: int = 48, after: int = 32) -> list[tuple[int, int]]:
    """Stretches of text around digits and at-signs; what lies further away is no entity."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def _side(c: str) -> str:
    if not c or c.isspace():
        return "gap"
    if c.isalnum():
        return "alnum"
    return c if c in ".-+@_/:" else "mark"


def _number_features(s: str) -> list[str]:
    groups = _NUMBER.findall(s)
    digits = sum(map(len, groups))
    seps = [x for x in re.split(r"[0-9]+", s) if x]
    kinds = set("".join(seps))
    lens = [len(g) for g in groups]
    out = [
        f"digits{digits if digits < 20 else 20}", f"open{s[0] if not s[0].isdigit() else 'd'}",
        f"close{s[-1] if not s[-1].isdigit() else 'd'}", f"groups{min(len(groups), 6)}",
        "seps" + ("none" if not kinds else "".join(sorted(kinds)) if len(kinds) < 3 else "many"),
    ]
    if len(seps) and max(map(len, seps)) > 2:
        out.append("wide")
    if s.count("(") != s.count(")") or s.count("(") > 1:
        out.append("parens")
    elif "(" in s:
        out.append("area")
    if "\n" in s:
        out.append("line")
    if kinds == {"."} and len(groups) == 4:
        out.append("quad" if all(int(g) <= 255 for g in groups if len(g) < 5) and max(lens) < 4 else "badquad")
    if 13 <= digits <= 19:
        out.append("luhn" if luhn("".join(groups)) else "noluhn")
    if lens[-2:] == [3, 4]:
        out.append("threefour")
    if len(groups) > 1 and set(lens) == {4}:
        out.append("fours")
    return out


def _address_features(s: str) -> list[str]:
    m = _AT.search(s)
    local, domain = s[:m.start()].rstrip(), s[m.end():].lstrip()
    plain = _DOT.sub(".", domain.replace(" ", ""))
    out = ["strict" if _STRICT.match(s) else "loose", "sign" if m.group() == "@" else "word",
           f"blanks{min(3, sum(c.isspace() for c in s))}", f"labels{min(4, plain.count('.') + 1)}"]
    out.append("local" if local and all(c in _LOCAL for c in local) else "badlocal")
    out.append("domain" if _DOMAIN.fullmatch(plain) else "baddomain")
    if re.search(r"\.[A-Za-z]{2,}$", plain):
        out.append("top")
    return out


@dataclass
class Lattice:
    """Candidate segments of one region: by end token, (start token, kind, features)."""

    starts: list[int]
    ends: list[int]
    segments: list[list[tuple[int, int, list[str]]]] = field(default_factory=list)


def lattice(text: str, a: int, b: int) -> Lattice:
    tokens = [(a + m.start(), a + m.end(), m.group()) for m in _TOKEN.finditer(text[a:b])]
    n = len(tokens)
    out = Lattice([t[0] for t in tokens], [t[1] for t in tokens], [[] for _ in range(n)])
    kind = []
    for _, _, s in tokens:
        kind.append("space" if s.isspace() else "num" if s[0].isdigit() and s.isascii() else "alpha" if s.isalpha()
                    else "at" if _AT.fullmatch(s) else "dot" if _DOT.fullmatch(s) else s)
    for i in range(n):
        if kind[i] not in ("num", "alpha", "+", "("):
            continue
        digits = letters = ats = 0
        number = True
        before = _side(text[tokens[i][0] - 1:tokens[i][0]])
        for j in range(i, min(n, i + MAX_TOKENS)):
            s = tokens[j][2]
            k = kind[j]
            if tokens[j][1] - tokens[i][0] > MAX_CHARS and j > i:
                break
            digits += len(s) if k == "num" else 0
            letters += k == "alpha"
            ats += k == "at"
            number &= k in ("num", "space", "+", "(", ")", ".", "-", "/")
            if ats > 1 or digits > 24 or (k == "space" and "\n" in s) or not (number or ats or k in (
                    "num", "alpha", ".", "_", "-", "+", "%", "space", "dot")):
                break
            if k not in ("num", "alpha"):
                continue
            after = _side(text[tokens[j][1]:tokens[j][1] + 1])
            around = [f"before{before}", f"after{after}"]
            if number and digits >= 4:
                feats = _number_features(text[tokens[i][0]:tokens[j][1]]) + around
                out.segments[j] += [(i, t, feats) for t in (1, 2, 3)]
            elif ats and letters and j > i + 1 and not number:
                feats = _address_features(text[tokens[i][0]:tokens[j][1]])
                if "badlocal" not in feats:
                    out.segments[j].append((i, 0, feats + around))
    return out


# --- the model ----------------------------------------------------------------------


def _score(weights: dict, kind: int, feats: list[str]) -> float:
    own = weights.get(kind)
    return own.get("", 0.0) + sum(own.get(f, 0.0) for f in feats) if own else -math.inf


def best_segments(weights: dict, lat: Lattice, margin: float = 0.0) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the highest-scoring segmentation; a segment must gain `margin`."""
    n = len(lat.segments)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(n):
        top, via = best[j], None
        for i, kind, feats in lat.segments[j]:
            s = best[i] + _score(weights, kind, feats) - margin
            if s > top:
                top, via = s, (i, kind)
        best[j + 1], back[j + 1] = top, via
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, lat.starts[i], lat.ends[j - 1]))
            j = i
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expected(weights: dict, lat: Lattice) -> tuple[float, list[tuple[int, list[str], float]]]:
    """(log partition sum, [(kind, features, posterior)] of all candidate segments)."""
    n = len(lat.segments)
    scores = [[_score(weights, k, f) for _, k, f in seg] for seg in lat.segments]
    fwd = [0.0] * (n + 1)
    for j in range(n):
        fwd[j + 1] = _log_sum([fwd[j], *(fwd[i] + s for (i, _, _), s in zip(lat.segments[j], scores[j]))])
    bwd = [0.0] * (n + 1)
    gather: list[list[float]] = [[] for _ in range(n + 1)]
    for j in range(n - 1, -1, -1):
        # everything that starts at token j + 1 has been gathered
        bwd[j + 1] = _log_sum(gather[j + 1]) if gather[j + 1] else 0.0
        gather[j].append(bwd[j + 1])
        for (i, _, _), s in zip(lat.segments[j], scores[j]):
            gather[i].append(s + bwd[j + 1])
    total = fwd[n]
    return total, [
        (k, f, math.exp(fwd[i] + s + bwd[j + 1] - total))
        for j in range(n) for (i, k, f), s in zip(lat.segments[j], scores[j])
    ]


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3,
          decay: float = 1e-3, seed: int = 3) -> dict:
    """Weights {kind: {feature: weight}} from (text, spans)."""
    weights: dict = {k: {"": -4.0} for k in range(len(KINDS))}
    cases = []
    for text, spans in examples:
        for a, b in regions(text):
            lat = lattice(text, a, b)
            gold, free = [], True
            start_at = {s: k for k, s in enumerate(lat.starts)}
            end_at = {e: k for k, e in enumerate(lat.ends)}
            for kind, s, e in spans:
                if s < b and e > a:
                    i, j = start_at.get(s), end_at.get(e)
                    hit = [f for x, k, f in lat.segments[j] if (x, k) == (i, kind)] if i is not None and j is not None else []
                    if hit:
                        gold.append((kind, hit[0]))
                    else:
                        free = False  # a span the lattice cannot express
            if free and any(lat.segments):
                cases.append((lat, gold))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in rng.permutation(len(cases)):
            lat, gold = cases[k]
            change: dict = {}
            for kind, feats, p in expected(weights, lat)[1]:
                if p > 1e-6:
                    for f in ("", *feats):
                        change[kind, f] = change.get((kind, f), 0.0) - p
            for kind, feats in gold:
                for f in ("", *feats):
                    change[kind, f] = change.get((kind, f), 0.0) + 1
            for (kind, f), g in change.items():
                w = weights[kind].get(f, 0.0)
                weights[kind][f] = w + step * (g - decay * w)
    found = {k for _, gold in cases for k, _ in gold}
    return {k: w for k, w in weights.items() if k in found}


def _loosen(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The passage with phone numbers and addresses in looser forms, and their spans."""
    out, new, at = "", [], 0
    taken = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < taken:
            continue
        taken = b
        s = text[a:b]
        if kind == 3:
            s = re.sub(r"^\+[0-9]{1,3}[\x20.-]?(?=.)", "", s) or s
        elif kind == 0:
            s = s.replace("@", (" [at] ", "(at)", " (at) ")[a % 3])
        out += text[at:a]
        new.append((kind, len(out), len(out) + len(s)))
        out += s
        at = b
    return out + text[at:], new


def fit(docs: DataFrame, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Weights learned from the bounded sample of passages of `docs`."""
    rows = texts(docs, id_col, text_col)
    at = F.regexp_instr("text", F.lit("[0-9@]"))
    picked = (
        rows.select("doc_id", "text", at.alias("at")).where("at > 0")
        .select(F.xxhash64("doc_id").alias("h"),
                F.substring("text", F.greatest(F.col("at") - 80, F.lit(1)), F.lit(SNIPPET)).alias("passage"))
        .orderBy("h", "passage").limit(sample).collect()
    )
    examples = []
    for r in picked:
        passage = r.passage[: r.passage.rfind(" ")] if len(r.passage) == SNIPPET and " " in r.passage else r.passage
        spans = base_spans(passage)
        examples.append((passage, spans))
        if any(k in (0, 3) for k, _, _ in spans):
            examples.append(_loosen(passage, spans))
    return train(examples)


def all_spans(text: str, weights: dict, margin: float = 1.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), each by kind and start."""
    base = base_spans(text)
    found = list(base)
    for a, b in regions(text):
        near = [(s, e) for _, s, e in base if s < b and e > a]
        for span in best_segments(weights, lattice(text, a, b), margin):
            if all(span[2] <= s or span[1] >= e for s, e in near):
                found.append(span)
    return base, sorted(found)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: dict | None = None, margin: float = 1.0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest are of the base spans."""
    weights = fit(docs, id_col=id_col, text_col=text_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                both = [all_spans(t, weights, margin) for t in strings(part, "text")]
                counts = [[sum(k == kind for k, _, _ in b) for b, _ in both] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b, _ in both], pa.string()),
                     pa.array([_join(x) for _, x in both], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or chain of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, weights: dict | None = None, margin: float = 1.0, id_col: str = "doc_id",
           text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """`docs` with the spans in its texts replaced; `chars_col`, if there, follows the new text."""
    weights = fit(docs, id_col=id_col, text_col=text_col) if weights is None else weights
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    size = docs.columns.index(chars_col) if chars_col in docs.columns else None
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, names[at]):
                held = part.column(at).to_pylist()
                new = [None if t is None else masked(t, all_spans(t, weights, margin)[1]) for t in held]
                cols = list(part.columns)
                cols[at] = pa.array(new, cols[at].type)
                if size is not None and pa.types.is_integer(cols[size].type):
                    n = [old if t is None else len(t) for old, t in zip(cols[size].to_pylist(), new)]
                    cols[size] = pa.array(n, cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return find(read(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": op2_pii}
ORACLE: dict[str, str] = {}
