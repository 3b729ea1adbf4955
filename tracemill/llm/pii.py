"""Personal data by weak supervision.

Patterns with checks give the base spans, which always stay. They and further candidates (credential-like strings, long
numbers that fail their check) are voted on by labelers: known shapes, gazetteers, context, mixture of characters, and
checksums. Counts of vote patterns over all documents go through expectation-maximisation, which estimates each labeler's
reliability for either class without labelled data. The resulting soft labels train a logistic span classifier over
features of the span itself, which decides on the further candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, documents

#: Least share of right votes that a labeler is granted.
RIGHT = 0.75
KINDS = ("email", "ip", "card", "phone", "secret", "id")
_ORDER = {k: i for i, k in enumerate(KINDS)}
# Patterns. Possessive and anchored forms match what the plain ones do, in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+")
_DIGIT = re.compile(r"[0-9]")
_SHAPE = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}")
_BEFORE = re.compile(r"([A-Za-z_]+)[\"' ]*[=:]?[\"' ]*\Z")
# Gazetteers.
KEYWORDS = frozenset("password passwd pwd secret token key apikey api_key access auth bearer credential login".split())
ENDINGS = frozenset("com org net edu gov io de fr es uk info".split())
CONTEXT = frozenset("mail email e-mail contact phone tel call fax card visa ip host address id account".split())


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans as (start, kind's place, end), in order; and long numbers that failed the card check."""
    found, failed = [], []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found), failed


def _votes(text: str, start: int, kind: int, end: int, passed: bool) -> str:
    """One letter for each labeler: y, n, or - where it abstains."""
    span = text[start:end]
    before = _BEFORE.search(text, max(0, start - 24), start)
    word = before[1].lower() if before else ""
    mixed = any(map(str.isdigit, span)) and any(map(str.isalpha, span))
    shape = "y" if _SHAPE.fullmatch(span) else "n" if kind == 4 else "-"
    names = "y" if word in KEYWORDS or kind == 0 and span.rpartition(".")[2].lower() in ENDINGS else "-"
    context = "y" if word in CONTEXT or text[start - 1 : start] in ("=", '"', "'", ":", "(") and start else "n" if text[start - 1 : start].isalnum() and start else "-"
    blend = "y" if kind == 4 and mixed and sum(map(str.isdigit, span)) >= 4 else "n" if kind == 4 else "-"
    check = "y" if passed and kind in (1, 2) else "n" if kind in (1, 2, 5) else "-"
    form = "y" if kind == 3 or kind == 2 and len(span) == 16 else "n" if kind == 5 and len(span) > 16 else "-"
    return shape + names + context + blend + check + form


def _traits(text: str, start: int, kind: int, end: int) -> list[int]:
    """Features of the span for the final classifier, each a small whole number."""
    span = text[start:end]
    digits, upper, lower = (sum(map(f, span)) for f in (str.isdigit, str.isupper, str.islower))
    n = end - start
    edge = sum(1 for c in (text[start - 1 : start] if start else "", text[end : end + 1]) if c.isalnum())
    return [kind, min(n // 6, 9), digits * 4 // n, upper * 4 // n, lower * 4 // n, edge, len(set(span)) * 4 // n]


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(start, kind, end, base, votes, traits) of base spans and of further candidates that overlap none of them."""
    base, failed = base_spans(text)
    out = [(a, k, b, True) for a, k, b in base]
    if _DIGIT.search(text):
        more = [(a, 5, b) for a, _, b in failed] + [(m.start(), 4, m.end()) for m in _SECRET.finditer(text)]
        taken = sorted((a, b) for a, _, b in base)
        i, reach = 0, 0
        for a, k, b in sorted(more):
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                out.append((a, k, b, False))
                reach = b
    return [(a, k, b, own, _votes(text, a, k, b, own), _traits(text, a, k, b)) for a, k, b, own in sorted(out)]


def reliabilities(patterns: dict[tuple[str, bool], float], rounds: int = 100) -> tuple[float, np.ndarray]:
    """EM over counts of (votes, base): the share of true ones among further candidates, and P(vote | class) as (class,
    labeler, y/n/-).

    Base spans are true by definition and stay at 1; the others start from their votes' majority. Base spans tell how
    labelers vote on true spans, but not how many of the others are true. An abstention says nothing about the class. A
    labeler that votes is held to be right in `RIGHT` of the cases of a class at least: where all spans of a pattern vote
    alike, counts alone could turn its meaning round.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    base = np.array([b for _, b in keys], dtype=bool)
    width = len(keys[0][0]) if keys else 0
    code = np.array([["yn-".index(c) for c in v] for v, _ in keys], dtype=int).reshape(len(keys), width)
    p = np.array([0.5 + 0.4 * np.tanh(((c == 0).sum() - (c == 1).sum()) / 2) for c in code])
    p[base] = 1.0
    share, table = 0.5, np.ones((2, width, 3))
    for _ in range(rounds):
        for cls, w in ((1, n * p), (0, n * (1 - p))):
            for j in range(width):
                seen = np.bincount(code[:, j], weights=w, minlength=3)[:2] + ((4, 1) if cls else (1, 4))
                right = max(RIGHT, seen[1 - cls] / seen.sum())
                table[cls, j, :2] = (right, 1 - right) if cls else (1 - right, right)
        share = ((n * p)[~base].sum() + 1) / (n[~base].sum() + 2)
        after = np.array([1.0 if b else posterior(v, share, table) for v, b in keys])
        if np.abs(after - p).max(initial=0) < 1e-9:
            break
        p = after
    return float(share), table


def posterior(votes: str, share: float, table: np.ndarray) -> float:
    x = np.log(share / (1 - share)) + sum(np.log(table[1, j, "yn-".index(c)] / table[0, j, "yn-".index(c)]) for j, c in enumerate(votes))
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _dummies(traits: list[int]) -> list[tuple[int, int]]:
    return list(enumerate(traits))


def classifier(rows: list[tuple[str, list[int], bool, int]]) -> dict[tuple[int, int], float]:
    """Weights by (trait, value), and the intercept under (-1, 0): ridge logistic regression on EM's soft labels."""
    patterns: dict[tuple[str, bool], float] = {}
    for votes, _, base, n in rows:
        patterns[votes, base] = patterns.get((votes, base), 0) + n
    share, table = reliabilities(patterns)
    names = sorted({d for _, t, _, _ in rows for d in _dummies(t)})
    place = {d: i for i, d in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (_, t, _, _) in enumerate(rows):
        x[i, [place[d] for d in _dummies(t)]] = 1
    y = np.array([1.0 if b else posterior(v, share, table) for v, _, b, _ in rows])
    n = np.array([c for _, _, _, c in rows], dtype=float)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.1)
    for _ in range(40 if rows else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip([*names, (-1, 0)], w.tolist(), strict=True))


def _accepts(weights: dict[tuple[int, int], float], traits: list[int]) -> bool:
    return sum((weights.get(d, 0.0) for d in _dummies(traits)), weights.get((-1, 0), 0.0)) > 0


_CANDIDATES = "found array<struct<start:long,kind:int,end:long,base:boolean,votes:string,traits:array<int>>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the candidates of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("traits", pa.list_(pa.int32()))]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return documents(docs).mapInArrow(run, f"doc_id long, {_CANDIDATES}")


def train(found: DataFrame) -> dict[tuple[int, int], float]:
    """The span classifier from all candidates. Only counts of distinct (votes, traits, base) reach the driver: both take
    small whole values, by far most combinations cannot occur (a kind has its own lengths and characters), and the number
    does not grow with the documents."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.votes", "c.traits", "c.base").agg(F.count(F.lit(1)).alias("n"))
    return classifier(sorted((r["votes"], list(r["traits"]), r["base"], r["n"]) for r in each.collect()))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points), n_added for every row.

    Null text counts as empty and has no spans. Repeated rows are each returned, a null doc_id like any other; an empty
    table gives an empty result; other columns are ignored.
    """
    found = Scratch(docs.sparkSession).save(scan(docs), "candidates")
    weights = train(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = [(c["start"], c["kind"], c["end"]) for c in found if c["base"]]
                more = [(c["start"], c["kind"], c["end"]) for c in found if not c["base"] and _accepts(weights, c["traits"])]
                kinds = [k for _, k, _ in base]
                rows.append((doc, *map(kinds.count, range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (5, 6) else pa.int64()) for i, c in enumerate(columns)], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    return found.mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets, and n_chars, where there is one, counted anew.

    Overlapping spans are replaced together, under the kind of the first. Null text stays null. Rows that repeat are each
    returned, a null doc_id like any other; an empty table gives an empty result.
    """
    weights = train(scan(docs))
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str) -> str:
        out, at, reach = [], 0, 0
        for a, k, b, own, _, traits in candidates(text):
            if own or _accepts(weights, traits):
                if a >= reach:
                    out += [text[at:a], f"[{KINDS[k].upper()}]"]
                reach = max(reach, b)
                at = reach
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else clean(t) for t in batch.column(text_at).to_pylist()]
            batch = batch.set_column(text_at, batch.schema.field(text_at), pa.array(texts, batch.schema.field(text_at).type))
            if chars_at is not None:
                kind = batch.schema.field(chars_at)
                batch = batch.set_column(chars_at, kind, pa.array([None if t is None else len(t) for t in texts], kind.type))
            yield batch

    return bounded(docs).mapInArrow(run, docs.schema)
