"""How well a document covers a query, word by word: the one step that depends on the order in which words are matched.

Matching is greedy: each match uses up its words. That is not a join, so it runs as an Arrow function, on no more than the best
candidates of each query. What is made of the features is a Column expression again, see trawl.operators.fuse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.similarity import damerau
from trawl.functions.text import DELIMITERS
from trawl.plans.config import CoverageConfig

#: Pairs of a query and a text whose features a task keeps, in case they come again.
KEPT_FEATURES = 10_000
_WORD = re.compile("[^" + re.escape(DELIMITERS) + "]+")

FEATURES = [
    ("terms_count", "int"), ("terms_any", "int"), ("terms_full", "int"), ("terms_strict", "int"), ("terms_prefix", "int"), ("first_match", "int"), ("sum_ci", "double"),
    ("doc_tokens", "int"), ("word_hits", "int"), ("longest_prefix_run", "int"), ("suffix_prefix_run", "int"), ("phrase_span", "int"), ("preceding_strict", "int"),
    ("last_has_prefix", "boolean"), ("last_is_type_ahead", "boolean"), ("idf_coverage", "double"), ("total_idf", "double"), ("missing_idf", "double"), ("weighted_coverage", "double"),
    ("last_ci", "double"), ("coverage_score", "int"), ("lcs", "int"), ("dominant", "boolean"), ("strong_anchor", "boolean"),
    ("query_tokens", "int"), ("prefix_last", "boolean"), ("perfect_doc", "boolean"), ("stem_evidence", "boolean"), ("anchor_stem", "boolean"),
    ("trailing_density", "int"), ("lexical_sim", "int"), ("single_char_boost", "int"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FEATURES)
_ARROW = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass
class Query:
    text: str
    tokens: list[str]
    gram_idf: list[float]
    word_idf: list[float]
    every: list[str] = field(init=False)

    def __post_init__(self):
        self.every = _WORD.findall(self.text)


def _common_prefix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def lcs(query: str, text: str, config: CoverageConfig) -> int:
    """len(query) if the text contains it, else their common prefix and a tolerance more."""
    if query in text:
        return len(query)
    p = _common_prefix(query, text)
    tolerance = int(len(query) * config.lcs_tolerance) if len(query) >= config.lcs_min_query else 0
    return min(p + tolerance, len(query), len(text)) if p else 0


class _State:
    """What the words of one query have found in one document so far."""

    def __init__(self, query: list[str], doc: list[tuple[int, str]]):
        self.q, self.d = query, doc
        self.q_on, self.d_on = [True] * len(query), [True] * len(doc)
        self.matched = [0.0] * len(query)
        self.whole, self.joined, self.prefix = ([False] * len(query) for _ in range(3))
        self.pos = [-1] * len(query)
        self.hits = 0
        self.n_whole = self.n_joined = self.n_affix = self.n_fuzzy = self.penalty = 0.0

    def hit(self, i: int, j: int, points: float) -> None:
        self.matched[i] += points
        at = self.d[j][0]
        if self.pos[i] < 0 or at < self.pos[i]:
            self.pos[i] = at
        self.q_on[i] = self.d_on[j] = False


def _whole(s: _State) -> None:
    for i, q in enumerate(s.q):
        j = next((j for j, (_, d) in enumerate(s.d) if s.d_on[j] and d == q), None)
        if j is None:
            continue
        s.hits += 1
        s.n_whole += len(q) + (i != len(s.q) - 1)
        s.penalty += not (i < len(s.d) and s.d[i][1] == q)
        s.whole[i] = s.prefix[i] = True
        s.hit(i, j, len(q))


def _joined(s: _State) -> None:
    for i, q in enumerate(s.q):
        k = next((k for k in range(i + 1, len(s.q)) if s.q_on[k]), None)
        if not s.q_on[i] or i + 1 >= len(s.q) or not s.q_on[i + 1] or k is None:
            continue
        other = s.q[k]
        j = next((j for j, (_, d) in enumerate(s.d) if s.d_on[j] and len(d) == len(q) + len(other) and d.startswith(q) and d.endswith(other)), None)
        if j is None:
            continue
        s.hits += 2
        s.n_joined += len(q) + len(other)
        s.joined[i] = s.joined[k] = s.prefix[i] = True
        s.hit(i, j, len(q))
        s.hit(k, j, len(other))
    for a in range(len(s.d) - 1):
        if not (s.d_on[a] and s.d_on[a + 1]):
            continue
        x, y = s.d[a][1], s.d[a + 1][1]
        i = next((i for i, q in enumerate(s.q) if s.q_on[i] and len(q) == len(x) + len(y) and q.startswith(x) and q.endswith(y)), None)
        if i is None:
            continue
        s.hits += 1
        s.n_joined += len(s.q[i])
        s.joined[i] = s.prefix[i] = True
        s.hit(i, a, len(s.q[i]))
        s.d_on[a + 1] = False


def _affix(s: _State) -> None:
    qs = sorted((i for i in range(len(s.q)) if s.q_on[i]), key=lambda i: -len(s.q[i]))
    ds = sorted((j for j in range(len(s.d)) if s.d_on[j]), key=lambda j: -len(s.d[j][1]))

    def part(q: str, d: str) -> tuple[float, bool]:
        if len(q) < len(d):
            if d.startswith(q):
                return len(q), True
            if d.endswith(q):
                return max(1, len(q) // 2), False
            return (len(q) * 0.6, False) if len(q) >= 4 and q in d else (0, False)
        return (len(d), False) if len(q) > len(d) and q.endswith(d) else (0, False)

    def near(q: str, d: str) -> tuple[float, bool]:
        n = len(q)
        if n >= len(d):
            return 0, False
        for size, most in ((n, n), (n + 1, n), (n - 1, n - 1)):
            if size and (e := damerau(q, d[:size], 1)) <= 1:
                return max(most - e, 0.1), False
        return 0, False

    for find, may in ((part, lambda i: True), (near, lambda i: len(s.q[i]) >= 4 or (i == len(s.q) - 1 and len(s.q[i]) >= 2))):
        for i in qs:
            if not s.q_on[i] or not may(i):
                continue
            for j in ds:
                if not s.d_on[j]:
                    continue
                points, begins = find(s.q[i], s.d[j][1])
                if points:
                    s.n_affix += points
                    s.hits += 1
                    s.prefix[i] |= begins
                    s.hit(i, j, points)
                    break


def _fuzzy(s: _State, config: CoverageConfig) -> None:
    def most(q: str) -> int:
        if len(q) > config.max_edited_word:
            return 0
        d = 2 if len(q) >= config.min_len_two_typos else 1 if len(q) >= config.min_len_one_typo or len(q) == 2 else 0
        return min(d, config.typos)

    allowed = [most(q) for q in s.q]
    for edits in range(1, max((a for a, on in zip(allowed, s.q_on) if on), default=0) + 1):
        for i, q in enumerate(s.q):
            if not s.q_on[i] or allowed[i] < edits:
                continue
            low, high = max(config.min_word, len(q) - edits), min(config.max_fuzzy_word, len(q) + edits, config.max_edited_word)
            for j, (_, d) in enumerate(s.d):
                if not s.d_on[j] or not low <= len(d) <= high or (len(q) == 2 and d[0] != q[0]):
                    continue
                e = damerau(q, d, edits)
                if e <= edits:
                    s.n_fuzzy += len(q) - e
                    s.hits += 1
                    s.hit(i, j, len(q) - e)
                    break


def _single_term_similarity(q: str, doc: list[str]) -> float:
    """The best of what the document's words have in common with a lone query word, 0 to 1."""
    n, best = len(q), 0.0
    if n < 3:
        return 0.0
    for t in doc:
        if len(t) < 2:
            continue
        at = q.find(t)
        if at >= 0:
            best = max(best, len(t) / n * (1 - at / n))
            continue
        overlap = next((k for k in range(min(n, len(t)), 1, -1) if q.endswith(t[:k])), 0)
        e = damerau(q, t, 2) if len(t) <= 32 else 3
        best = max(best, overlap / n, (n - e) / n if e <= 2 else 0.0)
    if n >= 6:
        k = min(6, n // 2)
        head, tail = q[:k], q[n - k :]
        long = [(i, t) for i, t in enumerate(doc) if len(t) >= 3]
        a = next((i for i, t in long if t.startswith(head) or head.startswith(t)), None)
        b = next((i for i, t in long if t.endswith(tail) or tail.endswith(t)), None)
        if a is not None and b is not None and a != b:
            best = max(best, min(1.0, 2 * k / n))
    return best


def _single_char_boost(query: list[str], doc: str, places: list[tuple[int, str]]) -> int:
    """For a last query word of one letter: the words before it lie in the document in their order, and the next word, one white
    space further, begins with the letter."""
    if len(query) < 2 or len(query[-1]) != 1:
        return 0
    at, first, last = 0, None, None
    for w in query[:-1]:
        hit = next((k for k in range(at, len(places)) if w in places[k][1]), None)
        if hit is None:
            return 0
        first = hit if first is None else first
        at, last = hit + 1, hit
    if last + 1 >= len(places):
        return 0
    (p, w), (p2, w2) = places[last], places[last + 1]
    if not w2.startswith(query[-1]) or not doc[p + len(w) : p2].isspace():
        return 0
    return 8 + max(0, 16 - first) + 4 * (len(w2) == 1)


def features(query: Query, text: str, config: CoverageConfig | None = None) -> dict:
    """The features of one query and one document. Texts compare in lower case; a null or empty one has no words."""
    config = config or CoverageConfig()
    doc = (text or "").lower()
    places = [(m.start(), m[0]) for m in _WORD.finditer(doc)]
    long = [(p, w) for p, w in places if len(w) >= config.min_word]
    seen: dict[str, int] = {}
    for p, w in long:
        seen.setdefault(w, p)
    s = _State(query.tokens, [(p, w) for w, p in seen.items()])
    n = len(s.q)
    if config.whole:
        _whole(s)
    if config.joined:
        _joined(s)
    if config.affix:
        _affix(s)
    full = [m >= len(q) - 0.01 for m, q in zip(s.matched, s.q)]
    if config.fuzzy and not (n and all(full)):
        _fuzzy(s, config)
        full = [m >= len(q) - 0.01 for m, q in zip(s.matched, s.q)]
    ci = [min(1.0, m / len(q)) for m, q in zip(s.matched, s.q)]
    idf, total = query.gram_idf, sum(query.gram_idf)
    strict = [(w or j) and f for w, j, f in zip(s.whole, s.joined, full)]
    prefix = [p and m > 0 for p, m in zip(s.prefix, s.matched)]
    run = longest = suffix = 0
    for p in prefix:
        run = run + 1 if p else 0
        longest = max(longest, run)
    for p in reversed(prefix):
        if not p:
            break
        suffix += 1
    found = [p for p in s.pos if p >= 0]
    common = lcs(query.text, doc, config)
    sum_ci = sum(ci)
    if n == 1 and query.text and common:
        sum_ci = max(sum_ci, min(1.0, common / len(query.text)))
    points = s.n_joined + s.n_whole + s.n_fuzzy + s.n_affix - s.penalty or (common - 2 if common > 2 else 0)
    every, words = query.every, [w for _, w in places]
    have = set(words)
    anchor = bool(every) and len(every[0]) >= 3 and any(w.startswith(every[0][:3]) for w in words)
    power = [i * c for i, c in zip(query.word_idf, ci)]
    mean = total / n if n and total > 0 else 0.0
    unmatched = [q for q in every if len(q) >= config.min_word and not any(w.startswith(q) for w in words)]
    evidence = [any(len(w) >= config.min_word and (q.startswith(w) or _common_prefix(q, w) >= config.min_word) for w in words) for q in unmatched]
    last = every[-1] if every else ""
    return {
        "terms_count": n, "terms_any": sum(c > 0 for c in ci), "terms_full": sum(full), "terms_strict": sum(strict), "terms_prefix": sum(s.prefix),
        "first_match": min(found, default=-1), "sum_ci": sum_ci, "doc_tokens": len(long), "word_hits": s.hits, "longest_prefix_run": longest, "suffix_prefix_run": suffix,
        "phrase_span": max(found) - min(found) + 1 if found and sum(c > 0 for c in ci) >= 2 else 0, "preceding_strict": sum(strict[:-1]),
        "last_has_prefix": bool(n and prefix[-1]), "last_is_type_ahead": bool(n and total > 0 and idf[-1] / total <= 1 / (n + 1)),
        "idf_coverage": sum(c * i for c, i in zip(ci, idf)) / total if total > 0 else 0.0, "total_idf": float(total), "missing_idf": float(sum((1 - c) * i for c, i in zip(ci, idf))),
        "weighted_coverage": sum(c * len(q) for c, q in zip(ci, s.q)) / sum(map(len, s.q)) if n else 0.0, "last_ci": ci[-1] if n else 0.0,
        "coverage_score": int(min(255.0, max(0.0, points / len(query.text) * 255))) if query.text else 0, "lcs": common,
        "dominant": n >= 2 and any(c > 0.1 and w > 0 and w >= mean and 2 * p >= sum(power) for c, w, p in zip(ci, query.word_idf, power)),
        "strong_anchor": anchor and n >= 2 and query.word_idf[0] >= mean,
        "query_tokens": len(every),
        "prefix_last": bool(every) and all(q in have for q in every[:-1]) and any(w.startswith(last) for w in words),
        "perfect_doc": bool(every) and bool(words) and all(any(w.startswith(q) or q.startswith(w) for q in every) for w in words),
        "stem_evidence": len(every) >= 2 and bool(unmatched) and all(evidence), "anchor_stem": anchor,
        "trailing_density": int(sum(last in w for w in words) / len(words) * 255) if 1 <= len(last) <= 2 and words else 0,
        "lexical_sim": int(min(1.0, _single_term_similarity(last, words)) * 255) if len(every) == 1 else 0,
        "single_char_boost": _single_char_boost(every, doc, places),
    }


def with_features(candidates: DataFrame, config: CoverageConfig | None = None) -> DataFrame:
    """candidates(query_id, doc_id, base, q, tokens, norm_text) to (query_id, doc_id, base, q_len, doc_len, FEATURES), batch by batch."""
    config = config or CoverageConfig()

    def run(batches):
        known: dict = {}
        done: dict = {}  # what equal queries and texts have is found once
        for batch in batches:
            ids, docs, base, q, tokens, texts = (batch.column(c) for c in ("query_id", "doc_id", "base", "q", "tokens", "norm_text"))
            places: dict[int, int] = {}
            rows, at = [], []
            for k, (i, text, asked) in enumerate(zip(ids.to_pylist(), q.to_pylist(), texts.to_pylist())):
                if i not in known:
                    listed = tokens[k].as_py() or []
                    known[i] = Query(text, [t["token"] for t in listed], [t["gram_idf"] for t in listed], [t["word_idf"] for t in listed])
                row = done.get((i, asked))
                if row is None:
                    if len(done) >= KEPT_FEATURES:
                        done.clear()
                    row = done[i, asked] = features(known[i], asked, config)
                place = places.get(id(row))
                if place is None:
                    place = places[id(row)] = len(rows)
                    rows.append(row)
                at.append(place)
            place = pa.array(at, pa.int64())
            cols = [pa.array([r[name] for r in rows], _ARROW[kind]).take(place) for name, kind in FEATURES]
            lengths = [pc.fill_null(pc.utf8_length(c), 0).cast(pa.int32()) for c in (q, texts)]
            yield pa.RecordBatch.from_arrays([ids, docs, base, *lengths, *cols], ["query_id", "doc_id", "base", "q_len", "doc_len", *(n for n, _ in FEATURES)])

    own = candidates.select("query_id", "doc_id", F.col("base").cast("double").alias("base"), "q", "tokens", "norm_text")
    kind = own.schema["query_id"].dataType.simpleString()
    return own.mapInArrow(run, f"query_id {kind}, doc_id bigint, base double, q_len int, doc_len int, {SCHEMA}")
