"""Secret scans: sliding-window Shannon entropy per character class over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import table

WINDOW = 16
#: Bits a window of each class must reach. A class is the narrowest alphabet that holds all characters of a window; windows
#: of digits alone are never secrets. Set from random strings of each class against the words of the test tables, alone, joined
#: by one of -_/ and followed by digits; the README has the shares.
THRESHOLDS = {"hex": 2.9, "alpha": 3.6, "alnum": 3.25, "symbol": 3.65}
CANDIDATE = r"[A-Za-z0-9+/=_-]"
_PLACEHOLDER = "abcdefghijklm|ABCDEFGHIJKLM|0123456789|EXAMPLE|example|XXXX|xxxx"
#: Candidates in which one of these is found are no secrets: UUIDs, alphabets in order and placeholders that leave no window of
#: other characters (a name of letters before = aside), a key of published manuals, published digests.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"^([A-Za-z_-]{{1,40}}=)?(.{{0,{WINDOW - 1}}}({_PLACEHOLDER}))+.{{0,{WINDOW - 1}}}$",
    r"^(.*=)?wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
    r"^sha(1|256|384|512)-[A-Za-z0-9+/]+=*$",
)
MASK = "[SECRET]"
_SCALE = 1 << 20


def _terms(window: int) -> list[int]:
    """c * log2(c) in fixed point: sums of these are exact in any order."""
    return [0, 0, *(round(c * math.log2(c) * _SCALE) for c in range(2, window + 1))]


def entropies(text: str, window: int = WINDOW) -> dict[str, int]:
    """For each class the least sum of c * log2(c) over windows of that class, in fixed point.

    The entropy of a window is log2(window) - sum / window. Counts per character, their sum, and the counts per class
    change by the one character that leaves and the one that enters.
    """
    term, counts, total = _terms(window), {}, 0
    digit = hexa = alpha = other = 0
    best: dict[str, int] = {}
    for i, c in enumerate(text):
        for ch, step in ((text[i - window], -1), (c, 1)) if i >= window else ((c, 1),):
            n = counts.get(ch, 0)
            total += term[n + step] - term[n]
            counts[ch] = n + step
            if ch.isdigit():
                digit += step
            elif ch.isalpha():
                alpha += step
                hexa += step * (ch in "abcdefABCDEF")
            else:
                other += step
        if i >= window - 1 and digit < window:
            kind = "symbol" if other else "hex" if digit + hexa == window else "alpha" if alpha == window else "alnum"
            if total < best.get(kind, 1 << 62):
                best[kind] = total
    return best


class Scanner:
    """Finds secrets in a text; holds the compiled patterns."""

    def __init__(self, window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW):
        self.window = window
        self.limit = {k: math.floor((math.log2(window) - t) * window * _SCALE) for k, t in (thresholds or THRESHOLDS).items()}
        self.allow = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
        self.find = re.compile(f"{CANDIDATE}{{{window},}}")

    def __call__(self, text: str) -> list[tuple[int, str, str, float]]:
        """(start, kind, candidate, entropy) of each; kind is the first class, in the order of the thresholds, that reaches its own."""
        out = []
        for m in self.find.finditer(text):
            if self.allow and self.allow.search(m[0]):
                continue
            sums = entropies(m[0], self.window)
            for kind, limit in self.limit.items():
                if sums.get(kind, limit + 1) <= limit:
                    out.append((m.start(), kind, m[0], math.log2(self.window) - sums[kind] / self.window / _SCALE))
                    break
        return out

    def mask(self, text: str, mask: str = MASK) -> str:
        at, parts = 0, []
        for start, _, found, _ in self(text):
            parts += [text[at:start], mask]
            at = start + len(found)
        return "".join([*parts, text[at:]])


_FOUND = "array<struct<start:int,length:int,kind:string,entropy:double,digest:string>>"
_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("entropy", pa.float64()), ("digest", pa.string())]))


def _candidates(text, window: int):
    """Only texts with a run long enough leave the JVM."""
    return F.coalesce(text.rlike(f"{CANDIDATE}{{{window},}}"), F.lit(False))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per secret: key, start and length in characters, kind, entropy in bits, SHA-256 of the secret (never itself).

    A candidate is a maximal run of letters, digits and +/=_- (ASCII) of at least window characters. Null and empty texts
    have none; texts are scanned whole, whatever their length; repeated rows are reported as often; a null key is reported
    as null; other columns are ignored. An empty table gives an empty table. Of classes that all reach their threshold the
    first in the order of thresholds names the secret.
    """
    scanner = Scanner(window, thresholds, allow)

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        rows = [[{"start": s, "length": len(c), "kind": k, "entropy": round(e, 6), "digest": hashlib.sha256(c.encode()).hexdigest()} for s, k, c, e in scanner(t)] for t in texts.to_pylist()]
        return pa.array(rows, _FOUND_ARROW)

    own = df.where(_candidates(F.col(text), window)).select(F.col(key).alias(key), found(F.col(text)).alias("__found"))
    return own.select(key, F.explode("__found").alias("__one")).select(key, "__one.*")


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = MASK, window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df with each secret in text replaced by mask, and the column length, if df has it, brought up to date in changed rows.

    All rows and columns stay: null and empty texts as they are, long ones masked whole, repeated rows each, null keys too, and a column named like any of
    scan()'s is left alone. Where several classes reach their threshold the secret is masked once. An empty table gives an empty table.
    """
    scanner = Scanner(window, thresholds, allow)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scanner.mask(t, mask) for t in texts.to_pylist()], pa.string())

    own = df.withColumn("__masked", masked(F.when(_candidates(F.col(text), window), F.col(text))))
    changed = F.col("__masked").isNotNull() & (F.col("__masked") != F.col(text))
    new = {text: F.coalesce("__masked", text)}
    if length in df.columns:
        new[length] = F.when(changed, F.length("__masked").cast(df.schema[length].dataType)).otherwise(F.col(length))
    return own.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


_RUN = f"{CANDIDATE}{{{WINDOW},}}"
SQL = f"""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '{_RUN}') AS m, string_split_regex(text, '{_RUN}') AS g FROM documents),
k AS (SELECT doc_id, i, m[i] AS cand, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM c)),
ok AS (SELECT * FROM k WHERE NOT ({" OR ".join(f"regexp_matches(cand, '{a}')" for a in ALLOW)})),
w AS (SELECT doc_id, i, cand, start, cand[p:p + {WINDOW - 1}] AS win FROM (SELECT *, unnest(range(1, length(cand) - {WINDOW - 2})) AS p FROM ok)),
s AS (SELECT *, CASE WHEN regexp_full_match(win, '[0-9]*') THEN 'digit' WHEN regexp_full_match(win, '[0-9a-fA-F]*') THEN 'hex' WHEN regexp_full_match(win, '[A-Za-z]*') THEN 'alpha'
             WHEN regexp_full_match(win, '[A-Za-z0-9]*') THEN 'alnum' ELSE 'symbol' END AS kind,
             list_sum(list_transform(list_distinct(string_split(win, '')), lambda ch: CASE WHEN length(win) - length(replace(win, ch, '')) < 2 THEN 0
               ELSE round((length(win) - length(replace(win, ch, ''))) * log2(length(win) - length(replace(win, ch, ''))) * {_SCALE}) END))::BIGINT AS total FROM w),
b AS (SELECT doc_id, i, cand, start, kind, min(total) AS total FROM s GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i, cand, start ORDER BY list_position({list(THRESHOLDS)}, kind)) AS nth FROM b
      WHERE total <= CASE kind {" ".join(f"WHEN '{k}' THEN {math.floor((math.log2(WINDOW) - t) * WINDOW * _SCALE)}" for k, t in THRESHOLDS.items())} ELSE -1 END)
SELECT doc_id, start, length(cand)::INT AS length, kind, round(log2({WINDOW}) - total / {WINDOW}.0 / {_SCALE}.0, 6) AS entropy, sha256(cand) AS digest FROM f WHERE nth = 1
"""
