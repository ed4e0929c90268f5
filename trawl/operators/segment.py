"""Long documents cut into overlapping passages at word ends."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import DELIMITERS

_WORD = re.compile("[^" + re.escape(DELIMITERS) + "]+")


def passages(text: str, target: int = 200, overlap: float = 0.2) -> list[str]:
    """About round((n + overlap * target) / (target - overlap * target)) passages of nearly equal length that begin and end with words,
    each beginning about overlap of its length before the end of the one before; one of fewer than two, or of a single word, is the whole text."""
    count = round((len(text) + overlap * target) / (target - target * overlap))
    ends = [m.end() for m in _WORD.finditer(text)]
    if count < 2 or len(ends) <= 1:
        return [text] if text else []
    begin = _WORD.search(text).start()
    size = round(len(text) / count * (1 + overlap))
    out, first = [], 0
    while first < len(ends):
        start = begin if first == 0 else ends[first]
        last = len(ends) - 1
        if len(out) < count - 1:
            for i in range(first, len(ends)):
                if ends[i] - start >= size:
                    before = ends[i - 1] - start if i > first else 0
                    last = i - 1 if size - before < ends[i] - start - size and i > first else i
                    break
        if ends[last] <= start and out:
            break
        out.append(text[start : ends[last]])
        if last == len(ends) - 1:
            break
        back = int((ends[last] - start) * overlap)
        k = last - 1
        while k > 0 and ends[last] - ends[k] < back:
            k -= 1
        if k >= 0 and back - (ends[last] - ends[min(k + 1, last)]) < ends[last] - ends[k] - back:
            k = min(k + 1, last)
        # always on from where this passage began
        first = max(k + 1 if k + 1 <= last else last, first + 1)
    return out


def split_documents(docs: DataFrame, key: str, text: str, target: int = 200, overlap: float = 0.2) -> DataFrame:
    """(doc_key, segment, text) of all passages; a null or empty text has none."""

    def run(batches):
        for batch in batches:
            keys, segs, texts = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = passages(t or "", target, overlap)
                keys += [k] * len(own)
                segs += range(len(own))
                texts += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segs, pa.int32()), pa.array(texts, pa.string())], ["doc_key", "segment", "text"])

    return docs.select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("text")).mapInArrow(run, "doc_key bigint, segment int, text string")


def needs_splitting(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """One row: whether any text is longer than limit."""
    return docs.agg(F.coalesce(F.max(F.length(text)) > limit, F.lit(False)).alias("needed"))
