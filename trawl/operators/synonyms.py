"""Synonyms: classes of words that count as one, the longest of each class standing for it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.text import DELIMITERS


class Synonyms:
    def __init__(self, groups: list[list[str]] | None = None):
        self.up: dict[str, str] = {}
        self.pairs: dict[str, set[str]] = {}
        for g in groups or []:
            self.add_group(g)

    def _root(self, x: str) -> str:
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def add(self, a: str, b: str) -> None:
        a, b = a.strip().lower(), b.strip().lower()
        if not a or not b or a == b:
            return
        self.pairs.setdefault(a, set()).add(b)
        self.pairs.setdefault(b, set()).add(a)
        ra, rb = sorted((self._root(a), self._root(b)), key=lambda w: (-len(w), w))
        self.up.setdefault(ra, ra)
        self.up[rb] = ra

    def add_group(self, words: list[str]) -> None:
        own = [w.strip().lower() for w in words if w.strip()]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                self.add(a, b)

    def of(self, word: str) -> set[str]:
        return set(self.pairs.get(word.strip().lower(), ()))

    def has(self, word: str) -> bool:
        return bool(self.of(word))

    def canonical(self, word: str) -> str:
        return self._root(word.strip().lower()) if word.strip().lower() in self.up else word

    def as_pairs(self) -> list[list[str]]:
        return sorted([a, b] for a, others in self.pairs.items() for b in others if a < b)

    @classmethod
    def of_pairs(cls, pairs: list[list[str]]) -> Synonyms:
        return cls(pairs)

    def clear(self) -> None:
        self.up.clear()
        self.pairs.clear()

    def __len__(self) -> int:
        return len(self.pairs)

    def mapping(self) -> dict[str, str]:
        return {w: r for w in self.pairs if (r := self._root(w)) != w}

    def canonical_text(self, text: Column) -> Column:
        """Each word of the text by the one that stands for its class; what is between the words stays."""
        replace = self._replacer()
        if replace is None:
            return text

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else replace(t) for t in texts.to_pylist()], pa.string())

        return run(text)

    def canonical_texts(self, texts: Column) -> Column:
        """canonical_text of each text of an array."""
        replace = self._replacer()
        if replace is None:
            return texts

        @F.arrow_udf("array<string>")
        def run(lists: pa.Array) -> pa.Array:
            return pa.array([None if x is None else [None if t is None else replace(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))

        return run(texts)

    def _replacer(self):
        to = self.mapping()
        if not to:
            return None
        word = re.compile("[^" + re.escape(DELIMITERS) + "]+")
        return lambda text: word.sub(lambda m: to.get(m[0].lower(), m[0]), text)

    def canonical_words(self, words: Column) -> Column:
        """The same over an array of words, without leaving the JVM."""
        to = self.mapping()
        if not to:
            return words
        known = F.create_map(*(F.lit(x) for kv in to.items() for x in kv))
        return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w))
