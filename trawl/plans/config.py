"""What an index and a search can be told."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Field weights by importance; what one occurrence adds before rounding.
WEIGHTS = {"high": 1.5, "med": 1.25, "low": 1.0}


@dataclass(frozen=True)
class FieldSpec:
    """A column of the documents: how much it weighs, whether it is searched, and whether it is counted in facets."""

    name: str
    weight: str = "med"
    indexable: bool = True
    facetable: bool = False


@dataclass(frozen=True)
class WordMatchConfig:
    min_exact: int = 2
    max_exact: int = 8
    min_delete: int = 3
    max_delete: int = 8
    affix: bool = True
    min_affix: int = 3
    #: Words of one affix that count, the first ones in the alphabet; None for all.
    most_affixes: int | None = 4096


@dataclass(frozen=True)
class IndexConfig:
    gram_sizes: tuple[int, ...] = (3,)
    start_pad: int = 2
    stop_term_limit: int = 1_250_000
    words: WordMatchConfig | None = field(default_factory=WordMatchConfig)
    #: Target length and overlap of passages.
    segment: tuple[int, float] | None = None
    #: Terms of a query that count, its words first; None for all.
    query_terms: int | None = 128
    #: Also the text without its delimiters, and its grams.
    high_resolution: bool = False
    #: Terms within one edit that stand for a missing one; None for all.
    most_expanded: int | None = 1024

    @property
    def min_word(self) -> int:
        return self.gram_sizes[0]

    @staticmethod
    def named(number: int) -> IndexConfig:
        return {
            100: IndexConfig((2, 3), words=None),
            103: IndexConfig((3,), words=None),
            400: IndexConfig(segment=(200, 0.2)),
            401: IndexConfig(segment=(200, 0.2)),
        }[number]


@dataclass(frozen=True)
class CoverageConfig:
    min_word: int = 2
    max_fuzzy_word: int = 20
    typos: int = 2
    min_len_one_typo: int = 3
    min_len_two_typos: int = 7
    min_word_hits: int = 1
    lcs_min_query: int = 5
    lcs_tolerance: float = 0.2
    whole: bool = True
    joined: bool = True
    affix: bool = True
    fuzzy: bool = True
    truncate: bool = True
    truncation_score: float = 254.0
    prescreen: bool = False
    #: Type-ahead queries that reach more documents than this are ranked by the first stage alone; None for no such limit.
    short_covered: int | None = 500
    #: Candidates that only words find count up to the depth of the search; off, all of them do.
    limit_words: bool = True
    #: Longer query words are not matched by edits.
    max_edited_word: int = 63

    @staticmethod
    def minimal() -> CoverageConfig:
        return CoverageConfig(joined=False, affix=False, fuzzy=False)
