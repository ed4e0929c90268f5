"""The corpus pipeline: stages over the documents table, each written before the next one reads it.

Documents that the quality rules reject go; of each group of near copies one document stays; secrets are masked; documents are
repeated or left out so that the sources meet their target weights; what remains is packed into sequences. Every stage but the
last returns the columns of documents. Nulls, empty texts and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from trawl.llm import jaccard, mixing, packing, quality, secrets
from trawl.llm.common import final, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the isolation forest, calibrated on the table labels, does not reject.

    Null and empty texts have statistics 0 and are judged by them; without labelled good documents all stay; a score equal to the threshold stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near copies, the one of the lowest doc_id.

    Null doc_ids and texts without words stay; of rows that are equal in doc_id and text one stays.
    """
    return jaccard.keep_one(docs)


def secret_scan(spark, docs, sf_dir):
    """Each secret replaced by a mask, n_chars brought up to date; all rows stay, null and empty texts as they are."""
    return secrets.redact(docs)


def source_mixing(spark, docs, sf_dir):
    """Sources weighted by the square roots of their tokens; a document may come several times, or not at all.

    A null source is one by itself; documents of a source without tokens come once. A column copy_no of docs would be replaced, so it is carried by another name.
    """
    if "copy_no" in docs.columns:
        return mixing.mix_sources(docs, copy_col="__copy_no").select(*docs.columns)
    return mixing.mix_sources(docs).select(*docs.columns)


def best_fit_packing(spark, docs, sf_dir):
    """Bins of packed documents: bin_id, slot, doc_id, start, n_tokens; a document without words has a row without a bin."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't grow the isolation forest or pack greedily; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What a stage writes on its way goes once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = final(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
