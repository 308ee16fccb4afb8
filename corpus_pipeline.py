"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage takes documents with any columns besides doc_id and text, and all but the
last return the rows that stay, with all their columns as they are: names that clash
with an operator's own (grade, score, held_out, ...) don't matter. Nulls in other columns
don't count. Empty tables give empty tables. Each stage is one pass or goes by shuffles;
none holds more of a table than a slab of texts, or one very long text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, jaccard, pieces, quality, toxicity
from waymark.llm._store import dropped, fold_of, written
from waymark.llm.registry import piece_model, table

Documents = DataFrame


def drop_toxic(spark: SparkSession, docs: Documents, sf_dir: str) -> Documents:
    """Documents that the ordinal model doesn't find toxic.

    The model is fitted on the labelled rows of the folder's own documents. Null and
    empty texts count as texts without features: they stay unless such texts are found
    toxic. Repeated rows go or stay together; a chance that equals the cutoff is toxic.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def keep_good(spark: SparkSession, docs: Documents, sf_dir: str) -> Documents:
    """Documents that the multiple-instance model predicts to be good (a score of GOOD or more).

    The model is fitted on the folder's own documents outside the held-out fold. Null
    and empty texts are scored as one empty passage; repeated rows go or stay together.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=fold_of("doc_id", 4) != 2)
    return quality.only_good(docs, model)


def one_of_each(spark: SparkSession, docs: Documents, sf_dir: str) -> Documents:
    """One document of each class of near duplicates: that with the least doc_id, of equal ones the least hash of its text.

    Repeated rows become one; of rows that agree in doc_id and text but not in other
    columns any one stays. Rows without a doc_id, null and blank texts all stay.
    """
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: Documents, sf_dir: str) -> Documents:
    """Documents that hold no benchmark passage. Null and empty texts hold none; repeated rows go or stay together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: Documents, sf_dir: str) -> DataFrame:
    """Figures of each document's pieces, with its other columns but the text. Null texts count as empty; every row gives one."""
    return pieces.encode_documents(docs, piece_model())


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", one_of_each), ("decontaminate", drop_leaks), ("encode", encode)]

#: Fitted models and hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            kept = written(kept, name)
            if k:
                dropped(docs)
        docs = kept
    return docs
