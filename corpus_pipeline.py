"""A corpus pipeline of four stages over the documents table.

Each stage takes what its predecessor kept.  The first three return the columns
of documents, the last one the packed pieces.  In every stage an empty table gives
an empty result, columns besides doc_id, text, lang and n_chars are carried along
whatever their names, and null or repeated ids stand for rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.llm import near_dedup, packing, quality, store, substring_dedup
from joblattice.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that each stage wrote for itself, by the data's folder and the stage's place.
_OWN_TABLES: dict[tuple[str, int], list[str]] = {}


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage that first deletes the tables its predecessor wrote for itself.

    The predecessor's rows are written by then; a table that ``docs`` still reads, because they were not, stays.
    """

    def wrap(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            old = _OWN_TABLES.pop((sf_dir, place - 1), [])
            read = docs.inputFiles() if old else []
            for folder in old:
                if not any(folder in name for name in read):
                    store.delete(spark, folder)
            with store.noted() as folders:
                result = f(spark, docs, sf_dir)
            _OWN_TABLES[sf_dir, place] = folders
            return result

        return run_stage

    return wrap


@_stage(1)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the perplexity bands reject; null texts are rejected.

    The bands are fitted on the table of labels; without a folder of tables they are the fixed ones.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if sf_dir else None
    return quality.kept_documents(docs, labels)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8; texts without words stay."""
    return near_dedup.one_of_each(docs, width=5, percent=80)


@_stage(3)
def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that a smaller document already has; a null text becomes empty."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    rows = substring_dedup.deduplicate(docs, width=13, with_text=True, carry=carry)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*[(made[c] if c in made else F.col(f"carried_{c}")).alias(c) for c in docs.columns])


@_stage(4)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces in sequences of 2048; an empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_duplicates", substring_duplicates),
    ("packing", packed),
]

#: Perplexity under a model of the whole corpus is beyond plain SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
