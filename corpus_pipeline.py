"""A corpus from raw documents: toxic and repetitive documents go, boilerplate lines go, one document of each group of near
duplicates stays, and what is left is packed. Each stage reads what its predecessor wrote, and all but the last return the
columns of what they read; n_chars follows the text.

Cases, in all stages: each row is judged by itself, whatever its id, null ids and repeated ids included, except that near
duplicates are named by ids. A null text counts as empty; texts of any length are taken whole; an empty table gives an empty
one; extra columns go along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import jaccard_join, line_dedup, packing, quality_rules, queries, toxicity
from daybook.llm.common import discard, shared_folder, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. A row whose score is 0.5 or more goes, where it lies and without a shuffle. Labels of held-out rows are never
    read. Null and empty texts have the score of a text without evidence; without labels of both kinds none is rejected unless
    all labels are toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.is_held_out())
    judged = toxicity.scored(docs, model, names=("__toxicity", "__evidence", "__restored"))
    return judged.where("__toxicity < 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. A row that fails the base rules or the verdict on repeats goes, texts of fewer than ten words (null and
    empty ones included) among them."""
    return quality_rules.keep_sound(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Lines of many sources go but for their first place; a row that is left without a word by that goes. Rows
    that repeat an id and its text are the same document and keep or lose the same lines; a null source is no source."""
    clean = line_dedup.remove_boilerplate(docs)
    left = clean.where((F.col("lines_removed") == 0) | F.col("text").rlike(line_dedup.HAS_WORD))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", F.when(F.col("lines_removed") > 0, length).otherwise(F.col("n_chars"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, on five words and a similarity of 0.8. Of each group the document with the smallest id stays. Rows with the
    same id are one document and stay or go together; a row without an id can't be named and stays."""
    groups = jaccard_join.link_documents(docs, k=5, num=80, den=100)
    rejected = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of all sequences, with their ids. A null or empty text is its end id alone; rows with null or
    repeated ids are documents of their own."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_repetitive), ("line dedup", drop_boilerplate), ("near duplicates", drop_near_duplicates), ("packing", pack)]

#: Viterbi decoding, a fitted classifier and BPE are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's table is deleted when the next one is there, but for that which packing reads."""
    shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
