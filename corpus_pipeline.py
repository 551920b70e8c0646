"""Training-data pipeline: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``documents``. SQL can express neither the trained
classifier nor the tokenizer, so there is no ``ORACLE_SQL``; tests/llm hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, setjoin, suffixdedup, toxicity
from tessera.llm.common import stored, temp
from tessera.sources.tables import read_table

#: documents at least as likely toxic as this go
TOXIC = 0.5
#: near duplicates: words of a shingle, and similarity in hundredths
WORDS, SIMILARITY = 5, 80
#: bytes of a repeated passage
PASSAGE = 100

ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go; the model learns from ``labels``."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    rows, c = toxicity.score_toxicity(docs, model)
    return rows.filter(F.col(c["p_toxic"]) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return setjoin.one_of_each(docs, WORDS, SIMILARITY).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds too are cut from the texts, whole characters only.

    A document that nothing but repeated passages and white space made up goes.
    """
    rows, c = suffixdedup.without_repeats(docs, PASSAGE, whole_characters=True)
    cut, text = F.col(c["starts"]).isNotNull(), temp("text")
    rows = rows.withColumn(text, F.when(cut, F.decode(F.col(c["kept"]), "UTF-8")).otherwise(F.col("text")))
    rows = rows.filter(~cut | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col(text), "n_chars": F.when(cut, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return rows.select(*[new[x].alias(x) if x in new else rows[x] for x in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows, c = mixing.mix(docs)
    times = temp("time")
    copies = rows.filter(F.col(c["copies"]) > 0).withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(c["copies"]))))
    return copies.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
