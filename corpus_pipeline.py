"""Training-data pipeline over ``documents``: language, near-duplicates, decontamination, secrets,
packing.

Every stage works on all rows that the stage before kept, and is written as Parquet in the shared
folder and read again, so a lost executor costs at most one stage.  A null or empty text is rejected
by the first stage; an empty table passes through all of them; all stages but the last return the
columns of ``documents`` as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.decontam import drop_contaminated
from corpuslens.llm.langid import held_out, identify, train
from corpuslens.llm.neardup import drop_near_duplicates
from corpuslens.llm.packing import pack
from corpuslens.llm.secrets import mask_secrets
from corpuslens.session import durable

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; what the models reject goes."""
    models = train(docs.filter(~held_out(docs)))
    return identify(docs, models, keep_rows=True).filter("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The models of the first stage, the components of the second and the tokens of the last cannot be
#: said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
