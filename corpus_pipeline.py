"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every document that the
stage before kept. All but the last return the columns of ``documents``.

- quality: documents that fail the base rules or the likelihood ratio go;
- toxicity: documents with a score of 0.5 or more go;
- near_duplicates: of each group of near-duplicates the smallest doc_id stays
  (of repeated rows, one);
- repeats: 100-byte strings that also occur earlier are cut out of the texts,
  and n_chars follows; every document stays, if need be with an empty text;
- packing: the pieces of the token sequences.

Null and empty texts fail the quality rules; a document without an id passes
every stage that it does not fail; an empty table stays empty; columns beyond
those of ``documents`` are kept under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import minhash, packing, quality, substrings, toxicity
from tonearm.runtime import save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs, quality.trusted_ids(spark, sf_dir)).where("kept").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(spark, docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(spark, docs)
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]
#: Signatures, trained scores and tokens can't be had in SQL; tests/llm/test_queries.py compares each stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
