"""A corpus pipeline of five stages, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again, so a lost
executor costs a part of one stage; what a stage has read is removed then.

Defined results, in every stage: null texts count as empty ones and stay null;
empty tables give empty ones; texts may be of any length; rows with a null or
repeated doc_id pass through all stages but the second like others, which says
what it does with them; columns of any name but those with two leading
underscores pass through the stages that return documents, the last one
returns its own. Ties are settled by doc_id and hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm import common, mixing, ngram_join, pii, sentencepiece_codec, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return docs.where(toxicity.score_column(model)(F.col("text")) < 0.5)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Five-word shingles, four fifths alike.

    Rows that repeat a doc_id and its text are one; rows of one doc_id with
    different texts all stay if it stands for its group; rows without a doc_id
    are in no group and all stay, as do empty and null texts.
    """
    groups = ngram_join.ngram_join(docs.select("doc_id", "text"), n=5, least=80)
    keep = groups.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("__kept")).distinct()
    t = docs.join(keep, F.col("doc_id") == F.col("__kept"), "left_semi").withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    t = t.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)
    return t.unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it."""
    t = pii.sanitised(docs)
    return t.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else t


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard after shard, each in the order of its local shuffle."""
    plan = mixing.mix(docs).groupBy(F.col("doc_id").alias("__doc"), F.col("source").alias("__from")).agg(F.max(F.struct("copies", "draws")).alias("__most")).where("__most.copies > 0")
    t = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__from")))
    t = t.withColumn("__draw", F.explode("__most.draws"))
    return t.orderBy("__draw.shard", "__draw.place").select(*docs.columns)


def pieces_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_ids, ids of every document of the mix, and whether decoding gives the text back."""
    t = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.codec(spark), check="round_trip")
    return t.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("PII", personal_data_out),
    ("mixing", sources_mixed),
    ("SentencePiece encoding", pieces_encoded),
]

#: Learned scores and piece search are beyond SQL; the whole has no brute-force twin, tests hold its stages one by one (README).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        common.drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
