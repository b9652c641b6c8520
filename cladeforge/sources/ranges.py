"""Byte ranges of one file, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the blocks that a file is cut into for joining with ranges.
BLOCK = 1 << 20


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """text of each line with its byte offset, by Hadoop's splittable text reader."""
    pairs = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text")
    return spark.createDataFrame(pairs, "offset bigint, value string")


def read_ranges(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """header, location, nucleotides of pieces (id, location, bases, first_byte, n_bytes) of a text file.

    Lines know their byte offset; each is joined to the pieces whose range it
    meets, by blocks of bytes, and cut to the range.
    """
    lines = lines_with_offsets(spark, path).withColumn("n", F.octet_length("value"))
    span = F.sequence(F.floor(F.col("first_byte") / BLOCK), F.floor((F.col("first_byte") + F.col("n_bytes") - 1) / BLOCK))
    asked = pieces.withColumn("block", F.explode(span))
    held = lines.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.greatest("n", F.lit(1)) - 1) / BLOCK))))
    last = F.col("first_byte") + F.col("n_bytes")
    t = held.join(asked, "block").where((F.col("offset") < last) & (F.col("offset") + F.col("n") > F.col("first_byte")))
    start = F.greatest(F.lit(0), F.col("first_byte") - F.col("offset"))
    t = t.withColumn("part", F.substr(F.regexp_replace("value", "\r", ""), (start + 1).cast("int"), (F.least(F.col("n").cast("bigint"), last - F.col("offset")) - start).cast("int")))
    t = t.dropDuplicates(["id", "location", "offset"])
    # a piece is at most a chunk long, so its lines are bounded
    t = t.groupBy("id", "location").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("a"))
    return t.select(F.col("id").alias("header"), "location", F.array_join(F.transform("a", lambda x: x["part"]), "").alias("nucleotides"))
