"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, as a Java class.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch: texts and packed rows are wide, and a batch is held by the JVM and the worker at once.
BATCH = 1_000


def narrow_batches(spark: SparkSession) -> None:
    """At most BATCH rows go to a Python worker at once, in this session, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH:
        spark.conf.set(key, str(BATCH))


#: What this Python worker remembers from task to task of one operator. Workers go on to other operators.
REMEMBERED: dict[object, object] = {}


def remembered(key: object, make: Callable[[], object]) -> object:
    """The value under a key, made where it is missing; what other keys hold is forgotten."""
    if key not in REMEMBERED:
        REMEMBERED.clear()
        REMEMBERED[key] = make()
    return REMEMBERED[key]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it again.

    Parquet is compressed and columnar, so it takes less disk than checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables of cut() that nothing reads any more: what came of them is in other tables."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if re.fullmatch(r"table-[0-9a-f]{32}", path.getName()):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Words of a text in order, array<string>; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array, as array<bigint> one longer than the input.

    Two levels of blocks keep the copying of growing arrays at n * block
    instead of n * n, so that texts with very many matches stay affordable.
    """
    zero = F.lit(0).cast("bigint")

    def running(first: Column, items: Column) -> Column:
        return F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def whole(items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.size(items) / F.lit(block)).cast("int"))
        pieces = F.transform(starts, lambda b: F.slice(items, b * block + 1, F.lit(block)))
        totals = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x))
        inner = F.zip_with(pieces, F.slice(running(zero, totals), F.lit(1), F.size(starts)), lambda p, o: running(o, p))
        # each block's last sum is the next block's first
        return F.concat(F.array(zero), F.flatten(F.transform(inner, lambda r: F.slice(r, F.lit(2), F.size(r) - 1))))

    return bind(lengths, whole)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
