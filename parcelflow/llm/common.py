"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A small table's files: so many for each core, or one for so many rows if that makes more.
FILES_A_CORE, FILE_ROWS = 2, 200_000
_ends = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table that lies in the plan. createDataFrame passes tuples through Python workers of the executors, in an environment of
    their own, so each executor gets a second Python daemon, whose workers stay; it takes an Arrow table without."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [[] for _ in kinds], kinds)], kinds), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local one is made only where none is set and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="parcelflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of this application in the shared folder. What lies there goes when the process ends (see release)."""
    global _ends
    if not _ends:
        _ends = True
        atexit.register(release, spark)
    return f"{shared_folder(spark)}/parcelflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs only its running tasks.

    most: the rows it has at most, where that is known. A small table then comes in few files, however many tasks its shuffles have:
    on a local path Hadoop forks a process (chmod) for each file and folder made, and until that runs, the JVM's memory reads twice.

    The tables lie in <spark.checkpoint.dir>/parcelflow/<application id>/. Those that nothing reads any more go by discard, the rest by
    release.
    """
    path = new_path(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-most // FILE_ROWS)))
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._durable_path = path
    return kept


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle. For a side that grows with the input: Spark's statistics see the size of the compressed
    files and not what an explode makes of a row, so it would broadcast a table many times larger than its threshold through the driver."""
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by durable that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table.__dict__["_durable_path"])


def release(spark: SparkSession) -> None:
    """Delete what durable() has written in this application. Results that still read it must have been written before."""
    with contextlib.suppress(Exception):
        _delete(spark, f"{shared_folder(spark)}/parcelflow/{spark.sparkContext.applicationId}")


def let(value: Column, of) -> Column:
    """of(value), the value being computed once and never copied into the parts of the expression by the optimizer."""
    return F.transform(F.array(value), of)[0]


def row_of(name: str) -> Column:
    """Column `name` of a row packed as `doc`, whatever the name is."""
    return F.col("doc").getField(name)


def unpacked(docs: DataFrame, replaced: dict[str, Column], *added: str) -> list[Column]:
    """The columns of docs out of `doc`, those in `replaced` new; columns of docs with the names of `added` ones give way to these."""
    taken = {a.lower() for a in added}
    return [replaced.get(c, row_of(c)).alias(c) for c in docs.columns if c.lower() not in taken]


def whole(text: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def words(text: str | Column) -> Column:
    return F.array_remove(F.split(whole(text), GAP), "")


def with_running_total(df: DataFrame, by: list[str], chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the earlier rows with the same `by` (not null), in the order of chunk, then order.

    Two levels, so that no key needs its rows in one task: sums of chunks are totalled first (a short row for each chunk), then
    each chunk adds up its own rows. Chunks should hold some thousands of rows.
    """
    sums = df.groupBy(*by, chunk).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(*by, chunk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    own = W.partitionBy(*by, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.join(bases, [*by, chunk])
    return rows.withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__base")
