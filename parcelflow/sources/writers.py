"""Sinks: exports by scope and kind, snapshots replaced by unit, append-only logs, status tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.operators import relational as R


def export_rows(rows: DataFrame, scope: str, kind: str, scopes: list[str] | None = None) -> DataFrame:
    """rows once for each scope they belong to ('all' and their own), only those asked for; unknown scopes have no rows."""
    each = rows.withColumn("__scope", F.explode(F.array(F.lit("all"), F.col(scope))))
    each = each.where(F.col("__scope").isin(*scopes)) if scopes is not None else each
    return each.withColumn("file", F.concat_ws("_", "__scope", kind)).drop("__scope")


def write_collections(collections: DataFrame, path: str, name: str = "file", text: str = "geojson") -> None:
    """A folder path/<name>=... with one text file for each row; Spark writes the files side by side. Nothing is written for no rows."""
    rows = collections.select(F.col(text).alias("value"), F.col(name))
    rows.write.mode("overwrite").partitionBy(name).text(path)


def replace_units(spark: SparkSession, path: str, new: DataFrame, unit: str) -> tuple[int, int]:
    """Put the rows of `new` in place of all rows of their units in the table at `path`; -> (rows deleted, rows inserted).

    Snapshots lie beside each other under path; the file path/CURRENT names the valid one and is swapped by one rename, so a
    reader sees the old table or the new one. A unit's rows come from one job, and a lost executor costs only its tasks.
    """
    new = new.select(*sorted(new.columns))
    old = current(spark, path)
    name = f"snapshot-{uuid.uuid4().hex}"
    if old is None:
        new.write.parquet(f"{path}/{name}")
        deleted = 0
    else:
        old = old.select(*sorted(old.columns))
        R.replace_units(old, new, unit).write.parquet(f"{path}/{name}")
        deleted = old.join(new.select(unit).distinct(), unit, "left_semi").count()
    inserted = new.count()
    _point(spark, path, name)
    return deleted, inserted


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The valid snapshot, None if there is none yet."""
    fs, at = _place(spark, f"{path}/CURRENT")
    if not fs.exists(at):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}")


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm = spark.sparkContext._jvm
    fs, at = _place(spark, f"{path}/CURRENT")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.next-{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, at, options)


def deleted(df: DataFrame, gone: Column) -> tuple[DataFrame, int]:
    """The rows that stay, and how many go; rows for which the condition is null stay."""
    gone = F.coalesce(gone, F.lit(False))
    return df.where(~gone), df.where(gone).count()


def append_log(rows: DataFrame, path: str) -> bool:
    """Append to a log as well as may be: whatever goes wrong is told, not raised."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:
        return False
    return True


def login_rows(attempts: DataFrame) -> DataFrame:
    """(admin_cd, ip, user_agent, ts, ok): an audit row for each attempt, successful or not; the id is its first eight characters, the
    address the first of those forwarded, else the peer's."""
    first = F.trim(F.split_part(F.col("forwarded"), F.lit(","), F.lit(1)))
    return attempts.select(F.substring("login", 1, 8).alias("admin_cd"), F.coalesce(F.nullif(first, F.lit("")), F.col("peer")).alias("ip"), "user_agent", "ts", "ok")


def status_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A status table: all columns as text, nulls empty, under a header."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def job_rows(units: DataFrame, code: str, geometry: str = "polygons") -> DataFrame:
    """The seed of a unit's work layer: its rows, four blank columns, and the area as a whole number."""
    blank = {c: F.lit("") for c in ("spec", "RI_NM", "RI_CD", "REMARK")}
    return units.where(F.col("adm_cd").cast("string") == code).withColumns(blank).withColumn("area", F.rint(G.multi_area(F.col(geometry))).cast("long"))


def seeded(work: DataFrame, units: DataFrame, codes: DataFrame, code: str = "adm_cd") -> DataFrame:
    """Rows for a work layer from the unit polygons with one of the codes: columns that both have (whatever the case), others null."""
    names = {c.lower(): c for c in units.columns}
    wanted = codes.select(F.trim(F.col(code).cast("string")).alias("__code")).distinct()
    rows = units.join(wanted, F.trim(F.col(names[code.lower()]).cast("string")) == F.col("__code"), "left_semi")
    return rows.select(*[(F.col(names[c.lower()]) if c.lower() in names else F.lit(None)).cast(work.schema[c].dataType).alias(c) for c in work.columns])


def layer_features(rows: DataFrame, geometry: str = "polygons", keep: tuple[str, ...] = ("adm_cd", "adm_nm", "ri_cd", "ri_nm", "remark")) -> DataFrame:
    """(keep, geometry): rows with a shape, coordinates in 7 decimals, the properties kept by lower-cased name."""
    names = {c.lower(): c for c in rows.columns}
    shaped = rows.where(F.coalesce(F.size(geometry), F.lit(0)) > 0)
    return shaped.select(*[F.col(names[k]).alias(k) for k in keep if k in names], G.rounded(F.col(geometry), 7).alias("geometry"))
