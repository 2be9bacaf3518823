"""Discovery of files by the grammar of their names. All of it is on tables of paths, so a listing of any size is a job like others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of whole-unit documents, of sheets (unit_N-i, perhaps with a copy's number), and folders that are left out.
MAIN = r"^(\d{8})\.pdf$"
SHEET = r"^(\d{8})_(\d+)-(\d+)(?:_(\d+))?\.([A-Za-z]+)$"
SKIPPED = r"(^|/)\.ipynb_checkpoints(/|$)"
#: Numbered folders of a work folder: what lies there and the endings it may have, the first one found counting.
SLOT_ENDINGS = {"shp": ("shp",), "xlsx": ("xlsx", "xlsm"), "raster_dir": ("jpg",)}


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a folder of any store; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def named(files: DataFrame, col: str = "path") -> DataFrame:
    """files with folder, name, stem and ext (lower case) added."""
    path = F.col(col)
    rows = files.withColumn("name", F.regexp_extract(path, r"([^/]*)$", 1)).withColumn("folder", F.regexp_replace(path, r"/?[^/]*$", ""))
    return rows.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def without_checkpoints(files: DataFrame, col: str = "path") -> DataFrame:
    return files.where(~F.col(col).rlike(SKIPPED))


def documents(files: DataFrame, col: str = "path") -> DataFrame:
    """(kind, adm_cd, sheet_id, path): whole-unit documents (sheet_id null) and their sheets, the last path in order for each key."""
    rows = named(files, col)
    main = rows.select(F.lit("main").alias("kind"), F.regexp_extract("name", MAIN, 1).alias("adm_cd"), F.lit(None).cast("string").alias("sheet_id"), F.col(col).alias("path"))
    parts = rows.where("ext = 'pdf'").where(F.regexp_extract("name", SHEET, 4) == "")
    split = parts.select(F.lit("split").alias("kind"), F.regexp_extract("name", SHEET, 1).alias("adm_cd"), F.concat_ws("-", F.regexp_extract("name", SHEET, 2), F.regexp_extract("name", SHEET, 3)).alias("sheet_id"), F.col(col).alias("path"))
    found = main.union(split).where("adm_cd <> ''")
    return found.groupBy("kind", "adm_cd", "sheet_id").agg(F.max("path").alias("path"))


def sheets(files: DataFrame, endings: tuple[str, ...] = ("jpg", "jpeg", "png"), col: str = "path") -> DataFrame:
    """(adm_cd, n, i, path) of every image that is named as a sheet; checkpoint folders are left out. Copies are rows too."""
    rows = named(without_checkpoints(files, col), col).where(F.col("ext").isin(*endings))
    part = lambda k: F.regexp_extract("name", SHEET, k)
    return rows.where(part(1) != "").select(part(1).alias("adm_cd"), part(2).cast("int").alias("n"), part(3).cast("int").alias("i"), F.col(col).alias("path"))


def bodies(files: DataFrame, **how) -> DataFrame:
    """One path for each sheet: the last in order."""
    return sheets(files, **how).groupBy("adm_cd", "n", "i").agg(F.max("path").alias("path"))


def duplicate_sheets(files: DataFrame, **how) -> DataFrame:
    """(adm_cd, n, i, paths, copies): sheets under several paths."""
    found = sheets(files, **how).groupBy("adm_cd", "n", "i").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return found.withColumn("copies", F.size("paths")).where("copies > 1")


def sheet_order() -> list:
    """Numeric order of sheets: 10-2 comes after 9-1."""
    return [F.col("n").cast("int"), F.col("i").cast("int")]


def slots(files: DataFrame, wanted: DataFrame, col: str = "path") -> DataFrame:
    """wanted(number 'NN', slot, kind) with `found`: the first path of the kind in the folder that starts with the number, the
    folder itself for rasters, null if there is none. Endings count in their order."""
    number = F.regexp_extract("folder", r"(?:^|/)(\d{2})[^/]*$", 1)
    endings = [F.struct(F.lit(k).alias("kind"), F.lit(e).alias("ext"), F.lit(i).alias("at")) for k, names in SLOT_ENDINGS.items() for i, e in enumerate(names)]
    rows = named(files, col).withColumn("number", number).where("number <> ''").withColumn("e", F.explode(F.array(*endings))).where("e.ext = ext")
    hits = rows.groupBy("number", F.col("e.kind").alias("kind")).agg(F.min_by(F.struct(F.col(col).alias("path"), "folder"), F.struct("e.at", col)).alias("hit"))
    found = F.when(F.col("kind") == "raster_dir", F.col("hit.folder")).otherwise(F.col("hit.path"))
    return wanted.join(hits, ["number", "kind"], "left").select("number", "slot", "kind", found.alias("found"))


def documents_over_images(files: DataFrame, col: str = "path") -> DataFrame:
    """Files but for images of which a PDF of the same folder and stem exists, whatever the case."""
    rows = named(files, col).withColumn("key", F.lower(F.regexp_replace(col, r"\.[^./]*$", "")))
    pdfs = rows.where("ext = 'pdf'").select("key").distinct().withColumn("has", F.lit(True))
    return rows.join(pdfs, "key", "left").where("ext = 'pdf' OR has IS NULL").select(*files.columns)


def unit_codes(files: DataFrame, col: str = "path") -> DataFrame:
    """Distinct codes that names start with."""
    return named(files, col).select(F.regexp_extract("name", r"^(\d{8})", 1).alias("adm_cd")).where("adm_cd <> ''").distinct()
