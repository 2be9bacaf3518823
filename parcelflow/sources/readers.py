"""Sources and sinks: rosters with aliased headers, world files, names as keys, feature collections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical roster columns and the header names that stand for them.
ALIASES = {
    "sido_cd": ("ctpv_cd", "sido_cd", "시도코드"),
    "sido_nm": ("ctpv_nm", "sido_nm", "시도명", "시도명칭"),
    "sigungu_cd": ("sgg_cd", "sigungu_cd", "시군구코드"),
    "sigungu_nm": ("sgg_nm", "sigungu_nm", "시군구명", "시군구명칭"),
    "adm_cd": ("emd_cd", "adm_cd", "읍면동코드", "행정동코드"),
    "adm_nm": ("emd_nm", "adm_nm", "읍면동명", "행정동명", "행정동명칭"),
    "li_nm": ("ri_nm", "법정리명", "리명"),
    "ri_nm": ("li_nm", "행정리명", "행정리명칭"),
    "ri_cd": ("li_cd", "행정리코드"),
    "work_yn": ("work_yn", "작업여부", "작업완료여부"),
    "remark": ("remark", "rmk", "비고", "특이사항"),
}
REQUIRED = ("adm_cd", "adm_nm", "ri_nm", "ri_cd")
#: So many units are asked for by a filter, more by a join.
FEW = 1000
IMAGE_NAME = r"(\d{8})_(\d+-\d+)(?:_\d+)?\.(?:jpe?g|png)$"


def plain_header(name: str) -> str:
    return re.sub(r"[\s_-]", "", name).lower()


def detect_columns(header: list[str]) -> tuple[dict[str, str], list[str]]:
    """Header -> ({header name: canonical name}, required names that are missing). Of several headers for one name the last counts."""
    stands_for = {plain_header(a): name for name, names in ALIASES.items() for a in names}
    last = {stands_for[plain_header(h)]: h for h in header if h and plain_header(h) in stands_for}
    return {h: name for name, h in last.items()}, [r for r in REQUIRED if r not in last]


def pick_sheet(headers: dict[str, list[str]]) -> str | None:
    """Of sheets (exported tables) by name, in order: the first whose header has all required columns, else the first."""
    return next((name for name, header in headers.items() if not detect_columns(header)[1]), next(iter(headers), None))


def roster_of(spark: SparkSession, sheets: dict[str, str], **how) -> DataFrame:
    """The roster from a workbook's sheets, each exported as CSV: {sheet name: path}. Only headers are read to choose."""
    headers = {name: spark.read.option("header", True).csv(path).columns for name, path in sheets.items()}
    return roster(spark, sheets[pick_sheet(headers)], **how)


def status_rows(spark: SparkSession, path: str, good: tuple[str, ...] = ("OK", "OK_NO_PDF")) -> DataFrame:
    """Rows of a status table that succeeded and name a unit and a sheet."""
    return succeeded(spark.read.option("header", True).csv(path), good)


def succeeded(rows: DataFrame, good: tuple[str, ...] = ("OK", "OK_NO_PDF"), named: tuple[str, ...] = ("admin_code", "sheet_id")) -> DataFrame:
    rows = rows.where(F.col("status").isin(*good))
    for c in named:
        rows = rows.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """An account table under a header, cells trimmed."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.trim(f"`{c}`").alias(c.strip()) for c in raw.columns])


def roster(spark: SparkSession, path: str, units: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A roster exported as CSV: columns renamed, cells trimmed, null as '', rows without a key left out."""
    raw = spark.read.option("header", True).csv(path)
    names, missing = detect_columns(raw.columns)
    if missing:
        raise ValueError(f"roster lacks {', '.join(missing)}")
    rows = raw.select(*[F.coalesce(F.trim(f"`{h}`"), F.lit("")).alias(c) for h, c in names.items()])
    rows = rows.where((F.col("adm_cd") != "") & (F.col("ri_cd") != "") & (F.col("ri_nm") != ""))
    if units and len(units) <= FEW:
        rows = rows.where(F.col("adm_cd").isin(units))
    elif units:
        rows = rows.join(spark.createDataFrame([(u,) for u in units], "adm_cd string"), "adm_cd", "left_semi")
    return rows.limit(limit) if limit else rows


def world_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ps_x, rot_x, rot_y, ps_y, tl_x, tl_y) of world files."""
    lines = F.split(F.trim("value"), r"\s*\n\s*")
    names = ("ps_x", "rot_x", "rot_y", "ps_y", "tl_x", "tl_y")
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return text.where(F.size(lines) >= 6).select("path", *[lines[i].cast("double").alias(n) for i, n in enumerate(names)])


def world_text(*params: Column) -> Column:
    return F.concat_ws("\n", *[F.format_string("%.13f", p) for p in params])


def image_names(paths: DataFrame, col: str = "path") -> DataFrame:
    """Adds adm_cd and sheet_id from file names; other names are left out."""
    return paths.withColumn("adm_cd", F.regexp_extract(col, IMAGE_NAME, 1)).withColumn("sheet_id", F.regexp_extract(col, IMAGE_NAME, 2)).where("adm_cd <> ''")


def feature_collection(df: DataFrame, by: list[str], properties: list[str], order: str, geometry: Column | None = None) -> DataFrame:
    """(by, geojson): features in order; nulls are kept. With no `by`, one collection, with [] where there is no row."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col(order).alias("id"), (geometry if geometry is not None else F.lit(None).cast("string")).alias("geometry"), F.struct(*properties).alias("properties"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), feature.alias("f")))), lambda x: x["f"])
    whole = F.struct(F.lit("FeatureCollection").alias("type"), sorted_.alias("features"))
    return (df.groupBy(*by) if by else df).agg(F.to_json(whole, {"ignoreNullFields": "false"}).alias("geojson"))
