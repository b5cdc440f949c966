"""What the names of budget files say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no part of a project's name.
NOISE = (
    "pdf", "xlsx", "xls", "bc3", "doc", "docx", "zip", "dwg", "pzh",
    "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8",
    "rev01", "rev02", "rev03", "rev1", "rev2", "rev",
    "revisado", "revisada", "corregido", "corregida", "firma",
    "definitivo", "final", "anexo", "sinmaterial", "sin", "material",
    "copia", "de", "y", "a", "la", "el", "los", "las",
    "ppto", "presupuesto", "mediciones", "medicion",
)
#: Patterns of a leading date and of a version, kinds of files and folders.
DATE = r"^(20\d{2})[-_.\s]?(\d{2})[-_.\s]?(\d{2})[\s_-]+"
VERSION = r"(?i)(?:^|[\s_\-\(])(v\d+|rev\s*0?\d+|revisad[oa]\d?)(?=[\s_\-\)\.]|$)"
RAW_KINDS = (".zip", ".dwg", ".pzh", ".docx", ".doc")
RANKS = {".pdf": 3, ".xlsx": 2, ".xls": 2, ".bc3": 1}
GOLDEN, APPROVED, DRAFTS, RAW = "00-golden-candidates-2025", "01-aprobados-pre-2025", "02-borradores-sin-cierre", "99-formato-raro"


def slug(words: Column) -> Column:
    """The words of a project's name in order of the alphabet, once each and six at most; long numbers and noise are left out."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(words), r"[-_.()/\\,\s]+", " ")), " ")
    own = F.filter(parts, lambda w: (w != "") & ~w.isin(*NOISE) & ~(w.rlike(r"^\d+$") & (F.length(w) > 3)))
    return F.coalesce(F.nullif(F.array_join(F.slice(F.sort_array(F.array_distinct(own)), 1, 6), "_"), F.lit("")), F.lit("sin_titulo"))


def parsed(files: DataFrame, name: str) -> DataFrame:
    """``files`` with what each name says: ext, date, version and slug."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    base = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    part = lambda i: F.regexp_extract("_base", DATE, i)
    date = F.try_to_timestamp(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--")), F.lit("yyyy-MM-dd")).cast("date")
    rows = files.withColumn("ext", ext).withColumn("_base", base).withColumn("date", date)
    rows = rows.withColumn("_rest", F.when(F.col("date").isNotNull(), F.regexp_replace("_base", DATE, "")).otherwise(F.col("_base")))
    mark = F.regexp_extract("_rest", VERSION, 1)
    digits = F.regexp_extract(mark, r"\d+", 0)
    version = F.when(mark == "", 0).when(digits == "", 1).otherwise(digits.cast("int"))
    before = F.when(mark == "", F.col("_rest")).otherwise(F.element_at(F.split("_rest", VERSION, 2), 1))
    return rows.withColumn("version", version).withColumn("slug", slug(before)).drop("_base", "_rest")


def plan(files: DataFrame, tie: str, year: int = 2025) -> DataFrame:
    """``files`` (of ``parsed``) with the folder that each goes to.

    Of a project the newest file, by date, version and kind, is a candidate if it is of ``year`` or later, else
    approved before; without a date, and all its other files, drafts. Files of odd kinds stand apart.
    """
    raw = F.col("ext").isin(*RAW_KINDS)
    rank = F.coalesce(*(F.when(F.col("ext") == e, n) for e, n in RANKS.items()), F.lit(0))
    newest = Window.partitionBy("slug").orderBy(F.desc_nulls_last("date"), F.desc("version"), F.desc(rank), tie)
    rows = files.where(~raw).withColumn("_n", F.row_number().over(newest))
    folder = F.when((F.col("_n") > 1) | F.col("date").isNull(), DRAFTS).when(F.year("date") >= year, GOLDEN).otherwise(APPROVED)
    return rows.withColumn("category", folder).drop("_n").unionByName(files.where(raw).withColumn("slug", F.lit("_")).withColumn("category", F.lit(RAW)))


def largest_pairs(files: DataFrame) -> DataFrame:
    """(folder, measurement, budget): of each folder's files (folder, name, size) the largest of either kind.

    Without a budget by name the largest other file counts, else the largest that is neither a certificate nor
    an invoice nor that measurement itself; folders without a pair are left out, ties go to the later name.
    """
    begins = lambda kind: F.startswith("name", F.lit(f"{kind}_"))
    largest = lambda cond: F.max_by("name", F.when(cond, F.struct("size", "name")))
    m = files.where(begins("MEDICION")).groupBy("folder").agg(F.max_by("name", F.struct("size", "name")).alias("measurement"))
    rows = files.join(m, "folder").where(F.col("name") != F.col("measurement"))
    other = ~F.contains("name", F.lit("CERTIFICACION")) & ~F.contains("name", F.lit("FACTURA"))
    found = rows.groupBy("folder", "measurement").agg(F.coalesce(largest(begins("PRESUPUESTO")), largest(begins("OTRO")), largest(other)).alias("budget"))
    return found.where("budget IS NOT NULL")
