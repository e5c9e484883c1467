"""Inventories of files: reading, pruning, classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths

#: Extensions by category. Each belongs to one.
CATEGORIES = {
    "photos": ("Photos", "avif bmp gif heic heif jfif jpeg jpg png tif tiff webp arw cr2 cr3 crw dng nef nrw orf pef raf raw rw2 sr2 srw x3f ico"),
    "videos": ("Videos", "3gp amv asf avi divx drc f4v flv m2ts m2v m4v mkv mov mp4 mpe mpeg mpg mpv mts mxf ogm ogv qt r3d rm rmvb vob webm wmv y4m"),
    "audio": ("Audio", "aac aif aiff amr ape flac m4a m4b mid midi mp3 oga ogg opus wav wma"),
    "documents": ("Documents", "doc docx epub markdown md odt pages rtf tex txt"),
    "pdfs": ("PDFs", "pdf"),
    "spreadsheets": ("Spreadsheets", "csv numbers ods tsv xls xlsb xlsm xlsx"),
    "presentations": ("Presentations", "key odp pot potx pps ppsx ppt pptx"),
    "design": ("Design", "ai eps fig indd psb psd qxp sketch svg xd"),
    "archives": ("Archives", "7z bz2 dmg gz iso rar tar tgz xz zip"),
    "data": ("Data & Web", "accdb db htm html json jsonl mdb rss sql sqlite sqlite3 xhtml xml yaml yml"),
    "other": ("Other", ""),
}
#: Image formats that can be decoded; folders that are single documents.
DECODABLE = "avif bmp gif heic heif jfif jpeg jpg png tif tiff webp".split()
PACKAGES = "app aplibrary band bundle dtbase2 fcpbundle framework imovielibrary kext logicx lrdata lrlibrary musiclibrary photolibrary photoslibrary plugin pkg rtfd scriptbundle sparsebundle theater tvlibrary xcodeproj xcworkspace".split()

LISTING = "path string, kind string, size long, mtime timestamp, birthtime timestamp"


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A listing table of ``LISTING``'s columns, in any format that Spark reads."""
    return spark.read.format(fmt).schema(LISTING).load(path)


def union_roots(*listings: DataFrame) -> DataFrame:
    """Several roots as one inventory: a path that several list counts once, as the first of them has it."""
    tagged = [x.withColumn("_root", F.lit(i)) for i, x in enumerate(listings)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    columns = [c for c in every.columns if c not in ("path", "_root")]
    first = every.groupBy("path").agg(F.min_by(F.struct(*columns), "_root").alias("f"))
    return first.select("path", "f.*")


def is_hidden(rel: Column) -> Column:
    return F.exists(F.split(rel, "/"), lambda x: F.startswith(x, F.lit(".")))


def in_package(rel: Column) -> Column:
    """Below a folder whose extension marks it as a single document."""
    folders = F.split(paths.parent(rel), "/")
    return F.exists(folders, lambda x: paths.suffix(x).isin(*[f".{p}" for p in PACKAGES]))


def scan(listing: DataFrame, root: str, exclude: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Regular files below ``root`` with their path relative to it; not in packages, nor below ``exclude``.

    Symlinks and other kinds go if the listing has the column ``kind``. ``exclude`` equal to ``root`` excludes nothing.
    """
    rel = paths.relative(F.col("path"), root)
    out = listing.where(F.startswith("path", F.lit(root + "/"))).withColumn("rel", rel)
    if "kind" in listing.columns:
        out = out.where("kind = 'file'")
    if not include_hidden:
        out = out.where(~is_hidden(F.col("rel")))
    if exclude and exclude != root:
        out = out.where((F.col("path") != exclude) & ~F.startswith("path", F.lit(exclude + "/")))
    return out.where(~in_package(F.col("rel")))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, i) for i, (k, (label, _)) in enumerate(CATEGORIES.items())], "category string, label string, ord int")


def extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f".{e}", k) for k, (_, names) in CATEGORIES.items() for e in names.split()], "ext string, category string")


def classify(files: DataFrame) -> DataFrame:
    """Adds ``name``, ``ext`` and ``category``; the extension table has 136 rows."""
    named = files.withColumn("name", paths.name(F.col("path"))).withColumn("ext", paths.suffix(paths.name(F.col("path"))))
    known = F.broadcast(extensions(files.sparkSession))
    return named.join(known, "ext", "left").withColumn("category", F.coalesce("category", F.lit("other")))


def pending_dates(files: DataFrame, dated: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Files of the chosen ``categories`` for which the date table (path, size, mtime, date_source) has no date as they are now."""
    known = dated.where("date_source is not null").select("path", "size", "mtime")
    return files.where(F.col("category").isin(*categories)).join(known, ["path", "size", "mtime"], "left_anti")


def decodable(files: DataFrame) -> DataFrame:
    return files.where(paths.suffix(paths.name(F.col("path"))).isin(*[f".{e}" for e in DECODABLE]))


def category_counts(classified: DataFrame) -> DataFrame:
    """Files by category, also those with none."""
    counts = classified.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories(classified.sparkSession).join(counts, "category", "left").select("category", "label", F.coalesce("n", F.lit(0)).alias("n"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
