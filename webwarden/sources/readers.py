"""Sources: brand catalogues, page snapshots, logs, labelled URL files, block lists, tables with guessed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRAND_SCHEMA = (
    "brand_id string, display_name string, official_login_url string, canonical_domains array<string>, brand_color string, official_cert_issuer string, security_advice string, screenshot_path string, logo_path string, "
    "dom_snapshot_path string, landing_snapshot_path string, embedding_cache_id string"
)
# Labels that mean a harmless URL.
BENIGN = ["0", "benign", "legitimate", "good", "safe"]


def brands(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue as one JSON array; missing fields are null."""
    return spark.read.schema(BRAND_SCHEMA).json(path, multiLine=True)


def brand_domains(catalogue: DataFrame) -> DataFrame:
    """(brand_id, domain): the canonical hosts, in lower case; a brand without any has brand.com."""
    own = F.when(F.size("canonical_domains") > 0, F.col("canonical_domains")).otherwise(F.array(F.concat("brand_id", F.lit(".com"))))
    return catalogue.select("brand_id", F.explode(own).alias("domain")).select("brand_id", F.lower("domain").alias("domain"))


def snapshots(spark: SparkSession, folder: str, name: str = "dom.html") -> DataFrame:
    """(brand_id, html) of the files `name` in the folders of the brands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("brand_id"), F.decode("content", "utf-8").alias("html"))


def reference_images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(brand_id, content): the first image by name of each folder; the key in lower case without blanks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    key = F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)), "[ _]|%20", "")
    return files.groupBy(key.alias("brand_id")).agg(F.min_by("content", "path").alias("content"))


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): numbers grow in the order of the files and of their lines, with gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) of tab-separated lines whose label (1, 0 or -1, the last meaning 0) is in the first or second
    column, or follows from "phish" in the file's name."""
    parts = F.split(F.trim("value"), "\t")
    a, b = F.trim(F.try_element_at(parts, F.lit(1))), F.trim(F.try_element_at(parts, F.lit(2)))
    code = lambda c: F.when(c == "1", 1).when(c.isin("0", "-1"), 0)
    named = F.when(F.contains(F.lower(F.input_file_name()), F.lit("phish")), 1).otherwise(0)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.when(code(a).isNotNull(), b).otherwise(a).alias("url"), F.coalesce(code(a), code(b), named).alias("label"))
    return rows.filter("url <> ''")


def urls_in_cells(table: DataFrame) -> DataFrame:
    """(url, label 1): every cell of a sheet that starts with http(s)."""
    cells = F.explode(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in table.columns]))
    return table.select(cells.alias("url")).filter(F.col("url").rlike("^https?://")).withColumn("label", F.lit(1))


def urls_in_names(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(url): hosts that file names spell, without the prefix and what follows the last underscore."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), rf"^{prefix}|_[^_]*$", "")
    return spark.read.format("binaryFile").load(path).select(stem.alias("h")).filter(F.contains("h", F.lit("."))).select(F.concat(F.lit("http://"), "h").alias("url")).distinct()


def blocklist_feed(spark: SparkSession, path: str) -> DataFrame:
    """(url, label 1) of a feed: comments and filter syntax skipped, bare hosts given a scheme."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("v")).filter(~F.col("v").rlike(r"^[#\[!]") & F.contains("v", F.lit(".")))
    return rows.select(F.when(F.col("v").rlike("^https?://"), F.col("v")).otherwise(F.concat(F.lit("http://"), "v")).alias("url"), F.lit(1).alias("label")).distinct()


def guessed_table(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) of a CSV whose columns are found by their names: a url or domain column, and a label, class, type
    or result column; a table without labels holds positives."""
    t = spark.read.csv(path, header=True)
    pick = lambda words: next((c for c in t.columns if any(w in c.lower() for w in words)), None)
    url, label = pick(["url", "domain", "link"]), pick(["label", "class", "type", "result", "status"])
    if url is None:
        return spark.createDataFrame([], "url string, label int")
    value = F.when(F.lower(F.trim(F.col(f"`{label}`"))).isin(BENIGN), 0).otherwise(1) if label else F.lit(1)
    return t.select(F.trim(F.col(f"`{url}`")).alias("url"), value.alias("label")).filter("url <> ''")
