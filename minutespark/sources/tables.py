"""Sources and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..schemas import EVAL_QUERIES
from .parse import decoded, html_to_text, pdf_to_text

EXTENSIONS = r"(?i)\.(pdf|html?|txt)\z"


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A table of a relational database; numeric keys split the read."""
    if not url:
        raise RuntimeError("the database URL is not set")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and partitions > 1:
        reader = reader.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def sample_files(spark: SparkSession, folder: str) -> DataFrame:
    """url (file://relative/path) and text of the PDF, HTML and text files below a folder; none if it is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "url string, text string")
    root = fs.resolvePath(path).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.col("path").rlike(EXTENSIONS))
    plain = F.regexp_replace("path", r"\A[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    files = files.select(F.concat(F.lit("file://"), F.substr(plain, F.lit(len(root) + 1))).alias("url"), "content", F.lower("path").alias("p"))
    pdf = files.filter(F.col("p").endswith(".pdf")).select("url", pdf_to_text(F.col("content")).alias("text"))
    html = files.filter(F.col("p").rlike(r"\.html?\z")).select("url", html_to_text(F.col("content")).alias("text"))
    text = files.filter(F.col("p").endswith(".txt")).select("url", clean_text(decoded(F.col("content"))).alias("text"))
    return pdf.unionByName(html).unionByName(text)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_QUERIES).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_eval_csv(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def rank_lines(hits: DataFrame) -> list[str]:
    """``rank<TAB>url`` of one query's hits (at most the limit of a search)."""
    rows = hits.orderBy("rank").select("rank", "url").limit(1000).collect()
    return [f"{r.rank}\t{r.url}" for r in rows] or ["No results found."]
