"""What the operators of this subpackage share: readers, words, intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; the schema is declared, so no file is opened to infer it."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see, for written tables and archives.

    Under ``spark.checkpoint.dir`` where the cluster names one, else under the
    session's warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Python workers get at most so much text at a time, in this session.

    Texts can be very long; the default is eight times as much for each of a worker's copies.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go when it has run, not when the driver
    happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    with shuffles_removed(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``written`` made and that no plan reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(names: list[str]) -> Column:
    """Columns, whatever their names are, as one struct."""
    return F.struct(*(F.col(f"`{name.replace('`', '``')}`") for name in names))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words, as long; null text has none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, SPACE, "")).cast("long")
