"""Written forms of the ledger and of the searchable index."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.vectors import EmbedderFactory, with_embedding
from tallybook.operators.filters import with_chunk, with_metadata
from tallybook.operators.identity import changed_months, month_fingerprints, named_copies, numbered_copies
from tallybook.session import materialize

#: Folders that one task writes at the same time.
_FOLDERS_AT_ONCE = 32

LEDGER_SCHEMA = "date date, description string, amount double, transaction_type string"


def write_ledger_csv(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_ledger_csv(spark: SparkSession, path: str, categorized: bool = False) -> DataFrame:
    schema = LEDGER_SCHEMA + (", category string" if categorized else "")
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_ledger_parquet(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").parquet(path)


def build_index(
    categorized: DataFrame, embed: bool = True, factory: EmbedderFactory | None = None
) -> DataFrame:
    """Ledger rows with id, metadata, chunk text and (unless ``embed`` is off) vector.

    The rebalance hint gathers each month in few files and lets Spark split a month that is
    too large for one task.  Only the ledger's own columns move; ids, texts and vectors are
    made afterwards, in the stage that writes them.
    """
    copies = numbered_copies(categorized).withColumns({"year": F.year("date"), "month_num": F.month("date")})
    copies = copies.hint("rebalance", "year", "month_num").drop("year", "month_num")
    index = with_chunk(with_metadata(named_copies(copies))).withColumn(
        "description_lc", F.lower("description")
    )
    return with_embedding(index, factory) if embed else index


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Write folders side by side, without sorting whole rows (with their vectors) by folder first.

    A task that meets more folders than this sorts the rest.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    stated = spark.conf.get(name)
    if int(stated):
        yield
        return
    spark.conf.set(name, _FOLDERS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(name, stated)


def _write_months(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    with _unsorted(spark):
        writer.mode("overwrite").partitionBy("year", "month_num").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Replace the index table, one folder per year and month (:func:`build_index` gathers them)."""
    _write_months(index.write, index.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _files_at(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def refresh_index(
    categorized: DataFrame, path: str, embed: bool = True, factory: EmbedderFactory | None = None
) -> DataFrame:
    """Bring the index at ``path`` up to date and return ``year, month_num, action``.

    Fingerprints of the months are kept beside the index.  Only months that are new or have
    another fingerprint are built, embedded and written, each replacing its own folder; the
    folders of months that are gone are removed, all others stay as they are.  Ids depend on
    the content of a month alone, so the result equals an index built anew.  Fingerprints are
    written last: a run that was interrupted builds the same months again.
    """
    spark = categorized.sparkSession
    beside = f"{path}/_months"  # readers of the index skip names with an underscore
    now = materialize(month_fingerprints(categorized))
    place, files = _files_at(spark, beside)
    stored = spark.read.schema(now.schema).parquet(beside) if files.exists(place) else now.limit(0)
    actions = materialize(changed_months(stored, now))
    wanted = actions.where("action IN ('added', 'changed')").select("year", "month_num")
    rows = categorized.withColumns({"year": F.year("date"), "month_num": F.month("date")})
    rows = rows.join(F.broadcast(wanted), ["year", "month_num"], "left_semi").drop("year", "month_num")  # at most one row a month
    if not wanted.isEmpty():
        _write_months(build_index(rows, embed, factory).write.option("partitionOverwriteMode", "dynamic"), spark, path)
    for gone in actions.where("action = 'removed'").collect():
        place, files = _files_at(spark, f"{path}/year={gone['year']}/month_num={gone['month_num']}")
        files.delete(place, True)
    now.write.mode("overwrite").parquet(beside)
    return actions
