"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook import vocab
from tallybook.functions.vectors import EmbedderFactory, candidate_scan, hashed_tokens, to_matrix
from tallybook.session import broadcast_if_small, materialize

# Query vectors one pass over the index holds in every Python worker; more queries
# mean more passes.
_QUERIES_PER_PASS = 50_000

#: Winners (an id and three numbers each) that every task may hold to fetch their columns.
_WINNERS_AT_ONCE = 500_000

#: Pieces in which the candidates of one query are merged first.
SALTS = 64


def _query_blocks(queries: DataFrame, id_column: str):
    total = queries.count()
    blocks = max(1, -(-total // _QUERIES_PER_PASS) * 2 if total > _QUERIES_PER_PASS else 1)
    for block in range(blocks):
        part = queries
        if blocks > 1:
            part = queries.where(F.pmod(F.xxhash64(id_column), F.lit(blocks)) == block)
        table = part.toArrow()
        if table.num_rows:
            yield table.column(0).combine_chunks(), to_matrix(table.column(1))


def nearest(
    index: DataFrame,
    queries: DataFrame,
    k: int = vocab.TOP_K,
    query_id: str = "query_id",
    row_id: str = "vec_id",
    vector: str = "embedding",
    text: str | None = None,
    factory: EmbedderFactory | None = None,
) -> DataFrame:
    """The ``k`` nearest index rows of every query: ``query_id, rank, distance, <row>``.

    Exact.  The index is scanned in place once per block of queries and is never
    shuffled or paired up row by row: a task multiplies its Arrow batches with the
    query matrix and passes on only the ids of rows that can still be among the nearest.
    Equal query vectors are searched once, and candidates carry a number for their vector.  These are merged in two bounded steps (:func:`merged`); the other columns of the
    winners are fetched afterwards by ``row_id``, which must identify a row.  Ranks
    follow the distance (to 9 places), then ``row_id``.  Filter the index before the
    call to rank among matching rows only.  An index without stored vectors names its
    ``text`` column, which is embedded during the scan by the ``factory``.
    """
    source_column = text or vector
    queries = materialize(queries.select(query_id, vector))
    vectors = materialize(queries.select(vector).distinct().withColumn("_query", F.monotonically_increasing_id()))
    schema = T.StructType([
        T.StructField("_query", T.LongType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField(row_id, index.schema[row_id].dataType),
    ])
    arrow_schema = to_arrow_schema(schema)
    source = index.where(F.col(source_column).isNotNull()).select(row_id, source_column)
    model = (factory or hashed_tokens()) if text else None
    scans = [
        source.mapInArrow(candidate_scan(ids, matrix, k, source_column, row_id, arrow_schema, model), schema)
        for ids, matrix in _query_blocks(vectors.select("_query", vector), "_query")
    ]
    if not scans:
        scans = [index.sparkSession.createDataFrame([], schema)]
    found = reduce(DataFrame.unionByName, scans).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    asked = queries.join(vectors, vector).select(query_id, "_query")
    best = _first(merged(found, "_query", row_id, k).join(asked, "_query").drop("_query"), row_id, k, query_id)
    best = best.select(query_id, F.round("distance", 4).alias("distance"), row_id, "rank")
    others = [c for c in index.columns if c not in (source_column, row_id)]
    if not others:
        return best
    # The winners are few beside the index, which then need not move.
    return broadcast_if_small(materialize(best), _WINNERS_AT_ONCE).join(index.select(row_id, *others), row_id)


def merged(found: DataFrame, query_id: str, row_id: str, k: int) -> DataFrame:
    """The ``k`` nearest of each query's candidates, with ``rank``; ``_salt`` tells their pieces apart.

    First the best of each salt, then the best of those: no task gets more than ``k`` rows a
    query from each task before it, nor more than salts times ``k`` rows a query at the end.
    """
    return _first(_first(found, row_id, k, query_id, "_salt").drop("_salt"), row_id, k, query_id)


def _first(rows: DataFrame, row_id: str, k: int, *by: str) -> DataFrame:
    """The ``k`` nearest of each group, with ``rank``."""
    order = Window.partitionBy(*by).orderBy("distance", row_id)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def centroids(index: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per label, for use as queries: ``query_id, embedding``."""
    return (
        index.select(label, F.posexplode(vector).alias("place", "value"))
        .groupBy(label, "place")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
        .groupBy(F.col(label).alias("query_id"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("dims"))
        .select("query_id", F.transform("dims", lambda d: d["mean"]).alias(vector))
    )
