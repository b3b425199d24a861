"""Every query against its SQL on the smallest tables.

``TALLYBOOK_FEW_CHECKS=1`` compares a handful only.
"""

import datetime
import decimal
import os
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from workload import fixtures

SF = Path(entry.SMOKE_DIR)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SHORT = [
    "clean_ledger", "cells_headered", "cells_positional", "resp_dedupe_utr", "categorize_case",
    "rules_shadowed", "plan_questions", "answer_totals", "knn_join", "retrieve_batch",
    "src_mixed_headers", "index_write_read", "prompt_context", "knn_lsh", "norm_dates", "ledger_fingerprint",
    "category_summary", "kpi_cards", "text_answer_matches", "eval_report",
]
NAMES = SHORT if os.environ.get("TALLYBOOK_FEW_CHECKS") else sorted(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(f"{float(value):.10g}") + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    questions = fixtures.questions(spark, str(SF)).count()
    out = entry.entry(spark)
    assert out.count() == out.select("question_id").distinct().count() == questions > 1000
