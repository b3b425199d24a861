"""The registered queries over the smallest tables: SQL where there is some, the contracts' columns."""

import hashlib
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tallybook.llm import queries

SF = Path(entry.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_registered():
    assert sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, str(SF))
    cursor = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(tuple(value(row[i]) for i in order) for row in cursor.fetchall())
    assert sorted(tuple(value(v) for v in row) for row in df.collect()) == want


def test_pii_digests(spark, documents):
    from tallybook.llm.pii import KINDS, base_spans

    for r in queries.QUERIES["op6_find_pii"](spark, str(SF)).collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(documents[r.doc_id].text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [sum(s[0] == k for s in spans) for k in KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_languages_of_held_out_documents(spark, documents):
    pytest.importorskip("public_tokenizers")
    rows = [r for r in queries.QUERIES["op8_language_id"](spark, str(SF)).collect() if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in rows) >= 0.95 * len(rows) > 0


def test_model_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in queries.QUERIES["op4_hmm_score"](spark, str(SF)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
