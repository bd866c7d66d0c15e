"""A cross-section of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["b10_safe_component", "c04_numbered_termination", "d04_normalize_records", "d11_normalize_field_values", "e07_table_digest", "f05_table_constraints",
          "f10_referential_integrity", "f17_hierarchy_reconstruction", "f22_collect_checks", "g08_conclusion", "h06_record_documents", "i04_latest_events", "i10_scope_status"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, db, name):
    frame = contract.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    cursor = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=repr)
    assert got == want
