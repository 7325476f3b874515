"""What is made of the relationship view stays dealt by rows."""

from collections import Counter

import duckdb
import pytest

from tierweave import queries as Q
from tierweave.operators import relations
from tierweave.sources import writers

HERE = "/root/testdata/sf0.001"
SQL_TABLES = ("lineitem", "orders")


@pytest.fixture
def dealt(monkeypatch):
    """A task gets 500 line items or so of the 6,000."""
    monkeypatch.setattr(Q, "FILE_ROWS", 1_000, raising=False)
    monkeypatch.setattr(Q, "TASK_ROWS", 500, raising=False)


def most(rows):
    """The rows of all tasks, and of the largest."""
    sizes = rows.rdd.mapPartitions(lambda own: [sum(1 for _ in own)]).collect()
    return sum(sizes), max(sizes)


def equals_its_sql(spark, name):
    sql = duckdb.connect()
    for t in SQL_TABLES:
        sql.execute(f"CREATE VIEW {t} AS FROM '{HERE}/{t}.parquet'")
    return Counter(map(tuple, Q.queries()[name](spark, HERE).collect())) == Counter(sql.execute(Q.oracle_sql()[name]).fetchall())


def test_report_lines(spark, dealt):
    n = Q.table(spark, HERE, "lineitem").count()
    lines = writers.markdown(Q.rel(spark, HERE)).where("at.part in (6, 8, 10, 12)")
    total, largest = most(lines)
    assert total == n and largest <= 1_000
    assert equals_its_sql(spark, "report_markdown")


def test_reconciled_names(spark, dealt):
    n = Q.table(spark, HERE, "lineitem").count()
    total, largest = most(relations.reconcile_names(Q.rel(spark, HERE)))
    assert total == n and largest <= 1_000
    assert equals_its_sql(spark, "rel_reconcile_org")
