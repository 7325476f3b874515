"""Relationship queries over orders whose numbers are beyond a BIGINT, against their SQL with the exact number."""

import datetime
import random
from collections import Counter

import duckdb
import pytest

from tierweave import queries as Q

BIGINT = "CAST(((l_orderkey * 16 + l_linenumber) * 10000000 + l_partkey) * 10000 + l_suppkey % 10000 AS BIGINT) AS seq"
EXACT = "((CAST(l_orderkey AS HUGEINT) * 16 + l_linenumber) * 10000000 + l_partkey) * 10000 + l_suppkey % 10000 AS seq"
NAMES = [
    "graph_vendor_agg", "rel_at_layer", "rel_dedup_merge", "rel_infra_filter", "rel_marketing_filter", "rel_limits_topn", "report_json", "rel_predup", "graph_pages",
]


@pytest.fixture(scope="module")
def here(spark, tmp_path_factory):
    """Orders on both sides of 5,764,608, from where on their numbers are beyond a BIGINT, and some of ten digits, of which the evidence keeps nine."""
    folder, rng, day = tmp_path_factory.mktemp("numbers"), random.Random(4), datetime.datetime(2024, 1, 1)
    keys = [*range(1, 40), *range(5_764_590, 5_764_630), *range(8_999_960, 9_000_000), *range(1_000_000_005, 1_000_000_030), *range(10_000_000_050, 10_000_000_060)]
    lines = [(o, rng.randrange(1_200_000), rng.choice((3, 5, 6, 10_003, 59_990)), n, 1.0, 1.0, 0.0, 0.0, rng.choice("ANR"), rng.choice("OF"), day) for o in keys for n in (3, 1, 2, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(o, rng.randrange(6), "F", 1.0, day, rng.choice(("1-URGENT", "5-LOW"))) for o in keys]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_exact_sql(spark, here, name):
    sql = duckdb.connect()
    for t in ("lineitem", "orders"):
        sql.execute(f"CREATE VIEW {t} AS FROM read_parquet('{here}/{t}.parquet/*.parquet')")
    found = Q.queries()[name](spark, here)
    columns = ", ".join("TRY_CAST(seq AS BIGINT)" if c == "seq" else c for c in found.columns)
    want = sql.execute(f"SELECT {columns} FROM ({Q.oracle_sql()[name].replace(BIGINT, EXACT)})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert Counter(got) == Counter(want) and want
    if "seq" in found.columns:
        at = found.columns.index("seq")
        assert len({r[at] is None for r in got}) == 2
    with pytest.raises(duckdb.Error):  # the number itself is what a BIGINT does not hold
        sql.execute(f"SELECT max(seq) FROM (WITH {Q.REL} SELECT seq FROM rel)").fetchall()
