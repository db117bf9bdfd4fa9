"""Queries over tables whose keys are as large as those of copies of the test tables, against their SQL."""

import os

import pytest

from compare import connect, differences
from wayfare import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A folder of tables whose parts have up to seven digits and whose orders pass every letter of a designator."""
    d = str(tmp_path_factory.mktemp("large"))
    con = connect(SF)
    shifts = "(VALUES (0, 0), (260000, 260000), (1200000, 6500000), (1200200, 12740000)) s(part, orders)"
    con.execute(f"COPY (SELECT p_partkey + s.part AS p_partkey, part.* EXCLUDE (p_partkey) FROM part, {shifts}) TO '{d}/part.parquet'")
    con.execute(f"COPY (SELECT l_orderkey + s.orders AS l_orderkey, l_partkey + s.part AS l_partkey, lineitem.* EXCLUDE (l_orderkey, l_partkey) FROM lineitem, {shifts} WHERE l_orderkey % 3 = 0) TO '{d}/lineitem.parquet'")
    for name in ("nation", "region", "supplier"):
        os.symlink(f"{SF}/{name}.parquet", f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["built_source", "chart_publishers", "content_signature", "exchange_files", "fixed_width_points", "navdata_points", "piped_points", "publication_by_classes", "publication_by_rows"])
def test_equals_sql(spark, large, name):
    assert differences(catalog.QUERIES[name](spark, large), connect(large), catalog.ORACLE_SQL[name]) == []


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder of tables whose orders have thirteen digits, over several pages of charts."""
    d = str(tmp_path_factory.mktemp("far"))
    con = connect(SF)
    con.execute(f"COPY (SELECT l_orderkey * 7 + 1000000000000 AS l_orderkey, lineitem.* EXCLUDE (l_orderkey) FROM lineitem WHERE l_orderkey % 3 = 0) TO '{d}/lineitem.parquet'")
    return d


def test_pages_of_charts_keep_their_names(spark, far):
    assert differences(catalog.QUERIES["chart_publishers"](spark, far), connect(far), catalog.ORACLE_SQL["chart_publishers"]) == []
