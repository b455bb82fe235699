"""Queries get their whole input, and the operators tell what belongs to them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stocktide.operators import promo as pr
from stocktide.plans import q_clean

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_discount_lines_are_told_from_all_lines(spark):
    raw = q_clean.discount_rows(spark, SF)
    total, wanted = duckdb.connect().execute(f"SELECT count(*), count(*) FILTER (l_discount >= 0.09) FROM '{SF}/lineitem.parquet'").fetchone()
    assert raw.count() == total > wanted == pr.discount_lines(raw).count()


@pytest.mark.parametrize("name", ["promo_text_fields", "promo_calendar"])
def test_promo_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
