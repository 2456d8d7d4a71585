"""The corpus queries that have SQL, against DuckDB on the small driver tables."""

import os

import duckdb
import pytest

from skyloom.llm.oracles import ORACLES
from skyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = sorted(c[0] for c in result.description)
    assert names == sorted(df.columns)
    want = result.fetchdf()[names]
    got = df.select(names).toPandas()
    order = [c for c in ("doc_id", "item_id", "start_word", "anchor_id", "positive_id", "rank") if c in names]
    want, got = (x.sort_values(order).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) and want.astype(object).where(want.notna(), None).equals(got.astype(object).where(got.notna(), None))
