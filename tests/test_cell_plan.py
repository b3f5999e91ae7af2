"""The cell plan where no side of a join is small enough to be sent to all tasks."""

import glob
import os

import duckdb
import pytest
from test_oracles import SF, rows

from ledgerloom.plans import registry


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_cell_plans_hold_without_broadcasts(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(registry.ORACLES["cell_plan_full"])
    columns = [d[0] for d in found.description]
    limits = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in limits:
        spark.conf.set(k, "-1")
    try:
        # parts of a union were joined with hit nodes each, and then as one with lines that had another number of tasks: an error
        df = registry.QUERIES["cell_plan_full"](spark, SF)
        assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)
    finally:
        for k in limits:
            spark.conf.unset(k)
