"""Every registered query of the reconciliation library against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.number)):
            return int(v) if v == int(v) else round(float(v), 6)
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    with duckdb.connect() as c:
        for name in os.listdir(SF):
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
        yield c


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_residual_pairs(spark, con):
    """The pairing has no SQL: of each entity it costs what the cheapest one in memory costs, and has every payment once."""
    from itertools import groupby

    from tallyloom.operators import audit
    from tallyloom.plans.fixtures import BASE

    a = con.sql(BASE + "SELECT entity, row_id, amount, created_at // 86400 FROM ledger WHERE type = 'payment' AND fee IS NOT NULL AND order_id NOT IN (SELECT order_id FROM erp) ORDER BY 1, 2").fetchall()
    b = con.sql(BASE + "SELECT entity, order_id, amount, invoice_day FROM erp WHERE order_id NOT IN (SELECT order_id FROM ledger WHERE type = 'payment') ORDER BY 1, 2").fetchall()
    by_entity = lambda of: {k: list(g) for k, g in groupby(of, lambda r: r[0])}
    orders, want, cost = by_entity(b), {}, lambda x, y: abs(x[2] - y[2]) + 1_000 * abs(x[3] - y[3]) + 1_000_000
    for entity, own in by_entity(a).items():
        pairs = audit.assigned_pairs([[cost(x, y) for y in orders[entity]] for x in own]) if entity in orders else []
        want[entity] = (len(own), len(pairs), sum(c for *_, c, _ in pairs))
    got = catalogue.QUERIES["j13_residual_pairs"](spark, SF).toPandas()
    assert sorted(got.row_id) == sorted(r[1] for r in a) and set(got.status) <= {"refused", "unpaired"}
    pairs = got[got.order_id.notna()]
    assert not pairs.order_id.duplicated().any()
    at = {r[1]: r for r in a + b}
    assert all(r.cost == cost(at[r.row_id], at[r.order_id]) and r.entity == at[r.order_id][0] for r in pairs.itertuples())
    assert {e: (len(g), int(g.order_id.notna().sum()), int(g.cost.sum())) for e, g in got.groupby("entity")} == want


def test_entry_stands_alone():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
