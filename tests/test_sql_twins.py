"""Every registered query of the library against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from marketloom.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else (float(v) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else v) for v in r) for r in df.itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries()))
def test_twin(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in oracle_sql():
        want = con.sql(oracle_sql()[name]).df()
        assert plain(got)[0] == plain(want)[0]
        bad = [(a, b) for a, b in zip(plain(got)[1], plain(want)[1]) if a != b]
        assert len(got) == len(want) and not bad, (len(got), len(want), bad[:3])
