"""Every registered query without an underscore-numbered operator against its SQL, at the smallest size."""

import duckdb
import pandas as pd
import pytest

from tracklore.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches_sql(spark, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    if sql := catalog.oracle_sql().get(name):
        with duckdb.connect() as db:
            for t in TABLES:
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
            assert got == rows(db.execute(sql).df())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
