import os

import duckdb
import pandas as pd
import pytest

from shoebox.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def same_rows(spark_df, sql_df) -> bool:
    """The same columns and rows, whatever their order; numbers to 6 digits."""

    def plain(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            df[c] = [None if pd.isna(x) else round(float(x), 6) if pd.api.types.is_number(x) and not pd.api.types.is_bool(x) else str(x) for x in df[c]]
        return sorted(map(repr, df.itertuples(index=False, name=None)))

    return sorted(spark_df.columns) == sorted(sql_df.columns) and plain(spark_df) == plain(sql_df)
