import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (doc_id, text) pairs, in several partitions, with columns that no operator may trip over."""

    def make(rows, lang="en", extra=True):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, lang if len(rest) == 0 else rest[0], "s", len(t or "")) for i, t, *rest in rows]
        df = spark.createDataFrame(data, DOCS).repartition(3) if data else spark.createDataFrame([], DOCS)
        if extra:
            df = df.selectExpr("*", "'x' AS id", "1 AS key", "'y' AS h", "2 AS fp", "3 AS row", "'z' AS host", "0 AS n_docs", "NULL AS spans")
        return df

    return make


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()), key=repr)
