"""Every query that has SQL, against DuckDB."""

import duckdb
import pytest
from compare import assert_same, duck

from tessera.plans.registry import QUERIES, SQL


def test_sql_is_of_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name])
    spark.catalog.clearCache()


def test_digests_of_single_precision(spark, tmp_path):
    """A component of 0.9305 as a float times 1000 is 930.5 as a float, and less as a double."""
    row = (1, "a " * 315 + "b " * 124, "en", "src1", 878)
    spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(QUERIES["embed_reuse"](spark, str(tmp_path)), c, SQL["embed_reuse"])
