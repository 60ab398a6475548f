import __spark_entry__


def test_entry(spark, sf_dir):
    assert 0 < __spark_entry__.entry(spark).count() <= 20


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
