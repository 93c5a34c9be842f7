"""The entry points work with and without the training-data operators."""

import __spark_entry__


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
