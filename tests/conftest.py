import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logweave.session import local_session

    s = local_session(4, shuffle_partitions=4, app="logweave-tests")
    yield s
    s.stop()


@pytest.fixture
def lines_df(spark):
    """Build a line DataFrame ``[value, line_no]`` from a list of strings (line order = list order)."""

    def make(lines):
        return spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line_no bigint, value string")

    return make


@pytest.fixture
def entries_df(spark):
    """Entries ``[seq, message, event_data]`` from (message, payload_json_or_None) pairs."""
    from logweave.sources.table import entries_from_table

    def make(items, partitions=1):
        rows = [(i, m, p) for i, (m, p) in enumerate(items)]
        df = spark.createDataFrame(rows, "seq bigint, message string, payload string")
        if partitions > 1:
            df = df.repartition(partitions)
        return entries_from_table(df, message="message", payload_json="payload", keep=["seq"])

    return make
