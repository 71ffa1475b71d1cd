"""Sources: text columns as lines, spreading coarse inputs."""

from logweave.sources.balance import spread
from logweave.sources.table import lines_from_text_column


def test_lines_from_text_column_edges(spark):
    df = spark.createDataFrame(
        [(1, "a\nb\n"), (2, ""), (3, "x\r\ny\r"), (4, None), (5, "\n\nz"), (6, "solo")], "id bigint, text string")
    got = sorted(tuple(r) for r in lines_from_text_column(df, "text", keep=["id"]).collect())
    assert got == [
        (1, 0, "a"), (1, 1, "b"),           # no line after the final newline
        (3, 0, "x"), (3, 1, "y"),           # one trailing CR dropped per line
        (5, 0, ""), (5, 1, ""), (5, 2, "z"),
        (6, 0, "solo"),
    ]


def test_spread_only_on_request(spark):
    coarse = spark.range(100).coalesce(1)
    assert spread(coarse) is coarse
    spread_df = spread(coarse, 3)
    assert spread_df.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in spread_df.collect()) == list(range(100))
