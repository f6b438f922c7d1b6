import pytest
from pyspark.sql import functions as F

from latticework.llm.common import most_frequent


@pytest.mark.parametrize(
    "count",
    ["7", "5000000 + id", "3000000000", "id + 1", "int(pow(1.09, id))", "if(id < 3, 9000000, 2)"],
)
def test_as_many_as_asked_for_whatever_the_counts(spark, count):
    rows = spark.range(200).select(F.col("id").cast("string").alias("word"), F.expr(f"bigint({count})").alias("c"))
    counts = sorted((r.c for r in rows.collect()), reverse=True)
    for most in (1, 10, 150, 200, 500):
        got = most_frequent(rows, "c", most).collect()
        assert len(got) == len({r.word for r in got}) == min(most, 200)
        # up to a thousandth, no row left out counts more than one taken in
        assert min(r.c for r in got) >= counts[len(got) - 1] * 0.998


def test_no_rows(spark):
    assert most_frequent(spark.createDataFrame([], "word string, c long"), "c", 10).count() == 0
