from temblor.operators.cleaning import add_seq


def test_row_numbers_are_unique_and_stay(spark):
    df = add_seq(spark.range(100).repartition(3).withColumnRenamed("id", "v"))
    first = {r["v"]: r["seq"] for r in df.collect()}
    assert len(set(first.values())) == 100
    assert first == {r["v"]: r["seq"] for r in df.collect()}
