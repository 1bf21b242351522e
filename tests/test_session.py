from celltrail.session import cut_lineage


def test_estimates_stay_short(spark):
    """A frame joined to itself again and again, as pointers are doubled."""
    df = spark.range(64).selectExpr("id", "(id + 1) % 64 as p")
    for _ in range(6):
        df = cut_lineage(df.join(df.selectExpr("id as p", "p as q"), "p").selectExpr("id", "q as p"))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 100
    assert sorted(map(tuple, df.collect())) == [(i, i) for i in range(64)]
