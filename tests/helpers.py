DATA = "/root/testdata/sf0.001"


def same_rows(spark_df, sql, con):
    """Both as sorted lists of tuples, columns by name."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()), key=repr)
    assert key(a) == key(b)
