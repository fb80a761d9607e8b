import datetime as dt

from plinth.operators.skew import key_stats


def test_key_stats_nulls_ties_and_flush(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [("a", 1, t, "x", 9), ("a", None, t, "b", 9), ("a", 5, None, "c", 9), (None, 2, t, "d", 9), ("", None, None, None, 9), ("a", 1, t, "x", 9)]
    df = spark.createDataFrame(rows, "k string, v bigint, t timestamp_ntz, i string, n int")
    for slots in (500_000, 1):
        got = {r.key: r for r in key_stats(df, "k", "v", "t", "i", max_slots=slots).collect()}
        assert set(got) == {"a", None, ""}
        assert (got["a"].n, got["a"].n_values, got["a"].total, got["a"].largest) == (4, 3, 7, 5)
        assert (got["a"].first_id, got["a"].last_id, got["a"].first_at) == ("b", "x", t)
        assert (got[""].total, got[""].largest, got[""].first_id, got[""].last_at) == (0, None, None, None)
        assert got[None].n == 1
    assert key_stats(df.limit(0), "k", "v", "t", "i").count() == 0
