import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from plinth.operators import lineage
from plinth.operators.hot_join import hot_join, hot_keys
from plinth.operators.skew import key_stats


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_a_join(spark, how):
    rng = random.Random(4)
    large = [("a" if rng.random() < 0.5 else rng.choice("bcdefg"), rng.choice([1, None]), k) for k in range(2000)] + [(None, 1, -1)]
    small = [(k, v, f"{k}{v}{i}") for k in "abcxyz" for v in (1, 2) for i in range(2)] + [(None, 1, "n")]
    big, few = spark.createDataFrame(large, "k string, v int, n int"), spark.createDataFrame(small, "k string, v int, t string")
    want = sorted(map(str, big.join(few, ["k", "v"], how).collect()))
    assert sorted(map(str, hot_join(big, few, ["k", "v"], how, salts=5, shares=4, least=10).collect())) == want
    assert sorted(map(str, hot_join(big, few, ["k", "v"], how).collect())) == want
    assert hot_join(big.limit(0), few, ["k", "v"], how).count() == 0


def test_hot_keys_are_few_and_spread(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert [r.k for r in hot_keys(counts, ["k"], shares=10, least=100).collect()] == ["hot"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = hot_join(df, counts, ["k"], shares=10, least=100)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 10_000 and max(sizes) < 4000


def test_small_arrays_give_the_same_sums(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None, *map(str, range(40))]), rng.choice([None, rng.randint(-5, 9)]), f"i{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v bigint, i string").repartition(5)
    whole = {tuple(r) for r in key_stats(df, "k", "v", None, "i").collect()}
    assert whole == {tuple(r) for r in key_stats(df, "k", "v", None, "i", max_slots=3).collect()} and len(whole) == 43


def test_written_tables_are_deleted(spark):
    df = lineage.written(spark.range(5), "test")
    path = lineage._WRITTEN[-1][1]
    assert df.count() == 5
    lineage.forget()
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_no_own_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session)


def test_the_rest_loads_without_a_library_of_the_subpackage():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('p1_') for n in q) and 'p5_author_stats' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=lineage.__file__.rsplit("/plinth/", 1)[0])
