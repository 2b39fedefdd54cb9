import random
import time

from pyspark.sql import functions as F

from corpusmill.functions.text import ordered_distinct
from corpusmill.session import CLEANUP, written


def test_distinct_terms_of_a_whole_text(spark):
    rng = random.Random(3)
    words = ["a", "A", "b", "", "Bc", "bC", None, "É", "é"]
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(200)] + [[f"w{k}" for k in range(20_000)] * 2]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, t array<string>")
    for r in rows.withColumn("d", ordered_distinct(F.col("t"))).collect():
        want, seen = [], set()
        for t in r.t:
            if t is None or (t and t.lower() not in seen):
                want.append(t)
                seen.add(t and t.lower())
        assert r.d == want


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(manager.getAllFiles().mkString("\n").split("\n"))
    before, setting = files(), spark.conf.get(CLEANUP, None)
    table = written(spark.range(1000).repartition(7, "id"), "dealt")
    left = []
    for _ in range(50):  # they go a moment later
        left = [f for f in files() - before if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert table.count() == 1000
    assert spark.conf.get(CLEANUP, None) == setting
