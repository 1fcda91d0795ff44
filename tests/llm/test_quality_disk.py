"""What training shuffles isn't on the disks while texts are judged."""

import time

from barelake.llm import quality


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(k) for k in range(files.length())) if f.getName().startswith("shuffle_")}


def test_no_shuffle_of_the_training_is_left(spark):
    words = "stone river green walks house small and the".split()
    docs = spark.createDataFrame([(k, " ".join(words[(k * i + i // 3) % 8] for i in range(40)), "en") for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)], "doc_id long, quality int")
    settings = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    before = shuffled(spark)
    fitted = quality.train(docs, labels)
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    now = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    assert all(now[k] == v for k, v in settings.items())
    judged = fitted.judge(docs)
    assert judged.count() == judged.count() == 60 and {r["doc_id"] for r in judged.collect()} == set(range(60))
