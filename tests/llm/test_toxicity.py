import random

from pyspark.sql import functions as F

from docket.llm import toxicity as T
from docket.llm.common import crc_mod
from docket.session import read_table

DIR = "/root/testdata/sf0.01"


def test_features_are_distinct_and_stay_inside_texts():
    both = ["Ab cab", None, "", "xy"]
    row, bucket = T.features(both)
    for i, t in enumerate(both):
        alone = T.features([t])[1]
        assert sorted(bucket[row == i]) == sorted(alone)
    raw = b" ab cab "
    grams = {raw[i:i + n] for n in T.ORDERS for i in range(len(raw) - n + 1)}
    assert len(T.features(["Ab  cab\n"])[1]) == len(grams)


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    model = T.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    rows = T.score(docs, model).join(labels, "doc_id").filter(crc_mod("doc_id", 5) == 0).collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    found = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert right >= 0.95 and sum(found) / len(found) >= 0.6, (right, found)  # 45 toxic rows to learn from


def test_odd_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(20)] + (["stinker"] if i % 3 == 0 else [])), "t") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 1), (1, None), (None, 1)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "STINKER " * 50_000, "x"), (4, "fine", "x"), (None, "stinker", "x")],
                                "doc_id bigint, text string, label string")
    got = [(r["doc_id"], r["predicted"]) for r in T.score(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 0), (4, 1), (4, 0), (None, 1)], key=str)
    assert T.score(odd.limit(0), model).count() == 0
    none = T.fit(docs, labels.limit(0))
    assert T.score(docs, none).agg(F.max("score")).first()[0] < 1e-6
