import random

from pyspark.sql import functions as F

from .helpers import frame
from .test_models import LANGS


def prose(seed, n, words=60):
    r = random.Random(seed)
    return [" ".join(r.choice(LANGS["en"]) + r.choice("aeiou") + r.choice("bcdfgh") * r.randrange(2) + str(r.randrange(9)) * r.randrange(2) for _ in range(words)) for _ in range(n)]


def test_pipeline_catches_planted_cases_and_keeps_the_rest(spark, tmp_path):
    import corpus_pipeline

    texts = prose(1, 60)
    item = " ".join(prose(2, 1, 30)[0].split())
    passage = prose(3, 1, 70)[0]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    near = texts[3].split()
    near[20] = "edited"
    rows += [(100, texts[3], "en", "s", 0), (101, " ".join(near), "en", "s", 0), (102, "123 456 !!", "en", "s", 0), (103, None, None, None, None), (104, "", "en", "s", 0)]
    rows += [(110, texts[10][:50] + " " + item + " " + prose(4, 1)[0], "en", "s", 0)]
    rows += [(120 + k, prose(10 + k, 1, 90)[0] + " " + passage + " " + prose(20 + k, 1, 90)[0], "en", "s", 0) for k in range(3)]
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in range(60)}
    assert set(kept["language_id"]) == clean | {100, 101, 110, 120, 121, 122}
    assert set(kept["near_duplicates"]) == clean | {110, 120, 121, 122}
    last = kept["decontamination"]
    assert set(last) == clean | {110, 120, 121, 122}
    assert all(last[i]["text"] == texts[i] for i in clean)
    assert passage in last[120]["text"] and not any(x in last[k]["text"] for k in (121, 122) for x in (passage[:40], passage[-40:]))
    assert item[:60] not in last[110]["text"] and last[110]["n_chars"] == len(last[110]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(last)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
