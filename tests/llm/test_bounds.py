"""What lies beyond each operator's bound, forced by small bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import jaccard, langid, lm, packing, shared, substring, token_store

from .helpers import documents, frame


def test_no_more_keys_than_asked_for_whatever_their_counts(spark):
    r = random.Random(1)
    for counts in ([200_000] * 1000, [r.randrange(1, 50) for _ in range(500)], [10 ** r.randrange(12) for _ in range(300)], [1 << 40] * 3 + [(1 << 40) + 1] * 3, [7]):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "key long, n long")
        for most in (1, 5, 100, 10_000):
            least = lm.at_least(df, most)
            assert sum(n >= least for n in counts) <= most
            if len(counts) <= most:
                assert least == 1
        # steps are exact up to a thousand: no smaller bound would do
        if max(counts) < 1000 and len(counts) > 100:
            least = lm.at_least(df, 100)
            assert sum(n >= max(x for x in counts if x < least) for n in counts) > 100
    assert lm.at_least(spark.createDataFrame([], "key long, n long"), 5) == 1


def test_scores_are_the_same_when_no_frequent_key_fits(spark):
    docs = frame(spark, [(i, "aa bb aa " * 40, "en", "s", 0) for i in range(30)], extra=False)
    model = lm.learn(docs)
    rows = lambda df: sorted((r["row"]["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in df.collect())
    assert rows(lm.scored(docs, model, keep=["doc_id"])) == rows(lm.scored(docs, model, keep=["doc_id"], trie_runs=4, head_words=1))


def test_languages_that_are_joined_give_the_same_rows(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(20)), f"junk{i % 150}", "s", 0) for i in range(300)] + [(900, None, "en", "s", 0), (901, "12 34", "en", "s", 0), (902, "日本", None, "s", 0)]
    docs = frame(spark, rows)
    profiles = langid.learn(docs)
    found = lambda n: sorted((x["row"]["doc_id"], x["lang_pred"], round(x["score"], 12)) for x in langid.predict(docs, profiles, keep=["doc_id"], languages=n).collect())
    assert found(1) == found(10_000) and len(found(1)) == len(rows)
    assert found(1)[-3:] == [(900, "und", 0.0), (901, "und", 0.0), (902, "junk0", 0.0)]
    with_text = langid.predict(docs, profiles, languages=1)
    assert {"row", "text", "lang_pred", "score"} == set(with_text.columns)


@pytest.mark.parametrize("meeting", [1, 2])
def test_shares_of_a_frequent_shingle_lose_no_link(spark, monkeypatch, meeting):
    docs = frame(spark, documents(7, 120))
    rows = lambda: sorted(map(tuple, jaccard.groups(docs, size=3, num=60, den=100).select("id", "n_shingles", "component_id").collect()), key=repr)
    usual = rows()
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    assert rows() == usual


@pytest.mark.parametrize("frequent", [1, 10**9])
def test_small_shards_cut_the_same_windows(spark, monkeypatch, frequent):
    docs = frame(spark, documents(8, 80))
    rows = lambda: sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.with_removals(docs, width=5, digest=True).collect()), key=repr)
    usual = rows()
    monkeypatch.setattr(substring, "SHARD_WINDOWS", 3)
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    assert rows() == usual


def test_rows_of_one_id_are_dealt_to_several_files(spark):
    docs = frame(spark, [(5, f"text {i} " * 9, "en", "s", 0) for i in range(200)], extra=False).repartition(4)
    folder = shared.scratch(spark, "ids")
    listed = token_store.write_ids(docs, folder)
    assert listed.count() > 1
    got = token_store.read_ids(spark, folder, listed).collect()
    assert len(got) == 200 and sorted(r["start"] for r in got)[0] == 0
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_pieces_keep_their_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 5, 0)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError, match="offset"):
        packing.pack(pieces.withColumn("offset", F.lit(1)))
    assert np.array_equal([r["offset"] for r in packing.pack(pieces).collect()], [0])
