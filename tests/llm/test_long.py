"""One text beyond every block and batch limit goes through each operator whole."""

import random

import pytest

from quarryloom.llm import decontam, jaccard, langid, lm, packing, quality, shared, substring, token_store, tokens

from .helpers import frame

WORDS = 180_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(60_000)}" for _ in range(WORDS))
    assert len(long) > 2 * shared.PIECE_BYTES
    tail = " ".join(long.split(" ")[-40:])
    return [(1, long, "en", "s", 0), (2, long, "en", "s", 0), (3, "start " + tail, "en", "s", 0), (4, "short text", "en", "s", 0)]


def test_windows_and_phrases(spark, rows):
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.with_removals(frame(spark, rows), digest=True).collect()}
    assert got == {1: (WORDS, 0), 2: (WORDS, WORDS), 3: (41, 40), 4: (2, 0)}
    bench = spark.createDataFrame([(7, rows[2][1].removeprefix("start "))], "item_id long, text string")
    hits = {r["row"]["doc_id"]: (r["items"], sum(s["last"] - s["first"] + 1 for s in r["spans"])) for r in decontam.contamination(frame(spark, rows), bench).collect()}
    assert {k: v[1] >= 40 for k, v in hits.items()} == {1: True, 2: True, 3: True, 4: False}


def test_links(spark, rows):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows)).collect()}
    words = rows[0][1].split(" ")
    assert got[1] == got[2] == (len({tuple(words[k : k + 5]) for k in range(WORDS - 4)}), 1)
    assert got[3][1] == 3 and got[4] == (1, 4)


def test_tokens(spark, rows):
    n = len(tokens.Encoder(tokens.vocabulary()).whole([rows[0][1]])[0]) + 1
    pieces = packing.packed_documents(frame(spark, rows)).where("doc_id = 2").collect()
    assert sum(r["length"] for r in pieces) == n and len(pieces) == -(-n // 1024)
    folder = shared.scratch(spark, "test")
    files = token_store.write_ids(frame(spark, rows), folder)
    assert {r["doc_id"]: r["n_tokens"] for r in token_store.read_ids(spark, folder, files, digest=True).collect()}[1] == n


def test_models(spark, rows):
    df = frame(spark, rows)
    assert {r["lang_pred"] for r in langid.identified(df).collect()} == {"en"}
    scores = {r["row"]["doc_id"]: r for r in lm.scored(df, lm.learn(df)).collect()}
    assert scores[1]["n_tokens"] == scores[1]["n_known"] == WORDS + 1 and scores[1]["score"] == pytest.approx(scores[2]["score"])
    assert len(quality.classified(df).collect()) == 4
