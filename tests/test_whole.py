"""Queries return the whole of what they are given: counted here from the tables, not from the query."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import candidates
from quarryloom.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def test_every_line_has_its_enclosing_name(spark):
    texts = queries.table(spark, DATA, "documents").select("doc_id", "text").collect()
    expected = {(r["doc_id"], n) for r in texts if r["text"] is not None for n in range(1, r["text"].count("\n") + 2)}
    found = [(r["doc_id"], r["line_no"]) for r in queries.QUERIES["asof_enclosing_line"](spark, DATA).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_labels_hold_every_word(spark):
    texts = queries.table(spark, DATA, "documents").select("doc_id", "text").collect()
    words = {r["doc_id"]: [str(len(w)) for w in r["text"].split()] for r in texts}
    found = {r["doc_id"]: r for r in queries.QUERIES["label_ignore_roundtrip"](spark, DATA).collect()}
    assert found.keys() == words.keys() and all(r["restored"] for r in found.values())
    for i, r in found.items():
        labels = r["labels"].split(",")
        assert labels[: len(words[i])] == words[i] and set(labels[len(words[i]) :]) <= {"-100"}
        assert r["n_ignored"] == len(labels) - len(words[i])


def test_pivot_and_back_keeps_every_turn(spark):
    turns = queries.table(spark, DATA, "conversations").select("conv_id", "turn", "text").collect()
    assert max(r["turn"] for r in turns) >= 5
    found = queries.QUERIES["candidate_unpivot"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == sorted((r["conv_id"], r["turn"], r["text"]) for r in turns if r["text"])


@pytest.mark.parametrize("position", [2, -1, None])
def test_pivot_raises_for_a_position_without_a_column(spark, position):
    df = spark.createDataFrame([(1, 0, "a"), (1, position, "b")], "k long, pos int, code string")
    with pytest.raises(Exception, match="no column of 2 for position"):
        candidates.pivoted(df, "k", "pos", "code", 2).collect()


def test_every_candidate_position_is_scored(spark):
    positions = {r["turn"] for r in queries.table(spark, DATA, "conversations").select("turn").distinct().collect()} - {1}
    found = {r["position"]: r for r in queries.QUERIES["bleu_corpus"](spark, DATA).collect()}
    weighted = {r["position"]: r["p1"] for r in queries.QUERIES["weighted_ngrams"](spark, DATA).collect()}
    assert len(positions) > 1 and found.keys() == weighted.keys() == positions
