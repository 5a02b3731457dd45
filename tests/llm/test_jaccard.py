import random
import re

import pytest
from pyspark.sql import functions as F

from quarryloom.llm import components, jaccard

from .helpers import documents, frame


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed, groups=5, members=14):
    """Chains and stars of edits, in which members link to some of their group only."""
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 120))]
        for _ in range(members):
            words = list(base if r.random() < 0.5 or not rows else rows[-1][1].split(" "))
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = f"e{r.randrange(900)}"
            rows.append((i, " ".join(words), "en", "s", 0))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3), (3, 90, 100, 4)])
def test_groups_against_brute_force(spark, size, num, den, seed):
    rows = near_copies(seed)
    rows += [(i + 1000, *rest) for i, *rest in documents(seed)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows), size=size, num=num, den=den, sketch_bits=10).collect()}
    expected = brute(rows, size, num, den)
    assert got == expected
    assert sum(k != v[1] for k, v in expected.items()) > 10


def test_links_at_the_very_threshold(spark):
    a = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(a[:37]), "en", "s", 0), (2, " ".join(a[:34] + ["x", "y", "z"]), "en", "s", 0), (3, " ".join(a), "en", "s", 0), (4, " ".join(a[:34]), "en", "s", 0)]
    for num in (84, 85, 86, 92):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows), size=1, num=num, den=100).collect()}
        assert got == brute(rows, 1, num, 100)


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (9, "A b c d e", None, None, None), (10, None, None, None, None), (11, " ", None, None, None)]
    got = sorted((r["id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows), size=4, num=85, den=100).collect())
    assert got == [(0, 2, None), (4, 2, 4), (4, 2, 4), (9, 2, 4), (10, 0, 10), (11, 0, 11)]
    kept = sorted(r["doc_id"] or 0 for r in jaccard.one_of_each(frame(spark, rows)).collect())
    assert kept == [0, 4, 4, 10, 11]
    assert jaccard.groups(frame(spark, [])).count() == 0
    assert jaccard.one_of_each(frame(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    ids = list(range(200))
    r.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids[:100], ids[1:100], strict=False)] + [(ids[100], x) for x in ids[101:150]] + [(ids[150], ids[150])]
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{x: min(ids[:100]) for x in ids[:100]}, **{x: min(ids[100:150]) for x in ids[100:150]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
