import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from quarryloom.llm import decontam, substring

from .helpers import SCHEMA, documents, frame

SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("width", [1, 5, 13])
def test_repeats_against_brute_force(spark, width):
    rows = documents(2)
    first, found, expected = {}, {}, {}
    for i, t, *_ in rows:
        found[i] = SPACE.findall(t or "")
        for k in range(len(found[i]) - width + 1):
            first.setdefault(tuple(found[i][k : k + width]), i)
    for i, w in found.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.with_removals(frame(spark, rows), width=width, digest=True).collect()}
    assert got == expected
    assert any(v[1] for v in got.values())


def test_small_blocks_and_unchanged_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WINDOWS", 50)
    df = frame(spark)
    out = substring.without_repeats(df)
    assert out.columns == df.columns
    before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (df, out))
    assert set(before) == set(after)
    kept = {r["row"]["doc_id"]: r["kept"] for r in substring.with_removals(df, digest=True).collect()}
    assert {i: hashlib.sha256(" ".join(SPACE.findall(t or "")).encode()).hexdigest() for i, t in after.items()} == kept
    same = [i for i in before if before[i] == after[i]]
    assert len(same) > 20 and before[61] == after[61] and after[60] is None


def test_repeats_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text, None, None, None), (5, text, None, None, None)]
    got = sorted((r["row"]["doc_id"] or 0, r["n_removed"]) for r in substring.with_removals(frame(spark, rows), digest=True).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (5, 30)]
    assert substring.with_removals(frame(spark, [])).count() == 0


def brute(rows, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(i)
    out = {}
    for i, t, *_ in rows:
        w, hit, names = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[x]
        out[i] = (len(w), len(hit), sorted(str(x) for x in names if x is not None))
    return out


@pytest.mark.parametrize("phrase_words", [10, 100_000])
def test_contamination_against_brute_force(spark, phrase_words):
    rows = documents(3)
    items = [(1, rows[3][1]), (2, "The OF"), (3, None), (4, "..."), (None, rows[5][1]), (7, " ".join(ALNUM.findall(rows[66][1])[5:22])), (7, rows[8][1]), (9, "the the the the the the the the the the the")]
    rows.append((500, "the " * 40, None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(frame(spark, rows), bench, phrase_words=phrase_words, cut=True).collect()
    got = {r["row"]["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in found}
    assert got == brute(rows, items)
    for r in found:
        assert brute([(0, r["clean"])], items)[0][0] <= r["n_words"]
        if not r["spans"]:
            assert r["clean"] == {i: t for i, t, *_ in rows}[r["row"]["doc_id"]]


def test_contamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contamination(frame(spark), none).collect()
    assert len(got) == len(documents()) and not any(r["spans"] or r["items"] for r in got)
    assert decontam.decontaminated(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        runs = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(6)]
        runs += [runs[0], runs[0]]
        text = np.concatenate([np.r_[x, 0] for x in runs]).astype(np.int32)
        index = decontam.FMIndex(text, 6, sample=4)
        phrases = [rng.integers(1, 7, rng.integers(1, 6)) for _ in range(40)]
        sizes = np.array([len(p) for p in phrases])
        lo, hi = index.search(np.array([np.pad(p, (0, 6 - len(p))) for p in phrases], np.int32), sizes)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
