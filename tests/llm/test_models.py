import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import langid, lm, quality

from .helpers import SCHEMA, documents, frame

LANGS = {"en": "the and of to in that is was he for it with as his on be at by".split(), "fr": "le la les des une être avoir dans pour qui été où".split(), "de": "der die und das nicht ist ein über für sich schön".split()}


def spoken(seed=1, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANGS))
        rows.append((i, " ".join(r.choice(LANGS[lang]) for _ in range(r.randrange(5, 80))), lang, "s", 0))
    return rows


def grams(text):
    """The n-grams of the docstring, one character after another."""
    low = (text or "").lower()
    clean = " " + "".join(c if c.isalpha() else " " for c in low) + " "
    clean = re.sub(" +", " ", clean)
    return Counter(clean[k : k + n] for n in (1, 2, 3) for k in range(len(clean) - n + 1) if clean[k : k + n] != " ") if clean.strip() else Counter()


def ranked(counts, size=300):
    code = lambda g: sum((1 if c == " " else ord(c) + 2) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [g for _, _, g in sorted((-n, code(g), g) for g, n in counts.items())[:size]]


def test_language_id_against_brute_force(spark):
    rows = spoken() + [(i + 1000, *rest) for i, *rest in documents(4, 20)]
    profiles = {}
    for i, t, lang, *_ in rows:
        if lang and t is not None and zlib.crc32(str(i).encode()) % 5:
            profiles.setdefault(lang, Counter()).update(grams(t))
    places = {k: {g: p for p, g in enumerate(ranked(v))} for k, v in profiles.items()}
    expected = {}
    for i, t, *_ in rows:
        mine = ranked(grams(t))
        far = {k: sum(min(300, abs(v[g] - p)) if g in v else 300 for p, g in enumerate(mine)) for k, v in places.items()}
        best = min(sorted(far), key=far.get)
        expected[i] = (best, 1 - far[best] / (300 * len(mine))) if mine else ("und", 0.0)
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(frame(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-12 for k, v in expected.items())
    held = [r for r in rows if r[0] < 1000 and not zlib.crc32(str(r[0]).encode()) % 5]
    assert np.mean([got[r[0]][0] == r[2] for r in held]) > 0.95


def test_language_id_edges(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 20)
    rows = spoken(2, 40) + [(900, None, "en", None, None), (901, "123 !!", "en", None, None), (None, "the and of to", "en", None, None)]
    found = langid.identified(frame(spark, rows))
    got = {r["row"]["doc_id"]: r for r in found.collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[None]["lang_pred"] == "en" and len(got) == len(rows)
    assert spark.range(1).select(langid.held_out(F.lit(None).cast("long"))).first()[0] is True
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in langid.accepted(frame(spark, rows)).select("doc_id").collect()) == sorted([-1, *range(40)])
    unlearned = langid.identified(frame(spark, [(0, "some text", None, None, None), (5, "more", None, None, None)])).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert langid.identified(spark.createDataFrame([], SCHEMA)).count() == 0


def ppm(train, texts, order):
    """log10 probabilities by a trie of dictionaries, symbol by symbol."""
    ends, start = 0xFF, [0xFE] * order
    counts = {}
    for t in train:
        s = start + list(t) + [ends]
        for k in range(order, len(s)):
            for n in range(order + 1):
                counts.setdefault(tuple(s[k - n : k]), Counter())[s[k]] += 1
    out = []
    for t in texts:
        s, total = start + list(t) + [ends], 0.0
        for k in range(order, len(s)):
            gone = set()
            for n in range(order, -2, -1):
                if n < 0:
                    total += math.log10(1 / (lm.SYMBOLS - len(gone)))
                    break
                seen = {x: c for x, c in counts.get(tuple(s[k - n : k]), {}).items() if x not in gone}
                if not seen:
                    continue
                mass = sum(seen.values())
                if s[k] in seen:
                    total += math.log10((seen[s[k]] - 0.5) / mass)
                    break
                total += math.log10(0.5 * len(seen) / mass)
                gone |= set(seen)
        out.append(total)
    return out


@pytest.mark.parametrize(("order", "head"), [(2, 5), (5, 1_000_000)])
def test_scores_against_brute_force(spark, order, head, monkeypatch):
    monkeypatch.setattr(lm, "HELD_KEYS", 300)
    rows = documents(6, 40)
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t, *_ in rows}
    train = [i for i in low if zlib.crc32(str(i).encode()) % 10]
    df = frame(spark, rows)
    model = lm.learn(df.where(~lm.held_out(F.col("doc_id"))), order=order)
    found = lm.scored(df, model, order=order, head_words=head).collect()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in low.items()}
    c = Counter(w for i in train for w in words[i])
    total, distinct = sum(c.values()) + len(train), len(c) + 1
    scale = math.log10(total + 0.1 * (distinct + 1))
    scores = dict(zip(low, ppm([low[i].encode() for i in train], [t.encode() for t in low.values()], order), strict=True))
    assert (model.tokens, model.distinct, len(found)) == (total, distinct, len(rows))
    for r in found:
        i = r["row"]["doc_id"]
        base = sum(math.log10(c[w] + 0.1) - scale for w in words[i]) + math.log10(len(train) + 0.1) - scale
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert (r["n_tokens"], r["n_known"]) == (len(words[i]) + 1, sum(w in c for w in words[i]) + 1)
        assert r["score"] == pytest.approx(scores[i], rel=1e-5, abs=1e-5)


def test_a_small_trie_still_gives_probabilities(spark):
    df = frame(spark, documents(6, 40))
    model = lm.learn(df)
    found = lm.scored(df, model, trie_runs=500, head_words=10).collect()
    assert len(found) == df.count() and all(r["score"] < 0 for r in found)


@pytest.mark.parametrize(("order", "most"), [(2, 100), (5, 10), (5, 500), (5, 2000)])
def test_runs_beyond_the_broadcast_still_count(spark, order, most):
    rows = documents(6, 40)
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode() for i, t, *_ in rows}
    df = frame(spark, rows)
    model = lm.learn(df.where(~lm.held_out(F.col("doc_id"))), order=order)
    assert model.runs == model.trie.count() > most
    scores = dict(zip(low, ppm([t for i, t in low.items() if zlib.crc32(str(i).encode()) % 10], list(low.values()), order), strict=True))
    found = lm.scored(df, model, order=order, trie_runs=most).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["score"] == pytest.approx(scores[r["row"]["doc_id"]], rel=1e-5, abs=1e-5)


def test_scores_without_training_and_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = lm.learn(none)
    got = lm.scored(frame(spark, [(1, "ab", None, None, None), (None, None, None, None, None)]), model).collect()
    assert [(r["n_tokens"], r["n_known"]) for r in sorted(got, key=lambda r: r["n_tokens"])] == [(1, 0), (2, 0)]
    assert {round(r["score"] / math.log10(1 / lm.SYMBOLS), 6) for r in got} == {1.0, 3.0}
    assert all(abs(r["base_score"]) < 1e-9 for r in got)
    assert lm.scored(none, lm.learn(frame(spark))).count() == 0


def junk(seed=1, n=240):
    r = random.Random(seed)
    rows = []
    for i, (_, t, lang, *_) in enumerate(spoken(seed, n)):
        w = t.split()
        if i % 5 == 0:
            t = [" | ".join(w), " ".join(x + "###" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 40)][i // 5 % 4]
        else:
            t = " ".join(f"{x}{r.choice('abcdefgh')}{r.choice('xyz')}{r.randrange(9)}" if r.random() < 0.6 else x for x in w) + "."
        rows.append((i, t, lang, "s", 0))
    return rows


def test_quality_finds_junk_and_keeps_the_rest(spark):
    rows = junk()
    got = {r["row"]["doc_id"]: r for r in quality.classified(frame(spark, rows)).collect()}
    long = [r for r in rows if len(r[1].split()) >= 20]
    assert np.mean([got[i]["keep"] == bool(i % 5) for i, *_ in long]) > 0.95
    assert np.mean([got[i]["keep"] for i, *_ in rows if i % 5]) > 0.98


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]) + 1
    votes[rng.random(votes.shape) < 0.3] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts)
    assert abs(model.good - 0.8) < 0.02
    assert np.abs(model.chance[1, :, quality.GOOD] - right).max() < 0.03
    assert np.abs(model.chance[0, :, quality.BAD] - right).max() < 0.04


def test_quality_edges(spark):
    rows = documents(3, 30) + [(None, "some words here", None, None, None)]
    got = quality.classified(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["score"] == 0 and not r["keep"] for r in got if r["row"]["text"] is None or not r["row"]["text"].strip())
    assert all(0 <= r["score"] <= 1 and 0 <= r["weak_score"] <= 1 for r in got)
    assert quality.classified(spark.createDataFrame([], SCHEMA)).count() == 0
