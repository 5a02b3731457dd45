"""Each registered query on whole tables: empty ones, odd rows, and rows recomputed the plain way."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import quality, queries, tokens, words

from .helpers import SCHEMA, documents
from .test_models import junk

OWN = ("id", "row", "key", "n", "load", "token", "shard", "length", "offset", "sequence_id", "rank", "score", "a.b", "file")
PER_DOCUMENT = ("op3_decontamination", "op4_language_id", "op5_jaccard_join", "op6_substring_dedup", "op8_lm_scoring", "op9_quality", "op10_token_ids")
COLUMNS = {
    "op1_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_nearest_neighbours": "query_id rank vec_id score",
    "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_jaccard_join": "doc_id n_shingles component_id",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_quality": "doc_id n_votes weak_score score keep toxic_score toxic",
    "op10_token_ids": "doc_id start n_tokens ids_crc32",
    "op11_embedding_dedup": "vec_id n_links component_id kept",
    "op12_price_band_join": "item_id rank gap u sale_id line_no line_item_id n_pairs gap_sum lines_crc",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


def tables(spark, folder, docs, pages=(), bench=(), vectors=(), labels=(), items=(), lines=()):
    shop = (("items", items, "item_id long, name string, price double"), ("sale_lines", lines, "sale_id long, line_no int, item_id long, quantity int, amount double"))
    for name, rows, schema in (*shop, ("documents", docs, SCHEMA), ("pages", pages, "page_id long, url string, html string"), ("benchmark", bench, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"), ("labels", labels, "doc_id long, quality int, toxic int")):
        df = spark.createDataFrame(list(rows), schema)
        for own in OWN:  # names that operators use within
            df = df.selectExpr("*", f"'own' AS `{own}`")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd(seed=11):
    r = random.Random(seed)
    rows = documents(seed, 40)
    rows += [(7, rows[7][1], None, None, None)] * 3  # repeated rows
    rows += [(7, "another text under an id that is there", "en", None, None), (None, rows[5][1], "en", None, None), (None, None, None, None, None)]
    rows += [(900, " ".join(f"w{r.randrange(50_000)}" for _ in range(170_000)), "en", "s", 0), (901, "x" * 300_000, "en", "s", 0)]
    rows += [(902 + k, "one text that many documents have, a tie in every order " * 3, "en", "s", 0) for k in range(5)]
    return rows


def test_all_queries_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf = tables(spark, tmp_path, [])
    for name, query in queries.queries().items():
        df = query(spark, sf)
        assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split(), name
        assert df.count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_all_queries_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = odd()
    pages = [(1, "u", "x"), (1, "u", "x"), (2, None, None), (None, "v", "x"), (4, "w", ""), (5, "y", "z" * 2_000_000)]
    vectors = [(i, [1.0, float(i % 7), 2.0], 0) for i in range(60)] + [(50, None, 0), (None, [1.0, 1.0, 1.0], 0), (61, [0.0, 0.0, 0.0], None)]
    sf = tables(spark, tmp_path, rows, pages, [(1, rows[3][1]), (None, "the of and"), (2, None), (1, rows[3][1])], vectors, [(7, 1, 1), (7, 1, 0), (None, 1, 1), (3, None, None), (900, 0, 1), (1, 1, 0)],
        [(1, "a", 2.0), (1, "a", 2.0), (None, "b", 2.0), (3, None, None), (4, "c", 3.0)], [(1, 1, 4, 2, 4.1), (1, 1, 4, 2, 4.1), (None, 1, 4, 1, 2.0), (2, None, 1, 1, 2.0), (3, 1, 1, 0, 2.0)])
    for name, query in queries.queries().items():
        found = query(spark, sf).collect()
        if name in PER_DOCUMENT:
            assert Counter(r["doc_id"] for r in found) == Counter(i for i, *_ in rows), name
        if name == "op11_embedding_dedup":
            assert Counter(r["vec_id"] for r in found) == Counter(i for i, *_ in vectors)
        if name == "op12_price_band_join":
            assert Counter((r["item_id"], r["rank"]) for r in found) == {(1, 1): 2, (1, 2): 2, (None, 0): 1, (3, 0): 1, (4, 0): 1}
        if name == "op13_filter_audit":
            assert len(found) == 600 * len({x[2] or "" for x in rows}) and all(r["kept"] + r["removed"] >= 0 for r in found)
    assert Counter(r["page_id"] for r in queries.op7_warc(spark, sf).collect()) == Counter(i for i, *_ in pages)
    packed = corpus_pipeline.run(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.where("n > 1024 or n <> end").count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Repeated rows and ties leave one; null ids stay; columns of other tables' names pass through."""
    import corpus_pipeline

    rows = odd()
    sf = tables(spark, tmp_path, rows, bench=[(1, rows[3][1])])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == columns
        assert docs.where(" or ".join(f"`{c}` <> 'own'" for c in OWN)).count() == 0
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != "language_id":
            assert sum(ids[902 + k] for k in range(5)) <= 1 and ids[None] == 1
        assert ids[900] == 1 and ids[901] == 1


def test_packing_and_token_ids_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    rows = [r for r in odd() if r[0] is not None and r[0] != 7]
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    sf = tables(spark, tmp_path, rows)
    start, expected = 0, set()
    for i in sorted(ids):
        expected.add((i, start, len(ids[i]) + 1, crc([*ids[i], 0])))
        start += len(ids[i]) + 1
    assert {tuple(r) for r in queries.op10_token_ids(spark, sf).collect()} == expected
    expected = set()
    for i, x in ids.items():
        x = [*x, 2]
        first = len(x) % 1024 or 1024
        at = [0, *range(first, len(x), 1024), len(x)]
        expected |= {(i, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}
    assert {tuple(r)[:5] for r in queries.op1_packing(spark, sf).collect()} == expected


def test_base_scores_against_the_formula(spark, tmp_path):
    rows = documents(6, 50)
    found = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in rows}
    train = [i for i in found if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in found[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, tables(spark, tmp_path, rows)).collect()}
    for i, w in found.items():
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[y] for y in w), len(train)])
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(w) + 1, sum(y in c for y in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)


def votes_of(text):
    """The nine votes, each by its rule, from a text alone."""
    text = text or ""
    data, w = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    n, solid = len(w), sum(len(x) for x in w)
    symbol = lambda b: 33 <= b <= 126 and not chr(b).isalnum()
    alpha = sum(b < 128 and chr(b).isalpha() for b in data)
    share = lambda part, whole: part / max(1, whole)
    runs = [tuple(w[k : k + 5]) for k in range(n - 4)]
    lines = [x.split() for x in re.split(rb"\n", data) if x.split()]
    last = [x[-1][-1] for x in lines]
    many = n >= 20

    def vote(good, bad, known):
        return quality.ABSTAIN if not known else quality.BAD if bad else quality.GOOD if good else quality.ABSTAIN

    symbols, capitals = share(sum(map(symbol, data)), solid), share(sum(65 <= b <= 90 for b in data), alpha)
    bare, stutter = share(sum(all(map(symbol, x)) for x in w), n), share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n)
    again = 1 - len(set(runs)) / len(runs) if runs else 0
    variety = math.log(max(2, len(set(w)))) / math.log(max(2, n))
    short, shouting = share(sum(len(x) <= 3 for x in w), n), share(sum(x.endswith(b"!!") for x in w), n)
    ended = share(sum(b in b"!.?" for b in last), len(last))
    return [
        vote(symbols <= 0.06, symbols >= 0.09, many), vote(capitals <= 0.1, capitals >= 0.3, alpha >= 60), vote(bare <= 0.02, bare >= 0.1, many),
        vote(stutter <= 0.02, stutter >= 0.1, many), vote(again <= 0.1, again >= 0.3, many), vote(variety >= 0.85, variety <= 0.7, many),
        vote(0.12 <= short <= 0.5, short <= 0.05, many), vote(shouting <= 0.02, shouting >= 0.1, many), vote(ended >= 0.9, ended <= 0.5, many),
    ]


def buckets_of(text):
    """Counts of the scorer's buckets, word by word."""
    out, before = Counter(), None
    shape = lambda b: 1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b
    mix = lambda x: int(words.mixed(np.array([x], np.uint64))[0]) >> 48
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        h = int(words.split(pa.array([word.decode()])).hashes()[0])
        ends = [shape(word[-k]) if len(word) >= k else 0 for k in (1, 2, 3)]
        code = ends[0] << 24 | ends[1] << 16 | ends[2] << 8 | shape(word[0])
        out.update([h >> 48, mix(code + 0x51ED270B), mix(int(word == before) + 0x2545F491)])
        before = word
    return out


def test_quality_rows_against_brute_force(spark, tmp_path):
    rows = junk(3, 90) + [(500, None, None, None, None), (501, "", None, None, None), (502, " \n ", None, None, None), (503, "Lonely", None, None, None)]
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, tables(spark, tmp_path, rows)).collect()}
    votes = {i: votes_of(t) for i, t, *_ in rows}
    # expectation-maximisation, document by document
    good = {i: (v.count(quality.GOOD) + 1) / (v.count(quality.GOOD) + v.count(quality.BAD) + 2) for i, v in votes.items()}
    for _ in range(quality.ROUNDS):
        prior = (sum(good.values()) + 1) / (len(rows) + 2)
        chance = {}
        for y in (0, 1):
            for j in range(9):
                weight = {v: sum((good[i] if y else 1 - good[i]) for i in votes if votes[i][j] == v) + 0.5 for v in (quality.BAD, quality.GOOD)}
                chance[y, j] = {v: x / sum(weight.values()) for v, x in weight.items()} | {quality.ABSTAIN: 1.0}
        old = good
        good = {}
        for i, v in votes.items():
            bad, fine = ((1 - prior) * math.prod(chance[0, j][x] for j, x in enumerate(v)), prior * math.prod(chance[1, j][x] for j, x in enumerate(v)))
            good[i] = fine / (bad + fine)
        if max(abs(good[i] - old[i]) for i in good) < 1e-9:
            break
    # the scorer, on a dense matrix
    order = [i for i, *_ in rows]
    x = np.zeros((len(rows), quality.BUCKETS + 1))
    for k, (_, t, *_) in enumerate(rows):
        counts = buckets_of(t)
        for bucket, n in counts.items():
            x[k, bucket] = n / (quality.SMOOTH + sum(counts.values()))
    x[:, -1] = 1
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used], np.array([good[i] for i in order])
    weights, m, v = (np.zeros(len(used)) for _ in range(3))
    for k in range(1, quality.PASSES + 1):
        slope = x.T @ (1 / (1 + np.exp(-x @ weights)) - y) / len(y) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        weights -= 0.1 * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    score = 1 / (1 + np.exp(-x @ weights))
    for k, (i, t, *_) in enumerate(rows):
        r, empty = got[i], not (t or "").split()
        assert r["n_votes"] == sum(a != quality.ABSTAIN for a in votes[i]), i
        assert r["weak_score"] == pytest.approx(good[i], abs=1e-6)
        assert r["score"] == pytest.approx(0 if empty else score[k], abs=1e-3)
        assert r["keep"] == (r["score"] >= 0.5)


def test_toxic_words_against_brute_force(spark, tmp_path):
    rows = junk(5, 160)
    rows = [(i, t + " You MORON, scum!" if i % 4 == 0 else t, *rest) for i, t, *rest in rows]
    rows += [(300 + k, rows[0][1] + " copied", "en", "s", 0) for k in range(30)]  # copies teach no word of their own
    rows += [(400, None, None, None, None), (401, "", None, None, None), (402, "scum", None, None, None), (403, "a moronic act", None, None, None)]
    labels = [(i, 1, int(i % 4 == 0 or 300 <= i < 330)) for i, *_ in rows if i % 8 < 6 and i < 400] + [(2, 1, None), (None, 1, 1), (9, 0, 0), (9, 1, 1)]
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, tables(spark, tmp_path, rows, labels=labels)).collect()}
    assert len(got) == len(rows)
    word = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    known = {}
    for i, _, x in labels:
        if x is not None:
            known[i] = max(x, known.get(i, 0))
    texts = {"".join(chr(b) for b in b" ".join(word(t))): word(t) for _, t, *_ in rows}
    least = {}  # the key of a text: its least shingle by the engine's hash, recomputed one shingle at a time
    for name, w in texts.items():
        h = [words.split(pa.array([x]), "alnum").hashes()[0] for x in w]
        runs = [int(words.windows(np.array(h[k : k + 5], np.uint64), np.array([0, 5]), 5)[1][0]) for k in range(len(h) - 4)] or [int(x) for x in h]
        least[name] = min(runs, default=0)
    keys = {(v, least["".join(chr(b) for b in b" ".join(word(t)))], known[i]) for i, t, *_ in rows if i in known for v in word(t)}
    z, marks = quality.MARK_ERRORS, {}
    for v in {v for v, *_ in keys}:
        n, a = sum(k[0] == v for k in keys), sum(k[0] == v and k[2] for k in keys)
        p = a / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if low > 0.5:
            marks[v] = low
    assert {b"moron", b"scum"} <= set(marks) and b"copied" not in marks
    for i, t, *_ in rows:
        right = 1 - math.prod(1 - marks[v] for v in set(word(t)) & set(marks))
        assert got[i]["toxic_score"] == pytest.approx(right, abs=1e-9), i
        assert got[i]["toxic"] == (right >= quality.TOXIC), i
    assert all(got[i]["toxic"] == (i % 4 == 0) for i in range(160))
    assert got[402]["toxic"] and not got[400]["toxic"] and not got[401]["toxic"] and not got[403]["toxic"]
