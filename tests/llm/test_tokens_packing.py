import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarryloom.llm import packing, shared, token_store, tokens

from .helpers import documents, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("kept", "size"), [(50, 40), (3000, 1000), (tokens.KEPT_PIECES, tokens.SLICE_BYTES)])
def test_encoder_equals_library(library, kept, size):
    r = random.Random(4)
    some, few = "ab é ÀZ09²½\n\r\t  ''sdtmreve!?.,<|>-_×÷ſߠ　x\x85\x1c\xa0\xad日本“”’—…€→", "abs tdm'llreve \n"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for alphabet in (some, few) for _ in range(1000)]
    texts += [t for _, t, *_ in documents()] + ["<|endoftext|> hi", "x <|endoftext|> y z", "a<|endoftext|>b", "  lead", "a  \n\n b   ", "don't we'll I'D 'S", "a" * 5000, "ab " * 5000]
    texts += [f"x{chr(c)}y z{chr(c)} '{chr(c)}s" for c in (*range(0x250), *range(0x2000, 0x3000, 7))]
    e = tokens.Encoder(tokens.vocabulary(), kept, size)
    for a in range(0, len(texts), 300):
        part = texts[a : a + 300]
        ids, at = e.encode(pa.array(part, pa.string()))
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [library(t) for t in part]
        assert at[-1] == len(ids)


def test_other_settings_leave_whole_texts_to_the_library(library):
    e = tokens.Encoder(tokens.vocabulary())
    with open(tokens.vocabulary(), encoding="utf-8") as f:
        settings = json.load(f)
    assert tokens.splits_into_pieces(settings)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": settings["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [settings["added_tokens"][0] | {"lstrip": True}]}):
        assert not tokens.splits_into_pieces(settings | change)
    e.pieces = None
    ids, at = e.encode(pa.array(["don't", None, "日本 x"]))
    assert ids.tolist() == [*library("don't"), *library("日本 x")] and at.tolist() == [0, len(library("don't")), len(library("don't")), len(ids)]


def test_packing_is_gapless_whole_and_tight(spark, library):
    rows = documents(7, 150)
    found = packing.packed_documents(frame(spark, rows)).collect()
    ids = {i: np.array([*library(t), 2], "<u4") for i, t, *_ in rows}
    per, sequences = {}, {}
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 1024 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        per.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in per.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert sum(n for _, _, n in parts) == len(ids[i]) and all(n == 1024 for _, _, n in parts[1:])
        assert [s for _, s, _ in parts] == np.cumsum([0, *[n for _, _, n in parts]])[:-1].tolist()
    assert set(per) == set(ids)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 1024) + 1


def test_packer_bounds_open_sequences():
    p = packing.Packer(10, 2)
    assert [p.place(x) for x in (6, 7, 4, 9)] == [(0, 0), (1, 0), (0, 6), (2, 0)]
    assert p.open == 2
    p.place(8)  # a third open one: the fullest, with one place, closes
    assert p.open == 2 and not p.free >> 1 & 1
    assert p.place(1) == (3, 8)
    for bad in (0, 11):
        with pytest.raises(ValueError):
            p.place(bad)


def test_packing_empty_repeated_and_null_ids(spark):
    assert packing.packed_documents(frame(spark, [])).count() == 0
    rows = [(None, "a b", None, None, None), (3, None, None, None, None), (3, None, None, None, None)]
    got = packing.packed_documents(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (3, 1), (3, 1)]


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(3)
    for high in (1, 2, 300, 50_257, 1 << 20, 1 << 32):
        docs = [(int(k) if k else None, rng.integers(0, high, n, dtype=np.uint32).astype("<u4").tobytes()) for k, n in enumerate((0, 1, 7, 200, 3000, 0))]
        writer = token_store.Writer(mode, chunk=128)
        for part in (docs[:2], [], docs[2:]):
            writer.add([i for i, _ in part], np.frombuffer(b"".join(x for _, x in part), "<u4"), [len(x) // 4 for _, x in part])
        reader = token_store.Reader(writer.data())
        assert [(i, x.tobytes()) for i, x in reader.documents()] == docs
        whole = np.frombuffer(b"".join(x for _, x in docs), "<u4")
        assert reader.chunk(3).tolist() == whole[384:512].tolist()
    with pytest.raises(ValueError):
        token_store.Reader(b"no such file at all.")


def test_id_files_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_IDS", 500)
    rows = documents(9, 100)
    folder = shared.scratch(spark, "test")
    listed = token_store.write_ids(frame(spark, rows), folder)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids"]) for r in token_store.read_ids(spark, folder, listed).collect()}
    start = 0
    for i, t, *_ in sorted(rows):
        ids = [*library(t), 0]
        assert got[i] == (start, len(ids), ids)
        start += len(ids)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.read_ids(spark, folder, listed, digest=True).collect()} == {i: zlib.crc32(np.array(x[2], "<u4").tobytes()) for i, x in got.items()}


def test_no_documents_give_no_files(spark):
    folder = shared.scratch(spark, "test")
    listed = token_store.write_ids(frame(spark, []), folder)
    assert listed.count() == 0 and token_store.read_ids(spark, folder, listed).count() == 0


def test_packing_keeps_columns_and_raises_for_its_own_names(spark):
    pieces = packing.token_pieces(frame(spark, documents(3, 10))).selectExpr("*", "'own' AS `a.b`")
    got = packing.pack(pieces)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "a.b", "sequence_id", "offset"]
    assert got.where("sequence_id is null or offset is null or `a.b` <> 'own'").count() == 0
    for taken in ("offset", "sequence_id"):
        with pytest.raises(ValueError, match=taken):
            packing.pack(pieces.withColumn(taken, pieces["piece"]))


def test_id_files_null_and_repeated_ids(spark):
    folder = shared.scratch(spark, "test")
    listed = token_store.write_ids(frame(spark, [(2, "x", None, None, None), (None, None, None, None, None), (2, "x", None, None, None)]), folder)
    got = sorted(((r["doc_id"] or 0), r["start"], r["n_tokens"]) for r in token_store.read_ids(spark, folder, listed).collect())
    assert got == [(0, 0, 1), (2, 1, 2), (2, 3, 2)]
