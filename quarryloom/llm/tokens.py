"""Token ids of whole texts by a public byte-level BPE vocabulary, with the tokenizers library.

The library splits a text into pieces by a fixed pattern and merges within each piece, so a
piece alone gets the ids that it gets in its text. Pieces are split here with arrays, many
texts at once; the library's model gives the ids of a piece, which are kept, in bounded
number, for its next occurrence. Stretches with a special token or with characters beyond
those listed here go to the library as they are, as do all texts of a vocabulary with
other settings. All ids are those of the library's own call without added special tokens.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from quarryloom.llm import words

#: Pieces whose ids a Python worker keeps, about 60 bytes each.
KEPT_PIECES = 1 << 19
#: Bytes that are split at once; a longer text is cut between two words.
SLICE_BYTES = 1 << 19

SPACE, WHITE, LETTER, NUMBER, OTHER, STRANGE = range(6)


def _kind(c: str) -> int:
    """The kind of a character in the splitting pattern; STRANGE for any that isn't surely known."""
    category = unicodedata.category(c)
    if c in " \t\n\r":
        return SPACE if c == " " else WHITE
    return {"L": LETTER, "N": NUMBER, "P": OTHER, "S": OTHER}.get(category[0], STRANGE)


_one = np.array([_kind(chr(b)) if b < 128 else STRANGE for b in range(256)], np.uint8)
#: Kinds of two-byte characters up to U+024F, and of three-byte ones from U+2000 to U+2FFF: signs alone.
_two = np.array([_kind(chr(0x80 + k)) if 0x80 + k < 0x250 else STRANGE for k in range(512)], np.uint8)
_three = np.array([OTHER if _kind(chr(0x2000 + k)) == OTHER else STRANGE for k in range(4096)], np.uint8)
#: A space between two of these characters always begins a piece, whatever stands farther away.
_between = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_single = np.isin(np.arange(256), list(b"stmd"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return np.array([b if b in plain else next(rest) for b in range(256)], np.uint32)


def splits_into_pieces(settings: dict) -> bool:
    """Whether a vocabulary's settings are those that the splitting here is written for."""
    model, before = settings["model"], settings.get("pre_tokenizer") or {}
    return (
        settings.get("normalizer") is None
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and bool(before.get("use_regex"))
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(t[k] for t in settings["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        and not any(" " in t["content"] for t in settings["added_tokens"])
    )


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    out = _one[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        two = lead[data[lead] <= 0xC9]
        found = _two[(data[two].astype(np.int64) - 0xC2) * 64 + (data[two + 1] & 63)]
        out[two], out[two + 1] = found, found
        three = lead[data[lead] == 0xE2]
        found = _three[(data[three + 1].astype(np.int64) & 63) * 64 + (data[three + 2] & 63)]
        for k in range(3):
            out[three + k] = found
    return out


def piece_starts(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether each byte begins a piece; bounds: the first bytes of texts.

    A space joins the solid run after it. Other white space before a solid run leaves its
    last character alone; at the end of a text white space stays whole. An apostrophe
    alone takes s, t, m, d, re, ve or ll from the letters after it.
    """
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    group = np.maximum(kind, WHITE)
    change = first[:n].copy()
    change[:1] = True
    change[1:] |= group[1:] != group[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    closes = np.append(first[run[1:]], True)
    white = kind[run] <= WHITE
    start = np.zeros(n + 1, bool)
    start[run[white]] = True
    start[end[white & ~closes] - 1] = True
    joined = ~white & ~first[run] & (data[run - 1] == 32)
    start[run[~white & ~joined]] = True
    quote = np.flatnonzero((data[run] == 39) & (end - run == 1) & ~joined & ~closes)
    quote = quote[kind[end[quote]] == LETTER]
    if len(quote):
        q, last = run[quote], end[quote + 1]
        a, b = data[q + 1], data[np.minimum(q + 2, n - 1)]
        pair = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        size = np.where(_single[a], 1, np.where(pair & (q + 2 < last), 2, 0))
        q, last, size = q[size > 0], last[size > 0], size[size > 0]
        start[q + 1] = False
        start[(q + 1 + size)[q + 1 + size < last]] = True
    return start[:n]


class Pieces:
    """Ids of pieces of at most 15 bytes by their exact bytes, in a hash table of arrays; longer ones in a dictionary."""

    def __init__(self, model, limit: int):
        self.model, self.table = model, _byte_characters()
        self._allocate(limit)

    def _allocate(self, limit: int) -> None:
        self.limit = limit
        self.bits = max(6, (2 * limit - 1).bit_length() + 1)
        self.lo, self.hi = np.zeros(limit, np.uint64), np.zeros(limit, np.uint64)
        self.at, self.n, self.used = np.zeros(limit, np.int64), np.zeros(limit, np.int32), np.zeros(limit, bool)
        self.pool = np.zeros(4 * limit, np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.size = self.filled = 0
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}

    def _first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (lo ^ hi * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        at = self._first(lo, hi)
        found = self.slot[at]
        out = np.where((self.lo[found] == lo) & (self.hi[found] == hi), found, -1)
        left = np.flatnonzero((out < 0) & (found >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            found = self.slot[at[left]]
            same = (found >= 0) & (self.lo[found] == lo[left]) & (self.hi[found] == hi[left])
            out[left[same]] = found[same]
            left = left[(found >= 0) & ~same]
        return out

    def _place(self, entries: np.ndarray) -> None:
        at = self._first(self.lo[entries], self.hi[entries])
        while len(entries):
            free = self.slot[at] < 0
            self.slot[at[free]] = entries[free]
            lost = self.slot[at] != entries
            entries, at = entries[lost], at[lost] + 1 & (1 << self.bits) - 1

    def _make_room(self, more: int) -> None:
        """For more pieces: keeps the entries found since the last time, or none if these are too many."""
        held = np.flatnonzero(self.used[: self.size] & (self.hi[: self.size] > 0))
        if len(held) + more > self.limit * 3 // 4:
            held = held[:0]
        lo, hi, n = self.lo[held], self.hi[held], self.n[held]
        ids = self.pool[ragged(self.at[held], n)]
        # a slice without a place to cut it may have more different pieces than are kept
        self._allocate(max(self.limit, 2 * more))
        self._append(lo, hi, n, ids)
        self._place(np.arange(len(held), dtype=np.int32))

    def _append(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        a, b = self.size, self.size + len(n)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.lo[a:b], self.hi[a:b], self.n[a:b] = lo, hi, n
        self.at[a:b] = self.filled + np.cumsum(n) - n
        self.size, self.filled = b, self.filled + len(ids)
        return np.arange(a, b, dtype=np.int32)

    def _ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the library's many short-lived objects have no cycles: their collection would only cost time
        collecting = gc.isenabled()
        gc.disable()
        try:
            found = [[x.id for x in self.model.tokenize(name)] for name in names]
        finally:
            if collecting:
                gc.enable()
        n = np.fromiter(map(len, found), np.int32, len(found))
        return n, np.fromiter((x for ids in found for x in ids), np.uint32, int(n.sum()))

    def _names(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
        text = self.table[data[ragged(starts, sizes)]].tobytes().decode("utf-32-le")
        ends = np.cumsum(sizes).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each piece; the library's model is asked for those that aren't kept. data ends with 16 more bytes."""
        eights = np.lib.stride_tricks.sliding_window_view(data, 8)
        short = sizes <= 15
        lo = eights[starts].view("<u8").ravel() & _masks[np.minimum(sizes, 8)]
        hi = sizes.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero((sizes > 8) & short)
        hi[more] |= eights[starts[more] + 8].view("<u8").ravel() & _masks[sizes[more] - 8]
        hi[~short] = 0
        out = self.find(lo, hi)
        if self.size + int((out < 0).sum()) > self.limit:
            self._make_room(len(np.unique(np.stack([lo, hi]), axis=1).T) + int((~short).sum()))
            out = self.find(lo, hi)
        lost = np.flatnonzero((out < 0) & short)
        if len(lost):
            order = lost[np.lexsort((lo[lost], hi[lost]))]
            head = np.ones(len(order), bool)
            head[1:] = (lo[order[1:]] != lo[order[:-1]]) | (hi[order[1:]] != hi[order[:-1]])
            new = order[head]
            found = self._append(lo[new], hi[new], *self._ids(self._names(data, starts[new], sizes[new])))
            self._place(found)
            out[order] = found[np.cumsum(head) - 1]
        wide = np.flatnonzero(~short)
        pieces = [data[a : a + n].tobytes() for a, n in zip(starts[wide].tolist(), sizes[wide].tolist(), strict=True)]
        new = {x: i for x, i in zip(pieces, wide.tolist(), strict=True) if x not in self.long}
        if new:
            at, none = np.fromiter(new.values(), np.int64, len(new)), np.zeros(len(new), np.uint64)
            found = self._append(none, none, *self._ids(self._names(data, starts[at], sizes[at])))
            self.long.update(zip(new, found.tolist(), strict=True))
        out[wide] = [self.long[x] for x in pieces]
        self.used[out] = True
        return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of sizes[i] each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES, slice_bytes: int = SLICE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.slice_bytes = Tokenizer.from_file(path), slice_bytes
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.special = [re.compile(re.escape(t["content"].encode())) for t in settings["added_tokens"]]
        self.pieces = Pieces(self.library.model, kept) if splits_into_pieces(settings) else None

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's n + 1 places among them. A null text has none."""
        data, base = words.buffers(texts)
        if self.pieces is None:
            found = self.whole([x or "" for x in texts.to_pylist()])
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.cumsum([0, *map(len, found)])
        raw, parts = data.tobytes(), [np.zeros(0, np.uint32)]
        at, done, a = np.zeros(len(base), np.int64), 0, 0
        while a < len(data):
            cut = _between.search(raw, a + self.slice_bytes) if len(data) - a > self.slice_bytes else None
            b = cut.start() if cut else len(data)
            inside = slice(*np.searchsorted(base, [a, b]))
            ids, starts, places = self._slice(raw[a:b], base[inside] - a)
            at[inside] = done + places[np.searchsorted(starts, base[inside] - a)]
            parts.append(ids)
            done, a = done + len(ids), b
        at[base == len(data)] = done
        return np.concatenate(parts), at

    def _slice(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the first bytes of pieces, and where the ids of each piece begin."""
        data = np.frombuffer(raw + bytes(16), np.uint8)
        n = len(raw)
        kind = kinds(data)[:n]
        start = piece_starts(data[:n], bounds, kind)
        strange = [np.flatnonzero(kind == STRANGE), *(np.array([m.start() for m in x.finditer(raw)], np.int64) for x in self.special)]
        strange = np.unique(np.concatenate(strange))
        if not len(strange):
            starts = np.flatnonzero(start)
            entries = self.pieces.entries(data, starts, np.diff(starts, append=n))
            pool, at, size = self.pieces.pool, self.pieces.at[entries], self.pieces.n[entries]
        else:
            # stretches between places that always begin a piece
            cuts = np.unique(np.concatenate([[0, n], bounds, [m.start() for m in _between.finditer(raw)]])).astype(np.int64)
            held = np.unique(np.searchsorted(cuts, strange, side="right")) - 1
            a, b = cuts[held], cuts[held + 1]
            inside = np.zeros(n + 1, np.int64)
            inside[a] += 1
            inside[b] -= 1
            inside = np.cumsum(inside[:n]) > 0
            start &= ~inside
            start[a] = True
            starts = np.flatnonzero(start)
            own = ~inside[starts]
            entries = self.pieces.entries(data, starts[own], np.diff(starts, append=n)[own])
            found = self.whole([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            pool = np.concatenate([self.pieces.pool[: self.pieces.filled], np.fromiter((i for ids in found for i in ids), np.uint32)])
            at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            at[own], size[own] = self.pieces.at[entries], self.pieces.n[entries]
            size[~own] = [len(x) for x in found]
            at[~own] = self.pieces.filled + np.cumsum(size[~own]) - size[~own]
        return pool[ragged(at, size)], starts, np.r_[0, np.cumsum(size)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with the id end after each text, and the texts' places then."""
    return np.insert(ids, at[1:], np.uint32(end)).astype("<u4", copy=False), at + np.arange(len(at))
