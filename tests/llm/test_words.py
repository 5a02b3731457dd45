import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryloom.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1é \n\t.-日\x1c", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_words_hashes_and_windows(texts, width):
    array = pa.array(texts, pa.string())
    for kind, pattern, lower in (("space", r"[^\x20\x09-\x0D]+", False), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = words.split(array, kind, lower)
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t) if t else [] for t in texts]
        data = w.data.tobytes()
        flat = [data[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
        assert [flat[w.at[i] : w.at[i + 1]] for i in range(len(texts))] == want
        h = w.hashes()
        assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat)) == len(set(h.tolist()))
        first, runs = words.windows(h, w.at, width)
        expected = [(int(w.at[i]) + k, tuple(x[k : k + width])) for i, x in enumerate(want) for k in range(len(x) - width + 1)]
        assert first.tolist() == [k for k, _ in expected]
        assert len(set(runs.tolist())) == len({x for _, x in expected})


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in range(1, 14):
        assert words.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(50 - width + 1)]
