"""Random documents with copies, near copies, shared passages and odd rows."""

import random

WORDS = "the of and Rhein été niño straße x1 42 foo-bar Baz, qux. lorem ipsum dolor sit amet zeta eta theta iota kappa".split()


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    passage = [r.choice(WORDS) + str(r.randrange(90)) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.randrange(8)
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[r.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif kind == 2:
            text = " ".join([r.choice(WORDS) for _ in range(9)] + passage + [r.choice(WORDS) for _ in range(5)])
        else:
            text = r.choice([" ", "\n", "  "]).join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(1, 90)))
        rows.append((i, text, r.choice(["en", "de", None]), "src", len(text or "")))
    odd = [None, "", " \n\t ", "A.", "one two", passage[0], " ".join(passage), " ".join(passage), "日本語 テキスト 漢字", "<|endoftext|> don't  stop\r\n\r\n" * 20, "word " * 3000]
    rows += [(n + k, t, None, None, None) for k, t in enumerate(odd)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra: bool = True):
    df = spark.createDataFrame(rows if rows is not None else documents(), SCHEMA)
    if extra:  # columns with names that operators use within
        for name in ("id", "row", "key", "n", "load", "token", "shard", "length", "sequence_id", "rank", "score", "_gone"):
            df = df.selectExpr("*", f"'own' AS `{name}`")
    return df
