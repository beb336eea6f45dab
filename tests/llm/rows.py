"""A table with every oddity the operators must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use themselves.
        T.StructField("node", T.StringType()),
        T.StructField("root", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("_id", T.LongType()),
    ]
)


def prose(seed: int, words: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def lined(words: list[str], width: int = 12) -> str:
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies."""
    base = prose(1, 120)
    near = base[:]
    near[60] = "changed"
    short = ["one", "two", "three"]
    shared = prose(2, 60)
    texts = [
        lined(base),
        lined(near),
        lined(base),
        "",
        None,
        " \t\n \r\x0b\x0c ",
        "one",
        " ".join(short),
        " ".join(short).upper(),
        lined(prose(3, 6000, 300)),
        "x" * 3000 + "\n" + "yz" * 2000,
        lined(prose(4, 40) + shared + prose(5, 40)),
        lined(prose(6, 30) + shared + prose(7, 50)),
        "the same line\nthe same line\nanother line | # $ 50% <b>&\n\nthe same line",
        "Übung macht den Meister. Été à la plage; mañana será otro día! İΣ 日本語 ﬁ é́ 12²",
        "<|endoftext|> don't stop </s>[INST] ok [/INST] \\",
    ]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), "a", k, k, k) for k, t in enumerate(texts)]
    rows.append((None, lined(base), None, None, None, None, None, None, None))
    rows.append((100, lined(prose(8, 90)), None, None, 5, None, 1, None, None))
    rows += [rows[0], rows[0], rows[11]]
    rows += [(200 + k, lined(prose(200 + k, 80)), "de", None if k % 2 else "s1", 1, "b", 0, 0, 0) for k in range(8)]
    return rows
