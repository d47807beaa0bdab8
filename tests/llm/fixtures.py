"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, k int, slot string, _row int, _text string, block string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


def texts(seed=0, n=60):
    rng = random.Random(seed)
    passage = "\n".join(words(rng, 20) for _ in range(6))
    out = []
    for i in range(n):
        lines = [words(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 8))]
        if i % 7 == 3:
            lines += [passage]
        if i % 9 == 5 and out:
            base = out[-1] or "x"
            lines = [base.replace("a ", "b ", 1), words(rng, 2)]
        if i % 8 == 6 and out:
            lines = [out[-2] or "same"]
        out.append("\n".join(lines))
    out[10:10] = [None, "", " \n\t ", "one", "Two words", "é ß 漢字   x", words(rng, 12_000), "under the MIT License", "<|endoftext|> a", "\n\n\n"]
    return out


def documents(spark, seed=0, n=60):
    rows = []
    for i, t in enumerate(texts(seed, n)):
        rows.append((i * 3 % 1000, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, len(t) if t is not None else None, "h", i, "s", 1, "t", "b"))
    # One id with two texts, the second of them another id's as well.
    rows += [(rows[20][0], rows[40][1], "en", "s1", len(rows[40][1] or ""), "h", 0, "s", 1, "t", "b")]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1", 10, "h", 0, "s", 1, "t", "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
