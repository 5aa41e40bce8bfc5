import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, word string"


def prose(rng, n, words=900):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(40, 200)) for _ in range(30)]
    base[7] = prose(rng, 300)
    passage = prose(rng, 60)
    out = [(n, t) for n, t in enumerate(base)]
    out += [(100, None), (101, ""), (102, " \n\t"), (None, "a text without an id"), (None, base[0]), (103, "short"), (104, "x" * 30_000)]
    out += [(105, base[3]), (105, base[3]), (106, base[3] + "  "), (2, base[4]), (107, base[5].replace(" ", "\n")), (108, base[6].upper())]
    out += [(110 + n, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for n in range(6)]
    for n in range(6):
        words = base[7].split()
        words[n * 5] = "changed"
        out.append((120 + n, " ".join(words)))
    out += [(130, passage + " " + passage), (131, "日本語 text é " * 40), (132, "ab" * 4000), (133, "<|endoftext|> a <|endoftext|>"), (134, base[8] + "\x85 \x1c" + base[9])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{n % 5}", None if t is None else len(t), "clash", "clash") for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
