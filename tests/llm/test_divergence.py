"""The divergence audit against its SQL and against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corroborate.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def prob(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        p = {s: prob(counts[lang, s]) for s in sources}
        q = prob(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(found))
    return out


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}é" for n in range(300)]
    rows = []
    for n in range(900):
        lang = rng.choice(["en", "en", "de"])
        k = rng.randrange(40)
        text = " ".join(rng.choices(words[: 50 + 6 * k], k=rng.randrange(5, 60)))
        rows.append((text.upper() if n % 7 == 0 else text, lang, f"s{k}"))
    rows += [(None, "en", "empty"), ("", None, None), ("only_once", "xx", "a"), ("other", "xx", "b"), ("1 2 3", "xx", "日本"), (None, "en", None)]
    rows += [("hot " * 3000 + words[0], "en", "s1")] * 12
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(n, *r, "clash") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(3)


def test_against_brute_force(spark, corpus):
    assert got(divergence.audit(frame(spark, corpus))) == brute(corpus)


def test_many_blocks(spark, corpus, monkeypatch):
    """Blocks of few groups give tiles of two sides."""
    monkeypatch.setattr(divergence, "BLOCK", 5)
    assert got(divergence.audit(frame(spark, corpus), least=3, top=2)) == brute(corpus, 3, 2)


def test_empty_and_without_terms(spark, corpus):
    assert divergence.audit(frame(spark, corpus).limit(0)).isEmpty()
    assert got(divergence.audit(frame(spark, corpus), least=10**6)) == brute(corpus, 10**6)


def test_large_counts_divide_exactly():
    counts = np.array([0, 1, 10**10, 4 * 10**12, 5 * 10**14], dtype=np.int64)
    whole = 8 * 10**15 + 12345
    assert divergence.probability(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in counts]
    p, q = np.array([10**9 + 1, 5], dtype=np.int64), np.array([1, 5], dtype=np.int64)
    assert divergence.divergence(p, q).tolist() == [(10**9) ** 2 // (10**9 + 2), 0]


def test_words_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 10)
    data = ("Abc déf, GHI_jkl " * 20).encode()
    assert [w for part in divergence._words(data) for w in part] == [w.encode() for w in ["abc", "déf", "ghi", "jkl"] * 20]


def test_same_rows_as_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    found = con.execute(divergence.OP13_SQL)
    names = [c[0] for c in found.description]
    want = Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall())
    assert got(divergence.op13(spark, path)) == want and len(want) > 1000
