"""Cross-tokenizer alignment against brute force with the libraries' whole-text calls."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corroborate.llm import crosstok

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _chars():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def brute():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = _chars()

    def groups(text):
        """Groups as ([a ids], [b ids]), or None."""
        if not text:
            return None
        a = [(i, bytes(chars[c] for c in lib.id_to_token(i))) for i in lib.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
        raw = f" {text}".encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return None
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for n, (_, x) in enumerate(side):
                at += len(x)
                own[at] = n
            ends.append(own)
        out, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end] + 1, ends[1][end] + 1
            out.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
            i, j = x, y
        return out

    def all_rows(rows):
        found = [(i, groups(t)) for i, t in rows]
        pairs = Counter((a[-1], b[-1]) for _, g in found if g for a, b in g)
        best = defaultdict(int)
        for (_, b), n in pairs.items():
            best[b] = max(best[b], n)
        out = Counter()
        for i, g in found:
            links = [(a[-1], b[-1]) for a, b in g or ()]
            listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or ())
            sha = hashlib.sha256(listed.encode()).hexdigest() if g else ""
            out[i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(links), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), sha] += 1
        return out

    return all_rows


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def odd_texts(rng, n):
    letters = ["a", "the", "'s", " ", " ", "  ", "\n", "\t", "1", "12", ".", "é", "日本", "😀", "▁", "<|endoftext|>", "<s>", "　", "\x85", "\x1c", "\r\n", "&&&", "\0", "don't"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_awkward_rows(docs, rows, none, brute):
    assert got(crosstok.crosstok(docs)) == brute(rows)
    assert crosstok.crosstok(none).isEmpty()


def test_random_white_space_and_special_strings(spark, brute):
    rows = [(n, t) for n, t in enumerate(odd_texts(random.Random(11), 600))]
    assert got(crosstok.crosstok(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_small_bounds(spark, rows, brute, monkeypatch):
    """Cuts of long texts, forgotten units, split ids, full slots and long multiplicities change nothing. One thread's blocks are made here, as workers would not see the bounds."""
    for name, value in {"SEGMENT": 300, "UNITS_KEPT": 50, "BLOCK_BYTES": 2000}.items():
        monkeypatch.setattr(crosstok, name, value)
    both = crosstok.Pair("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    rows = [*rows, *((1000 + n, t) for n, t in enumerate(odd_texts(random.Random(3), 200))), (5000, "a a " * 3000)]
    pairs, found = Counter(), {}
    for n, (_, text) in enumerate(rows):
        block = crosstok._Block(both)
        block.add(n, text)
        codes, times = block.postings()
        assert not len(times) or times.max() <= 255
        for code, k in zip(codes.tolist(), times.tolist(), strict=True):
            pairs[code // crosstok.WIDE % crosstok.WIDE, code // crosstok.WIDE**2] += k
        r = block.documents(0).to_pylist()[0]
        found[n] = (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"])
    want = brute([(n, t) for n, (_, t) in enumerate(rows)])
    assert {w[0]: (w[1], w[2], w[3], w[7]) for w in want} == found
    assert sum(n * n for n in pairs.values()) == sum(w[6] for w in want)
    assert len(both.number) < 5000


def test_split_ids(docs, rows, brute):
    assert got(crosstok.crosstok(docs, share=60)) == brute(rows)
