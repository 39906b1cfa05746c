"""Words one edit apart against all pairs, forms and roots against a plain walk."""

import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselattice.llm import spelling


def near(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, times=10):
    out = {}
    for w, n in counts.items():
        others = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= times * n else None
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return sorted((w, *r) for w, r in out.items())


def grouped(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("word", F.explode(F.array_repeat("word", F.col("n").cast("int"))))
    return sorted(tuple(r) for r in spelling.spelling_groups(words).collect())


def test_all_pairs(spark):
    """Few letters, so that many words are near, in both halves, with all kinds of edits."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(400)}
    words |= {w[:k] + rng.choice("abzÿ") + w[k + rng.randint(0, 1):] for w in sorted(words)[:200] for k in (rng.randrange(7),)}
    counts = {w: rng.choice([2, 3, 20, 30, 400]) for w in sorted(words) if len(w) >= 7}
    assert grouped(spark, counts) == plain(counts)


def test_long_chain_ties_and_lengths(spark):
    """A chain of forms, two forms of one number (the smaller word wins), words of 3,000 letters, first and last letters."""
    chain = {"abcdefg" + "x" * k: 2 * 10**k for k in range(5)}
    long = {"q" * 3000 + "a": 2, "q" * 3000 + "b": 50, "q" * 3001: 3}
    ends = {"mnopqrs": 2, "nopqrst": 40, "mnopqru": 60, "xnopqrs": 60}
    counts = chain | long | ends
    assert grouped(spark, counts) == plain(counts)
    roots = {r[0]: r[2] for r in grouped(spark, chain)}
    assert set(roots.values()) == {"abcdefgxxxx"}


def test_one_large_group(spark):
    """1,500 words with the same first half and the same parities, of which few are near."""
    rng = random.Random(2)
    tails = set()
    while len(tails) < 1500:
        t = list("aabbccddeeff")
        rng.shuffle(t)
        tails.add("".join(t))
    counts = {"zzzzzzzzzzzz" + t: 2 for t in tails} | {"zzzzzzzzzzzz" + min(tails) + "a": 30}
    assert grouped(spark, counts) == plain(counts)


def test_words_of_texts(spark):
    """Runs and damage as in plain Python; null texts, null ids, empty and long texts, repeated rows, clashing columns."""
    texts = [(1, "Grünwald GRÜNWALD Ünderstood x2understanding"), (2, None), (None, "understanding nobody's-understanding"), (3, ""), (4, "÷×÷×÷×÷ " + "longword " * 20_000), (4, "a1bcdefgh")]
    texts += [(i, "understanding the neighbourhood") for i in range(300)]
    texts += texts[:1] * 2
    df = spark.createDataFrame([(*t, "x", "x") for t in texts], "doc_id long, text string, run string, word string")
    want = []
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want.append(run)
    counts = {w: want.count(w) for w in set(want) if len(w) >= 7 and want.count(w) >= 2}
    assert any(near(w, "understanding") for w in want)
    assert sorted(tuple(r) for r in spelling.spelling_groups(spelling.words_of(df)).collect()) == plain(counts)


def test_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "word string")).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(None,), ("short",), ("onlyonce",)], "word string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("aábz", min_size=7, max_size=10), st.integers(0, 9), st.sampled_from("aábz"), st.booleans(), st.booleans())
def test_an_edit_leaves_a_band_and_a_half(word, at, letter, drop, put):
    """The method's two claims: one edit flips at most two bits, so a band is equal, and a half of the longer length is equal."""
    at = min(at, len(word) - drop)
    other = word[:at] + letter * put + word[at + drop:]
    if not near(word, other):
        return

    def bands(w):
        out = [0] * spelling.BANDS
        for c in w:
            out[ord(c) % spelling.BANDS] ^= 1 << ord(c) // spelling.BANDS % 64
        return out

    flips = [bin(x ^ y).count("1") for x, y in zip(bands(word), bands(other))]
    assert sum(flips) <= 2 and 0 in flips
    half = max(len(word), len(other)) // 2
    assert word[:half] == other[:half] or word[-half:] == other[-half:]


def test_no_two_letters_share_a_bit():
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    assert len({(c % spelling.BANDS, c // spelling.BANDS % 64) for c in letters}) == len(letters)
