"""The text hash: no systematic collisions, and the same for equal bytes wherever they stand."""

import random

import numpy as np
from pyspark.sql import functions as F

from busnet.llm import hashing, lines, minhash


def thue_morse(bits):
    """A word of 2^bits letters and its complement; sums of powers of any odd base agree on them modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def one(text):
    data = np.frombuffer(text, np.uint8)
    return int(hashing.pieces(data, np.zeros(1, np.int64), np.array([len(data)]))[0])


def test_pieces():
    rng = random.Random(2)
    pieces = [b"", b"a", b"\0", b"\0\0", b"a" * 8, b"a" * 9, b"a" * 640, b"a" * 641, b"b" * 5000]
    pieces += [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    pieces += [bytes(rng.choice(b"ab") for _ in range(rng.choice([600, 639, 640, 641, 700]))) for _ in range(50)]
    data = np.frombuffer(b"x".join(pieces), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    starts = ends - np.array([len(p) for p in pieces])
    found = hashing.pieces(data, starts, ends).tolist()
    assert found == [one(p) for p in pieces]
    assert len(set(found)) == len(set(pieces))
    assert len(hashing.pieces(data[:0], starts[:0], ends[:0])) == 0


def test_words_of_a_thousand_letters(spark):
    for bits in (10, 11, 12):
        a, b = thue_morse(bits)
        assert one(a.encode()) != one(b.encode())
    (a, b), (c, d) = thue_morse(10), thue_morse(12)
    # two documents that share nothing, and one with two different lines
    rows = [(1, f"{a} {c}"), (2, f"{b} {d}"), (3, f"{a}\n{c}"), (4, f"{b}\n{d}"), (5, a), (6, b), (7, f"{a}\n{b}\n{c}\n{d}"), (8, f"{a} {c}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, minhash.Similarity(shingle=4)).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 6, 7: 7, 8: 1}
    cut = {r.doc_id: r.n_removed for r in lines.without_repeats(docs).collect()}
    assert cut == dict.fromkeys(range(1, 9), 0)
    alone = {r.doc_id: r.n_removed for r in lines.without_repeats(docs, lone=1).filter(F.col("n_removed") > 0).collect()}
    assert alone == {5: 1, 6: 1, 7: 4, 8: 1}
