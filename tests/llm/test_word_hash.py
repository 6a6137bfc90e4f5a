"""Words whose first chain of hashes collides, built by running that chain backwards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.common import Splitter, grams, hash_words, wide_grams
from tessella.llm.context_tree import score_texts
from tessella.llm.decontaminate import decontaminate
from tessella.llm.jaccard_join import jaccard_join
from tessella.llm.substring_dedup import substring_dedup

M = 2**64 - 1
K = [int(k) for k in common._KEYS]


def spread(x):
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D), (33, 1)):
        x = (x ^ x >> shift) * factor & M
    return x


def back(x):
    for shift, factor in ((33, 1), (27, 0x81DADEF4BC2DD44D), (31, 0x7FB5D329728EA185)):
        x = x * pow(factor, -1, 2**64) & M
        y = x
        for _ in range(3):
            y = x ^ y >> shift
        x = y
    return x


def chain(word):
    """The first chain of a word of 16 bytes, before the second is added."""
    a, b = (int.from_bytes(word[i : i + 8], "little") for i in (0, 8))
    return spread((spread(a ^ K[8]) * K[9] + K[10] & M) ^ spread((b + K[11] & M) ^ (16 * K[12] & M)))


def twin_of(word, seed):
    """Another word of 16 printable bytes with the same first chain."""
    draw = random.Random(seed)
    goal = back(chain(word))
    while True:
        head = bytes(draw.choices(range(97, 123), k=8))
        left = spread(int.from_bytes(head, "little") ^ K[8]) * K[9] + K[10] & M
        tail = ((back(goal ^ left) ^ (16 * K[12] & M)) - K[11] & M).to_bytes(8, "little")
        if all(33 <= c < 127 for c in tail):
            return head + tail


#: Found with twin_of. The benchmark's words are letters, digits and what is not ASCII: PLAIN.
PAIRS = [(b"internationalize", b"cuzwjvpy}_<f+j7'"), (b"misunderstanding", b'khckuvqc0c_"0(<!')]
PLAIN = (b"misunderstanding", b"unzwcvqgadw4ogmt")


def hashes(words, both=False):
    data = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    return hash_words(data, ends - sizes, ends, both)


@pytest.mark.parametrize("pair", PAIRS)
def test_one_chain_collides_and_the_hash_does_not(pair):
    assert pair[0] != pair[1] and chain(pair[0]) == chain(pair[1]) == chain(twin_of(pair[0], 7))
    h, t = hashes(list(pair), True)
    assert h[0] != h[1] and t[0] != t[1]


def test_hashes_of_many_words():
    draw = random.Random(3)
    words = list({bytes(draw.choices(b"abcdefgh\xc3\xa9", k=draw.choice([1, 2, 3, 6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(20000)})
    h, t = hashes(words, True)
    assert len(set(h.tolist())) == len(set(t.tolist())) == len(words)
    assert (hashes(words) == h).all()  # the second is an addition
    again = words[::-1]
    assert (hashes(again) == h[::-1]).all()  # place and neighbours have no part in it
    for both in (False, True):
        got = hashes([], both)
        assert [len(x) for x in (got if both else [got])] == [0] * (1 + both)


def test_runs_take_both_hashes():
    text = b"a b c d internationalize a b c d cuzwjvpy}_<f+j7'"
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    h, _, _, first, second = Splitter(both=True)(data, bounds)
    assert first.tolist() == [0, 10] and len(second) == 10
    runs = wide_grams(h, second, 5)
    assert runs[0] != runs[5] and (grams(h, 1) == h).all()
    assert wide_grams(h, second, 4)[0] == wide_grams(h, second, 4)[5]
    none = Splitter(both=True)(np.zeros(0, np.uint8), np.array([0, 0]))
    assert [len(x) for x in none] == [0, 0, 0, 2, 0]


@pytest.mark.parametrize("pair", PAIRS)
def test_operators_tell_them_apart(spark, pair):
    one, two = (w.decode() for w in pair)
    rest = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(0, f"{rest} {one}"), (1, f"{rest} {two}"), (2, f"{rest} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {0: 0, 1: 0, 2: 50}
    docs = spark.createDataFrame([(0, f"a b c d {one}"), (1, f"a b c d {two}"), (2, f"a b c d {one}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {0: 0, 1: 1, 2: 0}
    words = spark.createDataFrame([(0, one), (1, two), (2, one)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in score_texts(words, F.col("doc_id") == 0).collect()} == {0: 2, 1: 1, 2: 2}


def test_a_window_takes_both_hashes(spark):
    one, two = (w.decode() for w in PLAIN)
    assert one != two and chain(PLAIN[0]) == chain(PLAIN[1])
    items = spark.createDataFrame([(0, f"{one} b c")], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"x {two} b c"), (1, f"x {one} b c y")], "doc_id long, text string")
    for bound in (8 << 20, 0):
        assert {r.doc_id: r.n_hit for r in decontaminate(docs, items, broadcast_bytes=bound).collect()} == {0: 0, 1: 3}
