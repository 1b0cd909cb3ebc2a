"""Texts that polynomial hashes modulo powers of two can't tell apart: each operator must tell them apart."""

import hashlib
import subprocess
import sys
from pathlib import Path

import numpy as np

from graniteql.llm import katz, lines, minhash, packing, quality, substrings
from graniteql.llm import kernels as K

from .fixtures import frame


def thue_morse(n, letters="ab"):
    s = letters[0]
    for _ in range(n):
        s += s.translate(str.maketrans(letters, letters[::-1]))
    return s


ONE, TWO = thue_morse(10), thue_morse(10, "ba")


def rows(*texts):
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_hashes():
    text = K.Text(np.frombuffer(f"{ONE} {TWO} {ONE * 40} {TWO * 40}".encode(), np.uint8), np.array([0, 2049 + 81921 + 1]))
    text.split_words()
    for which in (0, 1):
        assert len(set(text.word_hash(which=which).tolist())) == 4
        assert len(set(span for span in K.text_hash(np.array([{"a": 7, "b": 9}[c] for c in ONE + TWO], np.uint64), np.array([0, 1024, 2048]), which).tolist())) == 2
    items = np.array([{"a": 7, "b": 9}[c] for c in ONE + TWO], np.uint64)
    for k in (64, 1024):
        value, at = K.windows(items, np.array([0, 1024, 2048]), k)
        runs = [(ONE + TWO)[i : i + k] for i in at.tolist()]
        assert len(set(value.tolist())) == len(set(runs))


def test_lines_and_quality(spark):
    found = by_id(lines.dedup_lines(spark, frame(spark, rows(ONE, TWO, ONE))))
    assert [found[i]["text"] for i in range(3)] == [ONE, TWO, ""]
    found = by_id(quality.judge(spark, frame(spark, rows(f"{ONE}\n{TWO}", f"{ONE}\n{ONE}"))))
    assert [found[i]["n_dup_lines"] for i in range(2)] == [0, 1]


def test_passages(spark):
    spaced = [" ".join(x) for x in (ONE, TWO)]
    words = [" ".join([x] * 25) for x in (ONE, TWO)]
    found = by_id(substrings.drop_repeats(spark, frame(spark, rows(*words))))
    assert found[0]["n_removed"] == found[1]["n_removed"] == 24  # each repeats itself
    assert found[1]["n_words"] == 25
    found = by_id(substrings.drop_repeats(spark, frame(spark, rows(*spaced)), length=1024, k=8))
    assert found[0]["n_removed"] == found[1]["n_removed"] == 0


def test_near_duplicates(spark):
    found = by_id(minhash.near_duplicates(spark, frame(spark, rows(ONE, TWO, ONE))))
    assert [found[i]["class_id"] for i in range(3)] == [0, 1, 0]


def test_scores(spark):
    found = by_id(katz.score_documents(spark, frame(spark, [(i, t, "en", "s", 1) for i, t in ((0, ONE), (2, f"{ONE} {ONE}"), (18, TWO))])))
    assert [found[i]["held_out"] for i in (0, 2, 18)] == [False, False, True]
    assert found[18]["n_known"] == 1 and found[0]["n_known"] == 2


def test_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    texts = [ONE, TWO, ONE[:200], TWO[:200]]
    pieces = by_id(packing.pack(spark, frame(spark, rows(*texts)), length=1 << 16))
    for i, t in enumerate(texts):
        assert np.frombuffer(pieces[i]["ids"], "<u4").tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_words_of_one_hash_are_compared(monkeypatch):
    """Were all hashes equal, ids would still be right."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    monkeypatch.setattr(K.Text, "word_hash", lambda self, lower=False, which=0: np.zeros(len(self.starts), np.uint64))
    mine = packing.WordTokenizer(packing.vocabulary())
    for words in ("one two one three", "two one four", "x" * 300 + " one"):
        data = np.frombuffer(words.encode(), np.uint8)
        ids, _ = mine.tokens(K.Text(data, np.array([0, len(data)])), 2)
        assert ids.tolist() == [*tokenizer.encode(words, add_special_tokens=False).ids, 2]


HUGE = """
import resource, sys
import numpy as np
from graniteql.llm import kernels as K, lines, minhash, quality, substrings
data = np.tile(np.frombuffer(b"ab", np.uint8), 32 << 20)
text = K.Text(data, np.array([0, len(data)]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert quality.measure(text, 5)[0].tolist() == [1]
assert len(lines._keys(text, 10)[0]) == 1
assert len(text.word_hash(True, 1)) == 1
assert len(minhash.entries(text, 5)[0]) == 1
assert len(substrings.anchors(text, 20, 8)[0]) == 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_word_of_64_mb_costs_little():
    out = subprocess.run([sys.executable, "-c", HUGE], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True)
    assert int(out.stdout) < 300
