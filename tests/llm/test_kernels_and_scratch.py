"""Kernels against plain Python on random texts; the shared steps of the operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteql.llm import kernels as K
from graniteql.llm import lines, scratch, substrings
from graniteql.llm.scratch import Scratch

from .fixtures import words

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab Ab\n\t\r\x0b\x0c é€𝄞#|\x00\x85 "), max_size=40)), max_size=8)


def one(texts):
    return list(K.Text.of(pa.array(texts, pa.string())))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    for a, b, x in one(texts):
        x.split_words()
        expected = [w for t in texts[a:b] for w in words(t)]
        assert [bytes(x.data[s:e]).decode() for s, e in zip(x.starts, x.ends, strict=True)] == expected
        assert x.n_words.tolist() == [len(words(t)) for t in texts[a:b]]
        assert x.code_points().tolist() == [len(t or "") for t in texts[a:b]]
        h = x.word_hash().tolist()
        assert [[p == q for q in h] for p in h] == [[p == q for q in expected] for p in expected]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows_and_repeats(texts, k):
    for a, b, x in one(texts):
        x.split_words()
        value, at = K.windows(x.word_hash(), x.first, k)
        expected, start = [], 0
        for t in texts[a:b]:
            ws = words(t)
            expected += [(start + i, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1)]
            start += len(ws)
        assert at.tolist() == [i for i, _ in expected]
        v = value.tolist()
        assert [[p == q for q in v] for p in v] == [[p == q for _, q in expected] for _, p in expected]
        twice, later = K.again(np.zeros(len(v), np.int64), value)
        runs = [w for _, w in expected]
        assert twice.tolist() == [runs.count(w) > 1 for w in runs]
        assert later.tolist() == [w in runs[:i] for i, w in enumerate(runs)]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_lines(texts):
    for a, b, x in one(texts):
        starts, ends, counts = lines._lines(x)
        assert [bytes(x.data[s:e]).decode() for s, e in zip(starts, ends, strict=True)] == [line for t in texts[a:b] for line in (t or "").split("\n")]
        assert counts.tolist() == [len((t or "").split("\n")) for t in texts[a:b]]


def test_long_texts_are_whole_and_slices_right():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randint(0, 99)}" for _ in range(n)) for n in (0, 5, 60_000, 3, 400_000, 1)]
    column = pa.concat_arrays([pa.array(["x y", None]), pa.array(texts)]).slice(2)
    seen = {}
    for a, b, x in K.Text.of(column, 1 << 16):
        x.split_words()
        h = x.word_hash()
        for i in range(a, b):
            seen[i] = h[x.first[i - a] : x.first[i - a + 1]]
    by_word = {}
    for i, t in enumerate(texts):
        assert len(seen[i]) == len(t.split())
        for w, v in zip(t.split(), seen[i].tolist(), strict=True):
            assert by_word.setdefault(w, v) == v
    assert len(set(by_word.values())) == len(by_word)


def test_winnowing_meets_equal_windows():
    """Equal windows of two texts belong to equal anchors at equal places."""
    r = random.Random(5)
    shared = [f"s{r.randint(0, 9)}" for _ in range(30)]
    texts = [" ".join([f"a{r.randint(0, 9)}" for _ in range(r.randint(0, 40))] + shared + [f"b{r.randint(0, 9)}" for _ in range(r.randint(0, 40))]) for _ in range(40)]
    (_, _, x), = one(texts)
    key, _, row, s, n = substrings.anchors(x, 20, 8)
    governed = {}
    for k, t, first, count in zip(key.tolist(), row.tolist(), s.tolist(), n.tolist(), strict=True):
        ws = texts[t].split()
        for i in range(first, first + count):
            governed.setdefault(tuple(ws[i : i + 20]), set()).add(k)
    assert sum(n) == sum(max(0, len(t.split()) - 19) for t in texts)
    assert all(len(keys) == 1 for keys in governed.values())


@pytest.mark.parametrize("bits", [6, 8, 26])
def test_rows_by_bitmap(spark, monkeypatch, bits):
    monkeypatch.setattr(scratch, "SLOT_BITS", bits)  # few slots are all taken
    rows = spark.range(-500, 500).select(F.col("id").alias("rid"), (F.col("id") * 2).alias("v"))
    ids = spark.range(-400, 600, 7).select(F.col("id").alias("rid"))
    gone = {r[0] for r in ids.collect()}
    assert sorted(r["rid"] for r in scratch.without(rows, ids).collect()) == [i for i in range(-500, 500) if i not in gone]
    assert {i for i in range(-500, 500) if i in gone} <= {r["rid"] for r in scratch.likely_rows(rows, ids).collect()}
    none = ids.filter("false")
    assert scratch.without(rows, none).count() == 1000 and scratch.likely_rows(rows, none).count() == 0


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("id % 10 AS k", "CAST(id AS STRING) AS v").repartition(7)
    found = scratch.number_rows(spark, df, [F.col("k"), F.col("v")], "n", Scratch(spark, "t")).collect()
    assert [r["n"] for r in sorted(found, key=lambda r: (r["k"], r["v"]))] == list(range(1000))


def test_with_ids(spark):
    s = Scratch(spark, "t")
    unique = spark.sql("SELECT id AS doc_id, 'x' AS text, 1 AS rid_like FROM range(5)")
    assert all(r["rid"] == r["doc_id"] for r in scratch.with_ids(spark, unique, "doc_id", ["text"], s).collect())
    mixed = spark.sql("SELECT * FROM VALUES (3, 'b'), (3, 'a'), (NULL, 'z'), (1, NULL), (1, NULL) AS t(doc_id, text)")
    found = sorted(scratch.with_ids(spark, mixed, "doc_id", ["text"], s).collect(), key=lambda r: r["rid"])
    assert [(r["doc_id"], r["text"]) for r in found] == [(1, None), (1, None), (3, "a"), (3, "b"), (None, "z")]
    assert [r["rid"] for r in found] == list(range(5))


def test_shared_folder_is_asked_of_the_session(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())
    Session.conf.get = staticmethod(lambda key, default=None: "hdfs://nn/ck/")
    assert scratch.shared_folder(Session()) == "hdfs://nn/ck"
