"""Each operator on documents against a brute-force version, and on the hard cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from graniteql.llm import exact, katz, lines, minhash, mixing, packing, quality, substrings

from .fixtures import LOWER, SCHEMA, clashing, documents, frame, hard, words

SPACE = " \t\n\r\x0b\x0c"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- quality rules

def measures(text):
    ws = words(text)
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + o for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for o in range(5)}
    full = [x for x in (text or "").split("\n") if words(x)]
    n = len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered)
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_quality_measures(spark):
    rows = documents()
    found = by_id(quality.judge(spark, clashing(frame(spark, rows))))
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(text)
        assert r["kept"] is (not r["base_failed"])  # no host is bad here


def test_quality_rejects_bad_hosts_only(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, good if i % 10 == 0 else "bad", "en", "junk", 1) for i in range(200)]
    rows += [(1000 + i, good if i % 10 else "bad", "en", f"host{i % 5}", 1) for i in range(500)]
    found = quality.judge(spark, frame(spark, rows)).collect()
    assert not any(r["kept"] for r in found if r["source"] == "junk")
    assert all(r["kept"] for r in found if r["source"] != "junk" and not r["base_failed"])
    kept = quality.keep_good(spark, frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found if r["kept"])


# --- exact dedup

def strip(text):
    return (text or "").translate({ord(c): None for c in SPACE})


def test_exact_dedup(spark):
    rows = documents()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[strip(text)].append((-len(text or ""), doc_id))
    for r in exact.exact_dedup(spark, clashing(frame(spark, rows))).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        group = sorted(groups[strip(text)])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (group[0][1], len(group), group[0][1] == r["doc_id"])
        assert bytes(r["digest"]).hex() == sha(strip(text))


def test_exact_dedup_hard(spark):
    rows = hard()
    found = exact.exact_dedup(spark, frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sum(r["kept"] for r in found) == len({strip(x[1]) for x in rows})
    kept = exact.keep_one(spark, frame(spark, rows)).collect()
    assert len(kept) == len({strip(x[1]) for x in rows}) == len({strip(r["text"]) for r in kept})


def digests_of(things):
    import numpy as np

    return np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in things), "<u8").reshape(-1, 4)


def four(n):
    import numpy as np

    return np.stack([np.arange(n), np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)], 1)


def test_cuckoo_index():
    index, live = exact.CuckooIndex(buckets=2), set()
    for start in range(0, 3000, 75):
        things = list(range(start, start + 75))
        keys = digests_of(things)
        assert (index.find(keys) == -1).all()
        index.insert(keys, four(75) + start)
        live |= set(things)
        gone = things[::3]
        assert index.delete(digests_of(gone)).all() and not index.delete(digests_of(gone)).any()
        live -= set(gone)
    assert index.resized > 3 and index.live == len(live)
    assert {int(v[0]) for v in index.entries()[1]} == live
    found = index.find(digests_of(sorted(live)))
    assert index.values[found, 0].tolist() == sorted(live)
    assert (index.find(digests_of(range(5000, 9000))) == -1).all()


def test_cuckoo_overflow_rebuilds_from_keys():
    import numpy as np

    index = exact.CuckooIndex(buckets=1)
    keys = np.array([[7, 0, 0, i] for i in range(8)], np.uint64)  # one fingerprint, which fits eight times once there are two buckets
    for i in range(8):
        index.insert(keys[i : i + 1], four(1) + i)
    assert index.resized and index.values[index.find(keys), 0].tolist() == list(range(8)) and index.live == 8


def test_cuckoo_merges_as_one_by_one():
    import random

    import numpy as np

    r, index, expected = random.Random(3), exact.CuckooIndex(), {}
    for _ in range(20):
        things = [r.randrange(300) for _ in range(50)]
        values = [[r.randrange(1000), 5, r.randrange(3), r.randrange(1, 4)] for _ in things]
        index.merge(digests_of(things), np.array(values))
        for x, v in zip(things, values, strict=True):
            old = expected.setdefault(x, [*v[:3], 0])
            if (-v[2], v[0]) < (-old[2], old[0]):
                old[:3] = v[:3]
            old[3] += v[3]
    at = index.find(digests_of(sorted(expected)))
    assert index.values[at].tolist() == [expected[x] for x in sorted(expected)] and index.live == len(expected)


def test_stored_index_updates(spark):
    rows = frame(spark, documents())
    found = exact.digests(rows.withColumn("rid", rows["doc_id"]), "rid", "doc_id")
    index = exact.build_index(spark, found, 100)
    some = [r["digest"] for r in index.select("digest").limit(5).collect()]
    gone = spark.createDataFrame([(x,) for x in some], "digest binary")
    after = exact.update_index(spark, index, deleted=gone)
    assert after.count() == index.count() - 5
    again = exact.update_index(spark, after, added=index.join(gone, "digest"))
    key = lambda df: sorted((bytes(r["digest"]), r["keep_id"], r["n"]) for r in df.collect())
    assert key(again) == key(index)


# --- mixing

def test_mixing(spark):
    rows = documents(n=200)
    found = mixing.mix_sources(spark, clashing(frame(spark, rows))).collect()
    sizes = {r[0]: len(words(r[1])) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    own = Counter()
    for r in rows:
        own[r[3]] += sizes[r[0]]
    target, free, rest = {}, set(sources), sum(own.values())
    while True:
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 3 * own[s] < weight[s] * level}
        if not over:
            break
        target |= {s: 3 * own[s] for s in over}
        free -= over
        rest = sum(own.values()) - sum(target.values())
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in found:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == own[r["source"]]
        taken[r["source"]] += r["taken"]
    for s in sources:
        largest = max((sizes[r[0]] for r in rows if r[3] == s), default=0)
        assert abs(taken[s] - target[s]) <= 3 * largest + 1
    again = mixing.mix_sources(spark, frame(spark, rows, 7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in found) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_hard(spark):
    """Null and repeated ids are documents of their own: what a source takes is near its target all the same."""
    rows = hard() * 3
    found = mixing.mix_sources(spark, clashing(frame(spark, rows))).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((x[0], len(words(x[1]))) for x in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)


def test_mixed_copies(spark):
    rows = hard()
    counts = mixing.mix_sources(spark, frame(spark, rows)).collect()
    out = mixing.mixed(spark, frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert out.count() == sum(r["copies"] for r in counts)


# --- substring dedup

def repeats(rows, length=20):
    first, out = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ws, gone = words(text), set()
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            if w in first:
                gone.update(range(i, i + length))
            else:
                first[w] = (doc_id, i)
        out[doc_id] = (len(ws), len(gone), " ".join(x for i, x in enumerate(ws) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = documents(seed, 90)
    expected = repeats(rows)
    for r in substrings.drop_repeats(spark, clashing(frame(spark, rows))).collect():
        assert (r["n_words"], r["n_removed"], r["text"]) == expected[r["doc_id"]]
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(x["end"] - x["start"] >= 20 for x in r["removed"])


def test_substrings_hard(spark):
    rows = hard()
    found = substrings.drop_repeats(spark, frame(spark, rows)).collect()
    assert len(found) == len(rows)
    whole = words(rows[0][1])
    mine = sorted((r["n_removed"] for r in found if r["doc_id"] == rows[0][0]), reverse=True)
    assert mine[:2] == [len(whole)] * 2 if len(whole) >= 20 else mine == [0, 0, 0]


# --- line dedup

def line_result(rows, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    owner = {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                owner.setdefault(key(x), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if owner.get(key(x), doc_id) == doc_id]
        out[doc_id] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, batches):
    rows = documents(3, 80)
    expected = line_result(rows)
    for r in lines.dedup_lines(spark, clashing(frame(spark, rows)), batches=batches).collect():
        assert (r["n_lines"], r["n_dropped"], r["text"]) == expected[r["doc_id"]]


def numbered(rows):
    """Rows in order of id (nulls last), then text (nulls first), with numbers in place of their ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(i, *r[1:]) for i, r in enumerate(order)], [r[0] for r in order]


def test_lines_hard(spark):
    rows, ids = numbered(hard())
    expected = Counter((ids[i], *x) for i, x in line_result(rows).items())
    found = lines.dedup_lines(spark, clashing(frame(spark, hard()))).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found) == expected


def test_line_runs_are_merged_in_order(spark):
    """Batches and compactions read the runs in their order: no run is dealt or sorted again."""
    scratch = lines.Scratch(spark, "runs")
    runs, kept = lines.LineRuns(spark, scratch, fanout=2), {}
    for b in range(7):
        keys = [(i * 7919 % 503, i % 11, b * 1000 + i) for i in range(b * 40, b * 40 + 200)]
        for one, two, rid in keys:
            kept.setdefault((one, two), rid)
            kept[one, two] = min(kept[one, two], rid)
        runs.add(spark.createDataFrame(keys, "k1 long, k2 long, rid long"))
    assert len(runs.levels) > 1 and all(len(x) <= 2 for x in runs.levels)
    with runs._in_order():
        batch = spark.createDataFrame([(1, 2, 3)], "k1 long, k2 long, rid long").groupBy("k1", "k2").agg({"rid": "min"})
        plan = runs.unknown(batch)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == len(runs.runs()) and plan.count("Sort [") == 1 and plan.count("Exchange") == 1
        plan = runs.merged(*runs.runs()[:2])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Sort [" not in plan and "Exchange" not in plan
    assert {(r["k1"], r["k2"]): r["owner"] for r in runs.close().collect()} == kept


# --- packing

def test_packing(spark):
    from tokenizers import Tokenizer

    rows = hard()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = packing.pack(spark, clashing(frame(spark, rows)), length=64).collect()
    line = {}
    docs = defaultdict(list)
    for p in pieces:
        ids = [int.from_bytes(p["ids"][i : i + 4], "little") for i in range(0, len(p["ids"]), 4)]
        assert len(ids) == p["length"] <= 64 and p["offset"] + p["length"] <= 64
        for i, x in enumerate(ids):
            assert line.setdefault(p["sequence_id"] * 64 + p["offset"] + i, x) == x
        docs[p["doc_id"]].append((p["start"], p["doc_tokens"], ids))
    assert sorted(line) == list(range(len(line)))  # no gap, so only the last sequence is padded
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc_id, tuple(ids)] += 1
    assert len(line) == sum(n * len(k[1]) for k, n in expected.items())
    for (doc_id, ids), n in expected.items():
        if sum(k[0] == doc_id for k in expected) == n == 1:
            parts = sorted(docs[doc_id])
            assert [x for p in parts for x in p[2]] == list(ids) and all(p[1] == len(ids) for p in parts)


def test_sequences(spark):
    pieces = packing.pack(spark, frame(spark, documents(n=20)), length=512)
    found = packing.sequences(pieces, 512).collect()
    assert all(len(r["ids"]) == 512 for r in found)
    assert sum(r["n_tokens"] for r in found) == sum(r["length"] for r in pieces.collect())


# --- LM scoring

class Brute:
    """Katz's model by dictionaries; Good-Turing discounts written anew."""

    def __init__(self, docs, held, order):
        self.order, self.uni, self.after = order, Counter(), [defaultdict(Counter) for _ in range(order)]
        for d, ws in docs.items():
            if not held[d]:
                self.uni.update(ws)
                line = ["<s>"] * (order - 1) + ws
                for i in range(order - 1, len(line)):
                    for n in range(2, order + 1):
                        self.after[n - 1][tuple(line[i - n + 1 : i])][line[i]] += 1
        self.n = sum(self.uni.values())
        self.d = [self.discount(list(self.uni.values()))] + [self.discount([c for x in self.after[n - 1].values() for c in x.values()]) for n in range(2, order + 1)]
        self.unknown = sum(c * (1 - self.d[0][c]) for c in self.uni.values() if c <= 5) / self.n

    @staticmethod
    def discount(counts):
        """d[r] = (r*/r - (k+1) n[k+1] / n[1]) / (1 - (k+1) n[k+1] / n[1]), r* = (r+1) n[r+1] / n[r], k = 5; where that is no factor, half a count."""
        n = Counter(counts)
        out = {}
        for r in range(1, 6):
            top = 6 * n[6] / n[1] if n[1] else 1
            value = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if n[r] and top != 1 else -1
            if n[r] == 0 and top != 1:
                value = (0 - top) / (1 - top)
            out[r] = value if 0 < value < 1 else (r - 0.5) / r
        return out

    def p(self, h, w):
        if not h:
            return self.uni[w] * self.d[0].get(self.uni[w], 1) / self.n if self.uni[w] else self.unknown
        c, d = self.after[len(h)].get(h), self.d[len(h)]
        if not c:
            return self.p(h[1:], w)
        freed = sum(x * (1 - d[x]) for x in c.values() if x <= 5)
        norm, freed = (sum(c.values()), freed) if freed > 0 else (sum(c.values()) + 1, 1)
        if c[w]:
            return c[w] * d.get(c[w], 1) / norm
        return freed / norm / (1 - sum(self.p(h[1:], x) for x in c)) * self.p(h[1:], w)


@pytest.mark.parametrize(("order", "split"), [(2, 1 << 16), (3, 1 << 16), (3, 1), (4, 40)])
def test_katz(spark, order, split):
    rows = documents(5, 80)
    rows = [r if r[0] != 1003 else (1003, " ".join(words(r[1])[:400]), *r[2:]) for r in rows if r[0] != 1004]  # brute force is slow
    docs = {r[0]: [w.translate(LOWER) for w in words(r[1])] + ["</s>"] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    brute = Brute(docs, held, order)
    v = len(brute.uni)
    assert sum(brute.p((), w) for w in brute.uni) + brute.unknown == pytest.approx(1)
    for n in range(2, order + 1):
        for h in sorted(brute.after[n - 1], key=lambda x: -len(brute.after[n - 1][x]))[:3]:
            assert sum(brute.p(h, w) for w in [*brute.uni, "never seen"]) == pytest.approx(1)
    model = katz.KatzModel(spark, clashing(frame(spark, rows)), order=order, split=split)
    for r in model.scores().collect():
        ws = docs[r["doc_id"]]
        line = ["<s>"] * (order - 1) + ws
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(brute.uni[w] > 0 for w in ws), brute.n)
        assert r["base_score"] == pytest.approx(sum(math.log10((brute.uni[w] + 1) / (brute.n + v + 1)) for w in ws))
        assert r["score"] == pytest.approx(sum(math.log10(brute.p(tuple(line[i : i + order - 1]), w)) for i, w in enumerate(ws)))


def test_katz_counts_of_more_than_32_bits():
    import numpy as np

    big = 3 << 32
    x = np.array([0, 5, big, (1 << 62) + 1])
    assert katz.unpacked(katz.packed(x)).tolist() == x.tolist()
    words = np.array([1, 7], np.uint64)
    asks = [dict(block=b, p=0, a=words.tobytes(), b=katz.packed(np.array([big, 1 - b])), c=katz.flags(np.array([False, b == 1]))) for b in (0, 1)]
    found = katz._count_words(katz._rows("block long, p int, a binary, b binary, c binary", asks)).to_pylist()
    assert found[0]["tokens"] == 2 * big + 1 and katz.unpacked(found[1]["a"]).tolist() == [2 * big, 1]
    one = katz.packed(np.array([2]))
    asks = [dict(p=0, block=b, sure=0, ctx=katz.rising(np.array([9])), hot=katz.flags(np.array([False])), runs=one, words=katz.rising(np.array([4, big])), succ=katz.packed(np.array([0, 1])), cnt=katz.packed(np.array([big, 1])), held=katz.flags(np.array([False, False])), low=katz.packed(np.array([big, big])), once=katz.rising(np.array([9])), once_hot=katz.flags(np.array([False])), times=katz.packed(np.array([big]))) for b in (0, 1)]
    found = katz._count_grams(katz._rows(katz._ASK, asks), katz.Level(np.ones(6)), True, True).to_pylist()
    assert katz.unpacked(found[0]["d"]).tolist() == [2 * big, 2] and katz.unpacked(found[0]["c"]).tolist() == [4, big]
    assert found[0]["r2"] == 1 and found[0]["r1"] == 2 * big


def test_katz_asks_a_row_a_block_and_partition(spark):
    rows = documents(5, 200)
    made = {}
    for parts in (2, 4, 8):  # a task makes a block at least
        model = katz.KatzModel(spark, frame(spark, rows, parts), order=2)
        made[model.blocks.count()] = model.asks().count()
    assert all(n <= blocks * model.n_parts for blocks, n in made.items()) and len(made) == 3


def test_katz_answers_move_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = katz.KatzModel(spark, frame(spark, documents(5, 60)))
        for df in (model.asks(), model.scores()):  # blocks and answers meet where they lie
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
            assert df.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_katz_scores_leave_no_hashes_on_disk(spark):
    import random
    from pathlib import Path

    from graniteql.llm import scratch

    rng, shared = random.Random(3), Path(scratch.shared_folder(spark).removeprefix("file://"))
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(1000)), "en", "s", 1) for i in range(100)]
    there = set(shared.glob("katz-*"))
    scores = katz.score_documents(spark, frame(spark, rows))
    (made,) = set(shared.glob("katz-*")) - there
    used = sum(f.stat().st_size for f in made.rglob("*.parquet"))
    assert used < 16 * 100_000  # bytes a word; its hash in a block and one in the table of words are 16
    assert scores.count() == 100


def test_katz_hard(spark):
    rows = hard()
    found = katz.score_documents(spark, frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(math.isfinite(r["score"]) for r in found)
    for order in (1, 2, 3):
        alone = katz.score_documents(spark, frame(spark, [(5, "a b", "en", "s", 1)]), order=order).collect()
        assert len(alone) == 1 and math.isfinite(alone[0]["score"])
    unseen = katz.score_documents(spark, frame(spark, [(18, "a b a b", "en", "s", 1)])).collect()  # held out
    assert unseen[0]["train_tokens"] == 0 and unseen[0]["score"] == 0


# --- near duplicates

def test_near_duplicates(spark):
    import random

    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows, group = [], {}
    for i in range(40):
        ws = [r.choice(vocabulary) for _ in range(150)]
        for j in range(r.choice([1, 1, 2, 30])):
            copy = list(ws)
            for _ in range(2 if j else 0):
                copy[r.randrange(150)] = "changed"
            rows.append((len(rows), (" " if j % 2 else "\n").join(copy).title() if j % 3 == 2 else " ".join(copy), "en", "s", 1))
            group[len(rows) - 1] = i
    rows += [(10_000, None, "en", "s", 0), (10_001, "  ", "en", "s", 0), (10_002, "few words", "en", "s", 0), (10_003, "Few  words", "en", "s", 0)]
    group |= {10_000: "none", 10_001: "none", 10_002: "few", 10_003: "few"}
    least = {}
    for k, g in group.items():
        least[g] = min(k, least.get(g, k))
    found = minhash.near_duplicates(spark, clashing(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    for x in found:
        assert x["class_id"] == least[group[x["doc_id"]]]
        assert x["class_size"] == sum(g == group[x["doc_id"]] for g in group.values())
    kept = minhash.keep_representatives(spark, frame(spark, rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(least.values())


def test_near_duplicates_link_past_the_least(spark):
    """Texts that differ too much from the bucket's least are still linked with each other."""
    import random

    r = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    drift, rows = list(base), []
    for i in range(12):  # each step changes a little, the ends have little in common
        rows.append((i, " ".join(drift), "en", "s", 1))
        for _ in range(5):
            drift[r.randrange(400)] = f"n{i}{r.random()}"
    found = by_id(minhash.near_duplicates(spark, frame(spark, rows)))
    assert {x["class_id"] for x in found.values()} == {0}


def bags(texts, s):
    """Shingle weights of each text, their frequencies counted over all; and the signatures."""
    import numpy as np
    import pyarrow as pa

    from graniteql.llm.kernels import Text

    (_, _, text), = Text.of(pa.array(texts), 1 << 30)
    own, value, count = minhash.entries(text, s.words)
    shingles, frequency = np.unique(value, return_counts=True)
    assert len(value) < minhash._FREQUENT  # so all are counted
    idf = minhash.Idf(shingles, frequency, len(texts), 1, s.idf_floor)
    plain = dict(zip(shingles.tolist(), frequency.tolist(), strict=True))
    weight = [(1 + math.log(c)) * (s.idf_floor + (1 - s.idf_floor) * math.log(len(texts) / plain[v]) / math.log(len(texts))) for v, c in zip(value.tolist(), count.tolist(), strict=True)]
    assert weight == pytest.approx(minhash.weights(value, count, idf), rel=1e-5)
    cut = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
    sig = minhash.signatures(own, value, np.array(weight, np.float32), len(texts), s.bands * s.rows)
    return [dict(zip(value[i:j].tolist(), weight[i:j], strict=True)) for i, j in zip(cut, cut[1:], strict=False)], sig.reshape(len(texts), s.bands, s.rows)


def alike(x, y):
    low = sum(min(w, y[v]) for v, w in x.items() if v in y)
    return low / (sum(x.values()) + sum(y.values()) - low)


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates_in_a_large_bucket(spark, monkeypatch, blocks):
    """Pairs whose only common band is that of a bucket of over 512 open members, against brute force."""
    import random

    if blocks:  # many rounds, and many blocks of pivots and members in each
        monkeypatch.setattr(minhash, "_FIRST_PIVOTS", 16)
        monkeypatch.setattr(minhash, "_PIVOTS", 60)
        monkeypatch.setattr(minhash, "_MEMBERS", 200)
    r = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(base)]
    for i in range(500):  # pairs that are alike, all others aren't
        at = r.randrange(8, 68)
        near = base[:at] + [f"n{i}_{j}" for j in range(5)] + base[at + 5 :]
        texts += [" ".join(near), " ".join(near[:-1] + ["end"])]
    s = minhash.Settings(bands=1, rows=1)
    found, sig = bags(texts, s)
    expected = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if sig[i, 0, 0] == sig[j, 0, 0] and alike(found[i], found[j]) >= s.threshold])
    failed = sum(sig[i, 0, 0] == sig[0, 0, 0] and expected[i] != 0 for i in expected)
    assert failed > 512 and len(set(expected.values())) < len(texts) - 200
    out = minhash.near_duplicates(spark, frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)]), s).collect()
    assert {x["doc_id"]: x["class_id"] for x in out} == expected


def test_near_duplicates_against_all_pairs(spark):
    """All pairs' weighted Jaccard similarity: classes are the components of those at 0.8 or more, and of the pairs by
    themselves at 0.80-0.85, 0.85-0.9 and above nearly all are found (README has the figures)."""
    import random

    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    for i in range(300):  # pairs by themselves, of all degrees of likeness
        ws = [r.choice(vocabulary) for _ in range(r.choice([60, 120, 240]))]
        copy = list(ws)
        for _ in range(1 + int(len(ws) * r.random() * 0.03)):
            copy[r.randrange(len(copy))] = f"x{i}"
        texts += [" ".join(ws), " ".join(copy)]
    base = [r.choice(vocabulary) for _ in range(200)]
    for i in range(150):  # a group whose members are around 0.8 to each other, some above, some below
        ws = list(base)
        for _ in range(r.choice([1, 2, 4, 5])):
            ws[r.randrange(len(ws))] = f"g{i}"
        texts.append(" ".join(ws))
    s = minhash.Settings()
    found, _ = bags(texts, s)
    links, holders = [], defaultdict(list)
    for i, bag in enumerate(found):
        near = Counter(j for v in bag for j in holders[v])
        links += [(i, j, sim) for j in near if (sim := alike(bag, found[j])) >= s.threshold]
        for v in bag:
            holders[v].append(i)
    expected = classes(len(texts), [x[:2] for x in links])
    out = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(spark, frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])).collect()}
    assert all(expected[i] == expected[c] for i, c in out.items())  # nothing is linked that isn't alike
    assert {i: out[i] for i in range(600, len(texts))} == {i: expected[i] for i in range(600, len(texts))}
    for low, high, least in ((0.8, 0.85, 0.97), (0.85, 0.9, 1), (0.9, 1.01, 1)):
        alone = [(i, j) for i, j, sim in links if i < 600 and low <= sim < high]
        share = sum(out[i] == out[j] for i, j in alone) / len(alone)
        print(f"similarity {low}-{high}: {len(alone)} pairs, found {share:.4f}")
        assert len(alone) > 20 and share >= least


def test_frequent_shingles_are_counted_exactly(spark, monkeypatch):
    """Those that enough documents hold, whatever else falls into their slots."""
    import random

    monkeypatch.setattr(minhash, "_FREQUENT", 1 << 7)
    r = random.Random(2)
    texts = [" ".join(["one two three four five"] * (i % 3 == 0) + [f"w{r.randrange(900)}" for _ in range(30)] + ["six seven eight nine ten"] * (i % 10 == 0)) for i in range(400)]
    rows = frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)])
    table = minhash.idf(spark, rows, minhash.Settings(), minhash.Scratch(spark, "t"))
    held = Counter(x for t in texts for x in {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)})
    least = -(-sum(held.values()) // (1 << 7))
    frequent = sorted(c for c in held.values() if c >= least)
    assert 1 <= len(frequent) == len(table.shingles)
    share = [0.85 + 0.15 * math.log(400 / c) / math.log(400 / least) for c in frequent]
    assert sorted(table.weight.tolist(), reverse=True) == pytest.approx(share, rel=1e-5)


def test_weighted_samples_agree_as_often_as_texts():
    import numpy as np

    own = np.repeat([0, 1], 200)
    value = np.concatenate([np.arange(200), np.arange(50, 250)]).astype(np.uint64)
    weight = np.concatenate([np.linspace(0.5, 2, 200), np.linspace(0.8, 1.5, 200)]).astype(np.float32)
    from graniteql.llm.kernels import mix

    sig = minhash.signatures(own, mix(value), weight, 2, 2000)
    a, b = dict(zip(value[:200], weight[:200], strict=True)), dict(zip(value[200:], weight[200:], strict=True))
    exact_sim = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs((sig[0] == sig[1]).mean() - exact_sim) < 0.04


def test_near_duplicates_hard(spark):
    rows = hard()
    found = minhash.near_duplicates(spark, frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert len(minhash.keep_representatives(spark, frame(spark, rows)).collect()) == len({x["class_rid"] for x in found})


# --- empty tables

def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (quality.judge, quality.keep_good, exact.exact_dedup, exact.keep_one, mixing.mix_sources, mixing.mixed, packing.pack, lines.dedup_lines, substrings.drop_repeats, katz.score_documents, minhash.near_duplicates, minhash.keep_representatives):
        assert f(spark, none).collect() == [], f
