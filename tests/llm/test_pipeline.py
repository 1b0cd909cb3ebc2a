"""The pipeline over a small folder: every stage's decisions hold for what comes after it, and the whole in plain Python."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline

from graniteql.llm import exact, minhash, packing, quality

from .fixtures import SCHEMA, clashing, documents, frame, hard, words
from .test_documents import alike, bags, classes, measures, strip


def test_stages(spark, tmp_path):
    rows = documents(7, 120)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kinds, kept = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert kept[name].dtypes == kinds
            docs = kept[name]
    ids = {k: sorted(r["doc_id"] for r in df.collect()) for k, df in kept.items()}
    first = frame(spark, rows)
    assert ids["quality rules"] == sorted(r["doc_id"] for r in quality.judge(spark, first).collect() if r["kept"])
    assert ids["exact dedup"] == sorted(r["doc_id"] for r in exact.exact_dedup(spark, kept["quality rules"]).collect() if r["kept"])
    assert ids["near dedup"] == sorted(r["doc_id"] for r in minhash.near_duplicates(spark, kept["exact dedup"]).collect() if r["rid"] == r["class_rid"])
    assert set(ids["mix sources"]) <= set(ids["near dedup"])
    starts = [r["doc_id"] for r in kept["pack"].collect() if r["start"] == 0]
    assert sorted(starts) == ids["mix sources"]


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def good(rows):
    """Quality rules: documents that don't fail, of hosts whose shrunk failure rate is a half at most."""
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(measures(r[1])[5])
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = sum(rates) / len(rates)
    spread = mean * (1 - mean)
    between = max(sum((x - mean) ** 2 for x in rates) / len(rates) - spread * sum(1 / len(x) for x in hosts.values()) / len(hosts), spread * 1e-6)
    strength = spread / between - 1 if between > 0 else 1
    kept = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) <= 0.5}
    return [r for r in rows if not measures(r[1])[5] and r[3] in kept]


def one_of_each(rows):
    best = {}
    for r in rows:
        key = strip(r[1])
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    return sorted(best.values())


def unlike(rows):
    """The least of each class of texts linked by a weighted Jaccard similarity of 0.8 or more, over all pairs."""
    s = minhash.Settings()
    found, _ = bags([r[1] for r in rows], s)
    root = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(found[i], found[j]) >= s.threshold])
    return [r for i, r in enumerate(rows) if root[i] == i]


def mixed_copies(rows):
    """id -> copies, by the systematic sample along documents in order of size."""
    own = Counter()
    for r in rows:
        own[r[3]] += len(words(r[1]))
    sources = sorted(own, key=lambda x: (x is None, x))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sources)}
    target, free, rest = {}, set(sources), sum(own.values())
    while free:
        level = rest / sum(weight[x] for x in free)
        over = {x for x in free if 3 * own[x] < weight[x] * level}
        if not over:
            target |= {x: weight[x] * level for x in free}
            break
        target |= {x: 3 * own[x] for x in over}
        free, rest = free - over, rest - sum(3 * own[x] for x in over)
    out = {}
    for x in sources:
        step, at = int(target[x] / own[x] * (1 << 20)), int(hashlib.md5(f"mix|{x or ''}".encode()).hexdigest()[:5], 16)
        for r in sorted((r for r in rows if r[3] == x), key=lambda r: (len(words(r[1])), r[0])):
            out[r[0]] = ((at + step) >> 20) - (at >> 20)
            at += step
    return out


def test_run_in_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = documents(7, 90)
    # near copies: a few words changed, so that some pairs are alike and some aren't
    rows += [(2000 + i, r[1].replace("alpha", f"x{i}", 1 + i % 3), *r[2:]) for i, r in enumerate(rows[:40]) if r[1]]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept = unlike(one_of_each(good(rows)))
    copies = mixed_copies(kept)
    assert len(kept) < len(one_of_each(good(rows))) < len(good(rows)) < len(rows) and max(copies.values()) > 1
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2] for r in kept}
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    starts = Counter(p["doc_id"] for p in pieces if p["start"] == 0)
    assert starts == Counter({i: n for i, n in copies.items() if n})
    line = 0
    for p in pieces:
        assert p["sequence_id"] * 4096 + p["offset"] == line  # no gaps
        line += p["length"]
        own = [int.from_bytes(p["ids"][i : i + 4], "little") for i in range(0, len(p["ids"]), 4)]
        assert own == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert line == sum(copies[i] * len(x) for i, x in ids.items())


def test_stages_keep_all_columns(spark, tmp_path):
    """Columns named like those used inside, null and repeated ids: all but the last stage return the rows they take."""
    docs = clashing(frame(spark, hard()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        mine = Counter(tuple(r) for r in docs.collect())
        found = Counter(tuple(r) for r in out.collect())
        assert found and set(found) <= set(mine), name
        if name != "mix sources":
            assert all(n <= mine[r] for r, n in found.items()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(hard())
