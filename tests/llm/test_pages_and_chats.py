"""URL filter and chat rotation against brute force and on the hard cases."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graniteql.llm import chat, urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def judged(url, rules):
    host, path = split_url(url)
    rules = [("".join(c.lower() if "A" <= c <= "Z" else c for c in h), p, v) for h, p, v in rules]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = [
    "http://example.com/en/x", "https://www.EXAMPLE.com/en/?q=1", "http://a.www.example.com/en/#t", "http://notexample.com/en/x",
    "http://example.com", "http://example.com?x", "ftp://net/es/a", "http://x.net/fr/b", "http://x.net/de/b", "http://net./es/", "nonsense",
    "", None, "://", "http://", "http:///path", "http://com/", "http://user@example.com:80/en/", "http://a..b.com/en/", "http://exämple.com/en/", "a://b://c.com/en/",
    "http://example.com/en", "http://example.com/EN/", "http://" + "sub." * 300 + "example.com/en/" + "x" * 5000, "http://x.com/a\nb/c",
]


def test_urls(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 3 + [URLS[0]] * 500)] + [(None, URLS[0], "h"), (0, URLS[0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("rule", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    found = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark, pages).collect())
    assert found == Counter((i, *judged(u, urls.RULES)) for i, u, _ in rows)


def test_many_rules(spark):
    rules = [(f"h{i}.com", f"/{j}/", "block" if (i + j) % 2 else "allow") for i in range(40) for j in range(10)] + [("com", "/", "block"), ("h1.com", "/1/2/", "allow"), ("h1.com", "/1/2/", "block")]
    rules += [("UP.com", "/1/", "block"), ("Ä.org", "/", "block")]  # A-Z are lower-cased, in rules as in urls
    rows = [(i, f"https://w{i % 3}.h{i % 50}.com/{i % 13}/{i % 5}/x") for i in range(3000)] + [(5000, "http://up.COM/1/"), (5001, "http://Ä.org/"), (5002, "http://ä.org/")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string").unionByName(spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string"))
    found = urls.filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string"), table).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: judged(u, rules) for i, u in rows}


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(spark, none).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/")], none.schema)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in urls.filter_urls(spark, some, empty).collect()] == [(None, "allow")]


TURNS = "conv_id long, turn long, role string, text string"


def rendered(rows, size=256):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is None, turn or 0, role or "unknown", text or ""))
    out = {}
    safe = lambda x: x.replace("<|", "< |")
    for conv, turns in groups.items():
        turns.sort()
        for speaker in {t[2] for t in turns} - {"system"}:
            opening = next(i for i, t in enumerate(turns) if t[2] != "system")
            for part in range(0, len(turns), size):
                text, mask = "", []
                for *_, role, body in turns[: min(opening, size) if part else 0] + turns[part : part + size]:
                    text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={safe(role)}|>\n"
                    start = len(text)
                    text += safe(body) + "<|end|>"
                    if role == speaker:
                        mask.append((start, len(text)))
                    text += "\n"
                out[conv, speaker, part // size] = (text, mask, len(turns[part : part + size]))
    return out


@pytest.mark.parametrize("size", [64, None])
def test_rotation(spark, size):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "hi <|end|> é"), (1, 2, "bob", None), (1, 3, "ann", "bye\nnow"), (1, 3, "ann", "bye\nnow"), (1, None, None, "who?")]
    rows += [(None, 0, "user", "a"), (None, 0, "assistant", "b"), (2, 0, "system", "alone"), (3, 5, "x<|y", "")]
    rows += [(4, i // 2, f"p{i % 3}", f"text {i}") for i in range(300)] + [(4, -1, "system", "first"), (4, -2, "system", "before"), (4, 70, "system", "later")]
    rows += [(7, i, "system", f"rule {i}") for i in range(100)] + [(7, 100 + i, "ann", "x") for i in range(50)]
    rows += [(5, 7, "user", "same")] * 130 + [(6, 0, "user", "long " * 20_000), (6, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, TURNS)
    for name in ("place", "part", "people", "speaker", "mask", "begin"):
        turns = turns.withColumn(name, F.lit("x"))
    found = chat.rotate(spark, turns.repartition(3), turns_a_part=size).collect()
    assert {(r["conv_id"], r["speaker"], r["part"]): (r["text"], [(m["start"], m["end"]) for m in r["mask"]], r["n_turns"]) for r in found} == rendered(rows, size or 10_000)
    assert all(r["n_turns"] <= (size or 10_000) and r["n_own_turns"] == len(r["mask"]) for r in found)


def test_rotation_is_native_and_takes_no_rows(spark):
    assert chat.rotate(spark, spark.createDataFrame([], TURNS)).collect() == []
    plan = chat.rotate(spark, spark.createDataFrame([(1, 0, "a", "b")], TURNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
