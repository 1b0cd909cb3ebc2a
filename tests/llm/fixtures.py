"""Small tables with every hard case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def documents(seed=1, n=60):
    """Rows (doc_id, text, lang, source, n_chars) that share passages, lines and copies."""
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta.", "eta", "Theta", "iota", "kappa", "λ", "mu"] + [f"w{i}" for i in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(55))
    line = "All rights reserved by the owner."
    rows, texts = [], []
    for i in range(n):
        body = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 12, 40, 90]))) for _ in range(r.randint(1, 4))]
        if i % 5 == 0:
            body.insert(1, passage)
        if i % 4 == 0:
            body.append(f"  {line.upper() if i % 8 else line}\t")
        text = "\n".join(body)
        if i % 7 == 3 and texts:
            text = r.choice(texts)
        if i % 11 == 5 and texts:
            text = r.choice(texts) + " \n"
        texts.append(text)
        rows.append((i * 3, text, "en", f"src{i % 4}", len(text)))
    long = " ".join(f"{r.choice(vocabulary)}{r.randint(0, 30)}" for _ in range(30_000))
    rows += [
        (1000, None, None, "src1", None),
        (1001, "", "en", None, 0),
        (1002, " \t\n\r\x0b\x0c ", "en", None, 7),
        (1003, long, "en", "src0", len(long)),
        (1004, long, "en", "src0", len(long)),
        (1005, "a b c d " * 30, "xx", "src2", None),
        (1006, "<|endoftext|> \x01 'S \x01'll x\x01y İÅ", "xx", "srć", None),
        (1007, "\n\n\n", "en", "", 3),
        (1008, "one two three", "en", "src3", 13),
        (1009, "ONE two three", "en", "src3", 13),
    ]
    return rows


def hard(seed=1):
    """``documents`` with a null id, repeated ids and repeated rows."""
    rows = documents(seed, 20)
    return rows + [(None, rows[2][1], None, None, None), (None, None, None, None, None), rows[0], rows[0], (rows[1][0], "another text under the same number", "en", "src1", 1)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def clashing(df):
    """The same rows with extra columns of the names used inside."""
    from pyspark.sql import functions as F

    for name in ("rid", "key", "part", "at", "n", "digest", "size", "place", "rank", "k1", "owner", "n_words", "kept", "host", "sig", "class_id", "others", "_part", "ids", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df
