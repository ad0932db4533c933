"""Awkward inputs shared by the operator tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.01"

LONG = "\n".join(" ".join(f"word{(i * 7919 + j * 104729) % 9973}" for j in range(12)) for i in range(2500))

# nulls in every column, empty, blank and very long texts, ties, repeated rows
ROWS = [
    (1, "alpha beta gamma delta. Epsilon zeta eta theta\niota kappa", "en", "s1", 50),
    (1, "alpha beta gamma delta. Epsilon zeta eta theta\niota kappa", "en", "s1", 50),
    (2, "ALPHA beta gamma delta. epsilon zeta eta theta\niota kappa", "en", "s2", 50),
    (3, None, None, None, None),
    (4, "", "en", "s1", 0),
    (5, " \t\n\x0b\x0c\r ", "en", None, 7),
    (6, "one", "fr", "s2", 3),
    (7, "one two", "fr", "s2", 7),
    (8, LONG, "en", "s1", len(LONG)),
    (9, LONG + " tail", "en", "s1", None),
    (None, "alpha beta gamma delta. Epsilon zeta eta theta\niota kappa", "en", "s3", 50),
    (None, "no id and nothing like it", None, "s3", 25),
    (10, "naïve café 東京 \U0001f600 <|endoftext|> x y", "es", "é", 30),
]
# extra columns whose names clash with those that the operators use inside
EXTRA = ["size", "block", "label", "cid", "id", "u", "v", "score", "bucket", "place", "copy", "stats", "kept", "n"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd(spark, rows=None, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in EXTRA}) if extra else df


def words(text, k):
    import re

    up = {i: i + 32 for i in range(65, 91)}
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(up))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def labels_for(spark, rows, names="doc_id bigint, quality int, toxic int"):
    return spark.createDataFrame(rows, names)


def auc(score, label):
    import numpy as np

    score, label = np.asarray(score, float), np.asarray(label)
    pos, neg = score[label == 1], score[label == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
