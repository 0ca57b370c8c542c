"""Inputs and brute-force versions shared by the operator tests."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# extra columns whose names clash with those that the operators use inside
CLASH = "fp long, component_id string, root long, h string, spans string, doc string, n_removed string, score string"


def words(text):
    return WORD.findall(text or "")


def with_clashes(df):
    from pyspark.sql import functions as F
    for c in CLASH.split(", "):
        name, kind = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def prose(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


EDGE_ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "one two three"), (None, "one two three"),
             (None, None), (6, "x " * 3000), (7, "Äé ß \U0001f600 　 tail"), (8, "a\u0000b  c\x1cd\x85e")]
