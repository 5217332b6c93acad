"""The filter audit against a plain run of every order, potentials against Shapley values by definition."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from obslake.llm import filter_audit as A

from .helpers import words

LONG = " ".join(f"w{i}" for i in range(120))


def fails(text):
    t, w = text or "", words(text)
    return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}


def brute(rows, said):
    out = {}
    for part in {g or "" for _, _, g in rows}:
        for order in permutations("ABCDE"):
            docs = []
            for i, t, g in rows:
                f = fails(t)
                f["E"] = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
                if (g or "") == part:
                    docs.append((i, f))
            left = list(docs)
            for step, c in enumerate(order, 1):
                gone = [d for d in left if d[1][c]]
                left = [d for d in left if not d[1][c]]
                every = sum(d[1][c] for d in docs)
                only = sum(d[1][c] and sum(d[1].values()) == 1 for d in docs)
                lost = [sum((i, k) in said for i, _ in gone) for k in ("good", "toxic")]
                out[part, "".join(order), step] = [len(left), len(gone), every - len(gone), only, *lost]
    shapley = {}
    for (part, order, step), x in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + x[1]
    return {k: (*x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def test_against_a_plain_run(spark):
    rows = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (3, LONG, "en"), (None, LONG, "en"), (None, LONG, "en"), (4, None, "en"), (5, "", "de"), (6, " \n", "de"), (7, "a b " * 80, "en"),
        (8, LONG + " $", "de"), (9, LONG.upper(), "en"), (10, "SHORT $", ""), (11, "word " * 60_000, "de"), (12, LONG + " $", "fr"), (-5, LONG + " $", "fr"), (13, "x y|z", "fr"), (13, "x y|z", "fr"),
    ]
    labels = [(2, 1, 0), (3, 1, 1), (8, 0, 1), (9, None, 1), (9, 1, None), (12, 1, 0), (None, 1, 1), (99, 1, 1)]
    said = {(i, k) for i, g, t in labels if i is not None for k, v in (("good", g), ("toxic", t)) if v == 1}
    df = spark.createDataFrame([(i, t, g, 5, "x") for i, t, g in rows], "doc_id long, text string, lang string, quality int, part string").repartition(5)
    got = A.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got.collect()} == brute(rows, said)


def test_potentials_are_shapley_values(spark):
    counts = [(s, 1 + 7 * s % 11) for s in range(16)]
    df = spark.createDataFrame([("p", s, n, 0, 0) for s, n in counts], "part string, mask int, n long, good long, toxic long")
    got = A.games(df, 4).first()
    v = lambda s: sum(n for m, n in counts if m & s)
    for i in range(4):
        want = sum((v(sum(1 << j for j in o[: o.index(i) + 1])) - v(sum(1 << j for j in o[: o.index(i)])) for o in permutations(range(4))), Fraction(0))
        assert got["potential"][15] - got["potential"][15 ^ 1 << i] == want
    assert sum(got["potential"][15] - got["potential"][15 ^ 1 << i] for i in range(4)) == factorial(4) * v(15)


def test_an_empty_table_and_filters_of_ones_own(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a", "x"), (2, "bb", "x"), (3, "a", "x")], docs.schema)
    got = A.audit(some, labels, {"S": F.char_length("text") < 2, "L": F.col("n_words") > 1}, duplicates=None)
    assert sorted((r["filter_order"], r["step"], r["removed"], r["shapley"]) for r in got.collect()) == [("LS", 1, 0, 0), ("LS", 2, 2, 4), ("SL", 1, 2, 4), ("SL", 2, 0, 0)]
    with pytest.raises(ValueError):
        A.audit(some, labels, {"E": F.lit(True)})
