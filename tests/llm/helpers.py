"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, n_words long, score double, block string, kept string"
WORDS = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """rows of (doc_id, text) with columns whose names operators also give."""
    return spark.createDataFrame([(i, t, "en", -1, -1.0, "x", "y") for i, t in rows], SCHEMA)


def odd_rows(seed=1, n=60, alphabet=("ab", "ba", "a", "é", "x"), longest=80):
    """Random texts over few words, so that much repeats; and all awkward ones."""
    r = random.Random(seed)
    base = [" ".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n // 2)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n // 2, n):
        t = r.choice(base)
        a = r.randint(0, max(0, len(t) - 1))
        rows.append((i, r.choice([t, t[a:], t[:a] + " zz " + t[a:], t + "\n" + r.choice(base), t.upper()])))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a"), (1004, "word " * 5000), (1005, "word " * 5000), (-7, "ab ba " * 30), (None, "ab ba " * 30)]
    r.shuffle(rows)
    return rows


def words(text, lower=False):
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)


def least(i):
    return -(1 << 63) if i is None else i
