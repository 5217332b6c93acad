"""What each filter of a chain removes in every order of the chain, and what it is worth over all orders.

A document fails a set of filters, a mask of bits; failing doesn't depend on the order. So everything follows from the
number of documents of each mask: a coalition of filters removes the documents whose mask meets it. The removal game
of a part has one value for each of the 2^k coalitions, and the audit is read off these values:

* a step of an order adds its filter to the coalition of those before it, and removes the difference of the values;
* Hart-Mas-Colell potentials, found from small coalitions to large ones by
  |S| P(S) = v(S) + the sum of P(S without i) over i in S, give the Shapley value of i as P(all) - P(all without i).
  Potentials are kept times k!, which makes them whole numbers: that is the sum of what i removes over all orders.

One filter may be `duplicates`: a document whose text is that of a document with a smaller id, in any part. Texts are told
apart by SHA-256. Documents are added up by (text, part) before any of this meets, so that a group of copies
costs a row a task; the second sum, over the parts that share a text, has a row for each part.

Edge cases: a null text is the empty text; a null part is the empty string; a null id is never smaller than another
and never a duplicate; rows of one id and text are each counted and no duplicates of each other; a document without labels is
neither good nor toxic, one with several rows of labels is what any of them says; extra columns are ignored; very long texts
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_FILTERS = 6
COUNTS = ("n", "good", "toxic")


def default_filters() -> dict[str, Column]:
    """Failure conditions over `text`, `words` and `n_words`, by letter."""
    kinds, caps = F.size(F.array_distinct("words")).cast("long"), F.char_length("text") - F.char_length(F.translate("text", UPPER, ""))
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * kinds < 80 * F.col("n_words"),
        "C": 100 * caps.cast("long") > 10 * F.char_length("text").cast("long"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """rows with good and toxic, 0 or 1. Rows without an id, which may be many, stay out of the join."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where("id IS NOT NULL").join(said, "id", "left")
    zero = F.lit(0)
    return known.select("id", "part", "mask", "digest", *[F.coalesce(c, zero).cast("long").alias(c) for c in COUNTS[1:]]).unionByName(
        rows.where("id IS NULL").select("id", "part", "mask", "digest", *[zero.cast("long").alias(c) for c in COUNTS[1:]])
    )


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str | None, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each set of failed filters; bit i is the i-th letter, `duplicates` the last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != "")).withColumn("n_words", F.size("words").cast("long"))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    rows = _labelled(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), labels, id_col)
    if duplicates is None:
        return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    ids = rows.groupBy("digest", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *COUNTS)))  # the rows of the least id
    unknown = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in COUNTS]
    parts = ids.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS], first.alias("first"), *unknown)
    texts = parts.groupBy("digest").agg(F.min("first.id").alias("least"), F.collect_list(F.struct("part", "mask", *COUNTS, "first", *[f"null_{c}" for c in COUNTS])).alias("p"))
    one = texts.select("least", F.explode("p").alias("p"))
    leads = F.coalesce(F.col("p.first.id") == F.col("least"), F.lit(False))
    passing = {c: F.col(f"p.null_{c}") + F.when(leads, F.col(f"p.first.{c}")).otherwise(0) for c in COUNTS}
    bit = 1 << len(filters)
    both = F.array(
        F.struct(F.col("p.mask").alias("mask"), *[passing[c].alias(c) for c in COUNTS]),
        F.struct((F.col("p.mask") + bit).alias("mask"), *[(F.col(f"p.{c}") - passing[c]).alias(c) for c in COUNTS]),
    )
    return one.select(F.col("p.part").alias("part"), F.explode(both).alias("x")).where("x.n > 0").groupBy("part", "x.mask").agg(*[F.sum(f"x.{c}").alias(c) for c in COUNTS])


def games(masks: DataFrame, k: int) -> DataFrame:
    """A row a part: its documents, the removal values v_n, v_good, v_toxic of all coalitions (arrays by mask), failures of one filter only, and potentials times k!."""
    every = range(1 << k)
    value = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in every]).alias(f"v_{c}")
    only = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]).alias("only")
    out = masks.groupBy("part").agg(F.sum("n").alias("documents"), *[value(c) for c in COUNTS], only)
    out = out.withColumn("q0", F.lit(0).cast("long"))
    for size in range(1, k + 1):  # one projection a size: each potential is computed once
        smaller = lambda s: " + ".join(f"q{s ^ 1 << i}" for i in range(k) if s >> i & 1)
        potential = lambda s: F.expr(f"({math.factorial(k)} * v_n[{s}] + {smaller(s)}) div {size}").alias(f"q{s}")
        out = out.select("*", *[potential(s) for s in every if s.bit_count() == size])
    return out.select("part", "documents", *[f"v_{c}" for c in COUNTS], "only", F.array(*[f"q{s}" for s in every]).alias("potential"))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicates: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley (summed over all orders)."""
    filters = default_filters() if filters is None else filters
    letters = "".join(filters) + (duplicates or "")
    k = len(letters)
    if not 0 < k <= MOST_FILTERS or len(set(letters)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} filters, each with a letter of its own")
    game = games(mask_counts(docs, labels, filters, duplicates, id_col, text_col, part_col), k)
    bit = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    number = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(i))])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    steps = game.withColumn("filter_order", orders).withColumn("letters", F.split("filter_order", "")).select("*", F.posexplode("letters").alias("at", "letter"))
    steps = steps.withColumns({"index": number[F.col("letter")], "bit": bit[F.col("letter")], "before": F.aggregate(F.slice("letters", F.lit(1), F.col("at")), F.lit(0), lambda a, c: a + bit[c])})
    v = lambda c, s: F.get(F.col(f"v_{c}"), s)
    bits, before = F.col("bit"), F.col("before")
    step = {c: v(c, before + bits) - v(c, before) for c in COUNTS}
    whole = (1 << k) - 1
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), (F.col("documents") - v("n", before + bits)).alias("kept"), step["n"].alias("removed"), (v("n", bits) - step["n"]).alias("redundant"),
        F.get("only", F.col("index")).alias("unique_fails"), step["good"].alias("good_lost"), step["toxic"].alias("toxic_lost"),
        (F.get("potential", F.lit(whole)) - F.get("potential", F.lit(whole) - bits)).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the five filters over each language, in all 120 orders."""
    from .common import table

    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > least, false)::INT AS mask,
      (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1))::INT AS good, (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1))::INT AS toxic FROM d JOIN e USING (t)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS b FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
s AS (SELECT filter_order, step, b[step] AS f, coalesce(list_sum(b[1:step-1]), 0)::INT AS before FROM o, range(1, 6) k(step)),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER ((mask & (before | f)) = 0) AS kept, sum(n) FILTER ((mask & before) = 0 AND (mask & f) <> 0) AS removed, sum(n) FILTER ((mask & before) <> 0 AND (mask & f) <> 0) AS redundant,
             sum(n) FILTER (mask = f) AS unique_fails, sum(good) FILTER ((mask & before) = 0 AND (mask & f) <> 0) AS good_lost, sum(toxic) FILTER ((mask & before) = 0 AND (mask & f) <> 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r
"""
