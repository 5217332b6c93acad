"""Language-model scores, decontamination and quality rules against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from obslake.llm import decontaminate as D
from obslake.llm import lm_score as L
from obslake.llm import quality_rules as Q

from .helpers import LOWER, docs, least, odd_rows, words


def key(i):
    return least(i)


def test_base_score_is_exact(spark):
    rows = odd_rows(6, n=60)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*words(t, lower=True), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in L.score(docs(spark, rows), block_bytes=2000).collect():
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and math.isfinite(r["score"]) and r["score"] <= 0
    assert L.score(docs(spark, [])).count() == 0


def test_filter_reads_back_levels():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    counts = r.integers(1, 200, 3000)
    size = 1 << 18  # over 10 bits an insertion, as the operator sizes it
    marks = np.zeros(size, bool)
    for j in range(1, 9):
        for at in L._bits(L._six(keys[L.level(counts) >= j]), j, size):
            marks[at] = True
    got = L.Filter(np.packbits(marks, bitorder="little"), size, 1).counts(keys)
    middle = (np.exp2(L.level(counts)) + np.exp2(L.level(counts) - 1.0) - 1) / 2
    assert (got >= middle).all() and (got == middle).mean() > 0.95  # errors are one-sided
    other = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    assert (L.Filter(np.packbits(marks, bitorder="little"), size, 1).counts(other) == 0).mean() > 0.9


def brute_hits(rows, items, window=13):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for k, t in items:
        w = split.findall((t or "").translate(LOWER))
        if w:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(k))
    sizes, out = {len(x) for x in windows}, []
    for i, t in rows:
        w = split.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    names |= windows[tuple(w[s : s + n])]
        out.append((key(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("shard_words", [200_000, 20])
def test_decontamination_matches_brute_force(spark, shard_words):
    base = " ".join(f"q{k}" for k in range(40))
    items = [(1, base), (2, " ".join(base.split()[10:30])), (3, "ab ba a"), (10, "ab, BA. a!"), (4, ""), (5, None), (6, "q5 q6 q5 q6 q5 q6"), (7, "lone")]
    rows = odd_rows(7, n=30) + [(200, "x " + base.upper() + " y"), (201, "q3 " * 9 + base), (202, " ".join(base.split()[:12])), (203, "z " * 400 + base), (204, "lone q5 q6 q5 q6 q5 q6 q5 q6")]
    out = D.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())
    assert got == brute_hits(rows, items)


def test_the_number_of_scans_does_not_depend_on_the_shards(spark, monkeypatch):
    """Every read of the documents counts its rows; window hashes in several parts give the same."""
    rows = odd_rows(7) + [(2000 + k, f"{'filler ' * 40} item{k} " + " ".join(f"w{k}x{j}" for j in range(15))) for k in range(30)]
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(15))) for k in range(30)] + [(99, "ab ba")], "item_id long, text string")
    results, scans = [], []
    for shard_words, windows in ((200_000, 1 << 24), (20, 1 << 24), (60, 1 << 24), (20, 40)):
        monkeypatch.setattr(D, "WINDOWS", windows)
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        base = docs(spark, rows)
        out = D.decontaminate(base.mapInArrow(counted, base.schema), items, shard_words=shard_words)
        results.append(sorted((str(r["doc_id"]), r["n_hit"], r["items"], r["cleaned"]) for r in out.collect()))
        scans.append(seen.value / len(rows))
    assert results[0] == results[1] == results[2] == results[3] and sum(r[1] for r in results[0]) > 400
    assert scans[0] == 1 and scans[1] == scans[2] <= 3


@pytest.mark.parametrize("shard_words", [200_000, 20])
def test_repeated_item_ids_are_one_item(spark, shard_words):
    """Two rows of one id in one shard, and dealt over many shards."""
    a, b = " ".join(f"q{k}" for k in range(30)), " ".join(f"r{k}" for k in range(30))
    items = [(5, a), (5, b), (5, a), (6, b), (7, " ".join(f"s{k}" for k in range(200)))]
    rows = [(1, f"x {a} y {b} z"), (2, a), (3, items[-1][1] + " t"), (4, None), (4, ""), (4, a)]
    out = D.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words)
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())
    assert got == brute_hits(rows, items)
    assert {r["doc_id"]: r["items"] for r in out.where("doc_id < 3").collect()} == {1: ["5", "6"], 2: ["5"]}


def test_no_process_holds_more_than_a_shard(spark):
    """Twenty times the items give twenty times the shards, none of them larger."""
    item = lambda i: (i, " ".join(f"w{i}_{k}" for k in range(50)))

    def sizes(n):
        table = D.shards_of(spark.createDataFrame([item(i) for i in range(n)], "item_id long, text string"), "item_id", "text", 13, 200)
        return [sum(len(r[k]) for k in D.Automaton.FLAT) for r in table.collect()]

    few, many = sizes(4), sizes(80)
    assert len(many) >= 10 * len(few) and max(many) <= 1.3 * 4 * max(few) / len(few)


def test_spans_are_taken_out(spark):
    item = " ".join(f"q{k}" for k in range(15))
    clean = " ".join(f"c{k}" for k in range(400))
    rows = [(1, f"é {clean},  {item}! {clean}"), (2, f"{item} a b"), (3, clean), (4, None)]
    cut = lambda **k: {r["doc_id"]: r["cleaned"] for r in D.decontaminate(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"), **k).collect()}
    assert cut() == {1: f"é {clean},  ! {clean}", 2: " a b", 3: clean, 4: None}
    assert cut(longest=15)[1] == rows[0][1] and cut(longest=15)[2] == " a b"


def test_decontamination_without_a_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    r = D.decontaminate(docs(spark, [(1, "a b")]), none).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["spans"], r["contaminated"]) == (2, 0, [], [], False)
    assert D.decontaminate(docs(spark, []), none).count() == 0


def brute_rules(rows):
    out = []
    for i, t in rows:
        t, w = t or "", words(t)
        lines = [x for x in t.split("\n") if words(x)]
        windows = Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
        repeated = {p for s in range(len(w) - 4) if windows[tuple(w[s : s + 5])] > 1 for p in range(s, s + 5)}
        chars, signs, dups = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        bad = 2 * chars < 3 * len(w) or chars > 25 * len(w) or signs > len(w) or (dups >= 3 and 2 * dups > len(lines)) or not any(c.isalpha() for c in t)
        out.append((key(i), len(w), chars, signs, dups, len(repeated), failed, not failed and not bad))
    return sorted(out)


def test_rules_match_brute_force(spark):
    rows = odd_rows(8, n=60, alphabet=tuple(f"w{k}" for k in range(40))) + [(300, "a#*$ " * 4 + "\n".join(f"l{k % 3}" for k in range(30))), (301, "x y z " * 20), (302, "12345 " * 4 + " ".join(map(str, range(20))))]
    got = Q.apply_rules(docs(spark, rows)).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == brute_rules(rows)
    assert Q.apply_rules(docs(spark, [])).count() == 0


def test_rule_order_changes_no_verdict(spark):
    frame, rules = docs(spark, odd_rows(9, n=40)), Q.default_rules()
    a, b = (Q.apply_rules(frame, r, ordered=True).select("doc_id", "kept") for r in (rules, rules[::-1]))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    plan = Q.apply_rules(frame, rules, ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("max_bytes", [256 << 20, 4096])
def test_score_holds_every_bigram(spark, max_bytes):
    """Bigrams seen once count, and no size of the filter takes an n-gram out of the model."""
    rows = odd_rows(6, n=60) + [(2000 + i, f"once{i} twice{i // 2} only{i}") for i in range(40)]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    tokens = [(i, [*words(t, lower=True), None]) for i, t in rows]
    one = Counter(w for i, ws in tokens if not held[i] for w in ws)
    two = Counter(p for i, ws in tokens if not held[i] for p in zip(ws, ws[1:]))
    n, v = sum(one.values()), len(one)

    def about(c):
        q = c.bit_length()
        return (2**q + 2 ** (q - 1) - 1) / 2 if c else 0

    def logs(ws):
        for k, w in enumerate(ws):
            p = (about(one[w]) + 0.1) / (n + 0.1 * (v + 1))
            if k:
                b = about(two[ws[k - 1], w])
                p = 0.7 * (b / max(about(one[ws[k - 1]]), b, 1)) + 0.3 * p
            yield math.log10(p)

    want = sorted((least(i), sum(logs(ws))) for i, ws in tokens)
    got = sorted((least(r["doc_id"]), r["score"]) for r in L.score(docs(spark, rows), block_bytes=2000, bits=96, max_bytes=max_bytes).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("copies", [1, 10])
def test_trigram_score_matches_brute_force(spark, copies):
    """The query's model, over counts of one level and ten blocks' worth of the same text."""
    rows = odd_rows(6, n=40)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    tokens = [(i, [*words(t, lower=True), None]) for i, t in rows]
    grams = [Counter(tuple(ws[a : a + k]) for i, ws in tokens if not held[i] for a in range(len(ws) - k + 1)) for k in (1, 2, 3)]
    n, v, d, spread = sum(grams[0].values()), len(grams[0]), 0.75, 0.8

    def about(g):
        q = grams[len(g) - 1][g].bit_length()
        return (2**q + 2 ** (q - 1) - 1) / 2 if q else 0

    def logs(ws):
        for at in range(len(ws)):
            p = (about((ws[at],)) + 0.1) / (n + 0.1 * (v + 1))
            for k in (2, 3):
                if at + 1 >= k:
                    c = about(tuple(ws[at - k + 1 : at + 1]))
                    u = max(c, about(tuple(ws[at - k + 1 : at])))
                    p = min(1, max(c - d, 0) / u + d * u ** (spread - 1) * p) if u else p
            yield math.log10(p)

    want = sorted((least(i), sum(logs(ws))) for i, ws in tokens)
    got = L.score(docs(spark, rows), block_bytes=20_000 // copies, bits=96, order=3, discount=d, max_bytes=(256 << 20) // 10 ** (copies // 2)).collect()
    got = sorted((least(r["doc_id"]), r["score"], r["lang"], r["n_words"]) for r in got)
    assert [(i, *x) for i, _, *x in got] == [(i, "en", -1) for i, _ in want]
    assert [s for _, s, *_ in got] == pytest.approx([s for _, s in want])


def brute_costly(rows):
    out = []
    for (i, t), (*_, kept) in zip(sorted(rows, key=lambda r: (key(r[0]), r[1] or "")), brute_rules_by_row(rows)):
        t, w = t or "", words(t)
        lines = [x for x in t.split("\n") if words(x)]
        top = max((c for c in Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4)).values() if c > 1), default=0)
        bad = (len(w) >= 50 and 100 * sum(x.lower() in Q.STOP_WORDS for x in w) < 2 * len(w)) or (len(w) >= 50 and len(set(w)) ** 2 < 4 * len(w)) or 50 * top > len(w)
        if len(lines) >= 3:
            bad |= 10 * sum(bool(re.match("[\x20\x09-\x0d]*[-*•‣◦·]", x)) for x in lines) > 9 * len(lines) or 10 * sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*\\Z", x)) for x in lines) > 3 * len(lines)
        out.append((key(i), kept and not bad))
    return sorted(out)


def brute_rules_by_row(rows):
    return [brute_rules([r])[0] for r in sorted(rows, key=lambda r: (key(r[0]), r[1] or ""))]


def test_costly_rules_match_brute_force(spark):
    r, pool = __import__("random").Random(5), [f"w{k}é" for k in range(90)]
    prose = lambda n, stop: " ".join(r.choice(Q.STOP_WORDS) if r.random() < stop else r.choice(pool) for _ in range(n))
    rows = odd_rows(8, n=40, alphabet=tuple(pool)) + [(300 + k, prose(80, k / 40)) for k in range(12)]
    rows += [(400, "\n".join("- " + prose(6, 0.2) for _ in range(9))), (401, "\n".join(prose(6, 0.2) + "... " for _ in range(9))), (402, "\n".join(("• " if k else "") + prose(9, 0.3) for k in range(9)))]
    rows += [(403, " ".join(("a b" if k % 3 else prose(2, 0.5)) for k in range(30))), (404, "aab " * 3 + "abba baba bbba aabb abab bbab baab aaab"), (405, prose(8000, 0.3)), (406, " ".join(r.choice(["the", "of", "x", "y", "z", "zz", "yy"]) for _ in range(70))), (407, prose(60, 0.3) + " one two three four five " + prose(60, 0.3) + " one two three four five " + prose(20, 0.4))]
    got = Q.apply_rules(docs(spark, rows), [*Q.default_rules(), *Q.costly_rules()], ordered=True).select("doc_id", "kept").collect()
    assert sorted((key(x["doc_id"]), x["kept"]) for x in got) == brute_costly(rows)


def test_rejected_rows_skip_the_rules_after(spark):
    """A rule that fails the job where it is evaluated: no row that the base rules or an earlier rule rejects reaches it."""
    from pyspark.sql import functions as F

    good = " ".join(f"word{k}" for k in range(40))
    rows = [(1, good), (2, "too short"), (3, "ab cd " * 30), (4, " ".join("x" * 60 + str(k) for k in range(20))), (5, None)]
    trap = lambda ids: Q.Rule("trap", F.when(F.col("doc_id").isin(ids), F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(False))
    rules = [Q.Rule("long_words", F.col(Q.C_) > 25 * F.col(Q.N_)), trap([2, 3, 4, 5])]
    got = {r["doc_id"]: (r["failed_rule"], r["kept"]) for r in Q.apply_rules(docs(spark, rows), rules, ordered=True).collect()}
    assert got == {1: (None, True), 2: ("base", False), 3: ("base", False), 4: ("long_words", False), 5: ("base", False)}
    with pytest.raises(Exception, match="evaluated"):
        Q.apply_rules(docs(spark, rows), rules[::-1], ordered=True).collect()


def test_rules_are_ordered_by_rejections_per_cost(spark):
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"word{k}x{j}" for j in range(40))) for k in range(60)]
    dear = Q.Rule("dear", F.size(F.array_distinct(F.split(F.repeat(F.col(Q.T_), F.lit(200)), ""))) < 0)
    cheap = Q.Rule("cheap", F.col(Q.T_).contains("word1x"))
    never = Q.Rule("never", F.lit(False))
    assert [r.name for r in Q.order_rules(docs(spark, rows), [dear, never, cheap])][0] == "cheap"
    assert Q.order_rules(docs(spark, []), [dear, cheap]) == [dear, cheap]
    plan = Q.apply_rules(docs(spark, rows), [*Q.default_rules(), *Q.costly_rules()], ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
