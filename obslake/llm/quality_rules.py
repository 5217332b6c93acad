"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Words are runs without ASCII white space.  A rule rejects a document; the base
rules come first, the others in an order found on a sample of the whole table: each
rule's cost (time to evaluate it, with all that only it needs, over the sample's
documents that pass the base rules, less that of a scan) and selectivity (share it
rejects of them) give its rejections per cost, and the cascade tries the highest first.
The rules are nested in one CASE, and what a rule measures stands inside its own
branch: a document that a rule rejects computes nothing for those after it.  The
order changes the cost and which rule is named first, never the verdict.

Edge cases: null or blank text has no words, all measures 0, and fails the base
rules; ties in rejections per cost keep the rules' given order; very long texts are
measured whole; repeated rows are each judged, alike; extra columns pass through; a
result column replaces an input column of its name; an empty sample keeps the given
order; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: what is kept between the steps, under names of our own
T_, W_, N_, C_, S_, L_, D_, R_, LS_, Z_ = "__ob_text", "__ob_words", "__ob_n", "__ob_chars", "__ob_signs", "__ob_lines", "__ob_dups", "__ob_repeats", "__ob_ls", "__ob_z"


#: fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to in is that it for was with as on be at by "
    "der die das und ist nicht ein zu den von mit im "
    "le la les de des et en un une est que pour "
    "el los las y por con una no es"
).split()
BULLET = r"^[\x20\x09-\x0D]*[-*•‣◦·]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over the base measures (n_words, word_chars, n_symbols, n_dup_lines, n_lines), the text, its words and its lines."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Mild rules: they go for pages of symbols, of repeated lines, of one endless word or of single letters."""
    n, chars = F.col(N_), F.col(C_)
    return [
        Rule("short_words", 2 * chars < 3 * n),
        Rule("long_words", chars > 25 * n),
        Rule("symbols", F.col(S_) > n),
        Rule("dup_lines", (F.col(D_) >= 3) & (2 * F.col(D_) > F.col(L_))),
        Rule("no_letters", ~F.col(T_).rlike(r"\p{L}")),
    ]


def top_window() -> Column:
    """How often the most frequent 5-word window occurs, 0 where none occurs twice."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state, window):
        run = F.when(state["last"] == window["x"], state["run"] + 1).otherwise(F.lit(1))
        return F.struct(window["x"].alias("last"), run.alias("run"), F.greatest(run, state["best"]).alias("best"))

    return F.when(F.col(Z_).isNull(), F.lit(0)).otherwise(F.aggregate(F.col(Z_), start, step, lambda state: state["best"]))


def costly_rules() -> list[Rule]:
    """Rules that measure something of their own: hardly any function words, few kinds of words for the length, one window again and again, lists of bullets, lines that trail off."""
    n, lines = F.col(N_), F.col(L_)
    those = lambda pattern: F.size(F.filter(F.col(LS_), lambda x: x.rlike(pattern)))
    kinds = F.size(F.array_distinct(F.col(W_))).cast("long")
    stops = F.size(F.filter(F.col(W_), lambda w: F.lower(w).isin(STOP_WORDS)))
    return [
        Rule("stop_words", (n >= 50) & (100 * stops < 2 * n)),
        Rule("kinds", (n >= 50) & (kinds * kinds < 4 * n)),
        Rule("top_window", 50 * top_window() > n),
        Rule("bullets", (lines >= 3) & (10 * those(BULLET) > 9 * lines)),
        Rule("ellipsis", (lines >= 3) & (10 * those(ELLIPSIS) > 3 * lines)),
    ]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _hashes(words: Column, n: Column) -> Column:
    """64-bit hashes of the 5-word windows."""
    at = lambda i, k: F.element_at(words, (i + k).cast("int"))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))
    return F.when(n >= 5, hashes).otherwise(F.array().cast("array<bigint>"))


def measured(df: DataFrame, text_col: str) -> DataFrame:
    """df with the measures under their inner names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(T_, text).withColumn(W_, _words(F.col(T_)))
    out = out.withColumn(N_, F.size(W_).cast("long"))
    lines = F.filter(F.split(F.col(T_), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(LS_, lines)
    out = out.withColumns({
        C_: (F.char_length(T_) - F.char_length(F.regexp_replace(T_, r"[^\x20\x09-\x0D]+", ""))).cast("long"),
        S_: F.char_length(F.regexp_replace(T_, r"[^#*$%&|<>]+", "")).cast("long"),
        L_: F.size(LS_).cast("long"), D_: (F.size(LS_) - F.size(F.array_distinct(LS_))).cast("long"),
    })
    return out


def with_repeats(df: DataFrame) -> DataFrame:
    """df with the number of words inside 5-word windows that occur twice or more in the text."""
    h, s, z, p = "__ob_h", "__ob_s", Z_, "__ob_p"
    out = df.withColumn(h, _hashes(F.col(W_), F.col(N_))).withColumn(s, F.sort_array(h))
    some = F.expr(f"exists(transform({s}, (x, i) -> i > 0 AND x = {s}[i - 1]), b -> b)")
    # hashes with their places, sorted: a repeated window stands next to its like
    out = out.withColumn(z, F.when(some, F.expr(f"sort_array(transform({h}, (x, i) -> named_struct('x', x, 'i', i)))")))
    alike = f"(i > 0 AND {z}[i - 1].x = e.x) OR (i < size({z}) - 1 AND {z}[i + 1].x = e.x)"
    out = out.withColumn(p, F.when(F.col(z).isNotNull(), F.expr(f"sort_array(transform(filter({z}, (e, i) -> {alike}), e -> e.i))")).otherwise(F.array().cast("array<int>")))
    covered = F.expr(f"aggregate({p}, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(a.end, i), 'end', i + 5), a -> a.n)")
    return out.withColumn(R_, covered.cast("long"))


def _base(min_words: int, max_repeated: int) -> Column:
    return (F.col(N_) < min_words) | (100 * F.col(R_) > max_repeated * F.col(N_))


def order_rules(df: DataFrame, rules: list[Rule], text_col: str = "text", rows: int = 2_000, min_words: int = 10, max_repeated: int = 20) -> list[Rule]:
    """The rules by rejections per cost over about `rows` rows, drawn from the whole table: each row has the same chance."""
    every = df.count()
    cached = with_repeats(measured(df.sample(min(1.0, rows / max(every, 1)), seed=11).select(text_col), text_col)).cache()
    drawn = cached.where(~_base(min_words, max_repeated))  # over the cached columns, which it would else repeat
    try:
        n = drawn.count()
        if not n:
            return list(rules)

        def run(condition):
            began = time.perf_counter()
            got = drawn.agg(F.count(F.when(condition, 1))).first()[0]
            return got, time.perf_counter() - began

        def timed(condition):  # the first run compiles, the second counts
            got = [run(condition) for _ in range(2)]
            return got[1]

        scan = timed(F.lit(False))[1]
        gain = {}
        for rule in rules:
            rejected, took = timed(rule.rejects)
            gain[rule.name] = rejected / n / max(took - scan, 1e-3)
        return sorted(rules, key=lambda r: -gain[r.name])
    finally:
        cached.unpersist()


def apply_rules(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", ordered: bool = False, min_words: int = 10, max_repeated: int = 20) -> DataFrame:
    """df with the measures, base_failed, kept, and failed_rule (null where kept)."""
    rules = default_rules() if rules is None else rules
    if not ordered:
        rules = order_rules(df, rules, text_col, min_words=min_words, max_repeated=max_repeated)
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"}
    mine = [c for c in df.columns if c not in results]
    out = with_repeats(measured(df, text_col))
    base = _base(min_words, max_repeated)
    cascade = F.when(base, "base")
    for rule in rules:
        cascade = cascade.when(rule.rejects, rule.name)
    return out.select(
        *mine, F.col(N_).alias("n_words"), F.col(C_).alias("word_chars"), F.col(S_).alias("n_symbols"), F.col(D_).alias("n_dup_lines"), F.col(R_).alias("n_repeat_words"), base.alias("base_failed"), cascade.alias("failed_rule"),
    ).withColumn("kept", F.col("failed_rule").isNull())


def query(spark, sf_dir: str) -> DataFrame:
    """op8: per document the base measures and the verdict."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, [*default_rules(), *costly_rules()]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT * FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup, count(*) FILTER (regexp_matches(x, '@BULLET')) AS n_bullets, count(*) FILTER (regexp_matches(x, '@ELLIPSIS')) AS n_ellipses FROM x GROUP BY doc_id),
p AS (SELECT doc_id, s, array_to_string(w[s:s+4], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS s FROM d WHERE len(w) >= 5)),
q AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i) AS n_rep FROM (SELECT doc_id, unnest(generate_series(s, s + 4)) AS i FROM q WHERE c > 1) GROUP BY doc_id),
g AS (SELECT doc_id, max(c) AS top FROM q WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN (@STOPS))) AS n_stops, coalesce(top, 0) AS top, len(list_distinct(w))::BIGINT AS kinds
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN g USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * word_chars < 3 * n_words OR word_chars > 25 * n_words OR n_symbols > n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR NOT regexp_matches(t, '\p{L}')
            OR (n_words >= 50 AND 100 * n_stops < 2 * n_words) OR (n_words >= 50 AND kinds * kinds < 4 * n_words) OR 50 * top > n_words OR (n_lines >= 3 AND 10 * n_bullets > 9 * n_lines) OR (n_lines >= 3 AND 10 * n_ellipses > 3 * n_lines)) AS kept
FROM b
"""
).replace("@STOPS", _STOPS).replace("@BULLET", BULLET).replace("@ELLIPSIS", ELLIPSIS)
