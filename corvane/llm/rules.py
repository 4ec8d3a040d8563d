"""Operator 3: quality rules as weak supervision, with DataFrame functions only.

Rules look at statistics of the whole text and vote good, bad or abstain. Expectation-maximisation estimates
how often each rule is right about good and about bad documents, from the counts of vote patterns over all
documents; a document's posterior probability of being good then takes the place of "must pass every rule".
The patterns number at most 3^rules, so the fit's input is bounded whatever the corpus; documents are never shuffled.

A word is ``[^\\x20\\x09-\\x0D]+``. Repeated three-word windows are found by sorting hashes that carry their
position in the low bits; neighbours with equal hashes are compared word by word, so a collision can't count.

Defined results: null text has no words and fails the base rules, as do empty texts; rules abstain where their
ratio has no denominator; repeated rows are judged alike; an empty table gives an empty result (the fit then
returns its prior); added columns replace columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut, table

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"
#: name, ratio as SQL, a good vote's condition, a bad vote's; x stands for the ratio.
RULES = (
    ("symbols", "n_symbols / nullif(n_words, 0)", "x < 0.03", "x > 0.1"),
    ("letters", "n_alnum / nullif(word_chars, 0)", "x > 0.92", "x < 0.89"),
    ("bare_words", "n_bare / nullif(n_words, 0)", "x < 0.02", "x > 0.1"),
    ("repeats", "n_repeat_words / nullif(n_words, 0)", "x < 0.2", "x > 0.4"),
    ("variety", "n_distinct / nullif(n_words, 0)", "x > 0.35", "x < 0.15"),
    ("line_copies", "n_dup_lines / nullif(n_lines, 0)", "x < 0.05", "x > 0.3"),
    ("capitals", "n_upper / nullif(n_letters, 0)", "x < 0.1", "x > 0.3"),
    ("bangs", "n_bangs / nullif(n_words, 0)", "x < 0.02", "x > 0.2"),
    ("word_length", "word_chars / nullif(n_words, 0)", "x BETWEEN 3 AND 10", "x < 2.5 OR x > 12"),
    ("length", "n_words / 1", "x >= 100", "x < 50"),
)
KEEP = 0.5
ROUNDS = 40
#: Prior of good, and how often a vote is good about good and about bad documents, before any round. A bad vote starts out as strong evidence, a good one as weak: each kind of junk is seen by few rules.
START = (0.8, 0.97, 0.7)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_distinct", "n_bare", "n_alnum")


def _without(pattern: str) -> str:
    return f"CAST(length(regexp_replace(__t, '{pattern}', '')) AS BIGINT)"


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics the rules look at."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in STATS]
    esc = lambda p: p.replace("\\", "\\\\")
    rows = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.select("*", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"), F.expr(f"filter(split(__t, '\\n'), x -> x rlike '{esc(WORD)}')").alias("__l"))
    rows = rows.select("*", F.size("__w").alias("__n"), F.expr("length(bin(size(__w)))").alias("__b"))
    # hash of each window above its position; __b bits hold any position
    rows = rows.withColumn("__s", F.expr("if(__n >= 3, sort_array(transform(sequence(0, __n - 3), i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | CAST(i AS BIGINT))), array())"))
    rows = rows.withColumn("__m", F.expr("shiftleft(1L, __b) - 1L"))
    word = lambda p, k: f"__w[CAST({p} & __m AS INT) + {k}]"
    same = " AND ".join(f"{word('s', k)} = {word('__s[k + 1]', k)}" for k in range(3))
    rows = rows.withColumn("__e", F.expr(f"transform(__s, (s, k) -> k + 1 < size(__s) AND shiftright(s, __b) = shiftright(__s[k + 1], __b) AND {same})"))
    rows = rows.withColumn("__p", F.expr("sort_array(transform(filter(__s, (s, k) -> __e[k] OR (k > 0 AND __e[greatest(k - 1, 0)])), s -> s & __m))"))
    cover = "aggregate(transform(__p, (p, k) -> if(k + 1 < size(__p), least(3L, __p[k + 1] - p), 3L)), 0L, (a, x) -> a + x)"
    return rows.select(
        *rest,
        F.col("__n").cast("long").alias("n_words"),
        F.expr(_without(esc(BLANK))).alias("word_chars"),
        F.expr(_without(SYMBOL)).alias("n_symbols"),
        F.expr("CAST(size(__l) - size(array_distinct(__l)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(cover).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.expr(_without(r"\\P{L}+")).alias("n_letters"),
        F.expr(_without(r"\\P{Lu}+")).alias("n_upper"),
        F.expr(_without("[^!]+")).alias("n_bangs"),
        F.expr(_without(r"[^\\p{L}\\p{N}]+")).alias("n_alnum"),
        F.expr("CAST(size(array_distinct(__w)) AS BIGINT)").alias("n_distinct"),
        F.expr(r"CAST(size(filter(__w, x -> NOT x rlike '[\\p{L}\\p{N}]')) AS BIGINT)").alias("n_bare"),
    )


def votes(df: DataFrame) -> DataFrame:
    """Adds a column vote_<rule> for each rule: 1 good, 0 bad, null for none."""
    out = df
    for name, ratio, good, bad in RULES:
        x = f"({ratio})"
        sql = f"CASE WHEN {bad.replace('x ', x + ' ')} THEN 0 WHEN {good.replace('x ', x + ' ')} THEN 1 END"
        out = out.withColumn(f"vote_{name}", F.expr(sql))
    return out


def estimate(patterns: list[tuple[tuple, int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good and, for each rule, how often its vote is good among good and among bad documents. patterns: votes and how many documents cast them."""
    width = len(RULES)
    prior, rates = START[0], [START[1:]] * width
    patterns = sorted(patterns, key=lambda p: tuple(-1 if v is None else v for v in p[0]))
    for _ in range(rounds if patterns else 0):
        good = [(posterior(v, prior, rates) * n, n) for v, n in patterns]
        total = sum(n for _, n in good)
        prior = min(0.99, max(0.01, sum(g for g, _ in good) / total))
        fresh = []
        for j in range(width):
            cast = [(v[j], g, n - g) for (v, _), (g, n) in zip(patterns, good) if v[j] is not None]
            # one document's worth of the starting belief keeps every rate off 0 and 1
            a = (sum(g for v, g, _ in cast if v) + START[1]) / (sum(g for _, g, _ in cast) + 1)
            b = (sum(h for v, _, h in cast if v) + START[2]) / (sum(h for _, _, h in cast) + 1)
            fresh.append((a, min(a, b)))  # a rule's good vote never speaks against a document
        rates = fresh
    return prior, rates


def posterior(v: tuple, prior: float, rates: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior))
    for vote, (a, b) in zip(v, rates):
        if vote is not None:
            x += math.log(a / b) if vote else math.log((1 - a) / (1 - b)) if b < 1 else 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def fit(voted: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    names = [f"vote_{r[0]}" for r in RULES]
    rows = voted.groupBy(*names).count().collect()
    return estimate([(tuple(r[n] for n in names), r["count"]) for r in rows])


def judge(voted: DataFrame, model: tuple[float, list[tuple[float, float]]], keep: float = KEEP) -> DataFrame:
    """Adds base_failed, posterior and kept."""
    prior, rates = model
    x = F.lit(math.log(prior / (1 - prior)))
    for (name, *_), (a, b) in zip(RULES, rates):
        bad = math.log((1 - a) / (1 - b)) if b < 1 else 0.0
        x = x + F.expr(f"CASE vote_{name} WHEN 1 THEN {math.log(a / b)!r}D WHEN 0 THEN {bad!r}D ELSE 0D END")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-x)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voted = cut(votes(statistics(docs).drop("text")))
    out = judge(voted, fit(voted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The query in DuckDB's SQL: statistics by rows of words, and the rounds of EM as a recursive query over the vote patterns."""
    width = range(len(RULES))
    cast = []
    for k, (_, ratio, good, bad) in enumerate(RULES):
        x = "(" + ratio.replace(" / ", "::DOUBLE / ") + ")"
        cast.append(f"CASE WHEN {bad.replace('x ', x + ' ')} THEN 0 WHEN {good.replace('x ', x + ' ')} THEN 1 END AS v{k}")
    names = ", ".join(f"v{k}" for k in width)
    log = "ln(prior / (1 - prior))" + "".join(f" + CASE v{k} WHEN 1 THEN ln(a{k} / b{k}) WHEN 0 THEN CASE WHEN b{k} < 1 THEN ln((1 - a{k}) / (1 - b{k})) ELSE 0 END ELSE 0 END" for k in width)
    rates = ", ".join(f"((sum(g) FILTER (v{k} = 1)) + {START[1]}) / ((sum(g) FILTER (v{k} IS NOT NULL)) + 1) AS a{k}, ((sum(n - g) FILTER (v{k} = 1)) + {START[2]}) / ((sum(n - g) FILTER (v{k} IS NOT NULL)) + 1) AS b{k}" for k in width)
    safe = rates.replace("(sum(g) FILTER", "coalesce(sum(g) FILTER").replace("(sum(n - g) FILTER", "coalesce(sum(n - g) FILTER").replace(" = 1)) +", " = 1), 0) +").replace("NOT NULL)) +", "NOT NULL), 0) +")
    start = ", ".join(f"{START[1]}::DOUBLE AS a{k}, {START[2]}::DOUBLE AS b{k}" for k in width)
    least = ", ".join(f"a{k}, least(a{k}, b{k}) AS b{k}" for k in width)
    odds = f"1 / (1 + exp(-greatest(-700, least(700, {log}))))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
c AS (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM p),
r AS (SELECT id, count(DISTINCT i + j) AS n FROM c, (VALUES (0), (1), (2)) o(j) WHERE c.n > 1 GROUP BY id),
s AS (SELECT d.id, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
  length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs, len(list_distinct(w))::BIGINT AS n_distinct,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_bare, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g'))::BIGINT AS n_alnum
  FROM d JOIN w USING (id) LEFT JOIN r ON r.id = d.id),
v AS MATERIALIZED (SELECT *, {', '.join(cast)} FROM s),
q AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v GROUP BY ALL),
em AS (
  SELECT 0 AS k, {START[0]}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT k + 1, prior, {least} FROM (
    SELECT k, least(0.99, greatest(0.01, sum(g) / sum(n))) AS prior, {safe} FROM (SELECT k, {names}, n, n * {odds} AS g FROM em, q WHERE k < {ROUNDS}) GROUP BY k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {odds} >= {KEEP} AS kept
FROM v, (SELECT * FROM em ORDER BY k DESC LIMIT 1)"""


SQL = _sql()
