"""Quality rules as one projection.

A table of thresholds is compiled into Spark columns: counts first, then
ratios, then one boolean for each rule. Nothing is shuffled and no user
function runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.llm.common import aside, table

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: function words of the languages the corpus is written in
STOP_WORDS = (
    "the of and to in is that it for as with was on are be this by from or an at not which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur avec se "
    "el los del las por con una su para como más lo y al no"
).split()


class Rule(NamedTuple):
    """A document fails where ``value`` is under ``least`` or over ``most``."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: base rules decide ``base_failed``; the others add to ``kept``
BASE_RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_words", "repeat_ratio", most=0.5),
)
RULES = (
    Rule("many_words", "n_words", most=1_000_000),
    Rule("short_words", "mean_word_chars", least=2.0),
    Rule("long_words", "mean_word_chars", most=14.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("marks", "mark_ratio", most=0.30),
    Rule("stop_words", "stop_ratio", least=0.03),
    Rule("duplicate_lines", "dup_line_ratio", most=0.40),
    Rule("word_lines", "bar_ratio", most=0.20),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules need; the words of a text stay in its row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), "")
    step = docs.withColumn("_text", t).withColumn("_words", words)
    w = F.col("_words")
    n = F.size(w)
    # windows of three words: a hash decides the order, the words decide equality
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    step = step.withColumn("_windows", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    s = F.col("_windows")

    def same(a: Column, b: Column) -> Column:
        alike = a["h"] == b["h"]
        for k in range(3):
            alike = alike & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
        return F.coalesce(alike, F.lit(False))

    found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
    step = step.withColumn("_found", F.array_sort(F.transform(found, lambda x: x["i"])))
    p = F.col("_found")
    # each window adds the words that the one before it has not covered
    covered = F.aggregate(
        p, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")),
    )["sum"]
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(_without(x, SPACES + " ")) > 0)
    step = step.withColumn("_lines", lines)
    body = _without(F.col("_text"), SPACES + " ")
    stops = F.array(*(F.lit(x) for x in dict.fromkeys(STOP_WORDS)))
    return step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(body).cast("long"),
        "n_symbols": (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_marks": (F.length("_text") - F.length(_without(F.col("_text"), "!?"))).cast("long"),
        "n_bars": F.size(F.filter(w, lambda x: x == "|")).cast("long"),
        "n_stops": F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
    }).drop("_text", "_words", "_windows", "_found", "_lines")


def ratios() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "mark_ratio": share("n_marks", "n_words"),
        "stop_ratio": share("n_stops", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "bar_ratio": share("n_bars", "n_words"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """For each rule a boolean column that is true where the document fails it."""
    out = {}
    for rule in rules:
        fails = F.lit(False)
        if rule.least is not None:
            fails = fails | (F.col(rule.value) < rule.least)
        if rule.most is not None:
            fails = fails | (F.col(rule.value) > rule.most)
        out[rule.name] = fails
    return out


def judge(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with counts, ratios, ``base_failed``, ``failed`` (names of the rules failed) and ``kept``.

    Null and empty texts have no words, so they fail the base rule on length.
    Repeated rows are judged alike, an empty table gives no rows. Columns of
    ``docs`` with the name of a result are replaced.
    """
    every = {**compile_rules(base), **compile_rules(rules)}
    failed = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in every.items())))
    base_failed = F.lit(False)
    for c in compile_rules(base).values():
        base_failed = base_failed | c
    results = {"base_failed", "failed", "kept"}
    inner, back = aside(docs, {"_text", "_words", "_windows", "_found", "_lines"})
    rated = counts(inner, text).withColumns(ratios())
    rated = rated.withColumns({"base_failed": base_failed, "failed": failed}).withColumn("kept", F.size("failed") == 0)
    new = [c for c in rated.columns if c not in inner.columns or c in results]
    own = back(rated).columns
    moved = dict(zip(own, inner.columns))
    return rated.select(*(F.col(f"`{moved[c]}`").alias(c) for c in own if c not in new), *new)


def op7_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_TESTS = {r.name: " OR ".join(f"{r.value} {sign} {edge}" for sign, edge in (("<", r.least), (">", r.most)) if edge is not None) for r in (*BASE_RULES, *RULES)}
OP7_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
             len([x FOR x IN ws IF x = '|']) AS n_bars, len([x FOR x IN ws IF lower(x) IN ({_LIST})]) AS n_stops
      FROM w LEFT JOIN covered USING (rid)),
r AS (SELECT *, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars,
             coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_marks::DOUBLE / nullif(n_words, 0), 0) AS mark_ratio,
             coalesce(n_stops::DOUBLE / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_bars::DOUBLE / nullif(n_words, 0), 0) AS bar_ratio FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT ({" OR ".join(f"({t})" for t in _TESTS.values())}) AS kept FROM r
"""
