"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Counts of each text come first.  The rules that follow are predicates over them and over the text.  On a sample, each
rule's cost (the characters and words that it looks at) and its rejections are counted, for every combination of rules
that reject a row together; the rules are then put in order, each time the one that rejects most per cost of the rows
that all rules before it pass.  A later rule is tried only where the earlier ones pass.  The order never changes the
verdict, and equal rows give equal orders: nothing is timed.

Rows: a null text counts as empty (no words) and fails the base; repeated rows are judged alike; a text of any length
is read whole; further columns are ignored; an empty table gives an empty table (and rules in their given order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import of_sample, table

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\f\r"
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that the text has twice or more."""

    def marked(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
        places = F.array_sort(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, marked))

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of runs of width words to those of twice as many, of the runs that are there."""
        joined = lambda h: F.zip_with(h, F.slice(h, F.lit(width + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return _let(hashes, lambda h: F.slice(joined(h), F.lit(1), F.size(h) - width))

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        hashes, width = doubled(hashes, width), 2 * width
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, counted)).cast("long")


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (and word_list, line_list for the rules)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, SEPARATORS, "      ")) != "")
    out = df.withColumn("word_list", F.filter(F.split(F.translate(text, SEPARATORS, "      "), " ", -1), lambda w: w != ""))
    out = out.withColumn("line_list", worded)
    return out.withColumns(
        {
            "n_words": F.size("word_list").cast("long"),
            "word_chars": F.length(F.translate(text, SEPARATORS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("line_list") - F.size(F.array_distinct("line_list"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("word_list")),
        }
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Rejecting predicates over the columns of counts(), and what each costs: how many characters and words it looks
    at (one for a comparison of counts)."""
    n, one = F.col("n_words"), F.lit(1).cast("long")
    return {
        "symbols": (100 * F.col("n_symbols") > 10 * n, one),
        "word_length": ((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n), one),
        "dup_lines": (100 * F.col("n_dup_lines") > 50 * F.size("line_list"), one),
        "few_letters": (100 * F.size(F.filter("word_list", lambda w: w.rlike(r"\p{L}"))) < 80 * n, F.col("word_chars")),
        "stutter": (100 * F.size(F.filter("word_list", lambda w, i: w == F.get("word_list", i - 1))) > 10 * n, n),
        "few_distinct": (100 * F.size(F.array_distinct("word_list")) < 20 * F.least(n, F.lit(1000)), 2 * n),
    }


def base_failed(min_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def cascade_order(df: DataFrame, id_col: str, text_col: str, sample_rows: int = 1000) -> list[str]:
    """Names of the rules by conditional rejections per cost on a sample: a hash fraction of all rows, of about
    sample_rows rows.  One row for each combination of rules reaches the driver, 64 at most."""
    picked = df.where(of_sample(F.col(id_col).cast("string"), sample_rows, max(1, df.count())))
    told = counts(picked.select(F.col(text_col).cast("string").alias("text"))).where(~base_failed())
    names = list(rules())
    flags = told.select(F.concat(*(F.when(r, "1").otherwise("0") for r, _ in rules().values())).alias("hit"), *(cost.alias(f"cost_{k}") for k, (_, cost) in rules().items()))
    seen = flags.groupBy("hit").agg(F.count("*").alias("n"), *(F.sum(f"cost_{k}").alias(f"cost_{k}") for k in names)).collect()
    order: list[str] = []
    while len(order) < len(names):
        passed = [r for r in seen if all(r["hit"][names.index(k)] == "0" for k in order)]
        worth = {k: sum(r["n"] for r in passed if r["hit"][names.index(k)] == "1") / max(1, sum(r[f"cost_{k}"] for r in passed)) for k in names if k not in order}
        order.append(max(worth, key=lambda k: (worth[k], -names.index(k))))
    return order


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """(id, counts, base_failed, kept, rejected_by): rejected_by is "base", a rule's name, or null."""
    order, every = cascade_order(df, id_col, text_col, sample_rows), rules()
    counted = counts(df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        verdict = verdict.when(every[name][0], F.lit(name))
    out = counted.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rejected_by follows from the sample's order, which SQL does not draw
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


QUERIES = {"op8_quality_cascade": op8_quality_cascade}
ORACLES = {
    "op8_quality_cascade": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({WINDOW}) AS x(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 80 * n_words OR 100 * len(list_filter(w, lambda x, i: x = w[i - 1])) > 10 * n_words OR 100 * len(list_distinct(w)) < 20 * least(n_words, 1000)) AS kept
FROM based"""
}
