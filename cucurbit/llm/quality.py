"""Operator 2: a ledger of quality rules, one failure bit each, and policies applied to it.

``measure`` takes the measurements of a text once, ``ledger`` evaluates every rule of ``RULES``
once on them and keeps the outcome as bits of one long beside the measurements.  A policy is a
named, versioned mask: a row passes if its failures and the mask share no bit, so a new policy
needs no second look at the texts.  ``ablation`` counts from the bits alone what each rule of a
policy rejects, and what it alone rejects.

Everything is a DataFrame or SQL expression on one row; nothing is shuffled but the counts of
the ablation, of which there are at most 2 to the number of rules.

Defined results: a null text has no words, symbols or lines and fails the base rules, as does
an empty one.  Very long texts cost n log n.  Other columns of the input stay; columns named
like a measurement are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SPACE = r"[\\x20\\x09-\\x0D]+"

#: Bit, name and when a row fails, in SQL over the measurements.  Bits are never given anew.
RULES: list[tuple[int, str, str]] = [
    (0, "few_words", "n_words < 20"),
    (1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "exclamations", "10 * n_exclaims > 3 * n_words"),
    (4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (5, "long_words", "word_chars > 14 * n_words"),
]
BASE = {"few_words", "repeated_windows"}
#: Names of the rules by policy and version.
POLICIES = {
    ("base", 1): BASE,
    ("web", 1): {*BASE, "symbols", "exclamations", "repeated_lines"},
    ("web", 2): {*BASE, "symbols", "exclamations", "repeated_lines", "long_words"},
}


def mask(policy: str, version: int) -> int:
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[policy, version])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines and n_repeat_words."""
    t = f"coalesce(`{text}`, '')"
    steps: list[dict[str, str]] = [
        {"__words": f"array_remove(split({t}, '{SPACE}'), '')", "__lines": f"filter(split({t}, '\\\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"},
        {
            "n_words": "cast(size(__words) as long)",
            "word_chars": "cast(length(array_join(__words, '')) as long)",
            "n_symbols": f"cast(regexp_count({t}, '[#*$%&|<>]') as long)",
            "n_exclaims": f"cast(length({t}) - length(replace({t}, '!', '')) as long)",
            "n_lines": "cast(size(__lines) as long)",
            "n_dup_lines": "cast(size(__lines) - size(array_distinct(__lines)) as long)",
            "__windows": f"if(size(__words) < {WINDOW + 1}, array(), transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))))",
        },
        # Windows with their places, by content: equal ones are neighbours.  Most texts have none and skip the sort.
        {"__sorted": "if(size(array_distinct(__windows)) = size(__windows), array(), sort_array(transform(__windows, (h, i) -> struct(h, i))))"},
        {"__twice": "sort_array(filter(transform(__sorted, (w, i) -> if((i > 0 and __sorted[greatest(i - 1, 0)].h = w.h) or (i + 1 < size(__sorted) and __sorted[least(i + 1, size(__sorted) - 1)].h = w.h), w.i, -1)), i -> i >= 0))"},
        {"n_repeat_words": f"aggregate(transform(__twice, (p, i) -> if(i + 1 < size(__twice), least({WINDOW}, __twice[least(i + 1, size(__twice) - 1)] - p), {WINDOW})), 0L, (a, n) -> a + n)"},
    ]
    out = docs
    for step in steps:
        out = out.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return out.drop("__words", "__lines", "__windows", "__sorted", "__twice")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measurements and the failure bits of every rule, as the long ``failed``.

    Columns of these names are replaced, and columns named __words, __lines, __windows, __sorted and __twice go.
    """
    bits = " | ".join(f"if({sql}, {1 << bit}L, 0L)" for bit, _, sql in RULES)
    # A filter on the bits must not be pushed below the measurements, which would take them anew
    # for every rule and window: an expression that isn't deterministic stays where it is.
    return measure(docs, text).withColumn("failed", F.expr(f"({bits}) | (monotonically_increasing_id() & 0L)"))


def passes(policy: str, version: int, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy, version))) == 0


def ablation(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: the rows that fail it, and those that would be kept without it."""
    m = mask(policy, version)
    groups = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).count()
    rules = [(name, 1 << bit) for bit, name, _ in RULES if m >> bit & 1]
    found = groups.select("bits", "count", F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules))).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return found.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_alone"),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_lines", "failed"),
        (~passes("base", 1)).alias("base_failed"),
        passes("web", 2).alias("kept"),
    )


def oracle_sql(source: str = "documents") -> str:
    """DuckDB's SQL for the query."""
    bits = " + ".join(f"CASE WHEN {sql} THEN {1 << bit} ELSE 0 END" for bit, _, sql in RULES)
    return rf"""
WITH split AS (
  SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM {source}),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM split)),
twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM twice GROUP BY doc_id),
measured AS (
  SELECT split.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')))::BIGINT AS n_exclaims,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, ({bits})::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaims, n_lines, failed,
  (failed & {mask("base", 1)}) <> 0 AS base_failed, (failed & {mask("web", 2)}) = 0 AS kept
FROM judged"""
