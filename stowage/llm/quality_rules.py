"""Quality rules as a short-circuit cascade, in SQL expressions alone.

Each rule's cost and its rejections are measured on a sample; rules then run by falling rejections per cost, and a
document that one rule rejects is not put to the next. The order changes the time only, never the verdict.

Words are runs of characters other than space and tab to carriage return. Defined cases: null is a text without words
and is rejected as too short; repeated rows and ties are judged alike; an empty table gives an empty result and rules in
the order written; input columns that clash with an added name are replaced by it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.storage import drop_stored, stored

SAMPLE_ROWS = 400
# One row in so many is a candidate for the sample.
SAMPLE_RATE = 8
# A timed job puts a rule to each row of the sample so often; the fastest of so many jobs counts.
SAMPLE_PASSES = 4
SAMPLE_RUNS = 2
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TEXT = "coalesce(text, '')"
# Blanks of every kind as spaces.
SPACED = rf"translate({TEXT}, '\t\n\u000B\u000C\r', '     ')"
WORDS = f"(CASE WHEN trim({SPACED}) = '' THEN CAST(array() AS array<string>) ELSE split(trim({SPACED}), ' +') END)"
# A one-element array binds a name, so that the words of a text are cut once and not once for each use.
REPEATS = f"""transform(array({WORDS}), ws -> CASE WHEN size(ws) < 3 THEN 0L ELSE
  transform(array(transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))), hs ->
    CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE
      transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))), ss ->
        CAST(size(array_distinct(flatten(transform(
          filter(ss, (s, j) -> coalesce(s.h = get(ss, j - 1).h, false) OR coalesce(s.h = get(ss, j + 1).h, false)),
          s -> array(s.i, s.i + 1, s.i + 2))))) AS bigint))[0] END)[0] END)[0]"""
LINES = rf"filter(split({TEXT}, '\n'), x -> trim(translate(x, '\t\u000B\u000C\r', '    ')) <> '')"
FEATURES = {
    "n_words": f"CAST(size({WORDS}) AS bigint)",
    "word_chars": f"CAST(length(replace({SPACED}, ' ', '')) AS bigint)",
    "n_symbols": f"CAST(length({TEXT}) - length(translate({TEXT}, '{SYMBOLS}', '')) AS bigint)",
    "n_capitals": f"CAST(length({TEXT}) - length(translate({TEXT}, '{CAPITALS}', '')) AS bigint)",
    "n_lines": f"CAST(size({LINES}) AS bigint)",
    "n_dup_lines": f"transform(array({LINES}), ls -> CAST(size(ls) - size(array_distinct(ls)) AS bigint))[0]",
    "n_repeat_words": REPEATS,
}
# Measures that take one pass over the text; the others are taken only where a rule gets to them.
CHEAP = ("n_words", "word_chars", "n_symbols", "n_capitals")
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# The document is rejected where the condition holds; the first two are the base rules.
RULES = {
    "few_words": "{n_words} < 50",
    "repeats": "100 * {n_repeat_words} > 50 * {n_words}",
    "symbols": "10 * {n_symbols} > {n_words}",
    "capitals": "2 * {n_capitals} > {word_chars}",
    "short_words": "{word_chars} < 2 * {n_words}",
    "long_words": "{word_chars} > 20 * {n_words}",
    "dup_lines": "2 * {n_dup_lines} > {n_lines}",
}
BASE = ("few_words", "repeats")


def features(docs: DataFrame, names=tuple(FEATURES)) -> DataFrame:
    """The documents with the named measures of the column ``text``."""
    return docs.withColumns({n: F.expr(FEATURES[n]) for n in names})


def condition(rule: str) -> str:
    """A rule over measured columns."""
    return RULES[rule].format(**{n: n for n in FEATURES})


def over_text(rule: str) -> str:
    """A rule over the text itself."""
    return RULES[rule].format(**{n: f"({e})" for n, e in FEATURES.items()})


def cascade_order(docs: DataFrame, rules=tuple(RULES)) -> list[str]:
    """Rules by falling rejections per second on a sample of bounded size, timed over many passes in one job."""
    sample = stored(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_RATE)) == 0).limit(SAMPLE_ROWS), "quality-sample")

    rejected = sample.agg(*[F.count_if(F.expr(over_text(r))).alias(r) for r in rules]).first()
    passes = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_PASSES))).alias("pass"))

    def seconds(sql: str) -> float:
        asked, best = passes.agg(F.count_if(F.expr(sql))), []
        for _ in range(SAMPLE_RUNS):
            start = time.perf_counter()
            asked.collect()
            best.append(time.perf_counter() - start)
        return min(best)

    seconds(over_text(rules[0]) if rules else "true")
    idle = seconds("length(text) < 0")
    # A rule that is lost in the noise of a job counts as a hundredth of the empty job.
    worth = {r: rejected[r] / max(seconds(over_text(r)) - idle, idle / 100) for r in rules}
    drop_stored(docs.sparkSession, sample)
    return sorted(rules, key=lambda r: -worth[r])


def rejection(order: list[str], measured=()):
    """The first rule, in this order, that rejects a document; null if none does.

    Measures named in ``measured`` are columns. Of the others the cheap ones are bound once, where two rules need them, and a
    dear one is computed when its rule is reached.
    """
    bound = [n for n in CHEAP if n not in measured and sum("{" + n + "}" in RULES[r] for r in order) > 1]
    names = {n: n if n in measured else f"f.{n}" if n in bound else f"({e})" for n, e in FEATURES.items()}
    rules = " ".join(f"WHEN {RULES[r].format(**names)} THEN {r!r}" for r in order)
    if not bound:
        return F.expr(f"CASE {rules} END")
    held = ", ".join(f"'{n}', {FEATURES[n]}" for n in bound)
    return F.expr(f"transform(array(named_struct({held})), f -> CASE {rules} END)[0]")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, ``base_failed``, ``kept`` and the rule that rejected.

    The measures returned are taken of every document. Those that only other rules need are taken where the base
    rules pass, when the cascade gets to them.
    """
    order = [r for r in cascade_order(docs) if r not in BASE]
    failed = " ".join(f"WHEN {condition(r)} THEN {r!r}" for r in BASE)
    measures = features(docs.select("doc_id", "text"), RETURNED).withColumn("base", F.expr(f"CASE {failed} END"))
    rejected = F.when(F.col("base").isNotNull(), F.col("base")).otherwise(rejection(order, RETURNED))
    return measures.withColumn("rejected_by", rejected).select("doc_id", *RETURNED, F.col("base").isNotNull().alias("base_failed"), F.isnull("rejected_by").alias("kept"), "rejected_by")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with the columns they had."""
    return docs.where(F.isnull(rejection(cascade_order(docs))))
