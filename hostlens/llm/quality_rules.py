"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Counts per text are row-local array expressions.  Each rule rejects a document whose share exceeds a cutoff, and the
cutoffs are chosen on labelled documents, for every stratum and rule by itself:

- A cutoff is certified if the exact binomial test rejects "good documents are rejected at a rate of ``risk`` / rules or
  more": P(Binomial(n, risk / rules) <= k) <= ``error`` / (strata x rules), with k of n good labelled documents rejected.
- Cutoffs of a rule are tested from lenient to strict and only while all before them were certified (fixed sequence), so
  only strata and rules need the correction (Bonferroni).
- Of the certified cutoffs that one is used which rejects most bad documents net of good ones; ties go to the lenient one.

With probability 1 - ``error`` no stratum loses more than ``risk`` of its good documents to all rules together.  A stratum
with too few labels to certify anything keeps its documents, subject to the base rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import materialize

RISK = 0.05
ERROR = 0.1
_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 8
#: Cutoffs of each rule, from lenient to strict.
GRID = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02],
    "dup_line_share": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "repeat_share": [0.28, 0.25, 0.2, 0.15, 0.1, 0.05],
    "word_length": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words inside windows of 8 words that are found at least twice."""
    n = F.size(words)
    last = n - _WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, _WINDOW)).alias("h"), i.alias("i"))))
    hashes = F.transform(windows, lambda w: w["h"])

    def covered(sorted_: Column) -> Column:
        size = F.size(sorted_)
        at = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda j: ((j > 0) & (F.get(sorted_, j - 1)["h"] == F.get(sorted_, j)["h"])) | (F.get(sorted_, j + 1)["h"] == F.get(sorted_, j)["h"]),
        )
        starts = F.sort_array(F.transform(at, lambda j: F.get(sorted_, j)["i"]))
        steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.lit(_WINDOW), F.coalesce(b - a, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    some = F.size(F.array_distinct(hashes)) < last + 1
    return F.when(some, F.element_at(F.transform(F.array(F.sort_array(windows)), covered), 1)).otherwise(F.lit(0)).cast("long")


def counted(docs: DataFrame, *carried: str | Column) -> DataFrame:
    """The carried columns with the counts and shares of each text; a null text counts as none."""
    base = docs.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    base = base.withColumns({
        "_words": F.filter(F.split("_text", _SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
    })
    words = F.col("_words")
    base = base.withColumns({
        "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeated(words),
    }).drop("_words", "_lines", "_text")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    base = base.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    # Behind a one-row generator: a filter on a count would else be rewritten in terms of the text, once per use.
    fixed = [*COUNTS, "n_lines", *GRID, "base_failed"]
    return base.select(*[c for c in base.columns if c not in fixed], F.inline(F.array(F.struct(*fixed))))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logarithms."""
    first = n * F.log(F.lit(1 - p))
    odds = F.log(F.lit(p / (1 - p)))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(state["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(state["total"] - top) + F.exp(term - top))).alias("total"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.least(F.lit(1.0), F.exp(F.aggregate(steps, start, step, lambda s: s["total"])))


def thresholds(counts: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, rule, cutoff`` of each certified rule, from ``doc_id, stratum`` and shares.

    A document labelled more than once counts as good if any label is 1; null labels and ids are ignored.  Documents that fail the
    base rules are left out, as they never reach the cutoffs.
    """
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    holdout = counts.where(~F.col("base_failed")).select("doc_id", "stratum", *GRID).join(marks, "doc_id")
    # One pass: sums per stratum and test, combined before the shuffle.
    sums = holdout.groupBy("stratum").agg(
        F.count_if(F.col("good") == 1).alias("n"),
        *[F.count_if((F.col("good") == g) & (F.col(rule) > c)).alias(f"{rule}_{i}_{g}") for rule, grid in GRID.items() for i, c in enumerate(grid) for g in (0, 1)],
    )
    tests = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}_1").alias("k"), F.col(f"{rule}_{i}_0").alias("caught"))
        for rule, grid in GRID.items() for i, c in enumerate(grid)
    ])
    strata = sums.agg(F.count(F.lit(1)).alias("strata"))
    each = sums.select("stratum", "n", F.inline(tests)).join(F.broadcast(strata))
    rate = risk / len(GRID)
    # At k >= n * rate the tail is about a half or more: no need to sum it.
    p = F.when(F.col("k") >= F.col("n") * rate, F.lit(1.0)).otherwise(binomial_tail(F.col("n"), F.col("k"), rate))
    sequence = Window.partitionBy("stratum", "rule").orderBy("step")
    tested = each.withColumn("p", p).withColumn("worst", F.max("p").over(sequence))
    certified = tested.where(F.col("worst") <= F.lit(error) / (F.col("strata") * len(GRID)))
    best = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - F.col("k"), -F.col("step"))).alias("cutoff"))
    return best


def apply(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``kept`` for every row: not failed by the base rules, nor over a cutoff of its stratum."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in GRID])
    joined = counts.join(wide, counts["stratum"].eqNullSafe(wide["stratum"]), "left").drop(wide["stratum"])
    over = reduce(Column.__or__, [F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False)) for r in GRID])
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop(*[f"_{r}" for r in GRID])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``doc_id``, counts, shares, ``base_failed`` and ``kept`` of every document; the stratum is ``lang``.

    Null and empty texts have no words and so fail.  A null language is a stratum of its own.  Repeated rows are judged each;
    without labels only the base rules decide; other columns are ignored.
    """
    counts = materialize(counted(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum")), "rule-counts")
    return apply(counts, materialize(thresholds(counts, labels, risk, error), "rule-cutoffs"))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are (whatever their names).

    Texts are counted once; the verdict comes back to a row by its id, language and the hash of its text, of which it is a function: so
    repeated rows, null ids and null languages are kept or dropped as ``judge`` says.  Null, empty and blank texts fail, long ones
    are counted whole, and without rows or labels nothing but the base rules decides.
    """
    keys = {"doc_id": F.col("doc_id").cast("long"), "stratum": F.coalesce(F.col("lang").cast("string"), F.lit("")), "text_key": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    named = [c.alias(n) for n, c in keys.items()]
    counts = materialize(counted(docs, *named), "rule-counts")
    cutoffs = materialize(thresholds(counts, labels, risk, error), "rule-cutoffs")
    passed = apply(counts, cutoffs).where("kept").select(*[F.col(n).alias(f"_{n}") for n in keys])
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *named)
    same = nested["doc_id"].eqNullSafe(passed["_doc_id"]) & (nested["stratum"] == passed["_stratum"]) & (nested["text_key"] == passed["_text_key"])
    return nested.join(passed, same, "left_semi").select("_doc.*")
