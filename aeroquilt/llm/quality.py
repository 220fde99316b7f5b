"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes good (+1), bad (-1) or abstains (0).  Expectation-maximisation over the table of vote patterns - at most 3 ** rules
rows, whatever the corpus holds - estimates how each rule votes on good and on bad documents, and the share of good ones.  A document's posterior probability of being good replaces the all-must-pass filter.

Defined cases: a null text has no words; a document without words fails the base test; ties at the posterior threshold are kept; rows of one
id are judged one by one; columns of the names that are added are replaced, and only the votes of ``RULES`` count as votes.
Windows of five words are compared by 64-bit hashes inside one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_worded", "n_plain", "n_upper", "n_shouts", "n_ended")

#: Measure, good when it is at most the first bound, bad when it is over the second, else no vote.
RULES = {
    "symbols": ("try_divide(n_symbols, n_words)", 0.05, 0.15),
    "shouts": ("try_divide(n_shouts, n_words)", 0.02, 0.1),
    "upper": ("try_divide(n_upper, word_chars)", 0.2, 0.4),
    "odd_words": ("1 - try_divide(n_plain, n_words)", 0.15, 0.4),
    "word_length": ("abs(try_divide(word_chars, n_words) - 6.0)", 3.0, 5.0),
    "unended": ("1 - try_divide(n_ended, n_lines_worded)", 0.5, 0.9),
}


def let(value: Column, body) -> Column:
    """``body`` of one value that is computed once: a lambda's argument is never inlined."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            again = F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))
            step = lambda acc, i: F.struct((acc["n"] + i + 5 - F.greatest(i, acc["free"])).alias("n"), (i + 5).alias("free"))
            return F.aggregate(at, start, step, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, count))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(F.slice(h, i, 5)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(let(hashed, windows), covered))


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use."""
    docs = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.withColumn("__words", F.filter(F.split("__text", SPACE_CLASS), lambda w: w != ""))
    worded = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    docs = docs.withColumn("__lines", worded)
    signals = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeat_words(F.col("__words")),
        "n_lines_worded": F.size("__lines"),
        "n_plain": F.size(F.filter("__words", lambda w: F.rlike(w, F.lit(r"^[(\"']?[\p{L}\p{M}]+[.,;:!?)\"']?$")))),
        "n_upper": F.regexp_count("__text", F.lit("[A-Z]")),
        "n_shouts": F.regexp_count("__text", F.lit("!!+")),
        "n_ended": F.size(F.filter("__lines", lambda line: F.right(line, F.lit(1)).isin(".", "!", "?", '"'))),
    }
    docs = docs.withColumns({k: v.cast("long") for k, v in signals.items()}).drop("__text", "__words", "__lines")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    docs = docs.withColumn("base_failed", failed)
    for name, (measure, good, bad) in RULES.items():
        x = F.expr(measure)
        docs = docs.withColumn(f"vote_{name}", F.coalesce(F.when(x <= good, 1).when(x > bad, -1), F.lit(0)).cast("tinyint"))
    return docs


VOTES = [f"vote_{name}" for name in RULES]

#: Where EM starts: probability of the votes (-1, 0, +1) of any rule, for good and for bad documents, and the share of good ones.
START = {"good": (0.02, 0.38, 0.6), "bad": (0.4, 0.3, 0.3), "prior": 0.85}


def fit(votes: DataFrame, rounds: int = 40, tolerance: float = 1e-4, smoothing: float = 10.0) -> dict:
    """EM over vote patterns: ``model[rule][class]`` holds the probabilities of the votes -1, 0 and +1; every sum runs in Spark.

    ``smoothing`` pseudo-votes at the starting probabilities keep a rule that never fires from being read as evidence.
    """
    names = [c for c in votes.columns if c in VOTES]
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    patterns = votes.sparkSession.createDataFrame(patterns.collect(), patterns.schema).coalesce(1).cache()  # at most 3 ** len(names) rows
    model = {"prior": START["prior"], **{c: {y: START[y] for y in ("good", "bad")} for c in names}}
    for _ in range(rounds):
        p = patterns.withColumn("p", posterior(model))
        weight = {"good": F.col("n") * F.col("p"), "bad": F.col("n") * (1 - F.col("p"))}
        sums = [F.sum(w).alias(y) for y, w in weight.items()]
        sums += [F.sum(F.when(F.col(c) == v, w).otherwise(0.0)).alias(f"{c}{v}{y}") for c in names for v in (-1, 0, 1) for y, w in weight.items()]
        s = p.agg(*sums).first()
        if not s["good"]:
            break
        new = {"prior": min(0.99, max(0.01, s["good"] / (s["good"] + s["bad"])))}
        for c in names:
            new[c] = {y: tuple((s[f"{c}{v}{y}"] + smoothing * START[y][v + 1]) / (s[y] + smoothing) for v in (-1, 0, 1)) for y in ("good", "bad")}
        moved = max(abs(a - b) for c in names for y in ("good", "bad") for a, b in zip(new[c][y], model[c][y], strict=True))
        model = new
        if moved < tolerance:
            break
    patterns.unpersist()
    return model


def accuracies(model: dict) -> dict[str, float]:
    """How often each rule is right when it votes."""
    good = model["prior"]
    out = {}
    for c in model:
        if c != "prior":
            g, b = model[c]["good"], model[c]["bad"]
            out[c.removeprefix("vote_")] = (good * g[2] + (1 - good) * b[0]) / (good * (g[0] + g[2]) + (1 - good) * (b[0] + b[2]))
    return out


def posterior(model: dict) -> Column:
    """Probability of being good, given the votes."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for c in model:
        if c != "prior":
            bad, none, good = (math.log(a / b) for a, b in zip(model[c]["good"], model[c]["bad"], strict=True))
            odds = odds + F.when(F.col(c) == 1, good).when(F.col(c) == -1, bad).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with signals, votes, ``quality`` (posterior) and ``kept``.  The counted table is written once; EM and the verdict read it."""
    counted = materialise(with_signals(docs, text_col), "quality")
    p = posterior(fit(counted.where("not base_failed").select(*VOTES)))
    return counted.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = materialise(with_signals(docs).drop("text"), "quality")
    p = posterior(fit(counted.where("not base_failed").select(*VOTES)))
    kept = counted.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
