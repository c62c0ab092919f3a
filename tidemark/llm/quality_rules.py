"""Quality rules with risk control: cutoffs that labelled holdouts prove to reject few good documents, per stratum.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Shares that speak against a document the more, the higher they are; each of them is a rule.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "longest_run": "n_same_next / greatest(n_words, 1)",
}
CUTOFFS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _covered(windows: Column, run: int) -> Column:
    """Words in windows whose hash is found twice or more; windows: a hash for each place at which one starts."""
    placed = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    # each window with the hashes before and after it in order of hashes: one that equals either is repeated
    before = F.concat(F.array(F.lit(None).cast("long")), F.transform(placed, lambda x: x["h"]))
    after = F.concat(F.slice(F.transform(placed, lambda x: x["h"]), 2, F.size(placed)), F.array(F.lit(None).cast("long")))
    joined = F.arrays_zip(placed.alias("own"), before.alias("before"), after.alias("after"))
    twice = F.filter(joined, lambda x: F.coalesce(x["own"]["h"] == x["before"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda x: x["own"]["k"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")),
        lambda a, k: F.struct((a["n"] + k + run - F.greatest(k, a["until"])).alias("n"), (k + run).alias("until")),
        lambda a: a["n"],
    )


def measures(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): the counts that the rules look at; other columns are left out.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an earlier one),
    n_repeat_words (words in 8-word windows found twice or more), n_lines with a word, n_capitals, n_shouts (words
    that end in `!`), n_same_next (words equal to the one before). A null text has no words; all its counts are 0.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # each word is hashed once; all that is counted over words is counted over numbers
    words = F.transform(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))
    base = base.withColumn("words", words).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    words, run = F.col("words"), 8
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - run + 1), lambda k: F.xxhash64(F.slice(words, k, run)))
    base = base.withColumn("windows", F.when(F.size(words) >= run, windows).otherwise(F.array().cast("array<bigint>")))
    met = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return base.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        (F.length("text") - met(r"[\x20\x09-\x0D]")).alias("word_chars"),
        met("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"), run)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        met("[A-Z]").alias("n_capitals"),
        met(r"!(?=[\x20\x09-\x0D]|\z)").alias("n_shouts"),
        (F.size(words) - F.size(F.array_compact(F.transform(words, lambda w, k: F.when(F.get(words, k - 1) == w, None).otherwise(True))))).cast("long").alias("n_same_next"),
    )


def _binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at the rate: the sum of the exact terms, each made from the one before, in logarithms."""
    odds = F.log(F.lit(rate / (1 - rate)))
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct((n * F.log(F.lit(1 - rate))).alias("term"), (n * F.log(F.lit(1 - rate))).alias("total")),
        lambda a, i: F.when(i > k, a).otherwise(_next_term(a, i, n, odds)),
        lambda a: F.exp(a["total"]),
    )
    return F.when(k >= n, 1.0).otherwise(terms)


def _next_term(a: Column, i: Column, n: Column, odds: Column) -> Column:
    term = a["term"] + F.log((n - i + 1) / i) + odds
    most = F.greatest(term, a["total"])
    return F.struct(term.alias("term"), (most + F.log(F.exp(term - most) + F.exp(a["total"] - most))).alias("total"))


def stratum(column: str = "n_words") -> Column:
    """Strata by length: below 100 words, below 1000, and the rest."""
    return F.when(F.col(column) < 100, "short").when(F.col(column) < 1000, "middle").otherwise("long")


def _shares(measured: DataFrame, rules: dict[str, str]) -> DataFrame:
    return measured.withColumns({"stratum": stratum()} | {k: F.expr(f"cast({x} as double)") for k, x in rules.items()})


#: How large a part of the good holdouts that choose each rule may reject, from the mildest set of cutoffs to the strictest.
STEPS = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, column: str = "quality", *, rules: dict[str, str] = RULES, cutoffs: Sequence[float] = CUTOFFS, steps: Sequence[float] = STEPS, rate: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Rows (stratum, rule, cutoff): reject what is above. At most three strata times the number of rules.

    With probability 1 - delta, over all strata at once, the rules together reject at most `rate` of the good documents
    of a stratum. The labelled holdouts are halved by a hash of their ids. One half chooses: for each of the steps, a
    cutoff for each rule that rejects at most that part of its good and most of its bad, of equal ones the highest. The
    other half tests these sets of cutoffs as wholes, by what any rule of a set rejects: had a set a higher rate of
    false rejections, so few among the n good of this half would be as unlikely as the level, by the exact binomial
    tail. Strata are tested at delta / 3 each, which is Bonferroni's correction; the steps of a stratum from the mildest
    on until one fails, a fixed sequence, which needs no further one. The last that passed is taken. So a stratum needs
    80 good labels in the half that tests, with no false rejection among them; with fewer it has no rules.

    Rows with a null label or id teach nothing; repeated labels of an id count once, the greatest; rows of one doc_id
    each count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    held = stored(_shares(measured, rules).join(known, "doc_id").select("stratum", "y", (F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(2)) == 0).alias("tests"), *rules), "holdouts")
    # one row a stratum: counts of the good and the bad above each cutoff, in one pass without exploding the holdouts
    sums = [F.count_if((F.col("y") == y) & (F.col(k) > c)).alias(f"{k}_{j}_{y}") for k in rules for j, c in enumerate(cutoffs) for y in (0, 1)]
    counted = held.where("not tests").groupBy("stratum").agg(F.count_if(F.col("y") == 1).alias("good"), *sums)
    cases = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{k}_{j}_1").alias("wrong"), F.col(f"{k}_{j}_0").alias("right")) for k in rules for j, c in enumerate(cutoffs)))
    flat = counted.select("stratum", "good", F.explode(cases).alias("c")).select("stratum", "good", "c.*")
    some = flat.withColumn("step", F.explode(F.array(*(F.lit(x) for x in steps)))).where((F.col("right") > 0) & (F.col("wrong") <= F.col("step") * F.col("good")))
    chosen = some.groupBy("stratum", "step", "rule").agg(F.max(F.struct("right", "cutoff")).alias("best")).select("stratum", "step", "rule", F.col("best.cutoff").alias("cutoff"))
    chosen = stored(chosen, "chosen")
    sets = chosen.groupBy("stratum", "step").agg(*(F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cut_{k}") for k in rules))
    rejects = F.coalesce(F.greatest(*(F.coalesce(F.col(k) > F.col(f"cut_{k}"), F.lit(False)) for k in rules)), F.lit(False))
    tried = held.where("tests and y = 1").join(F.broadcast(sets), "stratum").groupBy("stratum", "step").agg(F.count("*").alias("good"), F.count_if(rejects).alias("wrong"))
    tested = tried.withColumn("passes", _binomial_tail(F.col("good"), F.col("wrong"), rate) <= delta / 3)
    # a row for each stratum and step; a step is reached if all milder ones pass
    in_turn = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    taken = tested.withColumn("reached", F.min("passes").over(in_turn)).where("reached").groupBy("stratum").agg(F.max("step").alias("step"))
    return chosen.join(F.broadcast(taken), ["stratum", "step"]).select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame, column: str = "quality", *, rules: dict[str, str] = RULES, **options) -> DataFrame:
    """Per row of docs: the measures, base_failed, failed (the rules that reject it), kept.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. kept is false for these, else
    true unless a rule's fitted cutoff is passed. Without labels no rule rejects anything. A null doc_id stays null and
    has no label; rows with one doc_id, repeated or not, are each judged by their own text; other columns, whatever
    their names, are left out; an empty table of documents gives no rows.
    """
    measured = stored(measures(docs), "measures")
    fitted = stored(fit_cutoffs(measured, labels, column, rules=rules, **options), "cutoffs")
    wide = fitted.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cut_{k}") for k in rules))
    shares = _shares(measured, rules).join(F.broadcast(wide), "stratum", "left")  # three rows at most
    failed = F.array_compact(F.array(*(F.when(F.col(k) > F.col(f"cut_{k}"), F.lit(k)) for k in rules)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return shares.select(*measured.columns, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
