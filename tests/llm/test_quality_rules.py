import math
import random
import re

import pytest
from conftest_llm import docs_of
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated)


def texts(words):
    rng = random.Random(5)
    rows = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "a\nb\na\n\n\na \nb", "É漢🙂#*$%&|<>", "w\x0bx\x0cy\x1cz\xa0q", "r s " * 20_000, "line\r\nline\r\nline"]
    for _ in range(60):
        body = [rng.choice(words[:40]) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, max(0, len(body) - 12))
            body += body[k : k + rng.randint(5, 20)]
        rows.append(rng.choice([" ", "\n", "  "]).join(body))
    return list(enumerate(rows))


def test_measures_match_brute_force(spark, words):
    rows = texts(words)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.measures(docs_of(spark, rows)).collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_exact_binomial_tail(spark):
    for n, k, p in ((10, 0, 0.1), (10, 3, 0.1), (50, 50, 0.2), (2000, 11, 0.01), (20_000, 150, 0.01)):
        (r,) = spark.range(1).select(qr._binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).collect()
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)  # noqa: B023, E731
        assert r.x == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-9, abs=1e-300)


def labelled(spark, n):
    """Good documents, one in fifty with some symbols, and bad ones full of them; of middle length all."""
    rng = random.Random(1)
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        signs = 120 if bad else 30 if rng.random() < 0.02 else 0
        body = [f"w{rng.randrange(10**6)}" + ("###" if j < signs else "") for j in range(150)]
        rows.append((k, " ".join(body)))
    return docs_of(spark, rows), spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(n)] + [(None, 1), (1, None)], "doc_id long, quality int")


def test_risk_is_controlled(spark):
    docs, labels = labelled(spark, 1600)
    got = qr.judge(docs, labels).collect()
    good = [r for r in got if r.doc_id % 4]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert not any(r.kept for r in got if r.doc_id % 4 == 0)
    cut = qr.fit_cutoffs(qr.measures(docs), labels).collect()
    assert {(r.stratum, r.rule) for r in cut} == {("middle", "symbols")}


def tail(n, k, p):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    return sum(math.exp(log(i)) for i in range(k + 1))


def test_cutoffs_and_verdicts_match_brute_force(spark):
    """The whole of choosing and testing on the table, in plain Python, from the measures alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    labels = labels.select("doc_id", "quality")
    measured = qr.measures(docs).join(labels.where("quality is not null"), "doc_id").withColumn("tests", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(2)) == 0).cache()
    rows = measured.collect()
    rate = {
        "symbols": lambda r: r.n_symbols / max(r.word_chars, 1), "repeats": lambda r: r.n_repeat_words / max(r.n_words, 1), "dup_lines": lambda r: r.n_dup_lines / max(r.n_lines, 1),
        "capitals": lambda r: r.n_capitals / max(r.word_chars, 1), "shouts": lambda r: r.n_shouts / max(r.n_words, 1), "longest_run": lambda r: r.n_same_next / max(r.n_words, 1),
    }
    want = set()
    for stratum, own in (("short", [r for r in rows if r.n_words < 100]), ("middle", [r for r in rows if 100 <= r.n_words < 1000]), ("long", [r for r in rows if r.n_words >= 1000])):
        choose, test = [r for r in own if not r.tests], [r for r in own if r.tests and r.quality == 1]
        n_good, best = sum(r.quality == 1 for r in choose), None
        for step in qr.STEPS:
            cut = {}
            for rule, of in rate.items():
                fits = [(sum(r.quality == 0 and of(r) > c for r in choose), c) for c in qr.CUTOFFS if sum(r.quality == 1 and of(r) > c for r in choose) <= step * n_good]
                if fits and max(fits)[0]:
                    cut[rule] = max(fits)[1]
            wrong = sum(any(rate[k](r) > c for k, c in cut.items()) for r in test)
            if not cut:
                continue
            if tail(len(test), wrong, 0.05) > 0.05 / 3:
                break
            best = cut
        want |= {(stratum, k, c) for k, c in (best or {}).items()}
    assert {tuple(r) for r in qr.fit_cutoffs(qr.measures(docs), labels).collect()} == want
    assert {s for s, _, _ in want} >= {"short", "middle"}
    for r in qr.judge(docs, labels).join(measured.select(F.col("doc_id").alias("id"), *(F.col(c).alias(f"m_{c}") for c in ("n_lines",))), F.col("doc_id") == F.col("id")).collect():
        stratum = "short" if r.n_words < 100 else "middle" if r.n_words < 1000 else "long"
        failed = {k for s, k, c in want if s == stratum and rate[k](r) > c}
        assert set(r.failed) == failed
        assert r.kept == (not r.base_failed and not failed)


def test_cutoffs_are_proved_on_the_smallest_table_of_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    assert qr.fit_cutoffs(qr.measures(docs), labels).count() >= 1


def test_words_that_shout(spark):
    texts = ["hello there!", "hello there! ", "a! b!! c", "!", "no!t", "a!\u00a0b", ""]
    got = {r.doc_id: r.n_shouts for r in qr.measures(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == {k: sum(w.endswith("!") for w in WORD.findall(t)) for k, t in enumerate(texts)}


def test_too_few_holdouts_prove_nothing(spark):
    docs, labels = labelled(spark, 150)
    assert qr.fit_cutoffs(qr.measures(docs), labels).collect() == []
    assert all(r.kept for r in qr.judge(docs, labels).collect())


def test_base_rules_and_odd_tables(spark, words):
    rows = [*texts(words), (5, "again " * 30), (None, "no id but words " * 8)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qr.judge(docs_of(spark, rows), none).collect()
    assert len(got) == len(rows)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert qr.judge(docs_of(spark, []), none).collect() == []


def test_native(spark):
    docs, labels = labelled(spark, 20)
    judged = qr.judge(docs.select(*docs.columns), labels)._jdf.queryExecution().executedPlan().toString()
    measured = qr.measures(docs)._jdf.queryExecution().analyzed().toString()
    assert not re.search("Python|Pandas|Arrow", judged + measured)
