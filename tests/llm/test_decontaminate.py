import hashlib
import random
import re

import pytest
from conftest_llm import docs_of

from tidemark.llm.decontaminate import drop_contaminated, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = [x[0] for x in split(text)]
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(x[0] for x in w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= items_
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        bytes_hit = sum(len((text or "")[w[k][1] : w[k][2]].encode()) for k in hit)
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit)), bytes_hit
    return out


@pytest.mark.parametrize("batch_bytes", [64 << 20, 400])
def test_matches_brute_force(spark, words, batch_bytes):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 60])]
    items += [(20, "Ünïcode Straße"), (21, "a b. c!"), (6, items[6][1]), (30, items[7][1]), (31, None)]
    docs = []
    for k in range(120):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            w = item.split()
            cut = w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)] if rng.random() < 0.5 else w
            parts += [rng.choice([", ", "-", " ", "\n\n"]).join(cut).upper() if rng.random() < 0.3 else " ".join(cut)]
        docs.append((k, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "!!!"), (203, "xünïcode straße"), (204, "ÜNÏCODE STRASSE ünïcode — straße"), (205, "z " * 20_000 + items[8][1]), (5, docs[5][1])]
    got = find_contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), batch_bytes=batch_bytes).collect()
    want = brute(docs, items)
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        row, n_bytes = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == row
        raw = (texts[r.doc_id] or "").encode()
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit
        inside = b" ".join(raw[s["from_byte"] : s["to_byte"]] for s in r.spans).decode()  # spans begin and end with whole words of the text
        assert sum(len(x[0].encode()) for x in split(inside)) == n_bytes


@pytest.mark.parametrize("batch_bytes", [64 << 20, 60])
def test_rows_without_hits_stay_whole(spark, batch_bytes):
    items = spark.createDataFrame([(1, "one two three four"), (2, "alpha beta"), (3, None)], "item_id long, text string")
    docs = [(1, "x One, two-three FOUR y"), (1, "clean"), (2, "alpha. Beta"), (3, None), (None, "clean too"), (None, "alpha beta"), (4, "alphabeta"), (5, ""), (1, "clean")]
    docs = docs_of(spark, docs)
    out = drop_contaminated(docs, items, batch_bytes=batch_bytes)
    assert out.schema == docs.schema
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if r.text in (None, "", "clean", "clean too", "alphabeta")), key=str)
    plan = drop_contaminated(docs.repartition(3), items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one asked for


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs_of(spark, []), items).collect() == []
    (r,) = find_contamination(docs_of(spark, [(1, "a b")]), items).collect()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
