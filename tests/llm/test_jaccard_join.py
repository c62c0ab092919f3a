import random
import re

import numpy as np
import pytest
from conftest_llm import docs_of

from tidemark.llm import jaccard_join as jj
from tidemark.llm.common import shingle_sets
from tidemark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def mixture(words, seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = text(60), []
    for base in range(14):
        body = text(rng.choice([3, 4, 5, 6, 9, 30, 80, 200]))
        for _ in range(rng.randint(1, 9)):
            copy = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.4:
                copy = copy[rng.randint(0, 2) :]
            rows.append(" ".join(copy))
        if base % 3 == 0:
            rows.append(" ".join(text(20) + passage + text(rng.randint(1, 60))))
    rows += ["", None, " \t\n", "one two", "One TWO", "one two three four five", "É É É É é", "x" * 3000, " ".join(text(5000))]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, words, seed):
    rows = mixture(words, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == brute(rows)


def test_frequent_members_move_work_but_not_results(spark, words):
    rows = mixture(words, 9)
    got = jj.jaccard_components(docs_of(spark, rows), sample_share=1.0, frequent_in=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_large_group_of_near_copies(spark, words):
    """A chain: each links to the next few alone, in blocks and groups smaller than itself."""
    rng = random.Random(1)
    body = [rng.choice(words) for _ in range(120)]
    rows = []
    for k in range(150):
        body[rng.randrange(120)] = f"w{k}"
        rows.append((k, " ".join(body)))
    assert {r.doc_id: r.component_id for r in jj.jaccard_components(docs_of(spark, rows)).collect()} == {d: c for d, (_, c) in brute(rows).items()}


def test_copies_share_a_class_and_repeated_rows_stay(spark):
    text = "a b c d e f g h"
    rows = [(5, text), (3, text.upper()), (9, text + " i j k l m n o"), (3, text.upper())]
    got = sorted((r.doc_id, r.class_id, r.component_id) for r in jj.jaccard_components(docs_of(spark, rows)).collect())
    assert got == [(3, 3, 3), (3, 3, 3), (5, 3, 3), (9, 9, 9)]


def test_null_ids_and_ids_with_two_texts(spark):
    """A null id links with nothing; the two texts of id 2 are two documents, which tie nothing together."""
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (None, one), (None, "other words"), (None, None), (5, None), (4, "x")]
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in jj.jaccard_components(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 4, 1, 1), (2, 4, 1, 1), (2, 4, 2, 2), (3, 4, 2, 2), (3, 4, 2, 2), (None, 4, None, None), (None, 1, None, None), (None, 0, None, None), (5, 0, 5, 5), (4, 1, 4, 4)], key=str)


def test_groups_are_cut_by_members(spark, words):
    """Groups of long texts hold fewer documents, and lose no link."""
    rng = random.Random(5)
    body = [rng.choice(words) for _ in range(400)]
    rows = [(k, " ".join([*body[: 200 + k], f"w{k}", *body[200 + k :]])) for k in range(60)]
    docs = docs_of(spark, rows)
    cut = jj.groups_of
    try:
        jj.groups_of = lambda tiles, percent: cut(tiles, percent, most_members=4000)
        got = {r.doc_id: r.component_id for r in jj.jaccard_components(docs).collect()}
    finally:
        jj.groups_of = cut
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_empty_table(spark):
    assert jj.jaccard_components(docs_of(spark, [])).collect() == []


def test_blocks_of_a_tile_find_all_pairs(spark):
    tiles = spark.createDataFrame([(7, d, 100 + d, True) for d in range(40)], jj.TILES)
    none = spark.createDataFrame([], "node long, component long")
    groups = spark.createDataFrame([], jj.MET)
    for block in (4096, 7):
        got = {(r.a, r.b) for r in jj.cross_pairs(tiles, none, groups, 75, block=block).collect()}
        assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if 100 * (100 + a) >= 75 * (100 + b)}


def test_bitmaps_bound_overlap_from_above():
    rng = np.random.default_rng(0)
    sets = []
    for n, m, shared in ((10, 12, 8), (300, 900, 200), (5, 5, 0), (1000, 1000, 1000)):
        both = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        a, b = both[:n], both[n - shared :]
        assert shared <= jj.most_overlaps(np.array([n]), [jj.bitmap(a)], np.array([m]), [jj.bitmap(b)])[0] <= min(n, m)
        sets.append((a, b, shared))
    sizes, bits = ([[f(s[k]) for s in sets] for k in (0, 1)] for f in (len, jj.bitmap))
    both = jj.most_overlaps(np.array(sizes[0]), bits[0], np.array(sizes[1]), bits[1])
    for (a, b, _), most in zip(sets, both, strict=True):
        x, y = (set(((s >> np.uint64(7)) & np.uint64(min(len(jj.bitmap(a)), len(jj.bitmap(b))) * 8 - 1)).tolist()) for s in (a, b))
        assert most == min(len(a) - len(x - y), len(b) - len(y - x))


def test_shingle_sets_are_those_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "b", "é", "\t", "cc", "\x0b\n"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for at_once in (10, 1 << 20):
        sets = shingle_sets([t.encode() for t in texts], at_once=at_once)
        seen = {}
        for t, s in zip(texts, sets, strict=True):
            assert len(s) == len(shingles(t))
            key = frozenset(shingles(t))
            assert seen.setdefault(key, s.tobytes()) == s.tobytes()
        assert len({v for v in seen.values()}) == len(seen)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}
