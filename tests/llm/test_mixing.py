import random
import re
from fractions import Fraction

from conftest_llm import docs_of

from tidemark.llm.mixing import apply_mix, mix, sainte_lague, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_highest_quotients():
    rng = random.Random(0)
    for _ in range(200):
        weights = [rng.choice([0, 1, 1, 2, 5, 40, 0.3]) for _ in range(rng.randint(1, 7))]
        caps = [rng.randint(0, 30) for _ in weights]
        seats = rng.randint(0, 60)
        won = [0] * len(weights)
        for _ in range(min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))):
            k = max((i for i in range(len(weights)) if won[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        assert sainte_lague(weights, seats, caps) == won


def test_targets_stop_and_reshare():
    assert targets([100, 100, 100], [3, 1, 2], Fraction(3, 2), 2) == [200, Fraction(250, 3), Fraction(500, 3)]
    assert targets([10, 0, 1000], [3, 1, 2], Fraction(3, 2), 2) == [20, 0, 1495]
    assert targets([], [], Fraction(3, 2), 2) == []
    assert targets([0, 0], [3, 1], Fraction(3, 2), 2) == [0, 0]


def corpus():
    rng = random.Random(6)
    rows = []
    for k in range(700):
        source = "hot" if k % 3 == 0 else rng.choice(["a", "B", "é", None])
        rows.append((k, " ".join(["w"] * rng.choice([0, 1, 3, 30, 300])), "en", source))
    return rows + [(9000, None, "en", "a"), (9001, "long " * 20_000, "en", "B"), (9002, "only", None, "single")]


def test_contract(spark):
    rows = corpus()
    got = {r.doc_id: r for r in mix(docs_of(spark, rows), shard_rows=64).collect()}
    assert len(got) == len(rows)
    size = {d: len(WORD.findall(t or "")) for d, t, _, _ in rows}
    by = {}
    for d, _, _, s in rows:
        by.setdefault(s, []).append(d)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets([sum(size[d] for d in by[s]) for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], Fraction(3, 2), 2)
    for s, target in zip(order, want, strict=True):
        total = sum(size[d] for d in by[s])
        for d in by[s]:
            assert (got[d].size, got[d].source_size) == (size[d], total)
            assert got[d].target == float(target)
            assert 0 <= got[d].taken <= 2 * size[d]
        assert abs(sum(got[d].taken for d in by[s]) - float(target)) <= 0.01 * float(target) + 2


def test_reruns_agree_on_any_partitions(spark):
    docs = docs_of(spark, corpus())
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    assert key(mix(docs)) == key(mix(docs.repartition(7, "n_chars")))


def test_empty_and_repeated(spark):
    assert mix(docs_of(spark, [])).collect() == []
    got = mix(docs_of(spark, [(1, "a b c", "en", "s"), (1, "a b c", "en", "s")])).collect()
    assert sum(r.taken for r in got) == 9
    assert all(r.size == 3 for r in got)


def test_taken_words_match_brute_force(spark):
    """Blocks laid out word by word in plain Python, on the shards, orders and starts that the seed gives."""
    from pyspark.sql import functions as F

    from tidemark.llm import mixing
    from tidemark.llm.common import unit_hash

    docs = docs_of(spark, corpus())
    own = mixing._sized(docs, 7)
    order = unit_hash(8, F.col("_key"))
    rows = docs.select("doc_id", *(c.alias(k) for k, c in own.items())).withColumn("o", order).collect()
    sources = sorted({r._source for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(r._size for r in rows if r._source == s) for s in sources]
    goal = targets(size, [(3, 1, 2)[k % 3] for k in range(len(size))], Fraction(3, 2), 2)
    shards = {}
    for r in rows:
        i = sources.index(r._source)
        shards.setdefault((i, r._key % -(-sum(x._source == r._source for x in rows) // 64)), []).append(r)
    block = [max(1, min(32, n // 256)) for n in size]
    blocks = {k: -(-sum(r._size for r in v) // block[k[0]]) for k, v in shards.items()}
    starts = {(r._src, r._shard): r.x for r in spark.createDataFrame(list(shards), "_src int, _shard long").select("_src", "_shard", unit_hash(9, F.col("_src"), F.col("_shard")).alias("x")).collect()}

    def deal(weights, seats, caps):
        won = [0] * len(weights)
        for _ in range(min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))):
            won[max((i for i in range(len(won)) if won[i] < caps[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        return won

    equal = [i for i in range(len(size)) if block[i] == 32]
    seats = [round(g / b) for g, b in zip(goal, block, strict=True)]
    for i, q in zip(equal, deal([float(goal[i]) for i in equal], round(sum(goal[i] for i in equal) / 32), [2 * sum(n for k, n in blocks.items() if k[0] == i) for i in equal]), strict=True):
        seats[i] = q
    want = {}
    for i in range(len(size)):
        own = sorted(k for k in shards if k[0] == i)
        for k, q in zip(own, deal([float(sum(r._size for r in shards[k])) for k in own], seats[i], [2 * blocks[k] for k in own]), strict=True):
            n = max(1, blocks[k])
            step = int(starts[k] * n)
            once_more = [(b + 1) * (q % n) + step >= n * (1 + (b * (q % n) + step) // n) for b in range(n)]
            at = 0
            for r in sorted(shards[k], key=lambda r: (r._size, r.o, r._key)):
                want[r.doc_id] = sum(q // n + once_more[w // block[i]] for w in range(at, at + r._size))
                at += r._size
    assert {r.doc_id: r.taken for r in mix(docs, shard_rows=64).collect()} == want


def test_a_small_source_leaves_the_blocks_of_others_alone(spark):
    rows = [(k, "w " * 96, "en", "large") for k in range(300)] + [(1000, "w " * 300, "en", "small")]
    with_small = {r.doc_id: r.taken for r in mix(docs_of(spark, rows)).collect()}
    assert abs(with_small[1000] - 600) <= 2
    assert all(n % 32 == 0 for d, n in with_small.items() if d < 1000)  # whole blocks of 32


def test_apply_takes_whole_rows_near_the_targets(spark):
    docs = docs_of(spark, corpus())
    out = apply_mix(docs, shard_rows=64)
    assert out.columns == docs.columns
    got, mixed = out.collect(), mix(docs, shard_rows=64).collect()
    ratio = {r.doc_id: r.taken / r.size for r in mixed if r.size}
    times = {d: sum(r.doc_id == d for r in got) for d in ratio}
    assert all(abs(times[d] - x) < 1 + 1e-5 for d, x in ratio.items())
    taken = sum(len((r.text or "").split()) for r in got if r.source == "hot")
    target = next(r.target for r in mixed if r.doc_id == 0)
    assert abs(taken - target) < 0.05 * target


def test_apply_on_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s")] * 2 + [(None, "x y", "en", "s"), (None, "x y z", "en", None), (2, None, "en", "s"), (3, "", "en", None)]
    docs = docs_of(spark, rows)
    said = sum(r.taken for r in mix(docs).collect())
    got = apply_mix(docs).collect()
    words = sum(len((r.text or "").split()) for r in got)
    assert said == round(1.5 * 19)
    assert abs(words - said) <= 7
    assert sum(r.doc_id == 1 for r in got) <= 4
    assert len(mix(docs).collect()) == len(rows)
    assert apply_mix(docs_of(spark, [])).collect() == []
