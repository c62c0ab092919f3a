"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, per source, then per shard of a source."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, unit_hash


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotient weight / (2 k + 1), none above its cap; ties go to the earlier one.

    A divisor found by halving gives all seats but a few, the heap deals out those.
    """
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    at = lambda d: [min(c, int(w / d + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    low, high = 0.0, 4.0 * max(weights, default=0) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(at(mid)) > seats else (low, mid)
    won = at(high)
    heap = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights, won, caps, strict=True)) if w > 0 and k < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction, most: int) -> list[Fraction]:
    """share times all sizes by weight; none above `most` times its size, the excess reshared by weight among the rest."""
    out = [Fraction(0)] * len(sizes)
    free, left = [i for i, n in enumerate(sizes) if n], share * sum(sizes)
    while free:
        each = left / sum(weights[i] for i in free)
        full = [i for i in free if each * weights[i] >= most * sizes[i]]
        for i in full or free:
            out[i] = Fraction(most * sizes[i]) if full else each * weights[i]
        if not full:
            break
        left -= sum(most * sizes[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


class _Mix:
    """What is known of all sources and shards: a row for each source and for each shard on the driver, no more."""

    def __init__(self, sized: DataFrame, weights: Sequence[int], share: Fraction, most: int, most_block: int, shard_rows: int, max_shards: int, seed: int):
        self.seed, spark = seed, sized.sparkSession
        found = sized.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r._source is None, r._source))
        per_shard = max(shard_rows, -(-sum(r.n for r in found) // max_shards))
        goal = targets([r.size for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
        block = [max(1, min(most_block, r.size // 256)) for r in found]
        rows = [(r._source, i, -(-r.n // per_shard), r.size, float(goal[i]), block[i]) for i, r in enumerate(found)]
        self.sources = self._small(spark.createDataFrame(rows, "_s string, _src int, _n_shards long, _source_size long, _target double, _block long"), len(rows))
        shards = self.dealt(sized).groupBy("_src", "_shard").agg(F.sum("_size").alias("size")).collect()
        shards.sort(key=lambda r: (r._src, r._shard))
        by_source: dict[int, list[int]] = {}
        for k, r in enumerate(shards):
            by_source.setdefault(r._src, []).append(k)
        blocks = [-(-r.size // block[r._src]) for r in shards]
        room = [most * sum(blocks[k] for k in by_source.get(i, ())) for i in range(len(found))]
        # blocks of one size for all sources; one with fewer than 256 such blocks is dealt its target in blocks of its own
        equal = [i for i in range(len(found)) if block[i] == most_block]
        won = [min(room[i], round(goal[i] / block[i])) for i in range(len(found))]
        for i, q in zip(equal, sainte_lague([float(goal[i]) for i in equal], round(sum(goal[i] for i in equal) / most_block), [room[i] for i in equal]), strict=True):
            won[i] = q
        quotas = []
        for i, ks in by_source.items():
            for k, q in zip(ks, sainte_lague([float(shards[k].size) for k in ks], won[i], [most * blocks[k] for k in ks]), strict=True):
                n = max(1, blocks[k])
                quotas.append((i, shards[k]._shard, q // n, q % n, n))
        self.quotas = self._small(spark.createDataFrame(quotas, "_src int, _shard long, _whole long, _rest long, _n_blocks long"), len(quotas))

    @staticmethod
    def _small(df: DataFrame, n: int, most: int = 100_000) -> DataFrame:
        return F.broadcast(df) if n <= most else df

    def dealt(self, sized: DataFrame) -> DataFrame:
        out = sized.join(self.sources, sized._source.eqNullSafe(F.col("_s"))).drop("_s")
        return out.withColumn("_shard", F.pmod("_key", F.col("_n_shards")))

    def taken(self, sized: DataFrame) -> DataFrame:
        """sized with _taken, and _until, the words of its shard up to and with this row; the order is by size, then by the seed."""
        order = Window.partitionBy("_src", "_shard").orderBy("_size", unit_hash(self.seed + 1, F.col("_key")), "_key").rowsBetween(Window.unboundedPreceding, 0)
        placed = self.dealt(sized).join(self.quotas, ["_src", "_shard"]).withColumn("_until", F.sum("_size").over(order))
        step = F.floor(unit_hash(self.seed + 2, F.col("_src"), F.col("_shard")) * F.col("_n_blocks"))

        def chosen(at):  # words of the first `at` of the shard that the blocks taken once more hold
            full = F.floor(at / F.col("_block"))
            before = lambda b: F.floor((b * F.col("_rest") + step) / F.col("_n_blocks"))
            return before(full) * F.col("_block") + (before(full + 1) - before(full)) * (at - full * F.col("_block"))

        words = F.col("_whole") * F.col("_size") + chosen(F.col("_until")) - chosen(F.col("_until") - F.col("_size"))
        return placed.withColumn("_taken", words.cast("long")).withColumn("_order", F.row_number().over(order))


def _sized(docs: DataFrame, seed: int) -> dict[str, Column]:
    text = F.col("text").cast("string")
    return {
        "_source": F.col("source").cast("string"),
        "_size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        "_key": F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text),
    }


_OPTIONS = {"weights": (3, 1, 2), "share": Fraction(3, 2), "most": 2, "most_block": 32, "shard_rows": 512, "max_shards": 20_000}


def mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, size (words), source_size, target (its source's), taken (words the mix takes).

    options: weights, share, most, most_block, shard_rows, max_shards. Sources in order of their code points, null last,
    weigh `weights`, repeated. Each source is dealt over shards by a hash of id and text, so a source with most of the
    rows is many shards; a shard's documents, in order of size and then of the seed, form a row of words cut into blocks
    of most_block words. Quotas of blocks go to sources by their targets and to a source's shards by their words, by
    Sainte-Lague. A source of fewer than 256 blocks has smaller blocks of its own, as many as its target takes. In a
    shard with n blocks and a quota q each block is taken q // n times, and q mod n blocks once more: those at equal
    steps from a seeded start. So a block is taken at most `most` times. On the driver is a row for each source and one
    for each shard, of which there are max_shards and one for each source at most.

    Null and empty texts have size 0 and nothing is taken of them. A null source is a source. A null doc_id stays null;
    rows with one doc_id, repeated or not, each count. An empty table gives no rows. Other columns are left out.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in _sized(docs, seed).items())), "mix-sizes")
    taken = _Mix(sized, seed=seed, **(_OPTIONS | options)).taken(sized)
    return taken.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def apply_mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """The rows of docs as the mix takes them, whole: each 0 to `most` times, by taken / size.

    The fractions are rounded along their running sum in a shard, whose rows stand in order of size: what is rounded off
    of one is added to the next of about the same size, so that a source's words come near its target. A row without
    words is taken by its source's share of target and words. Each row is decided by itself, in the pass that sorts its
    shard: nothing is joined by doc_id, so null ids and repeated rows are rows like others. Gives the columns of docs;
    their names may not begin with an underscore and be those used here (_source, _size, _key and so on).
    """
    own = _sized(docs, seed)
    narrow = stored(docs.select(*(c.alias(k) for k, c in own.items())), "mix-sizes")
    taken = _Mix(narrow, seed=seed, **(_OPTIONS | options)).taken(docs.withColumns(own))
    ratio = F.when(F.col("_size") > 0, F.col("_taken") / F.col("_size")).otherwise(F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(1.0))
    order = Window.partitionBy("_src", "_shard").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum(F.round(ratio * (1 << 20)).cast("long")).over(order)  # whole numbers, so that sums are exact
    start = F.floor(unit_hash(seed + 3, F.col("_src"), F.col("_shard")) * (1 << 20))
    rounded = taken.withColumn("_ratio", F.round(ratio * (1 << 20)).cast("long")).withColumn("_sum", until)
    copies = (F.shiftright(F.col("_sum") + start, 20) - F.shiftright(F.col("_sum") - F.col("_ratio") + start, 20)).cast("int")
    out = rounded.withColumn("_copies", copies).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
