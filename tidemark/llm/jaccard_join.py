"""N-gram Jaccard self join, exact: size-banded tiles, bitmap bounds, then intersection of sorted arrays.

Two sets of which one holds t of their union share one of the first n - ceil(t n) + 1 members of each in any one order
of all members; and where that is the first one shared, the smaller set has it so early that enough can follow, among
its first n - ceil(2 t n / (1 + t)) + 1. Members are 64-bit hashes; their order is by hash, save that those frequent in a sample of documents
come last (that moves work, never results). So a tile is what holds one such member, sorted by size and cut where
sizes differ too much. A pair met in a tile is dropped where bitmaps bound its overlap from above too low; the rest
is decided on the sorted arrays.

A group of n near copies has n^2 / 2 links, yet needs n - 1 to be one component. So documents are first put with the
leaders they meet in tiles, at most two, and each such group is joined on its whole texts, once for each document: by
bitmap bounds, then on the arrays, and only where two are not in one component yet. Then, where documents of different
components and groups still meet in a tile, all of those pairs are decided. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mixed, shingle_sets, slices, stored, text_batches, unit_hash
from .components import connected_components

SETS = "doc_id long, node long, n long, h1 long, h2 long, bits binary, prefix binary"
PACKED = "bucket long, members binary, at binary, early binary, docs binary, sizes binary"
TILES = "member long, doc long, size long, early boolean"
MET = "doc_id long, group long, leader long"
PAIRS = "a long, b long"


def least_overlap(na, nb, percent: int):
    """Least intersection size with 100 i >= percent (na + nb - i)."""
    return -(-(percent * (na + nb)) // (100 + percent))


def bitmap(members: np.ndarray) -> bytes:
    """A bit for each member's hash; the width is a power of two, 4 to 8 times the size, at least 64."""
    width = 64
    while width < 4 * len(members):
        width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[((members >> U64(7)) & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlaps(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes]) -> np.ndarray:
    """For each pair of sets with these sizes and bitmaps: none shares more, as each bit that one has alone stands for a member that it has alone.

    Pairs of the same two widths are taken together; the wider bitmap is folded to the narrower one's width.
    """
    wide = np.array([list(map(len, a)), list(map(len, b))]).T.reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for wa, wb in np.unique(wide, axis=0):
        at = np.flatnonzero((wide == (wa, wb)).all(axis=1))
        x, y = (np.frombuffer(b"".join([bits[k] for k in at]), np.uint64).reshape(len(at), -1) for bits in (a, b))
        w = min(wa, wb) // 8
        x, y = (np.bitwise_or.reduce(z.reshape(len(at), -1, w), axis=1) for z in (x, y))
        alone = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
        out[at] = np.minimum(na[at] - alone(x, y), nb[at] - alone(y, x))
    return out


def frequent_members(docs: DataFrame, width: int, share: float, least: int, most: int) -> np.ndarray:
    """Members that at least `least` documents of a share of all (those with the least hash) hold, at most `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))], ["member"])

    sample = docs.where(unit_hash(17, F.col("doc_id")) < share).select("text").distinct()
    seen = sample.mapInArrow(run, "member long").groupBy("member").count().where(F.col("count") >= least)
    return np.sort(np.array([r.member for r in seen.orderBy(F.desc("count"), "member").limit(most).collect()], dtype=np.int64).view(np.uint64))


def sets_of(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """A row for each document: set size, two hashes of the whole set, bitmap and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            rows = []
            for s in shingle_sets(texts, width):
                n = len(s)
                whole = int(np.add.reduce(s * U64(0xD6E8FEB86659FD93))) if n else 0
                other = int(np.bitwise_xor.reduce((s ^ (s >> U64(29))) * U64(0xA0761D6478BD642F))) if n else 0
                prefix = s
                if len(frequent) and n:
                    k = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[k] == s
                    prefix = np.concatenate([s[~late], s[late]])
                rows.append((n, whole, other, bitmap(s), prefix[: n - -(-percent * n // 100) + 1].tobytes() if n else b""))
            signed = lambda k: pa.array(np.array([r[k] for r in rows], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("node"), pa.array([r[0] for r in rows], pa.int64()), signed(1), signed(2), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())],
                ["doc_id", "node", "n", "h1", "h2", "bits", "prefix"],
            )

    return docs.mapInArrow(run, SETS)


def tiles_of(sets: DataFrame, percent: int, frequent: np.ndarray, per_bucket: int = 300_000) -> DataFrame:
    """Rows (member, doc, size, early) of the members in the prefixes of two documents or more of sizes that may link.

    Prefixes go to the buckets of their members' hashes in packed arrays, not as rows of their own. Members frequent in
    the sample go to buckets of their documents' hashes and all come out, so that no bucket gathers a hot member.
    """
    total = sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    shuffle = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, int(total // per_bucket) + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes = batch.column("doc").to_numpy(), batch.column("n").to_numpy()
            arrays = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            if not arrays:
                continue
            members = np.concatenate(arrays)
            lengths = np.array([len(x) for x in arrays])
            at = np.repeat(np.arange(len(arrays), dtype=np.uint32), lengths)
            place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            early = place <= (sizes - -(-2 * percent * sizes // (100 + percent)))[at]
            bucket = (members % U64(buckets)).astype(np.int64)
            if len(frequent):
                hot = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] == members
                bucket[hot] = -1 - (mixed(docs.view(np.uint64)) % U64(buckets)).astype(np.int64)[at[hot]]
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            out = []
            for b, lo, hi in zip(found, first, [*first[1:], len(order)], strict=True):
                own = order[lo:hi]
                used, back = np.unique(at[own], return_inverse=True)
                out.append((int(b), members[own].tobytes(), back.astype(np.uint32).tobytes(), np.packbits(early[own]).tobytes(), docs[used].tobytes(), sizes[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in range(1, 6))], ["bucket", "members", "at", "early", "docs", "sizes"])

    def tiles(rows: pa.Table) -> pa.Table:
        members, docs, sizes, early = [], [], [], []
        for r in rows.select(["members", "at", "early", "docs", "sizes"]).to_pylist():
            at = np.frombuffer(r["at"], np.uint32)
            members.append(np.frombuffer(r["members"], np.uint64))
            docs.append(np.frombuffer(r["docs"], np.int64)[at])
            sizes.append(np.frombuffer(r["sizes"], np.int64)[at])
            early.append(np.unpackbits(np.frombuffer(r["early"], np.uint8), count=len(at)).astype(bool))
        m, d, s, e = np.concatenate(members), np.concatenate(docs), np.concatenate(sizes), np.concatenate(early)
        if rows.column("bucket")[0].as_py() >= 0:
            order = np.lexsort((d, s, m))
            m, d, s, e = m[order], d[order], s[order], e[order]
            # sorted by size among a member's, a document whose neighbours are too far off in size links with none there
            near = (m[1:] == m[:-1]) & (100 * s[:-1] >= percent * s[1:])
            keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            _, back = np.unique(m, return_inverse=True)
            keep &= (np.bincount(back, e) > 0)[back]
            m, d, s, e = m[keep], d[keep], s[keep], e[keep]
        return pa.table({"member": m.view(np.int64), "doc": d, "size": s, "early": e})

    packed = sets.select(F.col("doc_id").alias("doc"), "n", "prefix").mapInArrow(pack, PACKED)
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tiles, TILES)


def groups_of(tiles: DataFrame, percent: int, most: int = 2048, most_members: int = 2_000_000) -> DataFrame:
    """Rows (doc_id, group, leader): the leader that a document meets most often in its own size band, and the one below.

    A band's leader in a tile is its first document by size and id. As those of the next band that are not too long for
    it come to its group as well, documents on both sides of a border meet. Leaders are in their groups; those of one
    leader are cut by a hash into groups of about `most`, or of as many as have most_members members, 16 MB of sets and as
    much of bitmaps.
    """
    band = F.floor(F.log("size") / F.log(F.lit(100.0 / percent)))
    lead = tiles.where("early").groupBy("member", band.alias("band")).agg(F.min(F.struct("size", "doc")).alias("lead"))
    visits = tiles.withColumn("below", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band - F.col("below"))
    met = visits.join(lead, ["member", "band"]).where("doc <> lead.doc").where(F.lit(percent) * F.col("size") <= 100 * F.col("lead.size"))
    met = met.groupBy("doc", "size", F.col("lead.doc").alias("leader"), "below").count()
    best = met.groupBy("doc", "size").agg(*(F.max(F.when(F.col("below") == k, F.struct("count", "leader"))).alias(f"best{k}") for k in (0, 1)))
    pairs = best.select(F.explode(F.array_compact(F.array_distinct(F.array("best0.leader", "best1.leader")))).alias("leader"), F.col("doc").alias("doc_id"), "size")
    pairs = stored(pairs, "met")
    cuts = pairs.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("size") / most_members)).alias("cuts"))
    own = pairs.join(cuts, "leader").select("doc_id", F.xxhash64("leader", F.pmod(F.xxhash64("doc_id"), "cuts")).alias("group"), "leader")
    return stored(own.union(own.select(F.col("leader").alias("doc_id"), "group", "leader").distinct()), "groups")


def group_links(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within groups, enough to join all that are linked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for piece, raw in slices(batches):
            for group, doc, leader, s in zip(piece.column("group").to_pylist(), piece.column("doc_id").to_pylist(), piece.column("leader").to_pylist(), shingle_sets(raw, width), strict=True):
                if held and group != last:
                    yield _joined(held, percent)
                    held = []
                last = group
                held.append((doc != leader, doc, s))
        if held:
            yield _joined(held, percent)

    return _with_texts(groups, docs).repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(run, PAIRS)


def _joined(held: list[tuple[bool, int, np.ndarray]], percent: int) -> pa.RecordBatch:
    """Links of one group: each document against those of other components, the leader first."""
    held.sort(key=lambda x: x[:2])
    ids, sets = [x[1] for x in held], [x[2] for x in held]
    sizes = np.array([len(s) for s in sets])
    width = 64
    while width < 4 * max(sizes):
        width *= 2
    bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
    for k, s in enumerate(sets):
        at = (s >> U64(7)) & U64(width - 1)
        np.bitwise_or.at(bits[k], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    component = np.arange(len(sets))
    a, b = [], []
    for k in range(len(sets) - 1):
        rest = np.arange(k + 1, len(sets))
        rest = rest[(component[rest] != component[k]) & (100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k]))]
        for lo in range(0, len(rest), 512):
            some = rest[lo : lo + 512]
            alone = np.bitwise_count(bits[k] & ~bits[some]).sum(axis=1, dtype=np.int64)
            other = np.bitwise_count(bits[some] & ~bits[k]).sum(axis=1, dtype=np.int64)
            need = least_overlap(sizes[k], sizes[some], percent)
            for j in some[np.minimum(sizes[k] - alone, sizes[some] - other) >= need]:
                if component[j] != component[k] and len(np.intersect1d(sets[k], sets[j], assume_unique=True)) >= least_overlap(sizes[k], sizes[j], percent):
                    component[component == component[j]] = component[k]
                    a.append(ids[k])
                    b.append(ids[j])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_texts(wanted: DataFrame, docs: DataFrame, max_sent: int = 1_000_000) -> DataFrame:
    """wanted, which has doc_id, with each document's text.

    Few documents are in question, as a rule: then their ids are sent to the texts, beyond max_sent the texts are shuffled.
    """
    ids = stored(wanted.select("doc_id").distinct(), "wanted")
    texts = docs.join(F.broadcast(ids) if ids.count() <= max_sent else ids, "doc_id", "left_semi")
    return wanted.join(texts, "doc_id")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of one key, of a partition sorted by the keys; a run may reach over batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, *columns]]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for x in got[: len(keys)]:
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = [x[lo:hi] for x in got]
            if held and any(held[0][k][0] != part[k][0] for k in range(len(keys))):
                yield [np.concatenate(x) for x in zip(*held, strict=True)][len(keys) :]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)][len(keys) :]


def cross_pairs(tiles: DataFrame, components: DataFrame, groups: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """The pairs of a tile that may link by size, are in different components and in no group together.

    A tile of more than `block` documents is cut into blocks, and each two blocks are a tile of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0

        def pairs() -> pa.RecordBatch:
            x, y = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for size, doc, comp, own, one, g, other_g, early in _runs(batches, ["member", "low", "high"], ["size", "doc", "comp", "own", "one", "g1", "g2", "early"]):
            until = np.searchsorted(size, 100 * size // percent, side="right")
            for k in np.flatnonzero(early[:-1]):  # the smaller of two is the earlier by size and id
                span = slice(k + 1, int(until[k]))
                apart = (g[span] != g[k]) & (g[span] != other_g[k]) & (other_g[span] != g[k]) & (other_g[span] != other_g[k])
                other = np.flatnonzero((comp[span] != comp[k]) & apart & ((own[span] != own[k]) | one[k])) + k + 1
                if len(other):
                    a.append(np.full(len(other), doc[k]))
                    b.append(doc[other])
                    n += len(other)
            if n > 200_000:
                yield pairs()
                a, b, n = [], [], 0
        if n:
            yield pairs()

    # a leader may be in more groups than two: pairs within those that are not told here are made again
    near = groups.groupBy(F.col("doc_id").alias("doc")).agg(F.min("group").alias("g1"), F.max("group").alias("g2"))
    known = near.join(components.select(F.col("node").alias("doc"), "component"), "doc", "left")
    # who meets no leader, having neighbours in other bands alone, is a group and a component of its own
    own = tiles.join(known, "doc", "left").select("member", "size", "doc", "early", F.coalesce("component", "doc").alias("comp"), *(F.coalesce(g, F.xxhash64(F.lit(1), "doc")).alias(g) for g in ("g1", "g2")))
    count = own.groupBy("member").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.ceil(F.count("*") / block).alias("blocks")).where("first < last")
    cut = own.join(count.select("member", "blocks"), "member").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("member", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "size", "doc", "comp", "own", "g1", "g2", "early").withColumn("one", F.col("low") == F.col("high"))
    return cut.repartition("member", "low", "high").sortWithinPartitions("member", "low", "high", "size", "doc").mapInArrow(run, PAIRS).distinct()


def bounded_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps do not rule a link out, dealt over as many tasks as a shuffle has by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = most_overlaps(na, batch.column("bits_a").to_pylist(), nb, batch.column("bits_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(most >= least_overlap(na, nb, percent)))

    of = lambda k: sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits_{k}"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.join(of("b"), "b").repartition(tasks, "a").join(of("a"), "a").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, PAIRS)


def linked_pairs(pairs: DataFrame, docs: DataFrame, width: int, percent: int, members: int = 64) -> DataFrame:
    """The pairs that link, by intersection of the sorted arrays of their whole texts.

    The pairs of one document are cut into groups of about `members`, so that its text is read once for each group
    and a document with very many pairs is many groups.
    """
    pairs = stored(pairs, "pairs")
    count = pairs.groupBy("a").agg(F.count("*").alias("n_pairs"))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n_pairs") / members)).alias("k"))
    wanted = dealt.select("a", "k", F.col("b").alias("doc_id")).union(dealt.select("a", "k", F.col("a").alias("doc_id")).distinct())
    texts = _with_texts(wanted, docs).select("a", "k", (F.col("doc_id") != F.col("a")).alias("second"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = None, np.empty(0, np.uint64)
        for piece, raw in slices(batches):
            a, b = [], []
            for x, second, doc, s in zip(piece.column("a").to_pylist(), piece.column("second").to_pylist(), piece.column("doc_id").to_pylist(), shingle_sets(raw, width), strict=True):
                if not second:
                    first, own = x, s
                    continue
                assert first == x, "the document of a group comes before its pairs"
                if len(np.intersect1d(own, s, assume_unique=True)) >= least_overlap(len(own), len(s), percent):
                    a.append(x)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return texts.repartition("a", "k").sortWithinPartitions("a", "k", "second").mapInArrow(run, PAIRS)


def _told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs(doc_id, text) with node: the doc_id, or a hash of id and text where rows of one doc_id have different texts."""
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h := F.xxhash64("text")).alias("least"), F.max(h).alias("most"))
    many = stored(texts.where("least <> most").select(F.col("doc_id").alias("many")), "many-texts")
    n = many.count()
    if not n:
        return docs.withColumn("node", F.col("doc_id")), False
    joined = docs.join(F.broadcast(many) if n <= 1_000_000 else many, F.col("doc_id") == F.col("many"), "left")
    return joined.withColumn("node", F.when(F.col("many").isNotNull(), F.xxhash64(F.lit(3), "doc_id", "text")).otherwise(F.col("doc_id"))).drop("many"), True


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 75, sample_rows: int = 1_000_000, sample_share: float = 0.05, frequent_in: int = 3, max_frequent: int = 200_000) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, class_id, component_id.

    A set has the distinct `width`-word shingles of the text, A-Z lower-cased; with fewer words the whole sequence is
    one. class_id is the least doc_id with just the same set, component_id the least one that links reach (itself
    included), where 100 * intersection >= percent * union is a link. Null and empty texts and those without words
    have an empty set, link with nothing and are a component of their own. Rows with one doc_id and the same text are
    one document; rows with one doc_id and different texts are different documents, each linked by its own text alone.
    A row with a null doc_id links with nothing; its class_id and component_id are null. An empty table gives no rows.
    Other columns are left out. Which members are frequent is seen in a sample of sample_share of the rows or about
    sample_rows, whichever is less; it moves work between tasks and never a link.
    """
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(sample_share, sample_rows / max(1, docs.count()))
    told, apart = _told_apart(docs)
    nodes = told.select(F.col("node").alias("doc_id"), "text")
    frequent = frequent_members(docs, width, share, frequent_in, max_frequent)
    sets = stored(sets_of(told.select("doc_id", "node", "text"), width, percent, frequent), "sets")
    key = ["n", "h1", "h2"]
    named = sets.where("n > 0 and node is not null")
    classes = stored(named.groupBy(*key).agg(F.min("node").alias("class_node"), F.min("doc_id").alias("class_id")), "classes")
    # one document stands for its class: found by its own id, so that a class of very many copies is no group
    own = named.select(F.col("node").alias("doc_id"), "n", "prefix", "bits").join(classes.select(F.col("class_node").alias("doc_id")), "doc_id", "left_semi")
    own = stored(own.dropDuplicates(["doc_id"]), "own")  # on the join's partitions and order
    tiles = stored(tiles_of(own, percent, frequent), "tiles")
    groups = groups_of(tiles, percent)
    near = stored(group_links(groups, nodes, width, percent), "near")
    more = cross_pairs(tiles, connected_components(near), groups, percent)
    more = linked_pairs(bounded_pairs(more, own.select("doc_id", "n", "bits"), percent), nodes, width, percent)
    links = stored(near.unionByName(more), "links")
    found = connected_components(links)
    per_class = classes.join(found.select(F.col("node").alias("class_node"), "component"), "class_node", "left").withColumn("component", F.coalesce("component", "class_node"))
    if apart:  # then the least node may not be the least id
        per_class = per_class.join(per_class.groupBy("component").agg(F.min("class_id").alias("component_id")), "component")
    else:
        per_class = per_class.withColumn("component_id", F.col("component"))
    # texts without words stay out of this join; a class of many copies is one row on the right, so its rows can be split
    out = named.select("doc_id", *key).join(per_class.select(*key, "class_id", "component_id"), key)
    alone = sets.where("n = 0 or node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id").unionByName(alone)
