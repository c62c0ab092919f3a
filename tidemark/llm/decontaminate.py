"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items, one scan of a text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, kept_rows, slices, stored, text_batches

#: Lower-cases A-Z; every ASCII byte that is neither letter nor digit becomes a space; the rest stays, byte for byte.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:long,last:long,from_byte:long,to_byte:long>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: bytes, width: int) -> set[bytes]:
    """Runs of `width` consecutive words, each word between spaces; the whole where there are fewer words."""
    w = words(text)
    return {b" " + b" ".join(w[k : k + width]) + b" " for k in range(max(1, len(w) - width + 1))} if w else set()


def automaton(patterns: dict[bytes, list[str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, items in patterns.items():
        a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, items))
    a.make_automaton()
    return a


def scan(text: bytes, found) -> tuple[int, np.ndarray, list[str], list[tuple[int, int, int, int]]]:
    """Number of words, flags of the hit words, items, and spans of hit words with byte offsets in the text as it was."""
    flat = text.translate(_NORMAL)
    w = flat.split()
    matches = list(found.iter((b" " + b" ".join(w) + b" ").decode("latin-1"))) if w else []
    hit = np.zeros(len(w) + 1, dtype=np.int64)
    if not matches:
        return len(w), hit[:-1] > 0, [], []
    ends = np.cumsum([len(x) + 1 for x in w])  # where the space after each word stands in the joined text
    for (_, (n, _)), last in zip(matches, np.searchsorted(ends, [e for e, _ in matches]), strict=True):
        hit[last - n + 1] += 1
        hit[last + 1] -= 1
    flags = np.cumsum(hit)[:-1] > 0
    solid = np.concatenate([[False], np.frombuffer(flat, np.uint8) != 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])  # the normal form has as many bytes as the text, so these are the text's own offsets
    runs = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    spans = [(int(a), int(b) - 1, int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in zip(runs[::2], runs[1::2], strict=True)]
    return len(w), flags, sorted({x for _, (_, items) in matches for x in items}), spans


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, batch_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs(doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, items, spans of hit words.

    benchmark has item_id and text, question and answer together. Words are lower-cased runs of ASCII letters, digits
    and all other than ASCII characters. The windows of the items are scanned for in one automaton, which each worker
    builds from the items' texts. Only where windows would take more than batch_bytes are the items split over several
    automata, each for a scan of the texts, whose rows are first written with a number each, by which the results are
    put together. A null text has no words; items without words have no windows; items that repeat count once; a null
    item_id reads as an empty string; empty tables give no hits or no rows. Rows with one doc_id, or a null one, are
    each judged by themselves. Other columns are left out.
    """
    items = _items(benchmark)
    passes = _passes(items, width, batch_bytes)
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if passes == 1:
        return docs.mapInArrow(_scanner(_texts(items), width), FOUND)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for k in range(passes):
        part = _texts(items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k))
        one = docs.mapInArrow(_scanner(part, width, keep_row=True), f"{FOUND}, row long")
        found = one if found is None else found.unionByName(one)
    return _merge(stored(found, "decontaminate"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, batch_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns; see find_contamination."""
    items = _items(benchmark)
    passes = _passes(items, width, batch_bytes)
    for k in range(passes):
        found = _automata(_texts(items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)), width)
        docs = kept_rows(docs, lambda texts, found=found: np.array([(a := found()) is None or not scan(x, a)[2] for x in texts], dtype=bool))
    return docs


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text <> ''").distinct()


def _passes(items: DataFrame, width: int, batch_bytes: int) -> int:
    size = items.agg(F.sum(F.octet_length("text").cast("long") * width)).first()[0] or 0
    return max(1, -(-size // batch_bytes))


def _texts(items: DataFrame) -> list[tuple[str, bytes]]:
    return sorted((r.item, r.text.encode()) for r in items.collect())  # at most batch_bytes / width of text


def _automata(texts: list[tuple[str, bytes]], width: int):
    """Gives the automaton of the items' windows, None without any; made once in each worker process."""
    key = hashlib.sha256(repr((texts, width)).encode()).hexdigest()

    def make():
        patterns: dict[bytes, set[str]] = {}
        for item, text in texts:
            for p in windows(text, width):
                patterns.setdefault(p, set()).add(item)
        return automaton({p: sorted(x) for p, x in sorted(patterns.items())}) if patterns else None

    return lambda: kept(("automaton", key), make)


def _scanner(texts: list[tuple[str, bytes]], width: int, keep_row: bool = False):
    automata = _automata(texts, width)
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automata()
        for piece, raw in slices(batches):
            got = [scan(x, found) if found is not None else (len(words(x)), np.zeros(0, bool), [], []) for x in raw]
            columns = [
                piece.column("doc_id"),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([int(x[1].sum()) for x in got], pa.int64()),
                pa.array([len(x[2]) for x in got], pa.int64()),
                pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in got], pa.string()),
                pa.array([bool(x[2]) for x in got], pa.bool_()),
                pa.array([x[2] for x in got], pa.list_(pa.string())),
                pa.array([[dict(zip(("first", "last", "from_byte", "to_byte"), s, strict=True)) for s in x[3]] for x in got], spans_type),
            ]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
            if keep_row:
                columns.append(piece.column("row"))
                names.append("row")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _merge(found: DataFrame) -> DataFrame:
    """One row for each row of the documents, from those of several passes; spans of different passes may overlap."""
    both = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
    )
    # spans sorted by their first word; a span that begins within or right after the one before lengthens it
    joined = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"), F.element_at(acc, -1)["from_byte"].alias("from_byte"), F.greatest(F.element_at(acc, -1)["to_byte"], s["to_byte"]).alias("to_byte"))))).otherwise(F.concat(acc, F.array(s))),
    )
    both = both.withColumn("spans", joined)
    return both.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "items",
        "spans",
    )
