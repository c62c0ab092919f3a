"""What the operators of this subpackage share: scratch tables, text slices, word hashes, folds."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.scratch import scratch

U64 = np.uint64
#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ has it.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_SLICE_ROWS, _SLICE_BYTES = 256, 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 48)) / F.lit(float(1 << 48))


def text_batches(docs: DataFrame, most: int = 8 << 20) -> DataFrame:
    """docs; from now on the session sends rows to Python in batches of `most` bytes, or fewer if that was set, as texts may be long."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key, "64m")).lower()
    if not re.fullmatch(r"[0-9]+b?", now) or int(now.rstrip("b")) > most:
        conf.set(key, str(most))
    return docs


def give_back() -> None:
    """Free memory of this worker process goes back to the machine: processes wait between tasks, and others need it then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that a piece holds few rows and, unless one text alone is longer, few MB; null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            ahead = np.cumsum(lengths[at : at + _SLICE_ROWS])
            n = max(1, int(np.searchsorted(ahead, _SLICE_BYTES, side="right")))
            part = batch.slice(at, n)
            yield part, [x or b"" for x in part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
            at += n
    give_back()


_held: list[Any] = [None, None]


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between its tasks: one thing alone, so that operators which take turns in a process don't add up."""
    if _held[0] != key:
        _held[:] = None, None
        _held[:] = key, make()
    return _held[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection, so distinct values stay distinct."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered while there is room."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lower_words(text: bytes) -> list[bytes]:
    """Words of the text with A-Z lower-cased; bytes.split() splits at just the six ASCII white spaces."""
    return text.translate(_LOWER).split()


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Those for a longer text than `most` are not kept, as a worker process lives on."""
        if len(self.up) >= n:
            return self.up, self.down
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, dtype=np.uint64)]), dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        if n <= most:
            self.up, self.down = up, down
        return up, down


_BYTE = mixed(np.frombuffer(_LOWER, np.uint8).astype(np.uint64) + U64(0x51_7C_C1_B7_27_22_0A_95))  # A-Z count as a-z


def shingle_sets(texts: list[bytes], width: int = 5, at_once: int = 1 << 19) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of runs of `width` words, A-Z lower-cased.

    Of fewer words the whole sequence is one run; a text without words has an empty set. Words are hashed as
    polynomials over their bytes, all of about at_once bytes of texts together.
    """
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        some, size = [], 0
        while k < len(texts) and (not some or size + len(texts[k]) < at_once):
            some.append(texts[k])
            size += len(texts[k]) + 1
            k += 1
        raw = np.frombuffer(b" ".join(some) + b" ", np.uint8)
        up, down = kept("powers", _Powers).to(len(raw))
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        h = mixed((sums[ends] - sums[starts]) * down[starts])
        begins = np.cumsum([0, *(len(x) + 1 for x in some)])
        first = np.searchsorted(starts, begins)  # of each text, among all words
        n = len(h) - width + 1
        runs = np.zeros(max(0, n), dtype=np.uint64)
        for j in range(width if n > 0 else 0):
            runs = mixed(runs * U64(_ODD) + h[j : j + n])
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo >= width:
                out.append(np.unique(runs[lo : hi - width + 1]))
            else:
                whole = np.zeros(1, dtype=np.uint64)
                for x in h[lo:hi]:
                    whole = mixed(whole * U64(_ODD) + x)
                out.append(mixed(whole + U64(hi - lo)) if hi > lo else whole[:0])
    return out


def kept_rows(docs: DataFrame, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of docs whose text keep() flags, whole and in place: nothing is shuffled or joined; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            yield piece.filter(pa.array(np.asarray(keep(texts), dtype=bool)))

    return text_batches(docs).mapInArrow(run, docs.schema)
