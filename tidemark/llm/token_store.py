"""Token ids in binary shards: one zstandard frame a document, all with a shared dictionary, and an offset index.

Layout of a store, a folder that Spark's readers and writers alone touch (so any file system will do):

``dictionary/``  one row: sha256, the dictionary's bytes, id width, end id.
``shards/``      rows (part, seq, first_doc, last_doc, n_docs, start_in_part, n_tokens, image), in ascending doc_id order.

A shard image is little-endian: magic ``TMK1``, id width (u32), documents n (u32), sha256 of the dictionary (32
bytes), doc ids (i64 x n), null flags of the ids (u8 x n), token counts (u32 x n), frame offsets (u64 x n+1), frames.
A frame holds one document's ids, end id included, as u16 or u32. To read a short document, one needs its shard's
row (statistics of first_doc and last_doc prune the rest), the index and that one frame.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, scratch, slices, text_batches, unit_hash

MAGIC = b"TMK1"
SHARDS = "part int, seq long, first_doc long, last_doc long, n_docs long, start_in_part long, n_tokens long, image binary"
ENCODED = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
#: White space other than the space and the line feed.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def single_spaced(text: str) -> bool:
    """Whether each space stands between two characters other than space and line feed."""
    return not (text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text)


#: Letters, in a pattern's brackets; those beyond ASCII and these blocks are odd.
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: What is neither letter nor odd, in a pattern's brackets: ASCII but for the apostrophe and rare white space, Latin-1's signs, punctuation, currencies.
_PLAIN = "\x00-\x08\n\x0e-\x1b -&(-\x7f\xa1-\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"


def patterns(added: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """Of odd characters, and of the units of a single-spaced text without anything odd.

    A unit is a run of letters or of no letters, with the space before it; a byte-level pre-tokenizer always cuts there,
    whatever stands around. What is odd could make it cut otherwise: an apostrophe, which takes letters into its piece;
    letters of other scripts; where an added token may begin; line feeds in a row, which are pieces by what follows.
    """
    fine = "".join(re.escape(chr(c)) for c in range(0x20C0) if re.match(f"[{_LATIN}{_PLAIN}]", chr(c)) and chr(c) not in {x[0] for x in added})
    return re.compile(f"[^{fine}]"), re.compile(f" ?[{_LATIN}]+| ?[^{_LATIN} ]+")


class Encoder:
    """Ids of whole texts by a tokenizers file, without special tokens added, as little-endian u32 bytes.

    A byte-level pre-tokenizer cuts a text at known places (see `patterns`), so what stands between them is encoded once
    and remembered while there is room: a unit is fresh when first met and known from the second time, and fresh ones go
    first, so that frequent units stay; where known ones alone fill three quarters, they have to be met again. Unseen
    units are encoded many at a time, found again by the ids that begin with a space, or are a line feed put before them. A
    text with any other kind of space goes to the library as a whole, and with any other kind of tokenizer all texts do.
    """

    def __init__(self, path: str, room: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.known, self.fresh = Tokenizer.from_file(path), room, {}, {}
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        self.by_unit = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not made["normalizer"] and not made["truncation"] and not made["padding"]
            and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or set(x["content"]) & {" ", "\n"} for x in made["added_tokens"])
        )
        self.odd, self.units = patterns([x["content"] for x in made["added_tokens"]])
        self.newline = self.one("\n")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.by_unit = self.by_unit and made["model"]["type"] == "BPE" and self.newline == struct.pack("=I", vocab.get("\u010a", -1 % 2**32))  # as byte-level pieces have a line feed
        self.spaced = np.zeros(self.tokenizer.get_vocab_size() + 1 + max(vocab.values(), default=0), bool)
        self.spaced[[k for x, k in vocab.items() if x[:1] == "\u0120"]] = True  # and a space
        self.spaced[[x["id"] for x in made["added_tokens"]]] = False

    def one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        odd = self.odd.search(text) or "\n\n" in text
        if not self.by_unit or not single_spaced(text) or (odd and _RARE.search(text)):
            return self.one(text)
        units = self._cut(text) if odd else self.units.findall(text)
        found = list(map(self.known.get, units))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            learnt = self._learn({units[k] for k in missing})
            for k in missing:
                found[k] = learnt[units[k]]
        return b"".join(found)

    def _cut(self, text: str) -> list[str]:
        """Units of a text with something odd: what stands between two spaces is one where anything in it is odd."""
        out: list[str] = []
        for k, word in enumerate(text.split(" ")):
            word = f" {word}" if k else word
            if self.odd.search(word) or "\n\n" in word:
                out.append(word)
            else:
                out += self.units.findall(word)
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are not known, from now on remembered."""
        if len(self.known) + len(self.fresh) > self.room:
            self.fresh, self.known = (self.known, {}) if len(self.known) > self.room * 3 // 4 else ({}, self.known)
        again, first, some = {}, {}, []
        for x in units:
            ids = self.fresh.pop(x, None)
            if ids is not None:
                again[x] = ids
            elif "\n" in x:
                first[x] = self.one(x)
            else:
                some.append(x if x[0] == " " else f"\n{x}")
        for k in range(0, len(some), 4096):
            self._encode(some[k : k + 4096], first)
        self.known.update(again)
        self.fresh.update(first)
        return again | first

    def _encode(self, some: list[str], out: dict[str, bytes]) -> None:
        """Ids of units, encoded one after another: ids that begin with a space, or are a line feed, begin each."""
        (got,) = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)  # without offsets
        raw = array("I", got.ids).tobytes()
        ids = np.frombuffer(raw, "<u4")
        begins = (4 * np.flatnonzero(self.spaced[ids] | (ids == np.frombuffer(self.newline, "<u4")))).tolist()
        if len(begins) != len(some):  # a space or a line feed begins no id of its own somewhere among these
            out.update((x, self.one(x)) for x in (x.removeprefix("\n") for x in some))
            return
        for x, start, end in zip(some, begins, [*begins[1:], len(raw)], strict=True):
            if x[0] == " ":
                out[x] = raw[start:end]
            else:
                out[x[1:]] = raw[start + 4 : end]


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, size: int, n_docs: int, seed: int = 23) -> bytes:
    """A zstandard dictionary from the whole id arrays of about n_docs documents, drawn from all by a seeded hash of id and text.

    It bears on the size of the files alone. Where the sample is too small to train on, its own bytes are the dictionary.
    """
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(encode(x.decode()), "<u4").astype(f"<u{width}").tobytes() for x in texts], pa.binary())], ["ids"])

    some = docs.where("text <> ''")
    drawn = unit_hash(seed, F.col("doc_id"), F.col("text"))
    share = n_docs / max(1, docs.count())  # of Parquet from the footers
    chosen = some.where(drawn < share).select("text").distinct() if share < 1 else some.select("text").distinct()
    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(run, "ids binary").collect() if r.ids)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def pack(docs: list[tuple[int | None, bytes]], width: int, sha: bytes, compressor) -> tuple[bytes, int]:
    """The image of one shard, and the number of ids in it."""
    frames = [compressor.compress(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()) for _, ids in docs]
    counts = np.array([len(ids) // 4 for _, ids in docs], "<u4")
    index = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes() + counts.tobytes() + np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes()
    return b"".join([MAGIC, struct.pack("<II", width, len(docs)), sha, index, *frames]), int(counts.sum())


def unpack(image: bytes, raw: bytes, only: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """doc_id, ids before it in the shard, ids as little-endian u32, of all documents or of those asked for alone."""
    import zstandard

    width, n = struct.unpack_from("<II", image, 4)
    if image[:4] != MAGIC or image[12:44] != hashlib.sha256(raw).digest():
        raise ValueError("not a shard of this store: magic or dictionary hash differ")
    at = 44
    parts = []
    for kind, m in (("<i8", n), ("u1", n), ("<u4", n), ("<u8", n + 1)):
        parts.append(np.frombuffer(image, kind, m, at))
        at += parts[-1].nbytes
    doc_ids, nulls, counts, offsets = parts
    starts = np.cumsum(counts, dtype=np.int64) - counts
    reader = zstandard.ZstdDecompressor(dict_data=dictionary(raw))
    for k in range(n):
        doc = None if nulls[k] else int(doc_ids[k])
        if only is None or doc in only:
            ids = np.frombuffer(reader.decompress(image[at + int(offsets[k]) : at + int(offsets[k + 1])]), f"<u{width}")
            if len(ids) != counts[k]:
                raise ValueError(f"document {doc}: {len(ids)} ids, the index has {counts[k]}")
            yield doc, int(starts[k]), ids.astype("<u4").tobytes()


def write_store(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 0, level: int = 3, dict_bytes: int = 64 << 10, dict_docs: int = 1000, shard_docs: int = 512, shard_bytes: int = 4 << 20) -> None:
    """Encode docs(doc_id long, text) and write them to a new store at path, in ascending doc_id order.

    Other columns are left out. Null texts count as empty; each document ends with end_id, so an empty one has one id.
    Rows with one doc_id all stay, ordered by a hash of the text; a null doc_id comes first. An empty table gives a
    store without shards. A shard holds up to shard_docs documents and, unless one alone is longer, shard_bytes of ids.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    raw = train_dictionary(docs, tokenizer_path, width, dict_bytes, dict_docs)
    sha, end = hashlib.sha256(raw).digest(), struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, compressor = encoder(tokenizer_path), zstandard.ZstdCompressor(level=level, dict_data=dictionary(raw))
        part, seq, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, held, size
            image, n = pack(held, width, sha, compressor)
            known = [d for d, _ in held if d is not None]
            row = [part, seq, min(known, default=None), max(known, default=None), len(held), start, n, image]
            seq, start, held, size = seq + 1, start + n, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.int64()] * 6, pa.binary()], strict=True)], ["part", "seq", "first_doc", "last_doc", "n_docs", "start_in_part", "n_tokens", "image"])

        for piece, texts in slices(batches):
            for doc, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                ids = encode(text.decode()) + end
                if held and (len(held) >= shard_docs or size + len(ids) > shard_bytes):
                    yield shard()
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield shard()

    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(sha), bytearray(raw), width, end_id)], "sha256 binary, raw binary, width int, end_id long").coalesce(1).write.parquet(f"{path}/dictionary")


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32, ids (little-endian u32, if asked for) of all documents, or of doc_ids alone."""
    (kept,) = spark.read.parquet(f"{path}/dictionary").collect()
    raw = bytes(kept.raw)
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    # one row for each part, not for each document: a running sum over them is small
    base = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    only = None if doc_ids is None else set(doc_ids)
    if only is not None:
        within = F.lit(False)
        for _, run in groupby(enumerate(sorted(only)), lambda x: x[1] - x[0]):
            run = [d for _, d in run]
            within = within | ((F.col("first_doc") <= run[-1]) & (F.col("last_doc") >= run[0]))
        shards = shards.where(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = list(unpack(row["image"], raw, only))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in got], pa.int64()), pa.array([row["start"] + x[1] for x in got], pa.int64()), pa.array([len(x[2]) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x[2]) for x in got], pa.int64()), pa.array([x[2] if with_ids else None for x in got], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return shards.join(base, "part").select("image", (F.col("base") + F.col("start_in_part")).alias("start")).mapInArrow(run, ENCODED)


def encode_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs to a store in the shared folder and give what reading it back shows: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer_path)
    return read_store(docs.sparkSession, path, with_ids=False).drop("ids")
