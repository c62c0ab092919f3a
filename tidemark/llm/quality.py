"""Quality by attention-based multiple-instance learning: passages are encoded, weighed by gated attention, then scored.

A passage is encoded from what its words say, the mean of their learned embeddings, and from how it is written, counts
of kinds of characters, word lengths and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, text_batches, WordHashes
from .labelled import labelled_sample

SCORED = "doc_id long, score double, most_weight double"
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"|", b"#*$%&<>", b"\n", b":;()[]{}\"'=/\\_-@+~^`"]
_KIND = np.full(256, len(_CLASSES) + 1, dtype=np.int64)  # what is left: control characters and spaces
_KIND[128:] = len(_CLASSES)
for _k, _chars in enumerate(_CLASSES):
    _KIND[list(_chars)] = _k
_KINDS = len(_CLASSES) + 2
N_FEATURES = _KINDS + 9


BUCKETS = 1 << 16


@dataclass
class Bag:
    """The passages of a text: a row of counts for each, the buckets of all its words, and how many each passage has."""

    counts: np.ndarray
    words: np.ndarray
    sizes: np.ndarray


def passages(text: bytes, words_each: int) -> Bag:
    """Passages of words_each words, the whole text over; without words one of zeros. Words are bare of punctuation, A-Z lower-cased."""
    words = text.split()
    if not words:
        return Bag(np.zeros((1, N_FEATURES), np.float32), np.zeros(0, np.uint16), np.zeros(1, np.int64))
    n = len(words)
    cuts = np.arange(0, n, words_each)
    sizes = np.diff(np.append(cuts, n))
    raw = np.frombuffer(text, np.uint8)
    h, bucket = kept("quality", _Words).of(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    own = np.repeat(np.arange(len(cuts)), sizes)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    where = np.zeros(len(raw), dtype=np.int64)
    where[starts[cuts[1:]]] = 1
    where = np.cumsum(where)
    chars = np.bincount(where * _KINDS + _KIND[raw], minlength=len(cuts) * _KINDS).reshape(-1, _KINDS)[: len(cuts)]
    order = np.lexsort((h, own))
    repeated = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
    same = np.bincount(own[order][1:][repeated], minlength=len(cuts))
    twins = np.bincount(own[1:][h[1:] == h[:-1]], minlength=len(cuts))
    three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7) if n > 2 else h[:0]
    seen = np.ones(len(three), dtype=bool)
    seen[np.unique(three, return_index=True)[1]] = False  # all but a run's first time in the whole text
    again = np.bincount(own[: len(three)][seen], minlength=len(cuts))
    mean = np.bincount(own, lengths, minlength=len(cuts)) / sizes
    spread = np.sqrt(np.maximum(0, np.bincount(own, lengths.astype(float) ** 2, minlength=len(cuts)) / sizes - mean**2))
    short = np.bincount(own[lengths <= 2], minlength=len(cuts))
    total = np.maximum(1, chars.sum(axis=1))
    counts = np.column_stack([chars / total[:, None], same / sizes, twins / sizes, again / sizes, mean / 10, spread / 10, short / sizes, sizes / words_each, np.full(len(cuts), np.log1p(n) / 10), np.ones(len(cuts))]).astype(np.float32)
    return Bag(counts, bucket, sizes)


class _Words(WordHashes):
    """Hash of a word, and of what is left without case and punctuation around it as a bucket; both in one number's halves."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) & ~0xFFFF | xxhash.xxh3_64_intdigest(word.strip(_EDGES).lower()) & 0xFFFF
        return value

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = super().of(words)
        return both >> np.uint64(16), both.astype(np.uint16)


_EDGES = b".,;:!?\"'()[]{}*_-"


def mean_words(table: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of the words' rows of each passage; zeros for one without words."""
    out = np.zeros((len(sizes), table.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(table[words], (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class AttentionPool:
    """x = counts, mean of word embeddings W; h = tanh(E x), a ~ exp(w . (tanh(V h) * sigmoid(U h))), p = sigmoid(c . sum a h + b)."""

    NAMES = ("E", "V", "U", "w", "c", "b")

    def __init__(self, hidden: int, gate: int, seed: int, embedding: int = 8):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.W = np.zeros((BUCKETS, embedding), np.float32)  # a word that was not learned says nothing
        self.E, self.V, self.U = rng.normal(0, 0.3, (N_FEATURES + embedding, hidden)), rng.normal(0, 0.3, (hidden, gate)), rng.normal(0, 0.3, (hidden, gate))
        self.w, self.c, self.b = rng.normal(0, 0.1, gate), rng.normal(0, 0.1, hidden), np.zeros(1)

    def forward(self, bags: list[Bag]) -> dict[str, np.ndarray]:
        """All passages of all bags in a row; first and many say where each bag's are."""
        f = {"many": np.array([len(x.sizes) for x in bags]), "words": np.concatenate([x.words for x in bags]), "sizes": np.concatenate([x.sizes for x in bags])}
        first, many = f["first"], f["many"] = np.cumsum(f["many"]) - f["many"], f["many"]
        f["x"] = np.concatenate([(np.concatenate([x.counts for x in bags]) - self.mean) / self.scale, mean_words(self.W, f["words"], f["sizes"])], axis=1)
        f["h"] = np.tanh(f["x"] @ self.E)
        f["t"], f["g"] = np.tanh(f["h"] @ self.V), _sigmoid(f["h"] @ self.U)
        e = (f["t"] * f["g"]) @ self.w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), many))
        f["a"] = e / np.repeat(np.add.reduceat(e, first), many)
        f["z"] = np.add.reduceat(f["a"][:, None] * f["h"], first, axis=0)
        f["p"] = _sigmoid(f["z"] @ self.c + self.b)
        return f

    def gradients(self, f: dict[str, np.ndarray], err: np.ndarray) -> dict[str, np.ndarray]:
        """err: derivative of the loss by the score before the sigmoid, for each bag."""
        first, many = f["first"], f["many"]
        dz = np.repeat(err[:, None] * self.c, many, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), many))
        gated = de[:, None] * self.w
        dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ self.V.T + dg @ self.U.T
        dh = dh * (1 - f["h"] ** 2)
        dw = (dh @ self.E[N_FEATURES:].T) / np.maximum(1, f["sizes"])[:, None]  # of each passage, for any of its words
        spread = np.column_stack([np.bincount(f["words"], np.repeat(g, f["sizes"]), minlength=BUCKETS) for g in dw.T])
        return {"W": spread, "E": f["x"].T @ dh, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ err, "b": np.array([err.sum()])}

    def train(self, bags: list[Bag], y: np.ndarray, epochs: int, rate: float, penalty: float, seed: int) -> None:
        """Adam on the logistic loss, over the labels as they are."""
        rng = np.random.default_rng(seed)
        rows = np.concatenate([x.counts for x in bags])
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        names = ("W", *self.NAMES)
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), 128):
                at = order[lo : lo + 128]
                f = self.forward([bags[k] for k in at])
                step += 1
                for k, g in self.gradients(f, (f["p"] - y[at]) / len(at)).items():
                    value = getattr(self, k)
                    g = (g + penalty * value).astype(value.dtype)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    value -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", *, per_class: int = 2500, words_each: int = 48, hidden: int = 16, gate: int = 8, embedding: int = 8, epochs: int = 25, rate: float = 0.01, penalty: float = 1e-4, seed: int = 1) -> AttentionPool:
    """Learn from about per_class documents of each label, the bound of the sample, by all passages of each.

    Null and repeated labels and ids: see labelled_sample. Without any label the pool stays as it was made at random,
    and its scores mean nothing; with labels of one kind all scores lean to that one.
    """
    sample = labelled_sample(docs, labels, column, per_class)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            rows = [passages(x, words_each) for x in texts]
            parts = [pa.array([a.tobytes() for a in column], pa.binary()) for column in zip(*((r.counts, r.words, r.sizes) for r in rows), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), *parts], ["doc_id", "y", "counts", "words", "sizes"])

    model = AttentionPool(hidden, gate, seed, embedding)
    rows = sorted(sample.mapInArrow(encode, "doc_id long, y int, counts binary, words binary, sizes binary").collect(), key=lambda r: (r.doc_id, r.y, r.words))
    if rows:
        bags = [Bag(np.frombuffer(r.counts, np.float32).reshape(-1, N_FEATURES), np.frombuffer(r.words, np.uint16), np.frombuffer(r.sizes, np.int64)) for r in rows]
        model.train(bags, np.array([r.y for r in rows]), epochs, rate, penalty, seed)
    return model


def score(docs: DataFrame, model: AttentionPool, words_each: int = 48) -> DataFrame:
    """Per row of docs(doc_id, text): score, higher for likelier good, and the largest attention weight of a passage.

    All passages of the whole text count. A null or empty text, or one of white space, is one passage of zeros, so all of
    these score alike. A null doc_id stays null; rows with one doc_id, repeated or not, are each scored by their own
    text; an empty table gives no rows; other columns, whatever their names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            f = model.forward([passages(x, words_each) for x in texts])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(f["p"], pa.float64()), pa.array(np.maximum.reduceat(f["a"], f["first"]), pa.float64())], ["doc_id", "score", "most_weight"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)
