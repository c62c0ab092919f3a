"""Toxicity by a factorization machine over hashed terms: linear weights and pairwise interactions of terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, kept, kept_rows, slices, text_batches, WordHashes
from .decontaminate import words
from .labelled import labelled_sample

SCORED = "doc_id long, score double"


def terms(text: bytes, bits: int) -> np.ndarray:
    """Hashed distinct words, lower-cased where they are ASCII, and hashed beginnings of 4 and 5 bytes of longer words."""
    own = set(words(text))
    begin = {w[:4] + b"-" for w in own if len(w) > 4} | {w[:5] + b"-" for w in own if len(w) > 5}
    return np.unique(kept("toxicity", WordHashes).of([*own, *begin]) & U64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Machine:
    """terms, sorted; a bias, a weight and a factor row for each."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        """Logistic of bias + sum of weights + sum over pairs of <factor, factor>, for distinct sorted terms."""
        at = places(self.terms, found)
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + pairs, -35, 35))))


def places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of `found` that are known stand in `known`; both are sorted and distinct."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.searchsorted(known, found)
    return at[known[np.minimum(at, len(known) - 1)] == found]


@dataclass
class Rows:
    """Documents by terms, 0 or 1, sparse: document k has the terms found[first[k] : first[k + 1]]; a term counts `scale` where it is found."""

    found: np.ndarray
    first: np.ndarray
    scale: np.ndarray

    @classmethod
    def dense(cls, x: np.ndarray) -> Rows:
        return cls(np.nonzero(x)[1], np.concatenate([[0], np.cumsum((x != 0).sum(axis=1))]), np.ones(x.shape[1], np.float32))


def train(x: np.ndarray | Rows, y: np.ndarray, rank: int, steps: int, rate: float, penalty: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the class-balanced logistic loss; x is documents by terms, 0 or 1. The scale is in the weights and factors returned.

    Gradients are sparse: a step reads and changes the rows of the terms in its documents alone.
    """
    rng = np.random.default_rng(seed)
    rows = x if isinstance(x, Rows) else Rows.dense(x)
    n, scale = len(rows.scale), rows.scale
    bias, bias_first, bias_second = 0.0, 0.0, 0.0
    # of each term its factors, then its weight
    params = np.concatenate([rng.normal(0, 0.01, (n, rank)), np.zeros((n, 1))], axis=1).astype(np.float32)
    first, second = np.zeros_like(params), np.zeros_like(params)
    met, place = np.zeros(n, bool), np.zeros(n, np.int64)
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    for step in range(1, steps + 1):
        at = rng.choice(len(y), min(256, len(y)), replace=False)
        sizes = rows.first[at + 1] - rows.first[at]
        begins = np.cumsum(sizes) - sizes
        t = rows.found[np.repeat(rows.first[at] - begins, sizes) + np.arange(sizes.sum())].astype(np.int64)
        met[t] = True
        used = np.flatnonzero(met)
        met[used] = False
        place[used] = np.arange(len(used))
        t = place[t]
        s = scale[used, None]
        p = params[used]
        v = p * s
        own = v.copy()
        own[:, rank] -= 0.5 * np.einsum("ij,ij->i", v[:, :rank], v[:, :rank])
        sums = np.zeros((len(at), rank + 1), np.float32)
        if len(t):
            sums[sizes > 0] = np.add.reduceat(own[t], begins[sizes > 0], axis=0)
        out = bias + sums[:, rank] + 0.5 * (sums[:, :rank] ** 2).sum(axis=1)
        err = (weight[at] * (1 / (1 + np.exp(-np.clip(out, -35, 35))) - y[at]) / len(at)).astype(np.float32)
        sums[:, rank] = 1
        if len(t):
            back = err[:, None] * sums
            grad = np.column_stack([np.bincount(t, np.repeat(back[:, k], sizes), minlength=len(used)) for k in range(rank + 1)]).astype(np.float32)
            grad[:, :rank] -= v[:, :rank] * grad[:, rank:]
            grad = grad * s + np.float32(penalty) * p
            m, q = first[used], second[used]
            m += np.float32(0.1) * (grad - m)
            q += np.float32(0.001) * (grad * grad - q)
            first[used], second[used] = m, q
            params[used] = p - np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(q * np.float32(1 / (1 - 0.999**step))) + np.float32(1e-8))
        g = float(err.sum())
        bias_first += 0.1 * (g - bias_first)
        bias_second += 0.001 * (g * g - bias_second)
        bias -= rate / (1 - 0.9**step) * bias_first / ((bias_second / (1 - 0.999**step)) ** 0.5 + 1e-8)
    own = params * scale[:, None]
    return float(bias), own[:, rank].copy(), own[:, :rank].copy()


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", *, per_class: int = 4000, bits: int = 22, rank: int = 8, steps: int = 600, rate: float = 0.02, penalty: float = 1e-4, seed: int = 3) -> Machine:
    """Learn from about per_class documents of each label (the bound of the sample) and all terms of these.

    Terms are counted over the sample in Spark. None is left out: the scale of a term depends on its own chi-square
    alone, near 0 for what chance gives and half of the most at 30, so that hundreds of thousands of terms that tell
    nothing can't be learned by heart. Two documents less than were met count, as one or two may be chance. Without documents of both labels the machine scores all alike: 0.5, or the only
    label's side of it. Null and repeated labels and ids: see labelled_sample.
    """
    sample = labelled_sample(docs, labels, column, per_class)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            for y, text in zip(piece.column("y").to_pylist(), texts, strict=True):
                t = terms(text, bits)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), y, np.int32))], ["term", "y"])

    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not pos or pos == n:
        return Machine(np.zeros(0, np.int64), 0.0 if not n else 2.0 if pos else -2.0, np.zeros(0), np.zeros((0, rank)))
    counts = sample.select("y", "text").mapInArrow(each, "term long, y int").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    gap = F.greatest(F.abs(F.col("p") - F.col("n") * F.lit(pos / n)) - 2, F.lit(0.0))
    chi = gap * gap * n / (F.col("n") * F.lit(pos / n * (1 - pos / n)) * (F.lit(n) - F.col("n") + 1))
    told = counts.select("term", chi.alias("chi")).toArrow().sort_by("term")
    chosen, telling = told.column("term").to_numpy(), told.column("chi").to_numpy()
    scale = ((telling + 0.1) / (telling + 30)).astype(np.float32)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            rows = [places(chosen, terms(t, bits)).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "at"])

    rows = sorted(sample.mapInArrow(known, "doc_id long, y int, at binary").collect(), key=lambda r: (r.doc_id, r.y, r.at))
    found = [np.frombuffer(r.at, np.int32) for r in rows]
    x = Rows(np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])]), scale)
    return Machine(chosen, *train(x, np.array([r.y for r in rows]), rank, steps, rate, penalty, seed))


def score(docs: DataFrame, machine: Machine, bits: int = 22) -> DataFrame:
    """Per row of docs(doc_id, text): score, higher for likelier toxic; a null or empty text has no terms but the bias.

    All terms of the whole text count. A null doc_id stays null; rows with one doc_id, repeated or not, are each scored
    by their own text; an empty table gives no rows; other columns, whatever their names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([machine.score(terms(x, bits)) for x in texts], pa.float64())], ["doc_id", "score"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def drop_toxic(docs: DataFrame, machine: Machine, cut: float = 0.5, bits: int = 22) -> DataFrame:
    """The rows of docs that score below cut, with all their columns; each row is judged by its own text, whatever its id."""
    return kept_rows(docs, lambda texts: np.array([machine.score(terms(x, bits)) < cut for x in texts], dtype=bool))
