"""Language identification, word first: log frequencies of known words, shorter and shorter n-grams for all others."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_batches, unit_hash

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, lang_pred string, score double"


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters; numerals that Python counts as word characters may stand among them."""
    return _LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


@dataclass
class Model:
    """words and n-grams (by length) to a row of log frequencies, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: list[dict[str, int]]
    gram_rows: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the word's longest n-grams of which any is known; zeros if there is none."""
        for known, rows in zip(reversed(self.grams), reversed(self.gram_rows), strict=True):
            found = [known[g] for g in grams(word, len(next(iter(known), " "))) if g in known]
            if found:
                return rows[found].mean(axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)


def _rows(counts: DataFrame, languages: list[str], alpha: float) -> tuple[dict[str, int], np.ndarray]:
    """Of rows (key, lang, count): log frequency in each language, less the mean over languages (so that a key tells languages apart only)."""
    found = counts.toArrow()
    keys, at = np.unique(np.array(found.column(0).to_pylist(), dtype=object), return_inverse=True) if found.num_rows else (np.array([], dtype=object), np.zeros(0, np.int64))
    where = {x: k for k, x in enumerate(languages)}
    table = np.full((len(keys), len(languages)), alpha)
    table[at, [where[x] for x in found.column(1).to_pylist()]] += found.column(2).to_numpy()
    logs = np.log(table / table.sum(axis=0))
    return {k: i for i, k in enumerate(keys)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(labelled: DataFrame, *, docs_per_language: int = 600, longest: int = 4, seed: int = 5) -> Model:
    """A model from labelled(doc_id, text, lang): about docs_per_language documents of each language, by a seeded hash.

    That is the only bound: all words of these documents are known then, and all n-grams of 1 to `longest` characters in
    them, a word counting as the root of its number. Words and n-grams are counted in Spark; the model, a row of numbers
    for each and a column for each language, is on the driver and sent to the tasks. Null texts and null languages teach
    nothing; rows with one doc_id each count.
    """
    rows = labelled.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n_docs"))
    languages = sorted(r.lang for r in sizes.collect())
    if not languages:
        return Model([], {}, np.zeros((0, 0), np.float32), [], [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(piece.column("lang").to_pylist(), texts, strict=True):
                found[lang].update(letter_words(text.decode()))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())], ["lang", "word", "n"])

    sample = rows.join(F.broadcast(sizes), "lang").where(unit_hash(seed, F.col("doc_id")) * F.col("n_docs") < docs_per_language)  # a row for each language
    seen = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = stored(seen, "words")
    known, word_rows = _rows(seen.select("word", "lang", F.col("n").cast("double").alias("n")), languages, 0.5)
    padded, maps, tables = F.concat(F.lit(" "), "word", F.lit(" ")), [], []
    for n in range(1, longest + 1):
        size = F.lit(n)
        gram = F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda k: F.substring(padded, k, size)))  # noqa: B023
        counted = seen.where(F.length(padded) >= n).select(gram.alias("gram"), "lang", F.sqrt("n").alias("n")).groupBy("gram", "lang").agg(F.round(F.sum("n"), 6).alias("n"))
        ids, table = _rows(counted, languages, 0.5)
        maps.append(ids)
        tables.append(table)
    return Model(languages, known, word_rows, maps, tables)


class _Memory(dict):
    """Row numbers of words, those of unseen ones made as they come; forgets them when there are too many."""

    def __init__(self, model: Model, room: int = 300_000):
        super().__init__(model.words)
        self.model, self.room, self.extra = model, room, []

    def __missing__(self, word: str) -> int:
        self.extra.append(self.model.unseen(word))
        at = self[word] = len(self.model.words) + len(self.extra) - 1
        return at

    def table(self) -> np.ndarray:
        if not self.extra:
            return self.model.word_rows
        return np.concatenate([self.model.word_rows, np.array(self.extra, dtype=np.float32).reshape(-1, len(self.model.languages))])

    def full(self) -> bool:
        return len(self.extra) > self.room


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs(doc_id, text): lang_pred and score, the share of the best language's likelihood.

    A text that is null or has no letter is `und` with score 0, and so is any text if no language was learned. Of equal
    languages the first by name wins. All words of a text count. A null doc_id stays null; rows with one doc_id, repeated
    or not, are each judged by their own text; an empty table gives no rows; other columns, whatever their names, are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(model)
        table = memory.table()
        for piece, texts in slices(batches):
            if memory.full():
                memory = _Memory(model)
                table = memory.table()
            found, scores = [], []
            rows = []
            for text in texts:
                words = letter_words(text.decode())
                if not model.languages or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
                    rows.append(None)
                else:
                    rows.append(np.fromiter(map(memory.__getitem__, words), dtype=np.int64, count=len(words)))
            if len(table) < len(memory.model.words) + len(memory.extra):
                table = memory.table()
            for at in rows:
                if at is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table[at].sum(axis=0, dtype=np.float64)
                best = int(np.argmax(total))
                found.append(model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)
