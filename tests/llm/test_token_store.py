import random
import zlib

import numpy as np
import pytest
from conftest_llm import docs_of

from tidemark.llm import token_store as ts
from tidemark.llm.common import scratch
from tidemark.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a", "Two words.", "two  spaces", "tab\there", " edge ", "line\nline", "É漢🙂 \x00", "<|endoftext|> x <|endoftext|>", "it's we'll", "12 345,6", "word " * 30_000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def want(tokenizer, rows):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    rows = list(enumerate(TEXTS * 3))
    shuffled = random.Random(1).sample(rows, len(rows))
    got = ts.encode_and_read(docs_of(spark, shuffled).repartition(5), tokenizer_path())
    assert sorted(tuple(r) for r in got.collect()) == want(tokenizer, rows)


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "1", ".", "!", "\xa0", "\r", "<|endoftext|>", "漢", "\x1c", "\x00", "🙂", " the", " ", "\x85"]
    encode = ts.Encoder(tokenizer_path(), room=40)
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_falls_back_to_single_words(tokenizer):
    """Where line feeds between words can't be found among the ids, each word is encoded by itself."""
    encode = ts.Encoder(tokenizer_path())
    encode.newline = b"\xff\xff\xff\x7f"
    text = "some words that it has not met before"
    assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_library_on_odd_characters(tokenizer):
    """Where letters, apostrophes, digits, signs, line feeds and an added token meet, and units are forgotten and met again."""
    rng = random.Random(6)
    parts = ["it", "Word", "é", "ß", "ł", "漢", "я", "'s", "'", "’", "'ll", "7", "½", "²", "ª", "\u0301", "—", "€", "_", ",", "...", " ", " ", " ", "\n", "\n\n", "<|endoftext|>", "<", "\t", "\x0b", "\x1f", "Ġ", "Ċ", "\u2028", "\xad"]
    for room in (12, 400_000):
        encode = ts.Encoder(tokenizer_path(), room=room)
        for _ in range(6000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
            assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_encoder_gives_the_library_each_run_of_letters_once(tokenizer):
    """Words that differ in what stands behind them share their letters, also where they first meet in one text."""
    encode = ts.Encoder(tokenizer_path())
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

        def encode(self, text, **how):
            given.append(text)
            return tokenizer.encode(text, **how)

    encode.tokenizer = Counted()
    stems = [f"{x}{y}{z}ing" for x in "abcde" for y in "fghij" for z in "klmno"]
    text = " ".join(stem + end for end in ("", ",", ".", "!!", ".###", ",%%%", ".\nThe") for stem in stems)
    assert encode(text) == encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert sum(map(len, given)) < 1.1 * sum(len(x) + 1 for x in stems)
    assert len(encode.known) + len(encode.fresh) < 1.1 * len(stems)


def test_dictionary_is_the_same_on_any_partitions(spark):
    docs = docs_of(spark, [(k, f"text {k} " * (1 + k % 50)) for k in range(3000)]).select("doc_id", "text")
    made = {ts.train_dictionary(d, tokenizer_path(), 2, 4096, 500) for d in (docs, docs.repartition(7, "text"))}
    assert len(made) == 1
    assert len(made.pop()) > 0


def test_single_documents(spark, tokenizer):
    rows = [(k, f"document {k} of some words") for k in range(2000)]
    path = scratch(spark, "test")
    ts.write_store(docs_of(spark, rows), path, tokenizer_path(), shard_docs=64)
    got = ts.read_store(spark, path, doc_ids=[1999, 3, 4, 77]).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == [w for w in want(tokenizer, rows) if w[0] in (3, 4, 77, 1999)]
    assert tokenizer.decode(np.frombuffer(got[0].ids, "<u4")[:-1].tolist()) == "document 3 of some words"
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.agg({"n_docs": "max"}).first()[0] == 64
    with pytest.raises(ValueError, match="dictionary hash"):
        list(ts.unpack(bytes(shards.first().image), b"another"))


def test_repeated_null_and_no_rows(spark, tokenizer):
    rows = [(7, "same"), (7, "same"), (7, None), (None, "no id")]
    got = ts.encode_and_read(docs_of(spark, rows), tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 7, 7, 7]
    assert sum(r.n_tokens for r in got) == sum(w[2] for w in want(tokenizer, rows))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert ts.encode_and_read(docs_of(spark, []), tokenizer_path()).collect() == []
