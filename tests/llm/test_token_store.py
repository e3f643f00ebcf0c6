"""op2: encoding against the library, exact round trips and edge cases."""

import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkmeter.llm import token_store as T
from inkmeter.llm.queries import tokenizer_path
from inkmeter.session import scratch_path

PATH = tokenizer_path()
PARTS = [" ", "  ", "the", " andé", "ª", "aʼb", "\n", "\t", "a", "é", "don't", "1", "12", ".", ",", "%%%", "x'", "'s", "ß", "漢字",
         "\x1c", "\x0b", "\xa0", " ", "<|endoftext|>", " .", "é", "_", "²", "THE!!", "\r\n", "$$$", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_library(library):
    enc = T.Encoder(PATH, bound=300)  # a small table, so that it turns over
    rng = random.Random(7)
    for _ in range(8_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_text_in_segments(library, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 50)
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(150))
        assert np.frombuffer(T.Encoder.__call__(T.encoder(PATH), text), "<u4").tolist() == \
            library.encode(text, add_special_tokens=False).ids


def expected(rows, library):
    rows = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    out, at = [], 0
    for k, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 1 << 12)
    rng = random.Random(9)
    rows = [(i * 3 - 50, " ".join(rng.choice(["the", "an", "of", "idiot,", "été."]) for _ in range(rng.randint(0, 200))))
            for i in range(120)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "word " * 50_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("key", F.lit(1))
    folder = scratch_path(spark, "test-tokens")
    manifest = T.write_store(docs, folder, PATH)
    assert manifest.count() > 8
    got = T.read_store(manifest, folder).collect()
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(
        expected(rows, library), key=str)
    one = next(r for r in got if r.doc_id == 1002)  # one document alone
    ids = T.read_ids(folder, one.file, one.row)
    assert ids.tolist() == library.encode("word " * 50_000, add_special_tokens=False).ids + [2]


def test_repeated_ids_are_all_written(spark, library):
    rows = [(5, "same")] * 40 + [(5, f"other {i}") for i in range(20)] + [(6, "last")]
    got = T.store_and_read(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 61 and sum(r.n_tokens for r in got) == sum(r[2] for r in expected(rows, library))
    assert next(r.start for r in got if r.doc_id == 6) == sum(r.n_tokens for r in got if r.doc_id == 5)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_table(spark):
    assert T.store_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_shard_names_its_dictionary():
    data = T.MAGIC + b"\0" * 32 + b"\2" + zlib.compress(b"") + (0).to_bytes(8, "little") + T.MAGIC
    with pytest.raises(ValueError):
        T.open_shard(data, b"another dictionary")
    assert isinstance(T.train_dictionary([b"abc"]), bytes)
    samples = [np.arange(i, i + 300, dtype="<u2").tobytes() for i in range(200)]
    assert zstandard.ZstdCompressionDict(T.train_dictionary(samples)).dict_id() > 0
