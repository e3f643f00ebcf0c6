"""Token ids as binary shards: one shared zstandard dictionary, one compressed frame per document.

A store is a folder with

- ``dictionary.zdict``: the zstandard dictionary, trained on serialised id arrays of a bounded sample;
- shards ``part-<range>-<n>.tok`` in ascending doc_id order: the magic, the SHA-256 of the dictionary (32 bytes),
  the bytes per id, then one frame per document, then the index (per document: id, whether the id is null, ids,
  place of the frame; zlib), its length and the magic again;
- a manifest (Parquet, written by Spark's own commit protocol): one row per shard with its rows, ids, bytes, SHA-256.

Any document is read alone: its frame's place is in the index, and the
dictionary named by the hash opens it.  Shards are written under temporary
names and moved when complete; their names and contents follow from the
input alone, so a repeated task writes the same file again.

The text crosses one shuffle, into ranges of doc_id.  Encoding runs per
distinct word: a text may be cut before a blank that precedes a non-blank,
where the tokenizer's own pre-tokenisation always cuts, so the ids of the
pieces joined are the ids of the text (a line feed between two words is a token of its own); frequent pieces are remembered in a
table of bounded size.

Defined results: null text is empty (only the end id); an empty table gives
an empty store; null doc_ids come first; rows with equal doc_id are all
written, ordered by the hash of their text; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.llm.common import (LOWEST, FileOutput, distinct_sample, filesystem, kept, prefix_sums, range_parts, read_file, tasks_for)
from inkmeter.session import scratch_path

MAGIC = b"IMTOKS1\n"
DICTIONARY = "dictionary.zdict"
#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 64 << 20
#: Characters encoded at a time.
PIECE = 1 << 20
#: White space other than blank and line feed (fixed values), and pairs of white space.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_PAIRS = ["  ", " \n", "\n ", "\n\n"]
#: A word and the signs after it; letters up to here are Latin.
_TAIL, _LATIN = re.compile(r"([^\W\d_]+)([^\w\s]+)"), "\u0250"


def _odd_space(text: str) -> bool:
    """Whether a text has white space that is not one blank or one line feed between two other characters."""
    return (text[0].isspace() or text[-1].isspace() or any(p in text for p in _PAIRS)
            or not text.isascii() and any(c in text for c in _OTHER_SPACE)
            or any(c in text for c in _ASCII_SPACE))


_ASCII_SPACE = [c for c in _OTHER_SPACE if c.isascii()]
_CUT = re.compile(r"(?= \S)")
_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("ids", "<u4"), ("at", "<u8"), ("size", "<u4")])


def _byte_letters() -> dict:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_MARKED = _BYTE_LETTERS[32]


class Recent(dict):
    """A table of bounded size: when the young half is full it becomes the old half; what is used again moves back."""

    def __init__(self, bound: int):
        super().__init__()
        self.old: dict = {}
        self.half = bound // 2

    def room(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


#: Marks the key of a piece that follows no blank; the keys of all others leave their blank out.
_BARE = "\0"
_FEED = _BARE + "\n"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class Encoder:
    """Whole-text encoding with a local tokenizer file, piece by piece."""

    def __init__(self, path: str, bound: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [_BARE]
        self.known = Recent(bound)

    def _whole(self, texts: list) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, lead: str) -> bytes:
        """One word of Latin letters is one pre-token: straight to the model, in the letters that stand for its bytes."""
        text = lead + word
        if word.isascii():
            text = _MARKED + word if lead else word
        else:
            text = text.encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(text)]
        return _PACK[len(ids)](*ids) if len(ids) < 64 else np.array(ids, dtype="<u4").tobytes()

    def _learn(self, missing) -> None:
        """Encode keys that are not known: words by the model, a word with signs in two parts, all else as a text."""
        known, rest = self.known, []
        for key in missing:
            lead, piece = ("", key[1:]) if key[0] == _BARE else (" ", key)
            if piece.isalpha() and (piece.isascii() or max(piece) < _LATIN):
                known[key] = self._word(piece, lead)
                continue
            m = _TAIL.fullmatch(piece)
            if m and (piece.isascii() or max(m.group(1)) < _LATIN):  # signs after a word are a pre-token of their own
                stem = m.group(1) if lead else _BARE + m.group(1)
                signs = _BARE + m.group(2)
                if signs not in known:
                    known[signs] = self._whole([m.group(2)])[0]
                if stem not in known:
                    known[stem] = known.old.get(stem) or self._word(m.group(1), lead)
                known[key] = known[stem] + known[signs]
            else:
                rest.append((key, lead + piece))
        if rest:
            known.update(zip([k for k, _ in rest], self._whole([t for _, t in rest])))

    def _segments(self, text: str) -> Iterator[str]:
        lo = 0
        while lo < len(text):
            hi = lo + PIECE
            if hi < len(text):
                cut = _CUT.search(text, hi)
                hi = cut.start() if cut else len(text)
            yield text[lo:hi]
            lo = hi

    @staticmethod
    def _keys(part: str) -> list:
        """The pieces of a segment as keys."""
        follows = part[0] == " " and len(part) > 1 and not part[1].isspace()  # a later segment starts with its blank
        body = part[1:] if follows else part
        if _odd_space(body):
            return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else _BARE + p
                    for p in _CUT.split(part) if p]
        keys: list = []
        for line in body.split("\n"):
            if keys:
                keys.append(_FEED)
            words = line.split(" ")
            if keys or not follows:
                words[0] = _BARE + words[0]
            keys += words
        return keys

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._whole([text])[0]
        out, known = [], self.known
        for part in self._segments(text):
            known.room()
            keys = self._keys(part)
            got = list(map(known.get, keys))
            if None in got:
                lost = [i for i, v in enumerate(got) if v is None]
                old, new = known.old, {}
                for i in lost:
                    v = old.get(keys[i])
                    if v is None:
                        new[keys[i]] = None
                    else:
                        known[keys[i]] = v
                if new:
                    self._learn(new)
                for i in lost:
                    got[i] = known[keys[i]]
            out += got
        return b"".join(out)


_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its table of pieces serves all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A zstandard dictionary of the samples; their plain bytes where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if width == 2 else ids


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, sample_rows: int = 1000,
                sample_ids: int = 4096, level: int = 3) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write the shards below ``folder``, return the manifest.

    The dictionary is trained in one task on ``sample_ids`` ids of each of ``sample_rows`` different texts; in a longer
    text the stretch begins at a place given by the text's crc32.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def stretch(ids: bytes, text: str) -> bytes:
        spare = len(ids) // 4 - sample_ids
        at = 4 * (zlib.crc32(text.encode("utf-8", "surrogatepass")) % (spare + 1)) if spare > 0 else 0
        return ids[at:at + 4 * sample_ids]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        got = sorted(_narrow(stretch(enc(t), t), enc.width) for b in batches for t in b["text"])
        yield pd.DataFrame({"d": [train_dictionary(got)]})

    chosen = distinct_sample(rows.select("text"), rows, sample_rows)
    made = chosen.repartition(1).mapInPandas(learn, "d binary").collect()
    dictionary = bytes(made[0].d) if made else b""
    out = FileOutput(folder, DICTIONARY)
    out.write(dictionary)
    out.commit()

    tasks = tasks_for(rows)
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    ranged, _ = range_parts(keyed, "key", "text", tasks * 4)
    ranged = (ranged.withColumn("id", F.col("doc_id").cast("string")).select("part", "key", "id", "text")
              .repartition(tasks, "part")
              .sortWithinPartitions("part", "key", F.col("id").isNotNull(), F.xxhash64("text"), "text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        frames = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        end = struct.pack("<I", end_id)
        out, index, done, part, seq = None, [], [], None, 0

        def close() -> None:
            nonlocal out, index
            if out is None:
                return
            table = zlib.compress(np.array(index, dtype=_INDEX).tobytes())
            out.write(table + struct.pack("<Q", len(table)) + MAGIC)
            out.commit()
            done.append((part, seq, out.name, len(index), sum(r[2] for r in index), out.size, out.digest.hexdigest()))
            out, index = None, []

        for pdf in batches:
            for p, i, text in zip(pdf["part"], pdf["id"], pdf["text"]):
                if p != part:
                    close()
                    part, seq = p, 0
                elif out is not None and out.size >= SHARD_BYTES:
                    close()
                    seq += 1
                if out is None:
                    out = FileOutput(folder, f"part-{part:07d}-{seq:05d}.tok")
                    out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([enc.width]))
                ids = enc(text) + end
                frame = frames.compress(_narrow(ids, enc.width))
                at = out.write(frame)
                index.append((0 if i is None else int(i), i is None, len(ids) // 4, at, len(frame)))
            if done:
                yield pd.DataFrame(done, columns=MANIFEST_COLUMNS)
                done = []
        close()
        yield pd.DataFrame(done, columns=MANIFEST_COLUMNS)

    return kept(ranged.select("part", "id", "text").mapInPandas(write, MANIFEST), "token-manifest")


MANIFEST = "part int, seq int, file string, docs long, ids long, bytes long, sha256 string"
MANIFEST_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def open_shard(data: bytes, dictionary: bytes):
    """(index, function place -> ids) of a shard; the dictionary must be the one the shard names."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token shard")
    if data[8:40] != hashlib.sha256(dictionary).digest():
        raise ValueError("shard was written with another dictionary")
    width = data[40]
    size, = struct.unpack("<Q", data[-16:-8])
    index = np.frombuffer(zlib.decompress(data[-16 - size:-16]), dtype=_INDEX)
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(k: int) -> np.ndarray:
        row = index[k]
        raw = opener.decompress(data[int(row["at"]):int(row["at"]) + int(row["size"])])
        got = np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4").astype("<u4")
        if len(got) != row["ids"]:
            raise ValueError("a frame and its index disagree")
        return got

    return index, ids


def read_ids(folder: str, file: str, row: int) -> np.ndarray:
    """The ids of one document alone: reads the shard's end, the index and that frame."""
    fs, base = filesystem(folder)
    dictionary = read_file(folder, DICTIONARY)
    with fs.open_input_file(f"{base}/{file}") as f:
        total = f.size()
        size, = struct.unpack("<Q", f.read_at(16, total - 16)[:8])
        index = np.frombuffer(zlib.decompress(f.read_at(size, total - 16 - size)), dtype=_INDEX)
        width = f.read_at(1, 40)[0]
        frame = f.read_at(int(index[row]["size"]), int(index[row]["at"]))
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress(frame)
    return np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4").astype("<u4")


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the shards in the manifest: doc_id, start, n_tokens, ids_crc32, file, row, frame_bytes."""
    files = prefix_sums(manifest.withColumn("_at", F.struct("part", "seq")), "_at", "ids")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = None
        for pdf in batches:
            for file, base, sha in zip(pdf["file"], pdf["base"], pdf["sha256"]):
                if dictionary is None:
                    dictionary = read_file(folder, DICTIONARY)
                data = read_file(folder, file)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{file} is not the file of the manifest")
                index, ids = open_shard(data, dictionary)
                n = index["ids"].astype(np.int64)
                yield pd.DataFrame({
                    "doc_id": pd.array([None if r["null"] else int(r["id"]) for r in index], dtype="Int64"),
                    "start": int(base) + np.cumsum(n) - n, "n_tokens": n,
                    "ids_crc32": [zlib.crc32(ids(k).tobytes()) for k in range(len(index))],
                    "file": file, "row": np.arange(len(index), dtype=np.int64),
                    "frame_bytes": index["size"].astype(np.int64)})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, row long, frame_bytes long"
    # a number of its own: sized by bytes, the few small rows of the manifest would all go to one task
    tasks = min(files.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism) or 1
    spread = files.select("file", "base", "sha256").repartition(tasks, "file")
    return spread.mapInPandas(read, schema)


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_store(write_store(docs, folder, tokenizer, end_id), folder)
