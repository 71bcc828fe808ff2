"""Token ids in binary shards whose document boundaries are Elias-Fano coded.

A table of token ids is a folder of Parquet files that hold one shard a row, with ``part`` (its range of document ids),
``seq`` (its place there), ``start`` (ids of the part before it), ``n_docs``, ``n_tokens`` and ``blob``. Parquet is the
container only because Spark's committer makes the write atomic on any store; a blob is complete in itself, all of it
little-endian:

    magic "EFTK", version u16, bytes an id u16, null document ids u64, first document id i64,
    boundaries: Elias-Fano of n_docs + 1 offsets, document ids: Elias-Fano of the differences from the first,
    ids: the concatenated array of n_tokens u16 or u32

    Elias-Fano: n u64, low bits a value u64, low length u64, high length u64, low bits, high bits, select samples u32

The value i is the high part (the place of the i-th set bit less i) and its low bits. A sample for every 256th set bit
gives the offset of a document in constant time, with about 2 + log2(ids / documents) bits a document.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches_of, partitions, rows_of, text_of

MAGIC, VERSION = b"EFTK", 1
#: Set bits between two select samples.
EVERY = 256
#: A shard is closed when it has so many ids; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 18
#: Words whose ids a worker remembers, and characters of texts that are encoded together.
MOST_WORDS, GROUP = 800_000, 4 << 20
#: Marks that are no letters or digits, and the first character after the Latin blocks.
MARKS, LATIN_END = ".,;:!?%#*$&|()\"-", chr(0x250)

# The normalizer and the pre-tokenizer of the word-level vocabulary files, as their JSON states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class EliasFano:
    """A sequence that never falls, of numbers from 0 up."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        marks[places] = 1
        return cls(n, width, low, np.packbits(marks, bitorder="little"), places[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4Q", self.n, self.width, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, blob: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, low, high = struct.unpack_from("<4Q", blob, at)
        at += 32
        parts = []
        for kind, count in (("u1", low), ("u1", high), ("<u4", -(-n // EVERY))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def _lows(self, first: int, last: int) -> np.ndarray:
        """The low bits of the values from first to before last."""
        if not self.width:
            return np.zeros(last - first, np.uint64)
        begin = first * self.width
        bits = np.unpackbits(self.low[begin // 8 : -(-last * self.width // 8)], bitorder="little")
        bits = bits[begin % 8 :][: (last - first) * self.width].reshape(-1, self.width).astype(np.uint64)
        return (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64)
        return ((high << np.uint64(self.width)) | self._lows(0, self.n)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        """The value i, by select from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // EVERY]), i % EVERY
        byte = place // 8
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        bits[: place % 8] = 0
        while (ones := int(bits.sum())) <= left:
            left -= ones
            byte += len(bits) // 8
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        place = 8 * byte + int(np.flatnonzero(bits)[left])
        return ((place - i) << self.width) | int(self._lows(i, i + 1)[0])


class Shard:
    """A blob, read without copying its ids."""

    def __init__(self, blob: bytes):
        view = memoryview(blob)
        magic, version, width, self.nulls, self.first = struct.unpack_from("<4sHHQq", view, 0)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"not a token shard: {magic!r}, version {version}")
        self.bounds, at = EliasFano.read(view, struct.calcsize("<4sHHQq"))
        self.keys, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", -1, at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all() + self.first).tolist()


def pack(keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A blob of documents in ascending order of ids, nulls first."""
    nulls = sum(key is None for key in keys)
    first = keys[nulls] if nulls < len(keys) else 0
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    own = EliasFano.of(np.array(keys[nulls:], np.int64).astype(np.uint64) - np.array(first, np.int64).astype(np.uint64))
    return struct.pack("<4sHHQq", MAGIC, VERSION, width, nulls, first) + bounds.to_bytes() + own.to_bytes() + ids


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file as the library reads it: strings of its special tokens in a text are those tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


#: How the byte-level pre-tokenizer writes bytes: visible Latin characters as they are, the others from U+0100 on.
_visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_written = {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(0x100)) - set(_visible)))}


class WordEncoder:
    """Ids of whole texts, by words where the tokenizer's own rules part them at white space, else by the library's call on the text.

    With NORMALIZER and PRE_TOKENIZER no rule looks across ASCII white space: NFC composes nothing with it, each run of it becomes
    one blank, letters are put in lower case one by one, no match of the pattern holds white space or looks around, and special
    tokens (which are found first) hold none and strip none. So the ids of a text are those of its words in order, and each word is
    encoded once. A letter and a mark after it are in different matches as well, so words share the ids of their stems; a
    stem of letters before LATIN_END is one match that NFC leaves as it is, so the library's model alone encodes its bytes.
    Tokenizers with other rules encode each text whole.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer, self.kind = tokenizer(path), np.dtype("<u2" if width == 2 else "<u4")
        self.model, self.code = self.tokenizer.model, "H" if width == 2 else "I"
        rules, added = json.loads(self.tokenizer.to_str()), self.tokenizer.get_added_tokens_decoder().values()
        self.parted = (rules["normalizer"], rules["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.parted &= not any(t.lstrip or t.rstrip or t.normalized or t.single_word or t.content.isalpha() or any(map(str.isspace, t.content)) for t in added)
        self.parted &= rules["post_processor"] is rules["truncation"] is rules["padding"] is None
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in encoded]

    def _stem(self, stem: str) -> bytes:
        written = stem if stem.isascii() else stem.encode().decode("latin-1").translate(_written)
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        known, others = self.known, []
        for word in words:
            stem = word.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END and "\u0130" not in stem):
                low = stem.lower()
                ids = known.get(low)
                if ids is None:
                    ids = known[low] = self._stem(low)
                if len(stem) < len(word):
                    marks = word[len(stem) :]
                    if marks not in known:
                        known[marks] = self.whole([marks])[0]
                    ids += known[marks]
                known[word] = ids
            else:
                others.append(word)
        known.update(zip(others, self.whole(others), strict=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return self.whole(texts)
        if len(self.known) > MOST_WORDS:
            self.known = {"": b""}
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([word for word in words if word not in self.known])
        found = [self.known[word] for word in words]
        table, sizes = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        at = coded.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = table[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], lengths)].tobytes()
        cuts = (self.kind.itemsize * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, width: int) -> WordEncoder:
    """The encoder of this worker, which keeps its words from task to task."""
    return WordEncoder(path, width)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending order of ids to ``path``.

    Nulls: a null text is empty, null ids come first. Rows with one id keep the order of their texts. Other columns are
    left out whatever their names; an empty table writes no shard. The one shuffle is by range of ids into ``parts``
    (by default the session's shuffle partitions); a task holds one shard, or one document where that is larger.
    """
    width = 2 if max(end_id, tokenizer(tokenizer_file).get_vocab_size() - 1) < 1 << 16 else 4
    end = end_id.to_bytes(width, "little")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])

    def shards(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder, part = word_encoder(tokenizer_file, width), TaskContext.get().partitionId()
        seq = start = held = 0
        keys, lengths, ids = [], [], []

        def closed() -> tuple:
            return part, seq, start, len(keys), held, pack(keys, lengths, b"".join(ids), width)

        for group in grouped(rows):
            for (key, _), raw in zip(group, encoder.texts([text for _, text in group]), strict=True):
                keys.append(key)
                ids += (raw, end)
                lengths.append(len(raw) // width + 1)
                held += lengths[-1]
                if held >= SHARD_TOKENS:
                    yield closed()
                    seq, start, held, keys, lengths, ids = seq + 1, start + held, 0, [], [], []
        if keys:
            yield closed()

    def grouped(rows: Iterator[tuple]) -> Iterator[list]:
        group, size = [], 0
        for key, raw in rows:
            group.append((key, text_of(raw)))
            size += len(group[-1][1])
            if size >= GROUP or len(group) == 8192:
                yield group
                group, size = [], 0
        if group:
            yield group

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(shards(rows_of(batches)), schema, weigh=lambda row: len(row[-1]))

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    ordered = given.repartitionByRange(parts or partitions(docs.sparkSession), "id").sortWithinPartitions("id", "raw")
    out = ordered.mapInArrow(run, "part int, seq int, start long, n_docs long, n_tokens long, blob binary")
    out.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the shards alone.

    ``start`` counts the ids of all documents before it, ``n_tokens`` has the end id, ``ids_crc32`` is of the ids as
    little-endian unsigned 32-bit integers. The offsets of parts are broadcast: a row for each of the write's ``parts``.
    """
    kind = "part int, seq int, start long, n_docs long, n_tokens long, blob binary"
    shards = spark.read.schema(kind).parquet(path)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, blob in rows_of(batches):
            shard = Shard(blob)
            bounds = shard.bounds.all()
            wide = memoryview(shard.ids.astype("<u4").tobytes())
            sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = (shard.doc_ids(), bounds[:-1] + base, np.diff(bounds), sums)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start")).alias("base"), "blob")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
