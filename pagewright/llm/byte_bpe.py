"""Byte-level BPE encoding and decoding by a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: White space as the pattern's \s has it (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Texts longer than this are split before encoding.
LONG = 16_384
#: Runs of white space longer than this are encoded without the pattern, which recurses over them.
LONG_RUN = 1_024
#: No match of the pattern goes from a character that isn't white space to one that is, so texts can be cut between them.
_cut = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
_run = re.compile(rf"[{SPACE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file: base64 token and rank on each line."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about LONG characters, or longer where it has no boundary."""
    at = 0
    while len(text) - at > LONG:
        cut = _cut.search(text, at + LONG)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text, the same as of the whole text at once, in bounded recursion."""
    if len(text) <= LONG and not _run.search(text):
        return enc.encode_to_numpy(text)
    out = [np.zeros(0, np.uint32)]
    for piece in pieces(text):
        at = 0
        for run in _run.finditer(piece):
            # \s+(?!\S) takes a run but for its last character, which begins the next match; at the end it takes all.
            end = run.end() - (run.end() < len(piece))
            out.append(enc.encode_to_numpy(piece[at : run.start()]))
            out.append(np.array(enc._encode_single_piece(piece[run.start() : end]), np.uint32))
            at = end
        out.append(enc.encode_to_numpy(piece[at:]))
    return np.concatenate(out)


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of ids; they need not be UTF-8, as a prefix of a text's ids isn't."""
    return enc.decode_bytes(ids)


def listed(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list column of id arrays."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.zeros(0, np.uint32), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))


def unlisted(column: pa.ListArray) -> list[np.ndarray]:
    """The id arrays of an Arrow list column; null is no ids."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy()
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for each row, in whole texts, special tokens taken as text.

    Null and empty texts have no ids. Rows stay as they are: null ids and repeated rows are kept, other columns are
    left out whatever their names. An empty table gives an empty table. Nothing is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for part in slices(batches):
            ids = listed([encode(enc, text_of(raw)) for raw in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Add ``decoded binary`` to ``id_col, ids``. Null ids decode as no ids; an id without a rank raises KeyError."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for part in slices(batches):
            decoded = [decode(enc, ids.tolist()) for ids in unlisted(part.column(1))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    given = encoded.select(F.col(id_col).alias("id"), "ids")
    return given.mapInArrow(run, "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


_names = list(map(str, range(1 << 16)))


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of decimal ids joined by commas."""
    return hashlib.sha256(",".join([_names[i] if i < len(_names) else str(i) for i in ids]).encode()).hexdigest()


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of decoded rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            arrays = [ids.tolist() for ids in unlisted(part.column(1))]
            columns = (
                pa.array(list(map(len, arrays)), pa.int64()),
                pa.array(list(map(ids_digest, arrays)), pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in part.column(2).to_pylist()], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = decoded.select(F.col(id_col).alias("id"), "ids", "decoded")
    out = given.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``id_col, n_tokens, ids, ids_sha256, decoded_sha256`` (no ``ids`` if not asked for): encoding, decoding and digests in one pass through Python.

    The same rows as the three functions above one after the other, with one worker a core instead of three.
    """
    names = ["id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for part in slices(batches):
            arrays = [encode(enc, text_of(raw)) for raw in part.column(1).to_pylist()]
            lists = [ids.tolist() for ids in arrays]
            columns = (
                pa.array(list(map(len, lists)), pa.int64()),
                *([listed(arrays)] if with_ids else []),
                pa.array(list(map(ids_digest, lists)), pa.string()),
                pa.array([hashlib.sha256(decode(enc, ids)).hexdigest() for ids in lists], pa.string()),
            )
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    kinds = {"id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    return given.mapInArrow(run, ", ".join(f"{name} {kinds[name]}" for name in names)).withColumnRenamed("id", id_col)
