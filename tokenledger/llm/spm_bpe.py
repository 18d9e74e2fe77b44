"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each token's bytes become printable characters (one per byte), the piece's score is its negative rank, and
normalisation is the identity, so a merge chosen by the highest score is the merge of the lowest rank.
Pre-tokens are encoded one by one; a pre-token that is a token itself is that token, as rank-file encoders
have it. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import MARK, SPACE, Encoder, byte_alphabet
from .common import gather, held, list_array, offsets_of, ship, text_slices, texts_of

#: Fixed values of sentencepiece's model format: field numbers, and the kinds of models and pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE_FIELD, VOCAB_SIZE_FIELD, UNK_FIELD, BOS_FIELD, EOS_FIELD, PAD_FIELD = 3, 4, 40, 41, 42, 43
BPE_MODEL, NORMAL_PIECE, UNKNOWN_PIECE = 2, 1, 2
#: Bytes of text encoded at once.
SLICE = 3 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks have gaps")
    return [t for _, t in rows]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows the last rank."""
    latin = byte_alphabet()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join([latin[b] for b in token]).encode()
        score = struct.pack("<f", -float(rank))
        out.append(_block(PIECES, _block(1, piece) + b"\x15" + score + _number(3, NORMAL_PIECE)))
    out.append(_block(PIECES, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN_PIECE)))
    trainer = _number(MODEL_TYPE_FIELD, BPE_MODEL) + _number(VOCAB_SIZE_FIELD, len(tokens) + 1) + _number(UNK_FIELD, len(tokens))
    trainer += b"".join(_number(f, -1) for f in (BOS_FIELD, EOS_FIELD, PAD_FIELD))
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _block(TRAINER, trainer), _block(NORMALIZER, identity)])


class SpmEncoder(Encoder):
    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.decoder = Decoder(path)
        self.normalizer, self.unsafe = None, SPACE + SPACE + "|" + MARK
        self.find = regex.compile(pattern, regex.V0).findall
        self.latin = dict(enumerate(byte_alphabet()))
        self.clear()

    def pretoken(self, piece: str) -> list[int]:
        data = piece.encode()
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        return self.model.encode(data.decode("latin-1").translate(self.latin))

    def word(self, piece: str) -> list[int]:
        if piece.isalpha():
            return self.pretoken(" " + piece)
        return self.ids(piece[1:] if piece[:1] == MARK else " " + piece)


class Decoder:
    """Bytes of ids by the inverse mapping: one gather over the tokens' bytes laid end to end."""

    def __init__(self, path: str) -> None:
        tokens = read_ranks(path)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts, self.bytes = offsets_of(self.sizes)[:-1], np.frombuffer(b"".join(tokens), np.uint8)

    def batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each list ids[offsets[i]:offsets[i + 1]]."""
        data, sizes = np.empty(int(self.sizes[ids].sum()), np.uint8), offsets_of(self.sizes[ids])
        for at in range(0, len(ids), 1 << 18):
            some = ids[at : at + (1 << 18)]
            data[sizes[at] : sizes[at + len(some)]] = self.bytes[gather(self.starts[some], self.sizes[some])]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(sizes[offsets]), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Rows (key, ids array<int>) of whole texts, one for each row of docs; with `decoded`, also the bytes that the ids decode to.

    A null or empty text has no ids; keys may be null or repeat, and equal rows give equal results; an empty table
    gives none. Other columns are dropped, whatever their names. One pass, no shuffle; a worker holds SLICE bytes
    of text or one longer text, its ids, and chunks up to bpe.CACHE.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(SpmEncoder, path, pattern)
        for part in text_slices(batches, "text", SLICE):
            ids, offsets = own.batch(texts_of(part))
            columns = [part.column("k"), list_array(ids.astype(np.int32), offsets, pa.int32())]
            if decoded:
                columns.append(own.decoder.batch(ids, offsets))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", decoded binary" if decoded else "")
    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, ids, decoded binary) of rows with ids, by the inverse mapping; null ids decode to nothing."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(Decoder, path)
        for batch in batches:
            sizes = offsets_of(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # a bounded number of ids at a time, or one list
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (1 << 20), "right")) - 1)
                part = batch.slice(at, to - at)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, own.batch(ids, sizes[at : to + 1] - sizes[at])], [*part.schema.names, "decoded"])
                at = to

    kind = encoded.select(key).schema[0].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")
