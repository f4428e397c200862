"""Byte-level BPE through a sentencepiece model written from the vocabulary.

The model's pieces are the vocabulary's byte strings, each byte as a printable
character, scored by negative rank, so that sentencepiece merges in rank order.
Normalisation is the identity. Pre-tokens are encoded apart; decoding maps ids
back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.shared import slices, table, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED = 1 << 18
CACHED_LENGTH = 64
TEXTS_AT_ONCE = 64


def byte_characters() -> str:
    """One printable character for each byte: itself where it is printable in
    Latin-1, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def _varint(number: int) -> bytes:
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes([*out, number])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    number = _varint(2 << 3 | 5) + struct.pack("<f", score)
    return _field(1, _field(1, text.encode()) + number + _field(3, kind))


def serialise_model(pieces: Iterable[bytes]) -> bytes:
    """A sentencepiece model file for byte strings in rank order.

    Field numbers are those of the public model format. The unknown piece the
    format demands comes last, so ids are ranks.
    """
    characters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    body = bytearray()
    count = 0
    for rank, piece in enumerate(pieces):
        body += _piece("".join(characters[b] for b in piece), -float(rank), normal)
        count += 1
    body += _piece("<unk>", 0.0, unknown)
    trainer = _field(3, bpe) + _field(4, count + 1) + _field(40, count)
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return bytes(body) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranked) - 1}")
    return [piece for _, piece in ranked]


class ByteBpe:
    """Encode and decode with one vocabulary; keeps a bounded memory of words."""

    def __init__(self, pieces: list[bytes], pattern: str):
        self.pieces = pieces
        self.digits = [str(i) for i in range(len(pieces))]
        self.split = regex.compile(pattern).findall
        self.characters = dict(enumerate(byte_characters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(pieces))
        # A token that is a piece as a whole is that piece, also where merging
        # would not lead to it.
        merged = self._merge(pieces)
        self.whole = {
            piece: [rank] for rank, piece in enumerate(pieces) if merged[rank] != [rank]
        }
        self.known: dict[str, list[int]] = {}

    def _merge(self, tokens: list[bytes]) -> list[list[int]]:
        mapped = [t.decode("latin-1").translate(self.characters) for t in tokens]
        return self.model.encode(mapped, num_threads=1)

    def _learn(self, tokens: Iterable[str]) -> dict[str, list[int]]:
        new = list(tokens)
        raw = [token.encode() for token in new]
        ids = self._merge(raw)
        unknown = len(self.pieces)
        for i, piece in enumerate(raw):
            ids[i] = self.whole.get(piece, ids[i])
            if unknown in ids[i]:
                raise ValueError(f"no piece for a byte of {new[i][:50]!r}")
        return dict(zip(new, ids, strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            split = [self.split(text) for text in texts[start : start + TEXTS_AT_ONCE]]
            if len(self.known) > CACHED:
                self.known = {}
            new = set(chain.from_iterable(split)).difference(self.known)
            learned = self._learn(new)
            self.known.update((t, i) for t, i in learned.items() if len(t) <= CACHED_LENGTH)
            long = {t: i for t, i in learned.items() if len(t) > CACHED_LENGTH}
            find = {**self.known, **long}.__getitem__ if long else self.known.__getitem__
            for tokens in split:
                yield list(chain.from_iterable(map(find, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """Built once in each Python worker."""
    return ByteBpe(read_ranks(path), pattern)


def encode_texts(docs: DataFrame, *keep: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids``, the token ids of ``text`` (NULL: empty).

    ``path`` names a rank file that every executor has.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    return _mapped(docs, keep, {"ids": "ARRAY<INT>"}, lambda c, text, ids: (ids,), path, pattern)


def encode_digests(docs: DataFrame, *keep: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``,
    the last from decoding the ids."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN

    def digest(own: ByteBpe, text: str, ids: list[int]) -> tuple:
        listed = ",".join(map(own.digits.__getitem__, ids)).encode()
        return (
            len(ids),
            hashlib.sha256(listed).hexdigest(),
            hashlib.sha256(own.decode(ids)).hexdigest(),
        )

    added = {"n_tokens": "BIGINT", "ids_sha256": "STRING", "decoded_sha256": "STRING"}
    return _mapped(docs, keep, added, digest, path, pattern)


_ARROW = {"BIGINT": pa.int64(), "STRING": pa.string(), "ARRAY<INT>": pa.list_(pa.int32())}


def _mapped(docs: DataFrame, keep: tuple, added: dict[str, str], answer, path: str, pattern: str) -> DataFrame:
    picked = docs.select(*keep, whole_text().alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    fields += [f"{name} {kind}" for name, kind in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, 512):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows = [answer(own, t, i) for t, i in zip(texts, own.encode(texts), strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1]
                + [pa.array(c, _ARROW[k]) for c, k in zip(columns, added.values(), strict=True)],
                names=[*keep, *added],
            )

    return picked.mapInArrow(run, ", ".join(fields))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again.

    NULL and empty texts have no tokens; repeated rows are rows of their own.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return encode_digests(docs, "doc_id")
