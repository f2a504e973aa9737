"""Encoding a corpus by a byte-level BPE vocabulary through a sentencepiece model.

The model isn't trained: it is serialised straight from the vocabulary.  Each byte is written as one
printable character, each entry of the vocabulary is a piece scored by its negative rank, and the
normaliser is the identity.  Merging the best-scored neighbours is then the vocabulary's own merge order.
Texts are cut into pre-tokens by the vocabulary's pattern; distinct pre-tokens are encoded once a batch.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.scale import spread

#: Where the public vocabularies lie; a parameter of every function.
TOKENIZERS = "/opt/tokenizers"
#: The pattern that cuts texts into pre-tokens, as published with the vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers between batches; beyond it starts anew, so memory stays bounded.
REMEMBERED, REMEMBERED_SIZES = 150_000, 600_000
#: Longest pre-token, in characters, that is remembered.
LONGEST = 64

_NORMAL, _UNKNOWN = 1, 2


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest are moved above 255."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, moved = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], moved = chr(256 + moved), moved + 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    import struct

    return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 entry and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks.

    The last id, one above the ranks, is the unknown piece that the format asks for; it is never used,
    since every byte is a piece.
    """
    mapped = byte_characters()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without a gap")
    pieces = b"".join(_piece("".join(mapped[b] for b in token), -float(rank), _NORMAL) for token, rank in ordered)
    pieces += _piece("<unk>", 0.0, _UNKNOWN)
    bpe, no = 2, 0
    trainer = _number(3, bpe) + _number(4, len(ordered) + 1) + _number(35, no) + _number(40, len(ordered))
    normal = _field(1, b"identity") + _number(3, no) + _number(4, no) + _number(5, no)
    return pieces + _field(2, trainer) + _field(3, normal)


class BytePairEncoder:
    """Encodes texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex
        import sentencepiece

        self.size = len(ranks)
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        mapped = byte_characters()
        self.to_characters = {b: c for b, c in enumerate(mapped)}
        self.to_byte = {c: b for b, c in enumerate(mapped)}
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def characters(self, text: str) -> str:
        # latin-1 gives each byte its own character, which translate() then maps
        return text.encode("utf-8", "replace").decode("latin-1").translate(self.to_characters)

    def _pieces(self, texts: Iterable[str]) -> tuple[list[list[str]], dict[str, list[int]]]:
        """The pre-tokens of each text, and the ids of those too long to be remembered."""
        cut = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*cut).difference(self.known))
        passing: dict[str, list[int]] = {}
        for piece, ids in zip(new, self.model.encode([self.characters(p) for p in new], num_threads=1) if new else ()):
            (self.known if len(piece) <= LONGEST else passing)[piece] = ids
        return cut, passing

    def encode_batch(self, texts: Iterable[str]) -> list[list[int]]:
        cut, passing = self._pieces(texts)
        known = self.known.__getitem__
        if passing:
            known = lambda p: self.known[p] if p in self.known else passing[p]
        return [list(chain.from_iterable(map(known, pieces))) for pieces in cut]

    def count_batch(self, texts: Iterable[str]) -> list[int]:
        """How many ids each text has.  Only numbers are remembered, so more pre-tokens than for their ids."""
        cut = [self.split(t) for t in texts]
        if len(self.sizes) > REMEMBERED_SIZES:
            self.sizes = {}
        new = list(set().union(*cut).difference(self.sizes))
        counted = dict(zip(new, map(len, self.model.encode([self.characters(p) for p in new], num_threads=1)))) if new else {}
        self.sizes.update((p, n) for p, n in counted.items() if len(p) <= LONGEST)
        size = self.sizes.__getitem__
        if any(len(p) > LONGEST for p in counted):
            size = lambda p: self.sizes[p] if p in self.sizes else counted[p]
        return [sum(map(size, pieces)) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: pieces back to bytes by the inverse mapping."""
        return b"".join(bytes(self.to_byte[c] for c in self.model.id_to_piece(int(i))) for i in ids).decode("utf-8", "replace")


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """``vocabulary``, sent to all executors, which needn't have the folder it lies in."""
    if os.path.exists(vocabulary) and vocabulary not in _SENT.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(vocabulary)
        _SENT[spark.sparkContext.applicationId].add(vocabulary)
    return vocabulary


#: The vocabularies sent, by application.
_SENT: dict[str, set[str]] = {}


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of the rank file at ``path``, or of its copy that was sent here; kept by the worker."""
    own = SparkFiles._is_running_on_worker or SparkContext._active_spark_context is not None
    sent = SparkFiles.get(os.path.basename(path)) if own else path
    return BytePairEncoder(read_ranks(sent if os.path.exists(sent) else path))


def encode_texts(df: DataFrame, key: str, text: str, *, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``(key, ids array<int>)`` of each row: the whole text's ids, without special tokens.

    Empty and null texts have no ids, ``[]``; blank texts have those of their blanks.  Strings that look
    like special tokens are ordinary text.  Any length; repeated rows each have their row; other columns
    are ignored; an empty table gives no row.  Narrow: no shuffle but to fill idle cores.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "ids": own.encode_batch(batch["_t"])})

    shipped(df.sparkSession, vocabulary)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return spread(rows).mapInPandas(encoded, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, *, as_column: str = "n_tokens", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with each text's number of tokens (0 for empty and null texts)."""
    shipped(df.sparkSession, vocabulary)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        return pd.Series(own.count_batch(texts.fillna("")), dtype="int64")

    return df.withColumn(as_column, counted(F.col(text)))
