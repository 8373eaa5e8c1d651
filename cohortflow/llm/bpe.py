"""Byte-level BPE encoding and decoding (operator 7), and the chunk encoder that packing shares.

A text is cut into spans of white space plus word (flat.chunks). Pre-tokenizer matches never cross
such a cut, so equal spans have equal ids wherever they stand: each distinct span, told by all its bytes, is
encoded once per worker and texts are put together by array lookups.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import small_batches

#: Distinct spans, and bytes of them, that a task remembers before it starts anew: some 100 MB.
REMEMBERED, REMEMBERED_BYTES = 300_000, 32 << 20


def byte_table() -> dict[str, int]:
    """The character that byte-level BPE shows for each byte, reversed: printable bytes show as
    themselves, the others as the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SpanEncoder:
    """Ids of the spans of texts, by a tokenizers file; one per Python worker and file.

    Spans of letters alone are one pre-token: they go straight to the tokenizer's BPE model, in the
    characters that stand for their bytes. All others take the tokenizer's whole path.
    """

    _known: dict[tuple, SpanEncoder] = {}

    def __init__(self, path: str, byte_level: bool, specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        back = byte_table()
        self.shown = {b: c for c, b in back.items()}
        self.model = self.tokenizer.model
        self.decodes = byte_level and not specials
        if self.decodes:
            self.tokenizer.encode_special_tokens = True  # their strings are then text like any other
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.pieces = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.pieces[i] = bytes(back[c] for c in token)
            self.numbers = [str(i).encode() for i in range(len(self.pieces))]
        self.reset()

    @classmethod
    def get(cls, path: str, byte_level: bool, specials: bool = False) -> SpanEncoder:
        """specials: a byte-level vocabulary's special tokens keep their own ids where their strings stand in a text."""
        key = (path, byte_level, specials)
        if key not in cls._known:
            cls._known[key] = cls(*key)
        return cls._known[key]

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.ids = array("I")
        self.ends = array("q", [0])
        self.names: list[bytes] = []
        self.bytes: list[bytes] = []

    def span_ids(self, raw: bytes) -> list[int]:
        plain = raw[1:] if raw[:1] == b" " else raw
        if plain.isalpha():  # of bytes: ASCII letters
            name = plain.decode() if self.byte_level else plain.lower().decode()
            return [t.id for t in self.model.tokenize(self.shown[32] + name if self.byte_level and plain is not raw else name)]
        text = raw.decode("utf-8", "replace")
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "\u0100":
            if not self.byte_level:
                raw = word.lower().encode()
            return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.shown))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def look_up(self, s: flat.Slice, spans: flat.Words) -> np.ndarray:
        """For each span its number: its ids are ids[ends[number] : ends[number + 1]]."""
        if len(self.at) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.reset()
        if not len(spans.start):
            return np.zeros(0, np.int64)
        codes, distinct = pd.factorize(flat.span_keys(s.data, spans.start, spans.end))
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if not flat.same_bytes(s.data, spans.start, spans.end, first[codes]):  # keys of long spans are hashes
            codes = first = np.arange(len(spans.start))
        raw, at, place = s.data.tobytes(), self.at, np.empty(len(first), np.int64)
        for k, (a, b) in enumerate(zip(spans.start[first].tolist(), spans.end[first].tolist(), strict=True)):
            span = raw[a:b]
            known = at.get(span)
            if known is None:
                known = at[span] = len(self.ends) - 1
                self.held += b - a
                ids = self.span_ids(span)
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
                if self.decodes:
                    self.names.append(b" ".join([self.numbers[i] for i in ids]))
                    self.bytes.append(b"".join([self.pieces[i] for i in ids]))
            place[k] = known
        return place[codes]

    def lengths(self, place: np.ndarray) -> np.ndarray:
        ends = np.frombuffer(self.ends, np.int64)
        return ends[place + 1] - ends[place]

    def encode(self, s: flat.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each row starts in them (and the end)."""
        spans = flat.chunks(s)
        place = self.look_up(s, spans)
        n, begin = self.lengths(place), np.frombuffer(self.ends, np.int64)[place]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(total[-1]) - np.repeat(total[:-1] - begin, n)
        return np.frombuffer(self.ids, np.uint32)[at], total[spans.first]


def same_ranks(vocabulary: str, ranks: str) -> None:
    """Raise unless the tokenizers file gives every piece of the rank file (base64 and rank a line) its rank as id."""
    pieces = SpanEncoder.get(vocabulary, True).pieces
    with open(ranks, "rb") as f:
        ranked = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in f if line.strip())}
    for rank, piece in ranked.items():
        if rank >= len(pieces) or pieces[rank] != piece:
            raise ValueError(f"{vocabulary} and {ranks} differ at {rank}")


def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = SpanEncoder.get(path, True)
    for batch in batches:
        n_tokens, ids_sha, bytes_sha = [], [], []
        for s in flat.slices(batch.column(1)):
            spans = flat.chunks(s)
            place = enc.look_up(s, spans)
            count = np.concatenate([[0], np.cumsum(enc.lengths(place))])
            n_tokens.append(np.diff(count[spans.first]))
            name, decoded = enc.names.__getitem__, enc.bytes.__getitem__
            for a, b in zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True):
                part = place[a:b].tolist()
                ids_sha.append(hashlib.sha256(b" ".join(map(name, part))).hexdigest())
                bytes_sha.append(hashlib.sha256(b"".join(map(decoded, part))).hexdigest())
        if n_tokens:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_tokens)), pa.array(ids_sha), pa.array(bytes_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    enc.reset()  # idle workers hold nothing


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the token count and sha256 of the ids and of the bytes decoded from them.

    Null and empty texts have no ids; repeated and null ids and repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read, whatever their names. No shuffle: one pass over the text column.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: digest_batches(it, vocabulary), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids, and for each id its byte span [start, end) in the UTF-8 text.

    One character may be split over several ids; the spans of such ids lie inside it. Odd rows as in digests().
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = SpanEncoder.get(vocabulary, True)
        width = np.array([len(p) for p in enc.pieces], np.int64)
        for batch in batches:
            for s in flat.slices(batch.column(1)):
                ids, first = enc.encode(s)
                end = np.cumsum(width[ids])
                start = end - width[ids]
                base = np.repeat(s.off[:-1], np.diff(first))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in (ids.astype(np.int32), start - base, end - base)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), *lists], ["doc_id", "ids", "starts", "ends"])
        enc.reset()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Adds `bytes` (exact) and `text`: a character whose bytes are split over ids is joined again; bytes
    that make no character, as after a cut inside one, become U+FFFD. Null ids give null; unknown ids fail. Columns
    `bytes` and `text` of `encoded` are replaced, all others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = SpanEncoder.get(vocabulary, True).pieces
        for batch in batches:
            raw = [None if ids is None else b"".join([pieces[i] for i in ids]) for ids in batch.column(ids_col).to_pylist()]
            text = [None if b is None else b.decode("utf-8", "replace") for b in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary()), pa.array(text, pa.string())], [*batch.schema.names, "bytes", "text"])

    rows = encoded.drop("bytes", "text")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", bytes binary, text string")
