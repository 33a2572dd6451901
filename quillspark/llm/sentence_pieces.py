"""SentencePiece encoding and decoding with the place of every piece in the original bytes.

The normaliser walks the text by the longest prefix found in the model's compiled character map and notes, for every
byte of the normalised text, the original byte it came from. The library cuts the text into pieces; each piece covers a
run of normalised bytes, which the notes project to a span of original bytes. A model whose map is empty (identity)
takes a vectorised way through the same rules. The lengths of the pieces must add up to the normalised text, so a
normaliser that differs from the library's is an error, never a silent shift.

Null texts count as empty. An empty text has no pieces. Texts are taken whole, whatever their length; one text is in a
worker's memory at a time, besides the Arrow batch it came in.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quillspark.llm.shared import small_batches

SPACE = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest key that text has at this place, and the key's length."""
        if not self.units:
            return None
        found, node = None, (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = self.units[node] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(b"\0", start)], i + 1 - at
        return found


@dataclass
class Encoded:
    ids: list[int]
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """One model: normalises, encodes with spans, decodes."""

    def __init__(self, model: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.own = sorted((p.piece.encode() for p in spec.pieces if p.type == USER_DEFINED), key=len, reverse=True)
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN}
        self.bytes = {i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.widths = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in spec.pieces], dtype=np.int64)
        self.plain = not self.map.units and not self.squeeze and not self.own and self.prefix and self.escape and not self.suffix

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the original byte."""
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        if self.plain:
            at = np.repeat(np.arange(len(raw)), np.where(np.frombuffer(raw, dtype=np.uint8) == 32, len(SPACE), 1))
            return SPACE + raw.replace(b" ", SPACE), np.concatenate((np.zeros(len(SPACE), dtype=np.int64), at, [len(raw)]))
        out, places, at, after_space = bytearray(), [], 0, self.squeeze
        mark = SPACE if self.escape else b" "

        def put(what: bytes, place: int) -> None:
            out.extend(what)
            places.extend([place] * len(what))

        steps = []
        while at < len(raw):
            text, width = self._step(raw, at)
            steps.append((text, at))
            at += width
        if self.squeeze:
            while steps and not steps[0][0].strip(b" "):
                steps.pop(0)
        if not steps:
            return b"", np.array([len(raw)])
        if self.prefix and not self.suffix:
            put(mark, steps[0][1])
        for text, place in steps:
            if self.squeeze and after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", mark), place)
                after_space = text.endswith(b" ")
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], places[-len(mark) :]
        if self.prefix and self.suffix:
            put(mark, len(raw))
        return bytes(out), np.array([*places, len(raw)])

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for word in self.own:
            if raw.startswith(word, at):
                return word, len(word)
        if found := self.map.longest(raw, at):
            return found
        width = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + width], width

    def encode(self, text: str | None) -> Encoded:
        text = text or ""
        ids = self.pieces.encode(text)
        normal, places = self.normalise(text.encode())
        widths = self.widths[ids] if ids else np.zeros(0, dtype=np.int64)
        if not self.unknown.isdisjoint(ids):
            said = self.pieces.encode(text, out_type=str)
            widths = np.array([1 if i in self.bytes else len(x.encode()) for i, x in zip(ids, said)], dtype=np.int64)
        ends = np.cumsum(widths)
        if (int(ends[-1]) if ids else 0) != len(normal):
            raise ValueError(f"pieces cover {int(ends[-1]) if ids else 0} of {len(normal)} normalised bytes")
        return Encoded(ids, places[ends - widths], places[ends])

    def decode(self, ids: list[int]) -> str:
        return self.pieces.decode(ids)


@lru_cache(maxsize=4)
def codec(model: str) -> Codec:
    return Codec(model)


def encode(text: Column, model: str) -> Column:
    """struct<ids, starts, ends>: piece ids and each piece's span of bytes in the text's UTF-8, ends exclusive."""

    @F.pandas_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = [codec(model).encode(x) for x in series]
            yield pd.DataFrame({"ids": [x.ids for x in rows], "starts": [x.starts for x in rows], "ends": [x.ends for x in rows]})

    return encoded(text)


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in rows:
            yield pd.Series([codec(model).decode([int(i) for i in x]) if x is not None else "" for x in series], dtype=object)

    return decoded(ids)


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Encodes and decodes every text where it lies and adds n_tokens, ids_sha256, decoded_sha256 and covered_bytes.

    Runs the same codec as encode() and decode() but keeps ids and spans inside the worker: only digests return to the
    JVM. covered_bytes is the number of original bytes under the pieces' spans, the text's length for a whole cover.
    """

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string,covered_bytes:long>")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, sha = codec(model), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for series in texts:
            rows = []
            for text in series:
                coded = own.encode(text)
                rows.append((len(coded.ids), sha(",".join(map(str, coded.ids))), sha(own.decode(coded.ids)), int((coded.ends - coded.starts).sum())))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    small_batches(docs.sparkSession)
    parts = ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in parts]
    coded = docs.select(F.struct(*kept).alias("row"), digests(F.col(text)).alias("coded"))
    return coded.select("row.*", "coded.*")
