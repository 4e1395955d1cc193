"""Operator 3: offset-preserving SentencePiece encoding, and decoding.

``Normaliser`` walks the text through the model's compiled character map, always by the longest prefix,
and records for each normalised byte the source bytes that it came from. The library segments the text;
every piece's place in the normalised text is then projected to a span of bytes of the original text. A model
without a map is normalised by its rules for spaces alone.

Defined results: a null text counts as empty; an empty text has no pieces; repeated rows give repeated
results; other columns are not read, so that their names can't clash. Texts are encoded whole at any length.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole

SPACE = "▁".encode()
#: Texts of one output batch, which bounds what a worker holds.
BATCH = 256
#: Words whose pieces a worker remembers.
KNOWN_WORDS = 100_000
_MARK = SPACE.decode()
_WORD_AND_SPACES = re.compile(r" +[^ ]*")


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie of UTF-8 keys, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """normalise(text) gives the normalised bytes and, for each of them, begin and end of its source bytes."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        data = text.encode()
        space = SPACE if self.escape else b" "
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.map is None and not self.squeeze:
            b = np.frombuffer(data, np.uint8)
            begin = np.repeat(np.arange(len(b), dtype=np.int32), np.where(b == 32, len(space), 1))
            pad = np.zeros(len(space) * self.prefix, np.int32)
            return space * self.prefix + data.replace(b" ", space), np.concatenate((pad, begin)), np.concatenate((pad, begin + 1))
        out, begin, end = bytearray(), [], []
        parts = list(self._parts(data))
        if self.squeeze:
            while parts and not parts[0][2].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.prefix:
            out += space
            begin += [parts[0][0]] * len(space)
            end += [parts[0][0]] * len(space)
        spaced = self.squeeze
        for at, size, new in parts:
            for k in range(len(new)):
                byte = new[k : k + 1]
                if byte == b" ":
                    if spaced and self.squeeze:
                        continue
                    byte = space
                same = new == data[at : at + size]
                out += byte
                begin += [at + k if same else at] * len(byte)
                end += [at + k + 1 if same else at + size] * len(byte)
                spaced = new[k : k + 1] == b" "
        if self.squeeze and spaced:
            while out.endswith(space):
                del out[-len(space) :], begin[-len(space) :], end[-len(space) :]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def _parts(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if not found:
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = size, data[at : at + size]
            yield at, *found
            at += found[0]


class Encoder:
    """The library's segmentation with spans of original bytes.

    Where no piece of a BPE model has a space mark after another character, no merge crosses the start of a run
    of spaces: a text's pieces are then those of its words one after another, each word with the spaces before
    it, and words that come again aren't segmented again. ``by_word`` says whether the model is of that kind;
    other models, and texts that hold the mark itself, are segmented whole.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        self.normaliser = Normaliser(model.normalizer_spec)
        kind, spec, mark = pb.ModelProto.SentencePiece, model.normalizer_spec, SPACE.decode()
        self.sizes = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = {k for k, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        apart = all(mark not in p.piece.lstrip(mark) for p in model.pieces) and not any(p.type == kind.USER_DEFINED for p in model.pieces)
        plain = self.normaliser.map is None and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.by_word = bool(plain and apart and model.trainer_spec.model_type == pb.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix)
        self.mark = self.sp.piece_to_id(mark)
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers, so that those of a text are one join

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not self.by_word:
            return [self.encode(t) for t in texts]
        split = [_WORD_AND_SPACES.findall(" " + t) if t and _MARK not in t else None for t in texts]
        known = self.words
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = list({w for words in split if words for w in words if w not in known})
        if new:
            # The library puts a space before each word; the one that stands there is taken off first.
            for w, ids in zip(new, self.sp.encode([w[1:] for w in new], num_threads=1), strict=True):
                known[w] = np.array(ids if len(w) > 1 else [self.mark], np.int32).tobytes()
        out = []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.encode(t))
                continue
            ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
            out.append((ids, *self._spans(ids, *self.normaliser.normalise(t))))
        return out

    def _spans(self, ids: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the pieces by the alignment of the normalised bytes."""
        sizes = self.sizes[ids] if sizes is None else sizes
        stop = np.cumsum(sizes)
        if stop[-1] != len(data):
            raise ValueError("the pieces do not cover the normalised text")
        return begin[stop - sizes].astype(np.int32), end[stop - 1].astype(np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and ends; a span is empty where a piece has no source (the prefix that the model adds)."""
        ids = np.array(self.sp.encode(text), np.int32)
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        sizes = self.sizes[ids]
        if self.unknown and not self.unknown.isdisjoint(ids.tolist()):
            sizes = np.array([len(p.encode()) for p in self.sp.encode(text, out_type=str)], np.int64)
        return ids, *self._spans(ids, *self.normaliser.normalise(text), sizes)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns ``keep`` with sp_ids, sp_begins and sp_ends: the pieces of the whole text and their spans of UTF-8 bytes.

    ``decoded``: with sp_decoded too, the library's decode(ids), made by the same worker that encodes.
    """
    ship(docs.sparkSession)
    base = docs.select(*keep, whole(text).alias("sp_text"))
    n = len(keep)
    names = [*keep, "sp_ids", "sp_begins", "sp_ends", *["sp_decoded"] * decoded]

    def run(batches):
        encoder = Encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(n).to_pylist()
                found = encoder.encode_batch(texts)
                cols = [_lists([f[k] for f in found]) for k in range(3)]
                if decoded:
                    cols.append(pa.array(encoder.sp.decode([f[0].tolist() for f in found], num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:n])
    return base.mapInArrow(run, f"{fields}, sp_ids array<int>, sp_begins array<int>, sp_ends array<int>" + ", sp_decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, ids: str = "sp_ids") -> DataFrame:
    """All columns with sp_decoded, the library's decode(ids); null ids count as none."""
    ship(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "sp_decoded"]
    base = encoded.select(*names)
    at_ids = names.index(ids)

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = sp.decode([i or [] for i in part.column(at_ids).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "sp_decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, sp_decoded string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The contract's columns for each document, derived from the encoded and the decoded rows."""
    return encode(docs, model_path, decoded=True).select(
        "doc_id",
        F.size("sp_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("sp_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("sp_decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("sp_ends"), F.lit(0)).cast("long").alias("span_bytes"),
        F.xxhash64("sp_begins", "sp_ends").alias("spans_hash"),
    )


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
