"""SentencePiece encoding with byte offsets, and decoding.

The model's own character map is compiled into a double-array trie followed by replacement
strings. ``Normaliser`` walks a text with the longest prefix that the trie knows, and records
for each normalised byte the source byte where its replacement began (and for its end, where
the source of the next one begins). The normalised text then goes to a copy of the model whose
own normalisation is switched off, so what is encoded is exactly what was aligned; the length
of every piece projects it to a span of original bytes.

Defined cases: a null or empty text has no pieces, only the end id; repeated rows are each
encoded; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import prepare, texts

# Fixed values of the model file's wire format: field numbers.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORM_NAME, NORM_MAP, NORM_DUMMY, NORM_EXTRA, NORM_ESCAPE = 1, 2, 3, 4, 5
SUFFIX_SPACE = 24
BYTE_TYPE, USER_TYPE = 6, 4
MARK = "▁".encode()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(field number, value, the field's own bytes) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            if key & 7 == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at:at + size], at + size
        yield key >> 3, value, data[start:at]


def _field(number: int, payload: bytes) -> bytes:
    out = bytearray()
    for x in (number << 3 | 2, len(payload)):
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out) + payload


class CharMap:
    """Longest-prefix lookups in a compiled character map.

    The blob is the trie's size in bytes, the trie's 32-bit units, and zero-ended replacements.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        self.starts = np.zeros(256, bool)
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.strings = blob[4 + n:]
            root = self._offset(self.units[0])
            for c in range(256):
                at = root ^ c
                self.starts[c] = at < len(self.units) and self.units[at] & 0x800000FF == c

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest known prefix of data[at:] and its replacement."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        position = self._offset(units[0])
        for i in range(at, len(data)):
            node = position ^ data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            position = node ^ self._offset(unit)
            if unit & 256:
                value = units[position] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[value:self.strings.index(b"\0", value)])
        return best


class Normaliser:
    """Normalised bytes and, for each of them and for the end, the source offset."""

    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True, suffix: bool = False):
        self.map = CharMap(blob)
        self.dummy, self.remove, self.suffix = dummy_prefix, remove_extra, suffix
        self.space = MARK if escape else b" "

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if not source:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.remove:
            return self._plain(source)
        return self._mapped(source)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no space to remove: only spaces change, all at once."""
        raw = np.frombuffer(source, np.uint8)
        width = np.where(raw == 32, len(self.space), 1)
        starts = np.repeat(np.arange(len(raw)), width)
        data, ends = source.replace(b" ", self.space), [len(raw)]
        if self.dummy and not self.suffix:
            return self.space + data, np.concatenate([np.zeros(len(self.space), np.int64), starts, ends])
        if self.dummy:
            return data + self.space, np.concatenate([starts, np.full(len(self.space), len(raw)), ends])
        return data, np.concatenate([starts, ends])

    def _mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, starts, at, n = bytearray(), [], 0, len(source)
        steps: list[tuple[int, bytes]] = []
        while at < n:
            hit = self.map.longest(source, at) if self.map.units and self.map.starts[source[at]] else None
            if hit:
                size, text = hit
            else:
                lead = source[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                text = source[at:at + size]
            steps.append((at, text))
            at += size
        first = 0
        if self.remove:
            while first < len(steps) and not steps[first][1].strip(b" "):
                first += 1
        if first == len(steps):
            return b"", np.array([n], np.int64)

        def put(data: bytes, where: int) -> None:
            out.extend(data)
            starts.extend([where] * len(data))

        if self.dummy and not self.suffix:
            put(self.space, steps[first][0])
        blank = self.remove
        for where, text in steps[first:]:
            while blank and text.startswith(b" "):
                text = text[1:]
            if not text:
                continue
            for part in text:
                put(self.space if part == 32 else bytes([part]), where)
            if self.remove:
                blank = text.endswith(b" ")
        last = n
        if self.remove:
            while out.endswith(self.space):
                last = starts[len(out) - len(self.space)]
                del out[len(out) - len(self.space):]
                del starts[len(out):]
        if self.dummy and self.suffix:
            put(self.space, last)
        return bytes(out), np.array([*starts, last], np.int64)


class PieceCodec:
    """Encodes and decodes with a SentencePiece model file; a worker keeps one of each."""

    kept: dict[str, PieceCodec] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, parts, widths, suffix, users = {}, [], [], 0, False
        for number, value, whole in fields(model):
            if number == NORMALIZER:
                spec = {k: v for k, v, _ in fields(value)}
                continue
            if number == TRAINER:
                suffix = next((v for k, v, _ in fields(value) if k == SUFFIX_SPACE), 0)
            if number == PIECES:
                piece = {k: v for k, v, _ in fields(value)}
                widths.append(1 if piece.get(3) == BYTE_TYPE else len(piece[1]))
                users |= piece.get(3) == USER_TYPE
            parts.append(whole)
        if users:
            raise ValueError("models with user-defined pieces are not supported")
        off = b"".join(bytes([k << 3, 0]) for k in (NORM_DUMMY, NORM_EXTRA, NORM_ESCAPE))
        parts.append(_field(NORMALIZER, _field(NORM_NAME, b"identity") + off))
        self.aligned = sentencepiece.SentencePieceProcessor(model_proto=b"".join(parts))
        self.widths = np.array(widths, np.int64)
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.normalise = Normaliser(spec.get(NORM_MAP, b""), bool(spec.get(NORM_DUMMY, 1)), bool(spec.get(NORM_EXTRA, 1)), bool(spec.get(NORM_ESCAPE, 1)), bool(suffix))
        self.names = [str(i) for i in range(len(widths))]

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, source: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids without the end id, and the original byte span of each: starts, ends.

        Bytes that are no valid UTF-8 become replacement characters first; spans count in that text.
        """
        try:
            source.decode()
        except UnicodeDecodeError:
            source = source.decode("utf-8", "replace").encode()
        text, starts = self.normalise(source)
        ids = self.aligned.encode(text.decode("utf-8", "replace")) if text else []
        width = self.widths[ids] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:
            # without byte fallback an unknown piece covers a run of characters: ask the library
            spans = self.aligned.encode(text.decode("utf-8", "replace"), return_type="proto").pieces
            width = np.array([len(p.surface.encode()) for p in spans], np.int64)
        cuts = np.concatenate([[0], np.cumsum(width)])
        if cuts[-1] != len(text):
            raise ValueError("the pieces do not cover the normalised text")
        return ids, starts[cuts[:-1]], starts[cuts[1:]]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _encoded(path: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(path)
        for batch in batches:
            n, ids_sha, decoded_sha, lists, begins, ends = [], [], [], [], [], []
            spans_sha = []
            for text in batch.column(1):
                ids, start, end = codec.encode(text.as_py())
                ids = [*ids, codec.end]
                n.append(len(ids))
                if spans:
                    lists.append(ids)
                    begins.append(start)
                    ends.append(end)
                    continue
                ids_sha.append(hashlib.sha256(" ".join([codec.names[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                spans_sha.append(hashlib.sha256(np.stack([start, end]).astype("<i8").tobytes()).hexdigest())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64())}
            if spans:
                kind = pa.list_(pa.int64())
                out |= {"ids": pa.array(lists, kind), "starts": pa.array(begins, kind), "ends": pa.array(ends, kind)}
            else:
                out |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string()), "spans_sha256": pa.array(spans_sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and starts and ends of all but it in original bytes."""
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_encoded(model_path, True), "doc_id long, n_tokens long, ids array<long>, starts array<long>, ends array<long>")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids, of the decoded text, and of the byte spans (little-endian 64-bit starts, then ends)."""
    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_encoded(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([codec.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
