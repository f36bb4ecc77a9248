"""SentencePiece encoding with the place of every piece in the source, and decoding."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

SPACE = "▁".encode()


class CharacterMap:
    """Longest-prefix rewriting rules read from a model's compiled character map, a double-array trie.

    The map is a little-endian length, the trie's units and the replacements, each ended by a zero byte.  A unit holds a
    label in its low byte, a leaf flag at bit 8, an offset above bit 10 (times 256 if bit 9 is set), or a leaf's value.
    """

    def __init__(self, blob: bytes):
        self.rules: dict[bytes, bytes] = {}
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
            stack = [(0, b"")]
            while stack:
                at, prefix = stack.pop()
                base = at ^ self._offset(units[at])
                if units[at] >> 8 & 1:
                    value = units[base] & 0x7FFFFFFF
                    self.rules[prefix] = texts[value : texts.index(b"\0", value)]
                for byte in range(1, 256):
                    child = base ^ byte
                    if child < len(units) and units[child] & 0x800000FF == byte:
                        stack.append((child, prefix + bytes([byte])))
        self.longest = max(map(len, self.rules), default=0)
        starts = b"".join(re.escape(bytes([b])) for b in sorted({k[0] for k in self.rules}))
        self.start = re.compile(b"[" + starts + b"]") if starts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def rewrite(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text rewritten at each place by the longest rule that matches, and each byte's place in the source."""
        if self.start is None:
            return data, np.arange(len(data) + 1)
        out, sources, at = [], [], 0
        while m := self.start.search(data, at):
            i = m.start()
            out.append(data[at:i])
            sources.append(np.arange(at, i))
            for length in range(min(self.longest, len(data) - i), 0, -1):
                new = self.rules.get(data[i : i + length])
                if new is not None:
                    break
            else:  # one whole character
                length = next((n for n in range(1, 4) if i + n >= len(data) or data[i + n] & 0xC0 != 0x80), 4)
                new = data[i : i + length]
                sources.append(np.arange(i, i + length))
                out.append(new)
                at = i + length
                continue
            out.append(new)
            sources.append(np.full(len(new), i))
            at = i + length
        out.append(data[at:])
        sources.append(np.arange(at, len(data) + 1))
        return b"".join(out), np.concatenate(sources)


class Encoder:
    """A model with its normaliser; equal to the library's ids, with byte spans of the source."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec = proto.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        # bytes of the normalised text that a piece covers; -1 where only the text tells (unknown pieces)
        self.sizes = np.array([1 if p.type == 6 else -1 if p.type == 2 else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each byte and the end, its place in the source."""
        text, source = self.map.rewrite(data)
        if self.spec.remove_extra_whitespaces:
            b = np.frombuffer(text, np.uint8)
            space = b == 32
            keep = ~(space & np.concatenate(([True], space[:-1])))
            end = len(text.rstrip(b" "))
            keep[end:] = False
            text, source = b[keep].tobytes(), np.append(source[:-1][keep], source[end])
        if not text:
            return b"", source[-1:]
        if self.spec.add_dummy_prefix:
            text, source = (text + b" ", np.append(source, source[-1])) if self.suffix else (b" " + text, np.append(source[0] if self.spec.remove_extra_whitespaces else 0, source))
        if self.spec.escape_whitespaces:
            wide = np.where(np.frombuffer(text, np.uint8) == 32, 3, 1)
            text, source = text.replace(b" ", SPACE), np.append(np.repeat(source[:-1], wide), source[-1])
        return text, source

    def spans(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """First and one past the last source byte of each piece; None if the pieces do not cover the normalised text."""
        text, source = self.normalise(data)
        sizes = self.sizes[ids]
        if (sizes < 0).any():
            sizes = np.array([len(p.surface.replace(" ", SPACE.decode()).encode()) if s < 0 else s for p, s in zip(
                self.model.encode(data.decode(), out_type="immutable_proto").pieces, sizes)], np.int64)
        ends = np.cumsum(sizes)
        if len(ids) and ends[-1] != len(text):
            return None
        return source[ends - sizes], source[ends]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``ids``, ``starts`` and ``ends`` (byte span of each piece in the source) and ``decoded``.

    Whole texts, without begin or end ids.  The text is normalised by the longest prefixes of the model's character map,
    keeping the source of every byte; the model cuts it into pieces, and the cumulated sizes of the pieces are looked up
    in that alignment.  A null or empty text has no ids, and rows that repeat each have theirs; an
    empty table gives none.  Where the alignment does not cover the pieces (symbols that a model exempts from
    normalisation), the ids stand and the spans are null.  ``path`` is the model file on every worker; it is read once a
    worker.  Own columns replace kept ones of the same names.
    """

    def make():
        e = encoder(path)

        def kernel(texts: pa.Array) -> list[pa.Array]:
            values = [t or "" for t in texts.to_pylist()]
            lists = e.model.encode(values, num_threads=1)
            flat = np.fromiter((i for ids in lists for i in ids), np.int32, sum(map(len, lists)))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            starts, ends = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32)
            unknown = np.zeros(len(values), bool)
            for k, value in enumerate(values):
                a, b = offsets[k], offsets[k + 1]
                spans = e.spans(value.encode(), flat[a:b])
                unknown[k] = spans is None
                starts[a:b], ends[a:b] = (0, 0) if spans is None else spans
            decoded = [e.model.decode(ids) if ids else "" for ids in lists]
            bare = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), mask=pa.array(unknown)) for x in (starts, ends)]
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *bare, pa.array(decoded, pa.string())]

        return kernel

    return map_texts(docs, make, "ids array<int>, starts array<int>, ends array<int>, decoded string", keep, text, most=1 << 20)
