"""Byte-level BPE as a monoid: halves are encoded recursively and joined at their boundary."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table, texts

#: A piece of at most this many bytes is merged directly, a longer one as a tree of halves.
LEAF_BYTES = 48
#: Pieces whose tokens a worker remembers; beyond it the memory starts anew.
REMEMBERED = 700_000

#: What the Unicode classes of a pattern come to among ASCII characters.
_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": "\t-\r ", r"\S": "^\t-\r "}


def ascii_pattern(pattern: str) -> str | None:
    """A pattern of the standard library with the same matches in ASCII texts; null if a class isn't known."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        part = next((k for k in _ASCII if pattern.startswith(k, i)), None)
        if part:
            if inside and part == r"\S":
                return None
            out.append(_ASCII[part] if inside else f"[{_ASCII[part]}]")
            i += len(part)
            continue
        if c == "\\":
            return None
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


class Codec:
    """Encodes and decodes by a table of ranks (bytes -> id), each match of ``pattern`` on its own.

    ``encode_piece`` is a tree reduction: the halves' tokens are joined by encoding a window over the boundary anew.
    The window grows on a side until its outermost token there is the one that stood there before. Then every two
    neighbouring tokens of the result are what their joined bytes encode to (those outside the window and across its
    ends were neighbours before), and a sequence all of whose neighbours are so is the encoding of the whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.find_ascii = re.compile(plain).findall if plain else self.find
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _leaf(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        get, none = ranks.get, 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            new = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(new + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + new, none)
        return [ranks[p] for p in parts]

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self._leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        i, j = min(2, len(left)), min(2, len(right))
        while True:
            window = left[len(left) - i :] + right[:j]
            new = self._leaf(self.decode_ids(window))
            grow_left = i < len(left) and new[0] != window[0]
            grow_right = j < len(right) and new[-1] != window[-1]
            if not (grow_left or grow_right) and (len(new) > 1 or (i == len(left) and j == len(right)) or len(window) == 1):
                return left[: len(left) - i] + new + right[j:]
            i, j = min(len(left), 2 * i), min(len(right), 2 * j)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        put = out.append
        for piece in self.find_ascii(text) if text.isascii() else self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
                if len(piece) <= LEAF_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            put(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_ids(self, ids: list[int]) -> bytes:
        """Concatenation up the tree: leaves of a few thousand ids, then their halves."""
        if len(ids) <= 8192:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode_ids(ids[:half]) + self.decode_ids(ids[half:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary file in a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.from_file(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded binary`` of every row's whole text, without special tokens.

    With ``digests``, ``ids_sha256`` and ``decoded_sha256`` take the place of the last two, so no list of ids
    leaves a worker. A null text is empty and has no ids. Row by row: repeated rows and null ids go through as they
    are; an empty table gives an empty result. ``path`` names a vocabulary file that every executor can open.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            cols = [[], [], []]
            for text in b.column("text").to_pylist():
                packed = c.encode_bytes(text)
                ids = np.frombuffer(packed, "<u4").tolist()
                decoded = c.decode_ids(ids)
                row = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (len(ids), ids, decoded)
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names)

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
