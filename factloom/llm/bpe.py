"""Byte-level BPE, encoded with a segment tree over the ranks of adjacent pairs.

Within a pre-token, the leaves of the tree hold the merge ranks of adjacent symbol pairs (infinite where
the pair has no merge). Its root gives the leftmost pair of lowest rank; a merge updates the few leaves
around it in logarithmic time, until the root is infinite. Pre-tokens repeat, so each worker keeps a
bounded memory of those it has encoded.

Defined cases: null is the empty text and has no ids; special tokens in a text become their own ids, as
the tokenizers library does by default; repeated rows give repeated results; a text of any length is
encoded whole, in n log n.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, tidy

INFINITE = 1 << 62
#: A worker remembers the pre-tokens of two generations, so many in each at most, and none longer than this.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class SegmentTree:
    """Minimum of (rank, position) over the leaves; ``put`` changes some of them."""

    def __init__(self, ranks: list[int]):
        n = len(ranks)
        base = 1 << (n - 1).bit_length()
        #: A node holds rank << 32 | position, so the minimum is the leftmost of the lowest rank.
        nodes = self.nodes = [INFINITE] * base + [r | k for k, r in enumerate(ranks)] + [INFINITE] * (base - n)
        self.base = base
        for k in range(base - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b

    def put(self, leaves: list[tuple[int, int]]) -> None:
        """Each leaf (position, rank << 32), then up to the first ancestor that stays the same."""
        nodes, base = self.nodes, self.base
        for position, rank in leaves:
            k = base + position
            low = nodes[k] = rank | position
            while k > 1:
                other = nodes[k ^ 1]
                if other < low:
                    low = other
                k >>= 1
                if nodes[k] == low:
                    break
                nodes[k] = low


class ByteBPE:
    """The encoder and decoder of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.first = [vocabulary[alphabet[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = vocabulary[a] << 32 | vocabulary[b]
            self.rank.setdefault(key, k << 32)
            self.merged.setdefault(key, vocabulary[a + b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        # letters, digits and other signs, each with one space before; English endings; white space
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one pre-token."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged = self.rank.get, self.merged
        tree = SegmentTree([rank(a << 32 | b, INFINITE) for a, b in zip(symbols, symbols[1:], strict=False)])
        after, before, nodes = list(range(1, n + 1)), list(range(-1, n - 1)), tree.nodes
        while nodes[1] < INFINITE:
            k = nodes[1] & 0xFFFFFFFF
            right = after[k]
            new = symbols[k] = merged[symbols[k] << 32 | symbols[right]]
            symbols[right] = -1
            end = after[k] = after[right]
            leaves = []
            if end < n:
                before[end] = k
                leaves.append((right, INFINITE))
                leaves.append((k, rank(new << 32 | symbols[end], INFINITE)))
            else:
                if right < n - 1:
                    leaves.append((right, INFINITE))
                leaves.append((k, INFINITE))
            if (left := before[k]) >= 0:
                leaves.append((left, rank(symbols[left] << 32 | new, INFINITE)))
            tree.put(leaves)
        return [x for x in symbols if x >= 0]

    def piece(self, part: str) -> bytes:
        """One pre-token's ids, as little-endian 32-bit integers."""
        if (ids := self.older.get(part)) is None:
            first = self.first
            ids = array("I", self.merge([first[b] for b in part.encode()])).tobytes()
        if len(part) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        piece, out = self.piece, []
        for section in self.cut(text) if self.cut and any(s in text for s in self.special) else (text,):
            if section in self.special:
                out.append(self.special[section].to_bytes(4, "little"))
            else:
                known = self.known.get
                out += [known(x) or piece(x) for x in self.parts(section)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One encoder a worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded_sha256) of every row: a narrow map in bounded batches."""
    import numpy as np

    ids_type = docs.schema[id_col].dataType
    ids_arrow, path = to_arrow_type(ids_type), vocabulary or default_vocabulary()

    @tidy
    def encode(arrow):
        bpe = loaded(path)
        for doc_id, text in batches(arrow, ["a", "b"], 128):
            found = [bpe.encode(x) for x in text]
            decoded = [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found]
            lengths = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, ids_arrow), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b")).mapInArrow(encode, f"doc_id {ddl(ids_type)}, n_tokens bigint, ids array<int>, decoded_sha256 string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the same round trip where only digests leave the worker."""
    ids_type = docs.schema[id_col].dataType
    ids_arrow, path = to_arrow_type(ids_type), vocabulary or default_vocabulary()

    @tidy
    def digest(arrow):
        bpe = loaded(path)
        for doc_id, text in batches(arrow, ["a", "b"], 128):
            found = [bpe.encode(x) for x in text]
            decoded = [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, ids_arrow), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b")).mapInArrow(digest, f"doc_id {ddl(ids_type)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
