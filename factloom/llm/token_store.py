"""Token ids in a compressed, randomly accessible file format: Re-Pair grammars per shard.

Documents are encoded by the tokenizers library, in ascending order of doc_id, and an end id is appended to
each. A shard is a run of documents of bounded size. In it, frequent pairs of ids are replaced by
nonterminals, again and again; first inside the shard's distinct words, whose pair counts are weighted by
how often a word occurs, then across words. Pair counts cover the whole shard, and no rule spans two
documents.

A shard's bytes, all little-endian:
    4 bytes "RPG2"; uint32 base, count of documents d, rules r, symbols s, width of a symbol in bytes (2 or 4)
    r * 2 uint32: the two symbols of each rule (a rule's number is the base, the vocabulary's size, + its place)
    r * uint32: how many ids each rule expands to
    (d + 1) * uint32: the symbol at which each document starts
    (d + 1) * uint64: the ids before each document in the shard
    s symbols
Shards are rows of Parquet files with the doc_ids beside them, written by Spark to the shared folder.

Defined cases: null is the empty text, which has the end id only; an empty table gives no shards and an
empty result; equal doc_ids are ordered by a hash of their text.
"""

from __future__ import annotations

import struct
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, small, stored, tidy

#: Nonterminals of a shard (with a vocabulary of up to 49,536 ids, two bytes hold all symbols), and how often a frequent pair occurs in it.
MOST_RULES, LEAST_COUNT = 16_000, 8
#: Rules a round within words, and in all such rounds; rules a round across words, which go on while there is room.
WORD_ROUND, WORD_RULES, TEXT_ROUND = 2250, 9000, 2500
SHARD_CHARS, REMEMBERED = 12_000_000, 600_000
#: Begins a unit that is a whole text; no word of a plain text has it.
WHOLE = "\uffff"
#: The id that ends a document, as bytes.
END = (1).to_bytes(4, "little")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Units of a text and their ids. Texts in plain Latin letters are cut at white space, and units into the words that the
    library's own splitter would give, so that it need encode each word once; all other texts go to the library whole."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: The first nonterminal: above all ids.
        self.base = 1 + max(1, *self.library.get_vocab(with_added_tokens=True).values())
        # below U+0250: runs of letters, single numerals, English endings, runs of other signs
        letters, numerals, space = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
        self.words = re.compile(f"[{letters}]+|[{numerals}]|'(?:s|t|re|ve|m|ll|d)|[^{letters}{numerals}{space}]+").findall
        #: Which ids end a word.
        self.last = np.array([(self.library.id_to_token(k) or "").endswith("</w>") for k in range(self.base)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> bool:
        return text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) < 0x250

    def cuttable(self, text: str) -> str | None:
        """The text in lower case if it may be cut at white space, else nothing: it has special tokens, other letters, or signs at which white space is seen differently."""
        # small letters may lie elsewhere than their capitals: the lower case counts
        small = text.lower()
        return None if not self.plain(small) or any(x in small for x in ("<|", "\x1c", "\x1d", "\x1e", "\x1f")) else small

    def units(self, texts: list[str | None]) -> tuple[list[pa.Array], list[int]]:
        """Strings to encode one by one, and how many each text has; a text that isn't cut is one unit, marked as whole."""
        found, sizes, run = [], [], []

        def cut() -> None:
            if run:
                words = pc.utf8_split_whitespace(pa.array(run, pa.large_string()))
                found.append(words.flatten())
                sizes.extend(np.diff(words.offsets.to_numpy()).tolist())
                run.clear()

        for text in texts:
            if (small := self.cuttable(text or "")) is not None:
                run.append(small)
            else:
                cut()
                found.append(pa.array([WHOLE + text], pa.large_string()))
                sizes.append(1)
        cut()
        return found, sizes

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, which go to the library together, parted by spaces, and are told apart by their last ids."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = self.library.encode(" ".join(part), add_special_tokens=False).ids
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # an id at which no word can end: one by one
                split = [array("I", self.library.encode(w, add_special_tokens=False).ids).tobytes() for w in part]
            else:
                raw = array("I", ids).tobytes()
                split = [raw[4 * x : 4 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            self.known.update(zip(part, split, strict=True))

    def ids(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian 32-bit integers."""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [[u] if u.isalpha() or u in known else None if u.startswith(WHOLE) else self.words(u) for u in units]
        new = {w for words in cut if words for w in words if w not in known}
        known.update((w, older[w]) for w in new if w in older)
        self._learn(sorted(w for w in new if w not in known))
        found = []
        for u, words in zip(units, cut, strict=True):
            if words is None:
                found.append(array("I", self.library.encode(u[1:], add_special_tokens=False).ids).tobytes())
            else:
                found.append(known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]))
        for w in new:  # long words are not remembered
            if len(w) > 64:
                del known[w]
        return found


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def replace_pairs(seq: np.ndarray, last: np.ndarray, weight: np.ndarray | None, rules: list[tuple[int, int]], most: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """One round: the ``most`` most frequent pairs become rules, and their places, leftmost first, nonterminals.

    ``last`` marks the last symbol of a unit, which begins no pair.
    """
    most = min(most, MOST_RULES - len(rules))
    open_pairs = ~last[:-1]
    if most <= 0 or not open_pairs.any():
        return seq, last, weight
    # a pair is one number: of 32 bits where symbols have 16
    kind, bits, factor = (np.uint32, 16, 0x9E3779B1) if int(seq.max()) < 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)
    codes = seq[:-1].astype(kind) << kind(bits) | seq[1:].astype(kind)
    if weight is None:
        ordered = np.sort(codes[open_pairs])
    else:
        own = np.flatnonzero(open_pairs)
        order = own[np.argsort(codes[own])]
        ordered = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    pairs = ordered[starts]
    counts = np.diff(np.append(starts, len(ordered))) if weight is None else np.add.reduceat(weight[order], starts)
    # the most frequent ones, equal ones in order of their codes
    edge = max(LEAST_COUNT, int(np.partition(counts, -most)[-most]) if len(counts) > most else 0)
    chosen = np.concatenate([np.flatnonzero(counts > edge), np.flatnonzero(counts == edge)])[:most]
    if not len(chosen):
        return seq, last, weight
    # a small hash table finds them; of two that meet in a slot the more frequent one, or the first, is taken this round
    slot = lambda c: (c * kind(factor)) >> kind(2 * bits - 20)
    chosen = chosen[np.argsort(-counts[chosen], kind="stable")]
    _, first = np.unique(slot(pairs[chosen]), return_index=True)
    table = pairs[chosen[np.sort(first)]]
    lookup = np.zeros(1 << 20, np.uint16)
    lookup[slot(table)] = np.arange(len(table))
    new = lookup[slot(codes)]
    places = np.flatnonzero((table[new] == codes) & open_pairs)
    new = base + len(rules) + new[places].astype(np.int64)
    rules += [(int(c) >> bits, int(c) & ((1 << bits) - 1)) for c in table.tolist()]
    # of places in a row every second one is taken
    begin = np.concatenate([[True], places[1:] != places[:-1] + 1])
    offset = np.arange(len(places)) - np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))
    places, new = places[offset % 2 == 0], new[offset % 2 == 0]
    seq, last = seq.copy(), last.copy()
    seq[places] = new
    last[places] = last[places + 1]
    keep = np.ones(len(seq), bool)
    keep[places + 1] = False
    return seq[keep], last[keep], None if weight is None else weight[keep]


def compress(units: list[bytes], texts: list[np.ndarray], base: int) -> bytes:
    """A shard from its distinct units' ids (below ``base``) and, per document, the numbers of its units in order."""
    rules: list[tuple[int, int]] = []
    sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
    whole = np.concatenate(texts) if texts else np.empty(0, np.int32)
    uses = np.bincount(whole, minlength=len(units))
    seq = np.frombuffer(b"".join(units), "<u4")
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    weight = np.repeat(uses, sizes)
    had = -1
    while len(seq) and had < len(rules) < WORD_RULES:
        had = len(rules)
        seq, last, weight = replace_pairs(seq, last, weight, rules, min(WORD_ROUND, WORD_RULES - had), base)
    # units without ids have no symbols; the others end at their marks
    short = np.zeros(len(units), np.int64)
    ends = np.flatnonzero(last) + 1
    short[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    starts = np.cumsum(short) - short
    n = short[whole]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[whole], n)
    per_text = np.array([int(short[t].sum()) for t in texts], np.int64)
    last = np.zeros(len(at), bool)
    last[np.cumsum(per_text) - 1] = True
    seq = seq[at]
    # until no pair is frequent or all nonterminals are taken; what is left within words is found here too
    weight, had = None, -1
    while len(seq) > 1 and had < len(rules):
        had = len(rules)
        seq, last, weight = replace_pairs(seq, last, weight, rules, TEXT_ROUND, base)
    lengths = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules):
        lengths[base + k] = lengths[a] + lengths[b]
    begins = np.concatenate([[0], np.flatnonzero(last) + 1])
    before = np.concatenate([[0], np.cumsum(lengths[seq])])[begins]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return b"".join([
        b"RPG2", struct.pack("<5I", base, len(texts), len(rules), len(seq), width), np.array(rules, "<u4").tobytes(), lengths[base:].astype("<u4").tobytes(),
        begins.astype("<u4").tobytes(), before.astype("<u8").tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"RPG2":
            raise ValueError("not a shard")
        self.base, self.documents, r, s, width = struct.unpack_from("<5I", raw, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.rules, self.lengths = take("<u4", 2 * r).reshape(r, 2), take("<u4", r)
        self.begins, self.before, self.symbols = take("<u4", self.documents + 1), take("<u8", self.documents + 1), take(f"<u{width}", s)
        self._flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._flat is None:
            base = self.base
            sizes = np.concatenate([np.ones(base, np.int64), self.lengths.astype(np.int64)])
            starts = np.cumsum(sizes) - sizes
            flat = np.empty(int(sizes.sum()), np.uint32)
            flat[:base] = np.arange(base)
            for k, (a, b) in enumerate(self.rules.tolist()):
                x, n = int(starts[base + k]), int(sizes[a])
                flat[x : x + n] = flat[starts[a] : starts[a] + n]
                flat[x + n : x + int(sizes[base + k])] = flat[starts[b] : starts[b] + sizes[b]]
            self._flat = flat, starts, sizes
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts, sizes = self._expansions()
        n = sizes[symbols]
        return flat[np.arange(int(n.sum())) + np.repeat(starts[symbols] - (np.cumsum(n) - n), n)]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.expand(self.symbols[self.begins[k] : self.begins[k + 1]])

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids by place in the shard; only the symbols that hold them are expanded."""
        sizes = self._expansions()[2]
        k = int(np.searchsorted(self.before, first, "right")) - 1
        lo = int(self.begins[min(k, self.documents)])
        end = int(self.begins[min(int(np.searchsorted(self.before, first + count, "left")), self.documents)])
        ahead = int(self.before[k])
        sums = ahead + np.concatenate([[0], np.cumsum(sizes[self.symbols[lo:end]])])
        a, b = int(np.searchsorted(sums, first, "right")) - 1, int(np.searchsorted(sums, first + count, "left"))
        return self.expand(self.symbols[lo + a : lo + b])[first - int(sums[a]) :][:count]


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Encode, compress and write all documents; the shards as a table (part, number, n_ids, doc_ids, shard), read back from its files."""
    ids_type = docs.schema[id_col].dataType
    ids_arrow, file = to_arrow_type(ids_type), vocabulary or default_vocabulary()

    @tidy
    def encode(arrow):
        from pyspark import TaskContext

        encoder, part, number = loaded(file), TaskContext.get().partitionId(), 0
        doc_ids, strings, sizes, size = [], [], [], 0

        def shard():
            coded = pa.chunked_array(strings, pa.large_string()).combine_chunks().dictionary_encode()
            units = [END, *encoder.ids(coded.dictionary.to_pylist())]
            ends = np.cumsum(sizes)
            whole = np.insert(coded.indices.to_numpy() + 1, ends, 0).astype(np.int32)  # number 0 ends a document
            raw = compress(units, np.split(whole, (ends + np.arange(1, len(ends) + 1))[:-1]), encoder.base)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(ids_arrow), pa.binary()]
            values = [part, number, int(Shard(raw).before[-1]), doc_ids, raw]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "number", "n_ids", "doc_ids", "shard"])

        for ids, texts in batches(arrow, ["a", "b"], 128):
            found, n = encoder.units(texts)
            strings += found
            sizes += n
            doc_ids += ids
            size += sum(len(x or "") + 64 for x in texts)
            if size >= SHARD_CHARS:
                yield shard()
                number += 1
                doc_ids, strings, sizes, size = [], [], [], 0
        if doc_ids:
            yield shard()

    rows = docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b"), F.xxhash64(col(docs, text_col)).alias("h"))
    rows = rows.repartitionByRange("a", "h").sortWithinPartitions("a", "h").drop("h")
    shards = rows.mapInArrow(encode, f"part bigint, number bigint, n_ids bigint, doc_ids array<{ddl(ids_type)}>, shard binary")
    if path is None:
        return stored(shards, "shards")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    ids_type = shards.schema["doc_ids"].dataType.elementType
    ids_arrow = to_arrow_type(ids_type)
    # three numbers a shard; a shard holds megabytes of text
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(shards.select("part", "number", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids"), "starts")

    @tidy
    def read(arrow):
        for doc_ids, raws, firsts in batches(arrow, ["doc_ids", "shard", "first"], 1):
            for ids, raw, first in zip(doc_ids, raws, firsts, strict=True):
                found = Shard(raw)
                crcs = []
                for lo in range(0, found.documents, 256):
                    hi = min(found.documents, lo + 256)
                    part = memoryview(found.expand(found.symbols[found.begins[lo] : found.begins[hi]]).astype("<u4", copy=False)).cast("B")
                    shift = int(found.before[lo])
                    crcs += [crc32(part[4 * (int(found.before[k]) - shift) : 4 * (int(found.before[k + 1]) - shift)]) for k in range(lo, hi)]
                before = found.before.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, ids_arrow), pa.array(first + before[:-1]), pa.array(np.diff(before)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(small(starts), ["part", "number"]).select("doc_ids", "shard", "first").mapInArrow(read, f"doc_id {ddl(ids_type)}, start bigint, n_tokens bigint, ids_crc32 bigint")
