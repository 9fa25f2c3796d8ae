"""Language identification by segmentation-marginalised unigrams.

The pieces of a public vocabulary have a probability per language. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words
(lower-cased runs of letters). Probabilities are learned by expectation-maximisation on words of a
bounded sample of labelled documents: at most SAMPLE of each of the LANGUAGES most frequent labels, drawn by
a hash. What leaves the executors is one number a language and piece, bounded by the vocabulary.

Defined cases: null texts and texts without a letter give ``und`` with score 0; without any labelled
document every text gives ``und``; equal likelihoods fall to the language first by code point; words of
more than LONGEST letters are scored in parts of that length; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, stored, tidy

#: Bound of the training sample in documents a language; EM rounds after the first count.
SAMPLE, ROUNDS = 600, 2
#: Labels that are learned at most, the most frequent ones: what leaves the executors is bounded whatever a lang column holds.
LANGUAGES = 200
LONGEST, UNKNOWN, SMOOTHING = 40, 1e-7, 0.02
#: Words whose scores a worker remembers at most.
REMEMBERED = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, lower case, each once; word starts are marked by U+2581."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(x for x in found if x.replace("▁", "a").isalpha() and "▁" not in x[1:])


#: Letters below U+0250, which a plain character class tells faster than Unicode properties.
_LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+").findall


def letter_runs(text: str) -> list[str]:
    import regex

    text = text.lower()
    if text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) < 0x250:
        return _LATIN(text)
    return regex.findall(r"\p{L}+", text)


def parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def spans(word: str, known: dict) -> list[list[tuple[int, object]]]:
    """For each end in the marked word, the starts of pieces that end there, with what ``known`` has for them.

    A word's mark belongs to its first letter, so a first piece is tried with the mark and without.
    """
    n = len(word)
    out: list[list[tuple[int, object]]] = [[] for _ in range(n + 1)]
    longest = known[""]
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = word[start:end]
            if piece in known:
                out[end].append((start, known[piece]))
            if start == 0 and (marked := "▁" + piece) in known:
                out[end].append((0, known[marked]))
    return out


def forward(word: str, table: dict[str, tuple[float, ...]], languages: int) -> list[float]:
    """Log probability of a word in each language: the sum over all segmentations."""
    unknown = (UNKNOWN,) * languages
    alpha = [[1.0] * languages]
    for end, found in enumerate(spans(word, table)):
        if end == 0:
            continue
        if not any(start == end - 1 for start, _ in found):
            found = [*found, (end - 1, unknown)]
        total = [0.0] * languages
        for start, p in found:
            total = [t + a * b for t, a, b in zip(total, alpha[start], p, strict=True)]
        alpha.append(total)
    return [math.log(x) if x > 0 else -745.0 for x in alpha[-1]]


def expected(word: str, table: dict[str, tuple[str, float]]) -> dict[str, float]:
    """Expected number of each piece over all segmentations of a word; ``table`` holds (piece, probability) by spelling."""
    n, found = len(word), spans(word, table)
    for end in range(1, n + 1):
        if not any(start == end - 1 for start, _ in found[end]):
            found[end].append((end - 1, ("", UNKNOWN)))
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for end in range(1, n + 1):
        alpha[end] = sum(alpha[start] * p for start, (_, p) in found[end])
    for end in range(n, 0, -1):
        for start, (_, p) in found[end]:
            beta[start] += beta[end] * p
    out: dict[str, float] = {}
    if alpha[n] > 0:
        for end in range(1, n + 1):
            for start, (piece, p) in found[end]:
                out[piece] = out.get(piece, 0.0) + alpha[start] * p * beta[end] / alpha[n]
    return out


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    """Labelled training documents, about ``per_language`` of each language, and the languages by code point."""
    held_out = F.pmod(F.crc32(F.coalesce(col(docs, id_col).cast("string"), F.lit(""))), 5) == 0
    rows = docs.select(col(docs, id_col).cast("string").alias("a"), col(docs, text_col).alias("b"), col(docs, lang_col).alias("c"), held_out.alias("h")).filter("not h and b is not null and c is not null")
    # one row a label, of a bounded number of them
    sizes = {r.c: r.n for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(LANGUAGES).collect()}
    share = F.lit(0.0)
    for language, n in sorted(sizes.items()):
        share = F.when(F.col("c") == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64("a"), F.lit(1 << 20)) < share * (1 << 20)).select("b", "c"), sorted(sizes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, per_language: int = SAMPLE, rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, ...]], list[str]]:
    """Piece to its probabilities, in the order of the languages returned beside it."""
    path = vocabulary or default_vocabulary()
    rows, languages = sample(docs, per_language, id_col, text_col, lang_col)
    if not languages:
        return {"": 0}, []

    @tidy
    def count(arrow):
        found: Counter = Counter()
        for text, language in batches(arrow, ["b", "c"], 64):
            for t, c in zip(text, language, strict=True):
                found.update((c, p) for w in letter_runs(t) for p in parts(w))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["c", "w", "n"])

    words = stored(rows.mapInArrow(count, "c string, w string, n bigint").groupBy("c", "w").agg(F.sum("n").alias("n")), "words")
    vocabulary_pieces = pieces(path)
    longest = max(map(len, vocabulary_pieces))
    estimate: dict[str, dict[str, float]] = {c: {} for c in languages}
    for turn in range(rounds + 1):
        given, first = words.sparkSession.sparkContext.broadcast(estimate), turn == 0

        @tidy
        def expect(arrow):
            known = dict.fromkeys(pieces(path), 0)
            found: dict[tuple[str, str], float] = {}
            tables: dict[str, dict] = {}
            for language, word, n in batches(arrow, ["c", "w", "n"], 4096):
                for c, w, m in zip(language, word, n, strict=True):
                    if c not in tables:
                        tables[c] = {x: (x, 1.0 / len(known) if first else given.value[c].get(x, 0.0)) for x in known} | {"": longest}
                    for piece, x in expected(w, tables[c]).items():
                        found[c, piece] = found.get((c, piece), 0.0) + m * x
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.float64())], ["c", "p", "x"])

        # bounded by languages * vocabulary; rounded, so that the order of addition doesn't show
        sums = words.repartition("c", "w").mapInArrow(expect, "c string, p string, x double").groupBy("c", "p").agg(F.round(F.sum("x"), 6).alias("x")).filter("p != ''")
        counts: dict[str, dict[str, float]] = {c: {} for c in languages}
        for r in sums.collect():
            counts[r.c][r.p] = r.x
        estimate = {}
        for c in languages:
            whole = sum(sorted(counts[c].values())) + SMOOTHING * len(vocabulary_pieces)
            estimate[c] = {x: (counts[c].get(x, 0.0) + SMOOTHING) / whole for x in vocabulary_pieces}
    return {x: tuple(estimate[c][x] for c in languages) for x in vocabulary_pieces} | {"": longest}, languages


class Scorer:
    """Scores texts, remembering the words it has met; new words of a batch go through the forward algorithm together."""

    def __init__(self, table: dict[str, tuple[float, ...]], languages: list[str]):
        self.languages, self.longest, self.row = languages, max(1, table[""]), {}
        names = [x for x in table if x]
        #: Row 0 is no piece, row 1 an unknown letter.
        self.p = np.array([(0.0,) * len(languages), (UNKNOWN,) * len(languages), *[table[x] for x in names]]).reshape(2 + len(names), len(languages))
        #: Every piece and every beginning of one: its row, or 0 for a mere beginning.
        self.pieces = {x[:k]: 0 for x in names for k in range(1, len(x))} | {x: k for k, x in enumerate(names, 2)}
        self.scores = np.zeros((1024, len(languages)))

    def _same_length(self, words: list[str], n: int) -> np.ndarray:
        """Log probabilities of words of one length."""
        get, longest = self.pieces.get, min(n, self.longest)
        found, marked = np.zeros((n, longest, len(words)), np.int32), np.zeros((n, len(words)), np.int32)
        places, values, starts, firsts = [], [], [], []
        for w, word in enumerate(words):
            for start in range(n):
                for end in range(start + 1, min(n, start + longest) + 1):
                    if (k := get(word[start:end])) is None:
                        break
                    if k:
                        places.append(((end - 1) * longest + end - start - 1) * len(words) + w)
                        values.append(k)
            for end in range(1, longest + 1):
                if (k := get("▁" + word[:end])) is None:
                    break
                if k:
                    starts.append((end - 1) * len(words) + w)
                    firsts.append(k)
        found.reshape(-1)[places] = values
        marked.reshape(-1)[starts] = firsts
        lone = found[:, 0, :]
        unknown = lone == 0
        unknown[0] &= marked[0] == 0
        lone[unknown] = 1
        alpha = np.ones((n + 1, len(words), len(self.languages)))
        for end in range(1, n + 1):
            total = self.p[marked[end - 1]]
            for length in range(1, min(end, longest) + 1):
                if (rows := found[end - 1, length - 1]).any():
                    total = total + alpha[end - length] * self.p[rows]
            alpha[end] = total
        return np.log(np.maximum(alpha[n], 1e-320))

    def learn(self, words: set[str]) -> None:
        """Scores of new words."""
        by_length: dict[int, list[tuple[str, int]]] = {}
        order = sorted(words)
        for k, word in enumerate(order):
            for part in parts(word):
                by_length.setdefault(len(part), []).append((part, k))
        found = np.zeros((len(order), len(self.languages)))
        for n, items in sorted(by_length.items()):
            for at in range(0, len(items), 2048):
                some = items[at : at + 2048]
                np.add.at(found, [k for _, k in some], self._same_length([x for x, _ in some], n))
        first = len(self.row)
        while first + len(order) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[first : first + len(order)] = found
        self.row.update(zip(order, range(first, first + len(order)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        runs = [letter_runs(x) if x and self.languages else [] for x in texts]
        if len(self.row) > REMEMBERED:
            self.row.clear()
        if new := set().union(*runs).difference(self.row):
            self.learn(new)
        out = []
        for words in runs:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.scores[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


_SCORERS: dict[object, Scorer] = {}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, model=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; predictions read the text only."""
    import uuid

    table, languages = model or train(docs, id_col, text_col, lang_col, vocabulary)
    ids_type = docs.schema[id_col].dataType
    ids_arrow, sent, tag = to_arrow_type(ids_type), docs.sparkSession.sparkContext.broadcast((table, languages)), uuid.uuid4().hex

    @tidy
    def predict(arrow):
        if tag not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[tag] = Scorer(*sent.value)
        scorer = _SCORERS[tag]
        for doc_id, held_out, text in batches(arrow, ["a", "h", "b"], 128):
            found = scorer.predict(text)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, ids_arrow), pa.array(held_out, pa.bool_()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.pmod(F.crc32(F.coalesce(col(docs, id_col).cast("string"), F.lit(""))), 5) == 0
    return docs.select(col(docs, id_col).alias("a"), held_out.alias("h"), col(docs, text_col).alias("b")).mapInArrow(predict, f"doc_id {ddl(ids_type)}, held_out boolean, lang_pred string, score double")
