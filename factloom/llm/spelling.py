"""Spelling variants of a corpus's words by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points (modulo 2^64), so words of the same letters share it,
and one more letter, one less or another one changes it by that letter's power or by a difference of two powers.
Every word also shows its key less each of its letters. Two words whose letters differ by an exchange then meet where
both show the same lessened key, an added or removed letter where the lessened key of one is the key of the other, so all
words at any such difference join on integers, at one row a distinct letter of a word.

Only words that meet so are looked at by letter order: with the letter taken out at each of its places, words that agree in
place and rest differ by that exchange alone, and a rest that is a word itself is one letter shorter. Words of one
place and rest differ in one letter, so such a group has no more members than there are letters (90); no pairs of a group of
anagrams are made.

Defined cases: null and empty texts have no words; in rows with a null doc_id no letter is taken out; repeated rows count as often as they
come; an empty table gives an empty result; other columns are ignored. Runs of any length count (the rests of words of over 64 letters
are known by a 127-bit polynomial hash, so their cost stays linear). Ties of forms go to the first word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, col, scratch, small, stored, tidy

#: The least letters of a word, and how many times as frequent a form must be.
LETTERS, TIMES = 6, 5
#: The least occurrences of a word.
OCCURRENCES = 5
#: One in so many runs of a document loses a letter.
ERRORS = 199
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Rests of longer words are known by a hash, with this base and modulus.
LONG, BASE, MODULUS = 64, 0x2545F4914F6CDD1D9E3779B97F4A7C15, (1 << 127) - 1
POWERS = [c**5 for c in range(256)]
RUNS = re.compile(rb"[a-z\xc0-\xff]+")


def letters(text: str | None) -> list[bytes]:
    """The runs of a text in Latin-1 (a byte a letter), A-Z in lower case; code points beyond it part runs like any other sign."""
    return RUNS.findall(text.encode("latin-1", "replace").lower()) if text else []


def misspelt(doc_id, run: bytes) -> bytes:
    """The run, less a letter where the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run.decode('latin-1')}".encode())
    if doc_id is None or h % ERRORS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def key(word: bytes) -> int:
    """The sum of letter powers as a signed 64-bit number."""
    return _signed(sum(map(POWERS.__getitem__, word)))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def rests(word: bytes, letter: int) -> list[tuple[int, str]]:
    """(place, rest) for each place of a letter in a word."""
    places = [i for i, c in enumerate(word) if c == letter]
    if len(word) <= LONG:
        return [(i, (word[:i] + word[i + 1 :]).decode("latin-1")) for i in places]
    before = [0]
    for c in word:
        before.append((before[-1] * BASE + c) % MODULUS)
    out, after, power, wanted = [], 0, 1, set(places)
    for i in range(len(word) - 1, -1, -1):  # ``after`` is the value of what follows i, ``power`` its shift
        if i in wanted:
            out.append((i, f"{len(word) - 1}#{(before[i] * power + after) % MODULUS:x}"))
        after = (after + word[i] * power) % MODULUS
        power = power * BASE % MODULUS
    return out[::-1]


def whole(word: bytes) -> str:
    """A word as a rest of longer ones."""
    if len(word) < LONG:
        return word.decode("latin-1")
    value = 0
    for c in word:
        value = (value * BASE + c) % MODULUS
    return f"{len(word)}#{value:x}"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of every word of at least LETTERS letters, after the errors. Counted in each task before anything moves."""

    @tidy
    def count(arrow):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for doc_id, text in batches(arrow, ["a", "b"]):
            for i, t in zip(doc_id, text, strict=True):
                for run, n in Counter(letters(t)).items():
                    if len(run) >= LETTERS:
                        word = misspelt(i, run)
                        if len(word) >= LETTERS:
                            total[word] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    rows = docs.select(col(docs, id_col).cast("string").alias("a"), col(docs, text_col).alias("b")).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _keyed(words: DataFrame) -> DataFrame:
    """(word, n, key, itself): ``itself`` is how the word looks as a rest."""

    @tidy
    def run(arrow):
        for word, n in batches(arrow, ["word", "n"]):
            raw = [w.encode("latin-1") for w in word]
            yield _batch([(w, c, key(r), whole(r)) for w, c, r in zip(word, n, raw, strict=True)], [("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("itself", pa.string())])

    return words.mapInArrow(run, "word string, n bigint, key bigint, itself string")


def _lessened(words: DataFrame) -> DataFrame:
    """(word, n, letter, less): a row for each distinct letter, with the key of the word without one of it."""

    @tidy
    def run(arrow):
        for word, n, k in batches(arrow, ["word", "n", "key"]):
            rows = [(w, c, x, _signed(v - POWERS[x])) for w, c, v in zip(word, n, k, strict=True) for x in sorted(set(w.encode("latin-1")))]
            yield _batch(rows, [("word", pa.string()), ("n", pa.int64()), ("letter", pa.int32()), ("less", pa.int64())])

    return words.select("word", "n", "key").mapInArrow(run, "word string, n bigint, letter int, less bigint")


def _placed(rows: DataFrame) -> DataFrame:
    """(word, n, less, place, rest) for each place of the letter."""

    @tidy
    def run(arrow):
        for word, n, letter, less in batches(arrow, ["word", "n", "letter", "less"]):
            out = [(w, c, k, i, r) for w, c, x, k in zip(word, n, letter, less, strict=True) for i, r in rests(w.encode("latin-1"), x)]
            yield _batch(out, [("word", pa.string()), ("n", pa.int64()), ("less", pa.int64()), ("place", pa.int32()), ("rest", pa.string())])

    return rows.select("word", "n", "letter", "less").mapInArrow(run, "word string, n bigint, less bigint, place int, rest string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many of the ``words`` (word, n) are at one edit, and the most frequent of them as (m, other), m being -n. Stored; words with none are left out."""
    with scratch(words.sparkSession) as keep:
        keyed = stored(_keyed(words), "keyed")
        lessened = stored(_lessened(keyed), "lessened")
        counted = lessened.groupBy("less").agg(F.count(F.lit(1)).alias("m"))
        exchanged = counted.filter("m > 1").select("less")
        shortened = counted.join(keyed.select(F.col("key").alias("less")).distinct(), "less", "left_semi").select("less")
        meeting = stored(exchanged.union(shortened).distinct(), "meeting")
        placed = stored(_placed(lessened.join(small(meeting), "less", "left_semi")), "placed")
        # words of one place and rest, sorted by frequency: the first other one is a member's best. At most one a letter.
        other = F.struct((-F.col("n")).alias("m"), F.col("word").alias("other"))
        groups = placed.groupBy("less", "place", "rest").agg(F.sort_array(F.collect_list(other)).alias("all")).filter(F.size("all") > 1)
        members = groups.select("all", F.posexplode("all").alias("at", "x"))
        replaced = members.select(F.col("x.other").alias("word"), (F.size("all") - 1).cast("bigint").alias("n_near"), F.col("all")[F.when(F.col("at") == 0, 1).otherwise(0)].alias("best"))
        longer = placed.select("less", "rest", "word", "n").distinct()
        shorter = keyed.select(F.col("key").alias("less"), F.col("itself").alias("rest"), F.col("word").alias("short"), F.col("n").alias("short_n"))
        removed = stored(longer.join(shorter, ["less", "rest"]), "removed")
        one = F.lit(1).cast("bigint").alias("n_near")
        added = removed.select("word", one, F.struct((-F.col("short_n")).alias("m"), F.col("short").alias("other")).alias("best")).union(removed.select(F.col("short").alias("word"), one, other.alias("best")))
        return keep(stored(replaced.union(added).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round doubles the steps taken, and counts grow fivefold a step, so few rounds do."""
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(now.join(small(ahead.filter("root != next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        now = further.select("word", "root")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least OCCURRENCES occurrences."""
    with scratch(docs.sparkSession) as keep:
        words = stored(word_counts(docs, id_col, text_col).filter(F.col("n") >= OCCURRENCES), "words")
        near = near_words(words)
        far = -F.col("best.m") >= TIMES * F.col("n")
        formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
        formed = stored(formed, "forms")
        return keep(stored(formed.join(small(roots(formed)), "word").select("word", "form", "root", "n", "n_near", "form_n"), "spelling"))
