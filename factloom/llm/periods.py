"""Periodic runs of words: heavy/light lag counting, then island scans at the lags that can hold a run.

A run of smallest period q shows as an island: consecutive places i whose words equal those at i + q, at least max(q, 12 - q) of them.
Lags are taken in ranges that double, and texts in blocks as long as the range's end, so an island's first
places lie in two neighbouring blocks. For each block and lag the equal places are counted exactly: by Fourier transforms of a
word's places where the word is frequent in the block, by differences of its places where it is rare. Only
where two neighbouring blocks have enough of them is a lag scanned for islands.

A run of period p shows at the multiples of p as well, as whole islands that no other run shares. Their places are known, and are taken off
the counts before a lag is judged; else a word repeated n times would be scanned at n / 2 lags.

The cost of a text of n words is about n sqrt(n) at most for counting, and falls with the number of words it
repeats; memory is in proportion to a batch of texts (WORDS words) or to one longer text. No rows are shuffled.

Defined cases: null and empty texts have no words and no run; a null doc_id leaves the text as it is; repeated rows each give their row;
an empty table gives an empty result; other columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, tidy

#: The least length of a run, in words; it also holds its period twice.
LEAST = 12
#: Words of the texts that are searched together, the end of the first range of lags, and values of a transform at once.
WORDS, FIRST, CELLS = 1 << 17, 128, 1 << 21

Run = tuple[int, int, int]


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def looped(doc_id, words: list[bytes]) -> list[bytes]:
    """The words, for one in ten documents repeated from some place on, as the checksum of its id says."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def need(lag):
    """The least island of a run of this period."""
    return np.maximum(lag, LEAST - lag)


class _Level:
    """Counts of equal places by block and lag, for lags from ``low`` up to ``high``, which is also the length of a block.

    Texts begin at blocks of their own. ``groups`` numbers words within texts (-1: no word), so equal groups mean one text;
    ``group`` and ``place`` are sorted by both.
    """

    def __init__(self, low: int, high: int, group: np.ndarray, place: np.ndarray, text_of_block: np.ndarray):
        self.low, self.high = low, high
        blocks = len(text_of_block)
        self.groups = np.full((blocks + 2) * high, -1, np.int64)
        self.groups[place] = group
        self.next = np.append(text_of_block[1:] == text_of_block[:-1], False)
        self.counts = np.zeros(blocks * high, np.int32)
        self._count(group, place)
        self.counts = self.counts.reshape(blocks, high)

    def _count(self, group: np.ndarray, place: np.ndarray) -> None:
        near = (group[1:] == group[:-1]) & (place[1:] - place[:-1] < self.high)
        light = np.flatnonzero(near)
        many = int(1.5 * np.sqrt(self.high * np.log2(self.high)))
        frequent = light[: np.searchsorted(light, len(group) - many)]
        frequent = frequent[(group[frequent + many] == group[frequent]) & (place[frequent + many] - place[frequent] < self.high)]
        if len(frequent):
            groups = int(group[-1]) + 1
            code = (place // self.high) * groups + group
            heavy = np.unique(code[frequent])
            at = np.minimum(np.searchsorted(heavy, code[light]), len(heavy) - 1)
            light = light[heavy[at] != code[light]]
            self._transform(heavy, code, place, groups)
        held, size, step = [], 0, 1
        while len(light):
            lag = place[light + step] - place[light]
            far = lag >= self.low
            held.append(place[light[far]] // self.high * self.high + lag[far])
            size += len(held[-1])
            if size > CELLS:
                self.counts += np.bincount(np.concatenate(held), minlength=len(self.counts)).astype(np.int32)
                held, size = [], 0
            step += 1
            light = light[: np.searchsorted(light, len(group) - step)]
            light = light[(group[light + step] == group[light]) & (place[light + step] - place[light] < self.high)]
        if size:
            self.counts += np.bincount(np.concatenate(held), minlength=len(self.counts)).astype(np.int32)

    def _transform(self, heavy: np.ndarray, codes: np.ndarray, place: np.ndarray, groups: int) -> None:
        """Correlates a block's places of each frequent word with those of this block and the next; lags below a block's length don't wrap at two."""
        n = self.high
        block = place // n
        spots = []
        for back in (0, 1):  # an element stands in its own block's row, and in the second half of the block's before
            code = codes - back * groups
            at = np.minimum(np.searchsorted(heavy, code), len(heavy) - 1)
            there = np.flatnonzero(heavy[at] == code)
            spots.append((at[there], place[there] - (block[there] - back) * n))
        rows = max(1, CELLS // (2 * n))
        for first in range(0, len(heavy), rows):
            part = heavy[first : first + rows]
            left, right = (np.zeros((len(part), 2 * n)) for _ in range(2))
            for back, (row, offset) in enumerate(spots):
                own = (row >= first) & (row < first + len(part))
                right[row[own] - first, offset[own]] = 1
                if not back:
                    left[row[own] - first, offset[own]] = 1
            product = np.conj(np.fft.rfft(left)) * np.fft.rfft(right)
            of = part // groups
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            found = np.rint(np.fft.irfft(np.add.reduceat(product, starts), 2 * n)[:, :n]).astype(np.int32)
            found[:, : self.low] = 0
            at = of[starts]
            counts = self.counts.reshape(-1, n)
            counts[at] += found

    def explain(self, run: Run) -> None:
        """Takes the islands of a known run at multiples of its period off the counts."""
        start, end, p = run
        lags = np.arange(-(-self.low // p) * p, min(self.high, end - start), p)
        if len(lags):
            blocks = np.arange(start // self.high, (end - int(lags[0]) - 1) // self.high + 1)
            upto = np.minimum((blocks[:, None] + 1) * self.high, end - lags[None, :])
            self.counts[blocks[0] : blocks[-1] + 1, lags] -= np.maximum(0, upto - np.maximum(blocks * self.high, start)[:, None]).astype(np.int32)

    def lags(self) -> np.ndarray:
        """Lags at which some neighbouring blocks have enough equal places."""
        both = self.counts.copy()
        both[:-1][self.next[:-1]] += self.counts[1:][self.next[:-1]]
        lags = np.arange(self.high)
        enough = (both >= need(lags)).any(axis=0)
        return np.flatnonzero(enough & (lags >= self.low))

    def islands(self, lag: int) -> list[tuple[int, int]]:
        """(start, length) of the islands of at least ``need`` places at a lag."""
        both = self.counts[:, lag].copy()
        both[:-1][self.next[:-1]] += self.counts[1:, lag][self.next[:-1]]
        chosen = np.flatnonzero(both >= need(lag))
        if not len(chosen):
            return []
        chosen = np.union1d(chosen, chosen[self.next[chosen]] + 1)
        if self.low >= FIRST:  # an island has seven points of this grid in a row: most lags end here
            grid = lag // 8
            points = np.unique(np.concatenate([np.arange(-(-b * self.high // grid) * grid, (b + 1) * self.high, grid) for b in chosen.tolist()]))
            chosen = np.unique(np.concatenate([np.arange(max(0, s - grid) // self.high, (s + (k - 1) * grid + grid) // self.high + 1) for s, k in self._stretches(points, lag, grid, 7)] or [np.empty(0, np.int64)]))
            chosen = chosen[chosen < len(self.next)]
        places = (chosen[:, None] * self.high + np.arange(self.high)).ravel()
        return self._stretches(places, lag, 1, int(need(lag)))

    def _stretches(self, places: np.ndarray, lag: int, step: int, least: int) -> list[tuple[int, int]]:
        """(start, number) of the longest stretches of equal places, ``step`` apart, that hold ``least`` of them."""
        same = (self.groups[places] == self.groups[places + lag]) & (self.groups[places] >= 0)
        hit = places[same]
        if not len(hit):
            return []
        first = np.flatnonzero(np.append(True, np.diff(hit) != step))
        number = np.diff(np.append(first, len(hit)))
        long = number >= least
        return list(zip(hit[first[long]].tolist(), number[long].tolist(), strict=True))


def periodic_runs(ids: np.ndarray, sizes: np.ndarray) -> list[list[Run]]:
    """The runs (start, end, smallest period) of each text, sorted by start and period; ``ids`` number the words of all texts one after another."""
    sizes = np.asarray(sizes, np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    text = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[text]
    # words sorted by text and number, each in order; single ones only keep their place
    code = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(code, kind="stable")
    text, within, code = text[order], within[order], code[order]
    group = np.cumsum(np.append(0, code[1:] != code[:-1])) if len(code) else code
    low, high = 1, FIRST
    while True:
        live = np.flatnonzero(sizes >= max(LEAST, 2 * low))
        if not len(live):
            break
        blocks = -(-sizes[live] // high)
        base = np.full(len(sizes), -1, np.int64)
        base[live] = (np.cumsum(blocks) - blocks) * high
        if len(live) < len(sizes):  # shorter texts have no such lags
            mine = base[text] >= 0
            text, within, group = text[mine], within[mine], group[mine]
        of_block = np.repeat(live, blocks)
        level = _Level(low, high, group, base[text] + within, of_block)
        for t in live.tolist():
            for (s, e), p in found[t].items():
                level.explain((s + int(base[t]), e + int(base[t]), p))
        for lag in level.lags().tolist():
            for s, n in level.islands(lag):
                t = int(of_block[s // high])
                run = s - int(base[t]), s - int(base[t]) + n + lag
                # only a part of a known run's island may have been scanned
                if not any(lag % p == 0 and a <= run[0] and run[1] <= e for (a, e), p in found[t].items()):
                    found[t][run] = lag
                    level.explain((s, s + n + lag, lag))
        low, high = high, 2 * high
    return [sorted(((s, e, p) for (s, e), p in runs.items()), key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        change[s + q] += 1
        change[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _searched(texts: list[list[bytes]]) -> list[list[Run]]:
    flat = pa.array([w for words in texts for w in words], pa.binary())
    return periodic_runs(flat.dictionary_encode().indices.to_numpy().astype(np.int64), np.array([len(words) for words in texts], np.int64)) if len(flat) else [[] for _ in texts]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs (start, length, period) and the words left, joined by spaces."""
    kind = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(kind)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @tidy
    def run(arrow):
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0

        def flush():
            runs = _searched(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, ids_arrow), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in found] for found in runs], pa.list_(run_type)),
                    pa.array([b" ".join(kept_words(w, found)).decode("utf-8", "surrogatepass") for w, found in zip(texts, runs, strict=True)], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

        for doc_id, text in batches(arrow, ["a", "b"], 256):
            for i, t in zip(doc_id, text, strict=True):
                words = looped(i, split_words(t))
                if texts and size + len(words) > WORDS:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(words)
                size += len(words)
        if texts:
            yield flush()

    rows = docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b"))
    return rows.mapInArrow(run, f"doc_id {ddl(kind)}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
