"""Operators 11 to 13 against plain versions, and stored tables of several threads."""

import hashlib
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql.types import NumericType

from factloom.llm import common, metric_join, near_dedup, periods, queries, spelling

from . import brute
from .test_operators import prose

DOC = "doc_id long, text string"


# -- spelling variants ----------------------------------------------------------------------------------------------


def near_by_hand(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows) -> dict:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts: dict[str, int] = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if near_by_hand(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelt(df) -> dict:
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_groups_equal_the_plain_version(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(90))
    base = ["running", "Straßeÿx", "anagrams", "listening", "aaaaaa", "abcabc", long]
    words = list(base)
    for _ in range(5):  # variants of variants, with ties
        for w in list(words)[:40]:
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeé") + w[i:], w[:i] + rng.choice("xyé") + w[i + 1 :], "".join(rng.sample(w, len(w)))]))
    rows = [(None, None), (3, ""), (4, " \n"), (None, "running runnings Running " * 9)]
    for i in range(40, 140):
        rows.append((i, rng.choice([" ", "-1", "Ā", "\n"]).join(rng.choice(words[: 1 + int(len(words) * rng.random() ** 3)]) for _ in range(60))))
    rows += [rows[-1], (rows[-1][0], "other text of that id")]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got, expected = spelt(spelling.spelling_groups(docs)), spelling_by_hand(rows)
    assert got == expected
    assert any(len(w) > spelling.LONG and x[3] for w, x in got.items()) and any(x[1] not in (w, x[0]) for w, x in got.items())
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_anagrams_make_no_pairs(spark):
    rng = random.Random(6)
    letters = "abcdefghij"
    words = {"".join(rng.sample(letters, 10)) for _ in range(1500)}
    frame = spark.createDataFrame([(w, rng.randrange(5, 90)) for w in words], "word string, n bigint")
    got = {r.word: (r.n_near, r.best.other) for r in spelling.near_words(frame).collect()}
    assert got == {}  # no two orders of ten different letters are one edit apart
    assert spelling.key(b"listen") == spelling.key(b"silent") and spelling.key(b"listen") - spelling.POWERS[ord("t")] == spelling.key(b"lisen")


# -- periodic runs ----------------------------------------------------------------------------------------------------


def runs_by_hand(w) -> list[tuple[int, int, int]]:
    n, seen, out = len(w), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("first", [16, 128])
def test_runs_equal_the_plain_version(monkeypatch, first):
    monkeypatch.setattr(periods, "FIRST", first)
    rng = random.Random(first)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, v = rng.choice([0, 1, 11, 12, 40, 130, 300, 700]), rng.choice([1, 2, 3, 10, 100, 5000])
            w = [rng.randrange(v) for _ in range(n)]
            for _ in range(rng.randint(0, 4)):
                if n > 3:
                    a = rng.randrange(n)
                    p = 1 + rng.randrange((n - a) // rng.randint(2, 5) + 1)
                    for i in range(a, a + rng.randint(0, n - a)):
                        w[i] = w[a + (i - a) % p]
            texts.append(w)
        found = periods.periodic_runs(np.array([x for t in texts for x in t], np.int64), [len(t) for t in texts])
        assert found == [runs_by_hand(t) for t in texts]


def test_a_frequent_word_is_counted_by_transforms(monkeypatch):
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 900, 3000))
    ids[1000:1900] = np.tile(ids[1000:1300], 3)
    calls, transform = [], periods._Level._transform
    monkeypatch.setattr(periods._Level, "_transform", lambda self, *a: (calls.append(len(a[0])), transform(self, *a)))
    assert periods.periodic_runs(ids, [3000])[0] == runs_by_hand(ids.tolist()) and sum(calls) > 10


def digest_by_hand(i, text) -> tuple:
    w = re.findall(brute.WORD, text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = [(s, e - s, q) for s, e, q in runs_by_hand(w)]
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_the_query_of_runs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, None), (None, "a b " * 20), (7, ""), (7, "x " * 200), (7, "x " * 200)]
    for i in range(60, 120):
        w = prose(rng, rng.randint(5, 200)).split()
        rows.append((i, rng.choice([" ", "\t", "\n\n"]).join(w + w[-5:] * rng.randint(0, 4))))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [(r.doc_id, *(r[c] for c in columns)) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda x: (x[0] or 0, repr(x))
    assert sorted(got, key=order) == sorted([(i, *digest_by_hand(i, t)) for i, t in rows], key=order)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 2
    assert periods.collapse_runs(frame.limit(0)).count() == 0


# -- Jaccard join ---------------------------------------------------------------------------------------------------


def similar(spark, rows, k, percent):
    found = metric_join.similar_classes(spark.createDataFrame(rows, DOC), k, percent).collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def edited(rng, base: list[str], times: int) -> str:
    w = list(base)
    for _ in range(times):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [w[i], f"n{rng.randrange(10**6)}"], [f"r{rng.randrange(10**6)}"]])
    return " ".join(w)


def join_corpus(rng):
    texts = {i: prose(rng, rng.randint(1, 60)) for i in range(60)}
    for g in range(12):
        base = prose(rng, rng.choice([12, 40, 90, 300])).split()
        for _ in range(rng.randint(2, 14)):
            texts[len(texts) + 5] = edited(rng, base, rng.randint(0, 1 + len(base) // 30))
    passage = prose(rng, 150)
    texts |= {1000 + i: passage + " " + prose(rng, 3 + i) for i in range(25)}
    return texts | {2000: None, 2001: "", 2002: " \n", 2003: "one", 2004: "ONE", 2005: "one two three four", 2006: "One two three four five"}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_joined_classes_equal_the_plain_version(spark, monkeypatch, k, percent):
    monkeypatch.setattr(metric_join, "SHARE", 1)
    texts = join_corpus(random.Random(percent))
    expected = brute.near(texts, k, percent)
    assert similar(spark, list(texts.items()), k, percent) == expected
    assert len({c for _, c in expected.values()}) < len(texts) - 20


def test_large_regions_are_cut_into_cells(spark, monkeypatch):
    for name, value in (("BLOCK", 12), ("PIVOTS", 4), ("CUTS", 2)):
        monkeypatch.setattr(metric_join, name, value)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = {i: edited(rng, base, rng.randint(0, 4)) for i in range(90)}
    texts |= {100 + i: " ".join(base[:100]) + " " + prose(rng, 20) for i in range(40)}  # equally far from each other
    cut, cells = [], metric_join._cells
    monkeypatch.setattr(metric_join, "_cells", lambda rows, *a: (cut.append(rows.count()), cells(rows, *a))[1])
    assert similar(spark, list(texts.items()), 3, 90) == brute.near(texts, 3, 90)
    assert cut and cut[0] > 0


def test_rows_of_shown_shingles_hold_numbers_only(spark, monkeypatch):
    """A row goes out for each shown shingle of each set, so it names sets, pivots and regions by numbers; the shown shingles are stored once while it does."""
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts + [" ".join(t.split()[:-1]) for t in texts])]
    tables, held, real, elect = {}, [], metric_join.stored, metric_join.elected
    monkeypatch.setattr(metric_join, "stored", lambda df, what: tables.setdefault(what, []).append(real(df, what)) or tables[what][-1])

    def elected(*a):
        here = Path(tables["classes"][0]._stored_at)
        held.extend(x.name for x in here.parent.iterdir() if x.name.startswith("signed-") and tables["signed"][0]._stored_at.endswith(x.name))
        return elect(*a)

    monkeypatch.setattr(metric_join, "elected", elected)
    found = {r.doc_id: r.component_id for r in metric_join.similar_classes(spark.createDataFrame(rows, DOC), 3, 90).collect()}
    assert found == {k: k % 20 for k in range(40)}
    narrow = [f for what in ("pivots", "entries", "regions", "homes", "links", "known") for t in tables.get(what, []) for f in t.schema]
    assert narrow and all(isinstance(f.dataType, NumericType) for f in narrow)
    assert not held


def test_windows_keep_every_link():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 150, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() / 8], rng.integers(0, 1 << 62, 1 + k % 9, dtype=np.uint64)])) for k in range(70)]
    edges = metric_join.joined(sets, list(range(len(sets))), 90)
    assert all(near_dedup._linked(sets[a], sets[b], 90) for a, b in edges)

    def classes(pairs):
        least = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert classes(edges) == classes([(a, b) for a in range(len(sets)) for b in range(a) if near_dedup._linked(sets[a], sets[b], 90)])
    assert metric_join.joined(sets, [1] * len(sets), 90) == []


def test_joined_classes_of_odd_rows(spark):
    base = prose(random.Random(3), 40)
    rows = [(None, base, 1), (None, base, 1), (2, base, 1), (2, base + " end", 1), (2, base, 1), (9, base, 1), (9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in metric_join.similar_classes(docs, 3, 90).collect())
    assert got == [(0, 38, 0), (0, 38, 0), (2, 38, 2), (2, 38, 2), (2, 39, 2), (9, 0, 9), (9, 38, 2)]
    assert metric_join.similar_classes(docs.limit(0), 3, 90).count() == 0


# -- stored tables ------------------------------------------------------------------------------------------------------


def test_threads_keep_their_own_tables(spark):
    rng = random.Random(1)
    base = prose(rng, 60)
    docs = spark.createDataFrame([(i, base + f" {i % 3}") for i in range(12)] + [(50 + i, prose(rng, 40)) for i in range(5)], DOC)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda _: sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()), range(4)))
    assert all(f == found[0] for f in found) and {c for i, c in found[0] if i < 12} == {0}


def test_scratch_deletes_what_is_not_kept(spark):
    with common.scratch(spark) as keep:
        gone, kept = common.stored(spark.range(3).toDF("a"), "gone"), keep(common.stored(spark.range(4).toDF("a"), "kept"))
    assert kept.count() == 4
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(gone._stored_at).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path(kept._stored_at)) and not fs.exists(path(gone._stored_at))
