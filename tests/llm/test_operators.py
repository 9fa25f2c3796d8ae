import hashlib
import random
from array import array
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, fingerprint, html_extract, language_id, mixing, near_dedup, quality, suffix_dedup, token_store, url_filter

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, size int, g string"


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "ä", "é"]) for _ in range(1 + rng.randrange(vocabulary) % 4)) for _ in range(n))


def corpus():
    """Nulls, empties, exact copies, near copies, passages, a long text, repeated windows and short texts."""
    rng = random.Random(7)
    base, passage = prose(rng, 260), prose(rng, 60)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(20)]
    texts += [None, "", "   \n\t ", "one", "One", "two words", "three little words", base, base, base.upper(), base.replace("ä", "ä "), "ab" * 300, "abcde " * 200, "é" * 150]
    for _ in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(4)]
    texts.append(prose(rng, 9000) + " " + passage)
    texts.append("ΟΔΥΣΣΕΥΣ 日本語 🎉 <|endoftext|> İ ß")
    return {3 * k + 1: t for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "hot", "hot", "hot"][i % 6], len(t or ""), "x", 5, "y") for i, t in texts.items()]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# -- html --------------------------------------------------------------------------------------------------------


def test_html_blocks_and_characters():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text&nbsp;here, <a href=x>one link</a> among many plain words of it.<p>Be.<p>Next</p><div class=\"comments\"><p>A reader says that this is a long comment about things</p></div></article>"
        "<aside>More links</aside><form><input>Sign up</form><footer>&copy; 2020 us</footer></body></html>"
    )
    assert html_extract.main_text(page) == "Head & line\nFirst bold text here, one link among many plain words of it.\nBe.\nNext"


def test_html_without_marks_and_cut_off():
    words = "plain words that make a sentence of some length and go on for a while longer than menus do "
    page = f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div>{words * 2}</div><div>{words * 3}</div><ul><li><a>Three</a><li><a>Four</a></ul><div>{words}<span"
    found = html_extract.main_text(page).split("\n")
    assert found == [" ".join((words * 2).split()), " ".join((words * 3).split()), words.strip()]
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_html_with_missing_ends():
    page = "<html><head><meta charset=x><title>T</title><body><article><p class=notice>We moved to a new place<p>The first of the paragraphs here<div>And a second one that follows</div></article>"
    assert html_extract.main_text(page) == "The first of the paragraphs here\nAnd a second one that follows"
    assert html_extract.main_text("<article><p>A &lt;b&gt; &#233;&eacute; &amp <p>B &am") == "A <b> éé &\nB &am"


#: Pages that the tree was not grown on, with names that say what they are, with none, and with misleading ones.
HELD_OUT = (
    "nav/ul/li:2:2- nav/ul/li:2:2- div.ad:11:0- article/h1:10:0+ article/p:33:0+ article/p:61:1+ article/p:8:0+ footer:10:0-",
    "header/h1:3:0- main/article/h2:6:0+ main/article/p:48:0+ main/article/p:29:0+ main/article/section.comments/p:22:0- main/article/section.comments/p:31:0- aside/h3:2:0- aside/ul/li:4:4- footer/p:8:1-",
    "div.cookie-banner/p:18:0- div.navbar/a:6:6- div.entry/h1:7:0+ div.entry/p:39:0+ div.entry/p:57:2+ div.entry/p:10:0+ div.widget/p:16:0- div.replies/p:50:0- div.footer:9:2-",
    "ul/li:1:1- ul/li:1:1- ul/li:2:2- div/h1:6:0+ div/p:58:0+ div/p:37:0+ div/p:12:0+ div/p:49:3+ ul/li:5:5- ul/li:6:6- div:7:2-",
    "div.x1/a:4:4- div.x2/h1:8:0+ div.x2/p:63:0+ div.x2/p:27:0+ div.x2/p:71:0+ div.x3/p:9:9- div.x4:6:0-",
    "nav.content/a:5:5- div.comments-on-life/h1:5:0+ div.comments-on-life/p:55:0+ div.comments-on-life/p:40:0+ div.comments-on-life/p:66:1+ footer.article:12:0-",
    "form/p:9:0- article/h1:3:0+ article/p:12:0+ article/p:4:0+ article/figure/figcaption:7:0+ article/div.promo:14:0- article/p:31:0+ div:22:0- form/p:14:0-",
    "article/p:3:0+ article/p:7:0+",
)


def test_html_tree_on_pages_it_has_not_seen():
    tree, right, found, wanted = html_extract.train_tree(), 0, 0, 0
    for page in HELD_OUT:
        text, kept = html_extract.labelled_page(page)
        got = [html_extract.decide(tree, x) for x in html_extract.features(html_extract.blocks(text))]
        right, found, wanted = right + sum(a and b for a, b in zip(got, kept, strict=True)), found + sum(got), wanted + sum(kept)
    assert 2 * right / (found + wanted) > 0.95


def test_html_without_and_with_misleading_names():
    import re

    for page in (HELD_OUT[0], HELD_OUT[3], HELD_OUT[5], HELD_OUT[7]):
        text, kept = html_extract.labelled_page(page)
        for changed in (re.sub(' class="[^"]*"', "", text), re.sub(' class="[^"]*"', ' class="content"', text), text.replace("<article>", '<article class="sidebar">')):
            assert [html_extract.decide(html_extract.train_tree(), x) for x in html_extract.features(html_extract.blocks(changed))] == kept


def test_html_deep_and_long():
    import time

    began = time.time()
    deep = "<div>" * 20_000 + "<p>some words in the middle of it all</p>" + "</span></b></div>" * 20_000
    assert len(html_extract.blocks(deep)) == 1
    long = "<article>" + "<p>" + "word " * 200_000 + "</p>" + "<p>x</p>" * 2000 + "</article>"
    assert len(html_extract.main_text(long).split("\n")) == 2001 and time.time() - began < 20


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 3), (1, "u", "<article><p>x</p></article>", 3), (None, None, None, None)], "page_id long, url string, html string, a int")
    rows = html_extract.extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


# -- urls --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://WWW.Example.org/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"), ("http://a.org/en/12", "a.org", "/en/12", "org/", "allow"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://a.org", "a.org", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("http://a.b?/x", "a.b", "", None, "allow"), ("http://casino-pills.net/", "casino-pills.net", "/", None, "block"), ("http://ÄB.net/", "Äb.net", "/", None, "allow"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    assert url_filter.parse(url) == (host, path)
    found = url_filter.rule_of(host, path)
    assert (found[0] if found else None) == rule
    assert (found[1] if found else "block" if url_filter.probability(host, path, url_filter.train()) >= 0.5 else "allow") == verdict or url in (None, "nothing")


def test_url_model_on_urls_it_has_not_seen():
    right = wrong = 0
    for turn in range(4):
        block, allow = (tuple(u for k, u in enumerate(urls) if k % 4 != turn) for urls in (url_filter.BLOCK, url_filter.ALLOW))
        model = url_filter.train(block, allow)
        for urls, bad in ((url_filter.BLOCK, True), (url_filter.ALLOW, False)):
            for u in urls[turn::4]:
                said = url_filter.probability(*url_filter.parse(u), model) >= 0.5
                right, wrong = right + (said == bad), wrong + (said != bad)
    assert right / (right + wrong) >= 0.75


def test_url_rules_by_brute_force():
    rng = random.Random(6)
    hosts, paths = ["org", "example.org", "a.example.org", "com", "x.com", "badexample.org", "org.net", ""], ["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/1", "/de/"]
    for _ in range(300):
        host, path, tail = rng.choice(hosts), rng.choice(paths), rng.choice(["", "?x=/es/", "#/de/"])
        fitting = []
        for h, p, v in url_filter.RULES:
            labels, wanted = host.split("."), h.split(".")
            if labels[-len(wanted) :] == wanted and path[: len(p)] == p:
                fitting.append((len(h + p), h + p, v))
        assert url_filter.parse(f"http://{host}{path}{tail}") == (host, path)
        assert url_filter.rule_of(host, path) == (max(fitting)[1:] if fitting else None)


def test_url_model_separates_its_table_and_variants(spark):
    model = url_filter.train()
    assert all(url_filter.probability(*url_filter.parse(u), model) > 0.5 for u in url_filter.BLOCK)
    assert all(url_filter.probability(*url_filter.parse(u), model) < 0.5 for u in url_filter.ALLOW)
    assert url_filter.probability("www.mega-casino.net", "/slots", model) > 0.5 > url_filter.probability("www.flower-garden.net", "/roses", model)
    pages = spark.createDataFrame([(1, "http://a.org/x", "h"), (1, "http://a.org/x", "h"), (None, None, "h")], "page_id long, url string, host string")
    assert [r.verdict for r in url_filter.judge_urls(pages).orderBy("page_id").collect()][1:] == ["allow", "allow"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# -- token store --------------------------------------------------------------------------------------------------


def test_token_store_matches_the_library(spark, docs, texts, nothing):
    from tokenizers import Tokenizer

    library, start, everything = Tokenizer.from_file(token_store.default_vocabulary()), 0, []
    shards = token_store.write_shards(docs)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_documents(shards).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), crc32(array("I", ids).tobytes())), i
        start += len(ids)
        everything += ids
    first = 0
    for row in shards.orderBy("part", "number").collect():
        shard = token_store.Shard(row.shard)
        for a, n in ((0, 5), (row.n_ids // 2, 40), (max(0, row.n_ids - 3), 3)):
            assert shard.ids(a, n).tolist() == everything[first + a : first + min(a + n, row.n_ids)]
        first += row.n_ids
    assert token_store.read_documents(token_store.write_shards(nothing)).count() == 0


def test_words_are_cut_as_the_library_cuts_them():
    encoder = token_store.WordEncoder(token_store.default_vocabulary())
    for k in range(0x3000):
        if not 0xD800 <= k < 0xE000:
            c = chr(k)
            for text in (c, f"a{c}b 1{c}", f"{c}'s Ab{c}{c} x"):
                units = [u for part in encoder.units([text])[0] for u in part.to_pylist()]
                assert b"".join(encoder.ids(units)) == array("I", encoder.library.encode(text, add_special_tokens=False).ids).tobytes(), (k, text)


def test_a_vocabulary_with_larger_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.default_vocabulary())
    library.add_tokens([f"<|added{k}|>" for k in range(20_000)])
    library.save(str(tmp_path / "wide.json"))
    texts = {k: f"the <|added{k * 7 % 20000}|> and the other {k % 5} thing " * 20 for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_documents(token_store.write_shards(docs, vocabulary=str(tmp_path / "wide.json"))).collect()}
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), crc32(array("I", ids).tobytes()))


def test_token_store_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "no id"), (1, "one"), (1, "one"), (1, "other"), (0, None)], "doc_id long, text string")
    got = token_store.read_documents(token_store.write_shards(rows)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 1, 1] and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_grammar_shrinks_and_restores():
    units = [array("I", x).tobytes() for x in ([1], [5, 6, 7], [5, 6], [9], [9, 9, 9, 9])]
    rng = np.random.default_rng(1)
    documents = [np.append(rng.integers(1, 5, 500), 0).astype(np.int32) for _ in range(20)]
    raw = token_store.compress(units, documents, 49_408)
    shard = token_store.Shard(raw)
    flat = [[int(x) for u in d for x in np.frombuffer(units[u], "<u4")] for d in documents]
    assert [shard.document(k).tolist() for k in range(20)] == flat
    assert len(shard.symbols) < sum(map(len, flat)) / 3 and len(shard.rules) > 2


def test_grammar_leaves_no_frequent_pair():
    units = [array("I", [k + 1]).tobytes() for k in range(100)]
    documents = [np.append(np.tile(np.arange(1, 65), 2), 0).astype(np.int32) for _ in range(60)]
    shard = token_store.Shard(token_store.compress(units, documents, 49_408))
    left = {}
    for a, b in zip(shard.begins[:-1].tolist(), shard.begins[1:].tolist(), strict=True):
        for pair in zip(shard.symbols[a : b - 1].tolist(), shard.symbols[a + 1 : b].tolist(), strict=True):
            left[pair] = left.get(pair, 0) + 1
    assert len(shard.rules) == token_store.MOST_RULES or max(left.values(), default=0) < token_store.LEAST_COUNT
    assert [shard.document(k).tolist() for k in range(60)] == [[x + 1 for x in d.tolist()] for d in documents]


# -- repeats -------------------------------------------------------------------------------------------------------


def test_windows_by_brute_force():
    rng = random.Random(3)
    for length in (4, 9, 100):
        for _ in range(40):
            parts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(60))) * (8 if length == 100 else 1) for _ in range(rng.randrange(1, 7))]
            seen, marks = set(), []
            for p in parts:
                m = bytearray(len(p))
                for k in range(len(p) - length + 1):
                    if p[k : k + length] in seen:
                        m[k : k + length] = b"\1" * length
                    seen.add(p[k : k + length])
                marks.append(bytes(m))
            for m, ranges in zip(marks, suffix_dedup.repeated_windows(parts, length), strict=True):
                got = bytearray(len(m))
                for a, b in ranges:
                    got[a:b] = b"\1" * (b - a)
                assert bytes(got) == m


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_repeats_of_a_corpus(docs, texts, nothing, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)  # long texts are cut into slices
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, digests=True).collect()}
    assert got == brute.repeats(texts)
    assert suffix_dedup.remove_repeats(nothing, digests=True).count() == 0


@pytest.mark.parametrize("size", [60, 85])
def test_a_gram_in_very_many_contexts(spark, size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 40)
    rng = random.Random(size)
    common = prose(rng, 40)[:size]
    texts = {k: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(40, 90))) + common + "".join(rng.choice("abcdefgh ") for _ in range(70)) for k in range(400)}
    texts[400] = "head " + texts[17][10:] + " tail"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, digests=True).collect()}
    assert got == brute.repeats(texts) and got[400][1] > 100


def test_parts_of_a_piece_hold_all_its_windows():
    rng = random.Random(8)
    raw = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(260)), np.uint8)
    for turn in range(3):
        lo, n, keys, c0, c1 = suffix_dedup.parts_of(raw, -5, turn)
        assert [x for a, m in zip(lo, n, strict=True) for x in range(a, a + m)] == list(range(161))
        # equal windows have equal keys, wherever they are
        other = suffix_dedup.parts_of(raw[37:], -5, turn)
        by_window = {x - 37: k for a, m, k in zip(lo, n, keys, strict=True) for x in range(a, a + m)}
        assert all(by_window[x] == k for a, m, k in zip(other[0], other[1], other[2], strict=True) for x in range(a, a + m))


def test_repeats_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(21)
    passage, unrelated = prose(rng, 60), prose(rng, 80)
    rows = [(1, passage), (2, prose(rng, 30) + " " + passage), (2, unrelated), (2, unrelated), (None, passage), (None, passage)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digests=True).collect())
    size = len(passage.encode())
    assert [x[2] for x in got if x[0] in (0, 1)] == [0, 0, 0]
    assert sorted(x[2] for x in got if x[0] == 2) == [0, 0, size] or sorted(x[2] for x in got if x[0] == 2) == [0, 0, size + 1]


def test_repeats_keep_characters_whole(spark):
    text = "é" * 120
    rows = spark.createDataFrame([(1, text, 120, "x"), (2, "z" + text, 121, "x"), (None, text, 120, "x"), (3, None, None, "x")], "doc_id long, text string, n_chars long, a string")
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(rows).collect()}
    # every window of the 240 bytes but the first two occurs earlier: the first character is left
    assert got[1].text == "é"
    assert got[None].text == text and got[3].text is None and got[2].n_chars == len(got[2].text) and got[2].text.startswith("z")
    assert suffix_dedup.strip_repeats(rows).columns == rows.columns


# -- byte-level BPE -----------------------------------------------------------------------------------------------


def test_bpe_matches_the_library(docs, texts, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    digests = {r.doc_id: r for r in bpe.digest_documents(docs).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert rows[i].ids == ids and rows[i].decoded_sha256 == decoded, i
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), decoded)
    assert bpe.encode_documents(nothing).count() == 0


def test_segment_tree_root():
    tree = bpe.SegmentTree([5 << 32, bpe.INFINITE, 3 << 32, 3 << 32, 9 << 32])
    assert tree.nodes[1] == 3 << 32 | 2
    tree.put([(2, bpe.INFINITE), (0, 3 << 32)])
    assert tree.nodes[1] == 3 << 32
    encoder = bpe.loaded(bpe.default_vocabulary())
    assert encoder.decode(encoder.encode("x" * 20_000)) == "x" * 20_000


# -- fingerprints -------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, texts, nothing):
    ids = sorted(texts)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    for k, i in enumerate(ids):
        t, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert r.near_edited == float(fingerprint.canonical(t) == fingerprint.canonical(edited)) and r.near_next == float(fingerprint.canonical(t) == fingerprint.canonical(following))
        assert r.group_id == min(j for j in ids if fingerprint.canonical(texts[j]) == fingerprint.canonical(t))
    assert {r.doc_id: r.group_id for r in fingerprint.duplicate_groups(docs).collect()} == {i: r.group_id for i, r in got.items()}
    assert fingerprint.edited_fingerprints(nothing).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_canonical_forms():
    assert fingerprint.canonical(" ＡＢ  Straße\n") == "ab strasse" == fingerprint.canonical("ab STRASSE")
    assert fingerprint.canonical("é") == fingerprint.canonical("É")


# -- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, texts, nothing):
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    sizes = {i: brute.base_rules(t)[0] for i, t in texts.items()}
    sources = sorted({r.source for r in rows if r.source is not None}) + [None]
    total = {s: sum(sizes[r.doc_id] for r in rows if r.source == s) for s in sources}
    expected = dict(zip(sources, brute.fill([k % 3 + 1 for k in range(len(sources))], [total[s] for s in sources]), strict=True))
    rates = brute.balanced([(r.doc_id, r.source, r.size) for r in rows], expected)
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == total[r.source] and abs(r.target - expected[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken and abs(r.rate - rates[r.doc_id]) < 1e-6
        assert r.size * int(r.rate + 1e-8) <= r.taken or r.size == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sources)
    assert max(len({round(r.rate, 3) for r in rows if r.source == s and r.size}) for s in sources) > 1  # rates differ by size within a source
    assert mixing.mix(nothing).count() == 0


def test_mixing_follows_the_multipliers(docs, monkeypatch):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    solve = mixing.multipliers
    monkeypatch.setattr(mixing, "multipliers", lambda *a: solve(*a).withColumn("slope", F.lit(0.0)))
    flat = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert taken != flat


def test_mixing_keeps_document_sizes(spark):
    rng = random.Random(9)
    rows = [(k, "w " * (rng.randrange(5, 40) if k % 3 else rng.randrange(100, 400)), "short" if k % 3 else "tall") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(3, 1)).collect()
    mean = lambda w: sum(w(r) * np.log(r.size) for r in got) / sum(w(r) for r in got)
    plain = lambda r: r.size * r.target / r.source_size
    assert abs(mean(lambda r: r.taken) - mean(lambda r: r.size)) < 0.9 * abs(mean(plain) - mean(lambda r: r.size))


def test_mixing_stops_and_shares_again(spark):
    rows = [(k, "w " * 10, "a") for k in range(50)] + [(100, "w", "b"), (101, None, "c"), (102, "w w", None)]
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["b"] == 3 and got["c"] == 0 and got[None] == 6 and abs(got["a"] - (503 - 9)) < 1e-9
    whole = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert whole.columns == ["doc_id", "text", "source"] and whole.filter("source = 'b'").count() == 3


# -- languages ------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    table = {"a": (0.1, 0.2), "b": (0.3, 0.1), "ab": (0.05, 0.5), "▁a": (0.2, 0.1), "▁ab": (0.4, 0.3), "": 3}
    exact = [(0.1 + 0.2) * 0.3 + 0.05 + 0.4, (0.2 + 0.1) * 0.1 + 0.5 + 0.3]
    assert np.allclose(np.exp(language_id.forward("ab", table, 2)), exact)
    scorer = language_id.Scorer(table, ["x", "y"])
    scorer.learn({"ab", "abab", "zz", "a"})
    for w in ("ab", "abab", "zz", "a"):
        assert np.allclose(scorer.scores[scorer.row[w]], language_id.forward(w, table, 2))


def test_languages_on_held_out_documents(spark):
    rng = random.Random(11)
    stems = {"en": ["the", "thing", "and", "water", "with", "shore"], "de": ["und", "der", "straße", "nicht", "schön", "zeit"], "fr": ["le", "être", "avec", "maison", "où", "été"]}
    rows = [(k, " ".join(rng.choice(stems[c]) for _ in range(30)), c, "s") for k, c in enumerate(rng.choice(list(stems)) for _ in range(240))]
    rows += [(900, None, "en", "s"), (901, "123 !!", "en", "s"), (902, "the water and", None, "s"), (902, "the water and", None, "s"), (903, "и" * 90, None, "s")]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    held = [r for r in found if r.held_out and r.doc_id < 900]
    truth = {i: c for i, _, c, _ in rows}
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[900] == by[901] == "und" and by[902] == "en" and by[903] in stems
    empty = language_id.identify(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")).first()
    assert (empty.lang_pred, empty.score) == ("und", 0.0)


# -- quality ---------------------------------------------------------------------------------------------------------


def test_base_rules(docs, texts, nothing):
    for r in quality.quality_verdicts(docs).collect():
        e = brute.base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, r.doc_id
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and (not r.base_failed or not r.kept)
    assert quality.quality_verdicts(nothing).count() == 0


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(60, 400)), "en", "a") for k in range(120)]
    rows += [(500 + k, " ".join(w + "###$$$" for w in prose(rng, 150).split()), "en", "a") for k in range(12)]
    rows += [(700 + k, prose(rng, 100), None, None) for k in range(5)] + [(1, rows[1][1], "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert [i for i, k in kept.items() if not k] == sorted(range(500, 512), key=[*kept].index)
    assert quality.keep_good(docs).count() == len(rows) - 12 and quality.keep_good(docs).columns == docs.columns


@pytest.mark.parametrize("share", [30, 45])
def test_junk_of_nearly_half_a_group_goes(spark, share):
    rng = random.Random(share)
    rows = [(k, prose(rng, rng.randrange(60, 400)), "en", "a") for k in range(200 - 2 * share)]
    rows += [(500 + k, " ".join(w + "###$$$" for w in prose(rng, rng.randrange(60, 400)).split()), "en", "a") for k in range(2 * share)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.quality_verdicts(docs).filter("not kept").collect()} == set(range(500, 500 + 2 * share))


def test_small_groups_are_judged(spark):
    rng = random.Random(11)
    rows = [(k, prose(rng, rng.randrange(60, 400)), ["en", "de", None][k % 3], f"s{k % 12}" if k % 5 else None) for k in range(90)]
    rows += [(500 + k, " ".join(w + "###$$$" for w in prose(rng, 150).split()), lang, source) for k, (lang, source) in enumerate([("en", "s0"), ("de", "s1"), (None, None), ("en", "alone"), ("fr", "alone")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality.quality_verdicts(docs).collect()
    assert {r.doc_id for r in got if not r.kept} == {500, 501, 502, 503, 504}
    assert len(got) == len(rows) and all(r.distance is not None for r in got if not r.base_failed)


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(3)
    rows = [(str(k), prose(rng, rng.randrange(60, 120)), "en", "a") for k in range(60)]
    passage = prose(rng, 22)
    odd = {
        "log_words": prose(rng, 12_000), "log_word_length": " ".join(3 * w for w in prose(rng, 90).split()), "symbols": " ".join(w + "#" for w in prose(rng, 90).split()),
        "repeated_lines": "\n".join(rng.choice(prose(random.Random(4), 30).split()) for _ in range(100)), "repeated_words": f"{prose(rng, 30)} {passage} {prose(rng, 30)} {passage}",
    }
    docs = spark.createDataFrame(rows + [(name, t, "en", "a") for name, t in odd.items()], "doc_id string, text string, lang string, source string")
    got = quality.quality_verdicts(docs).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == set(odd)


def points(rng, spark):
    """Correlated statistics of three groups, one of them of five rows, with some rows far off against the correlation only."""
    rows = []
    for g, n in (("a", 160), ("b", 70), (None, 5)):
        for k in range(n):
            x = rng.normal(5600, 800)
            y = 0.2 * (x - 5600) + rng.normal(1600, 30) if k % 10 or g is None else 1600 - 0.2 * (x - 5600) + rng.choice([-330, 330])
            rows.append((len(rows), "l", g, round(x), round(y), max(0, round(rng.normal(-20, 60))), 0, round(abs(rng.normal(0, 30)))))
    return rows, spark.createDataFrame(rows, "i int, g0 string, g1 string, x0 long, x1 long, x2 long, x3 long, x4 long")


def test_distances_match_an_independent_estimate(spark):
    floors = [f for _, f in quality.STATISTICS]
    rows, table = points(np.random.default_rng(2), spark)
    got = {r.i: r.d2 for r in quality.robust_distances(table, floors).collect()}
    expected = brute.robust_distances([(r[1], r[2]) for r in rows], np.array([r[3:] for r in rows], float), floors)
    assert max(abs(got[i] - d) / (1 + d) for i, d in enumerate(expected)) < 0.02
    again = {r.i: r.d2 for r in quality.robust_distances(table.repartition(7), floors).collect()}
    assert again == got


def test_the_covariance_decides(spark, monkeypatch):
    rows, table = points(np.random.default_rng(2), spark)
    floors = [f for _, f in quality.STATISTICS]
    with_it = {r.i for r in quality.robust_distances(table, floors).filter(f"d2 > {quality.CUTOFF}").collect()}
    fitted = quality._factored
    cleared = lambda e, p: fitted(e.withColumns({f"s{i}_{j}": F.lit(0.0) for i, j in quality._lower(p) if i != j}), p)
    monkeypatch.setattr(quality, "_factored", cleared)
    without = {r.i for r in quality.robust_distances(table, floors).filter(f"d2 > {quality.CUTOFF}").collect()}
    assert with_it > without


# -- near copies ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 2])
def test_near_copies(spark, docs, texts, nothing, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, k=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.near(texts)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert near_dedup.near_duplicates(nothing, k=4).count() == 0


def test_near_copies_of_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", 1), (2, "a b c d e f", 1), (5, "A B c d e f", 1)], "doc_id long, text string, node int")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(rows, k=4).collect())
    assert got == [(0, 0, True), (2, 2, True), (2, 2, True), (5, 2, False)]
    assert near_dedup.keep_one(rows, k=4).columns == rows.columns


def test_a_large_group_of_near_copies_grows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    rng = random.Random(12)
    base = prose(rng, 160).split()
    texts = {}
    for k in range(500):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{k}"
        texts[k] = " ".join(w)
    for k in range(500, 520):  # strangers that share most of it
        w = base[: 150 - k % 5] + [f"y{k}_{j}" for j in range(30)]
        texts[k] = " ".join(w)
    dealt, forests = [], near_dedup._forests

    def counted(rows, percent, exact):
        dealt.append(rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0)
        return forests(rows, percent, exact)

    monkeypatch.setattr(near_dedup, "_forests", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=4).collect()}
    assert got == brute.near(texts)
    # all pairs of its 25 blocks would be 13,000 rows of a group
    assert max(dealt) < 3500


def test_forest_reaches_what_links_reach():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in range(0, 120, 3)]
    values = near_dedup.min_max(sets, near_dedup.permutations())
    edges = near_dedup.forest(np.array([len(s) for s in sets]), near_dedup.sketches(values), sets, 80)
    assert all(near_dedup._linked(sets[a], sets[b], 80) for a, b in edges)
    least = list(range(len(sets)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if near_dedup._linked(sets[a], sets[b], 80):
                least[max(find(a), find(b))] = min(find(a), find(b))
    merged = list(range(len(sets)))

    def root(i):
        while merged[i] != i:
            i = merged[i]
        return i

    for a, b in edges:
        merged[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(k) for k in range(len(sets))] == [find(k) for k in range(len(sets))]


def test_components(spark):
    from factloom.llm.graph import components

    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "c"), ("x", "y"), ("x", "x")], "u string, v string")
    assert {r.node: r.component for r in components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert components(edges.limit(0)).count() == 0
    chain = spark.range(60).select(F.format_string("n%03d", "id").alias("u"), F.format_string("n%03d", F.col("id") + 1).alias("v"))
    assert {r.component for r in components(chain).collect()} == {"n000"}
