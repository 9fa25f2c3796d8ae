"""Odd tables for every operator and stage: clashing and strange column names, empty tables, null ids, repeated rows."""

import random

import pytest

import corpus_pipeline
from factloom.llm import bpe, fingerprint, html_extract, language_id, metric_join, mixing, near_dedup, periods, quality, suffix_dedup, token_store, url_filter

from .test_operators import prose

ODD = ("my col", "a.b", "x`y", "a", "h", "b", "g0", "x0", "size", "multiplier", "rate", "key", "place", "node", "_row", "kept", "d2", "start")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(31)
    base = prose(rng, 120)
    texts = [prose(rng, 90), base, base, None, "", " \n", prose(rng, 70) + " " + base, "ÄÖ ß 日本 " + prose(rng, 60)]
    rows = [([None, 3, 3, 4, 5, 6, 7, 7][k], t, [None, "en"][k % 2], ["s", None][k % 2], *[f"{c}{k}" for c in ODD]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD)), len(texts)


ROWS = {
    "op3": lambda d: token_store.read_documents(token_store.write_shards(d)), "op4": lambda d: suffix_dedup.remove_repeats(d, digests=True), "op5": bpe.digest_documents, "op6": fingerprint.edited_fingerprints,
    "op7": mixing.mix, "op8": language_id.identify, "op9": quality.quality_verdicts, "op10": near_dedup.near_duplicates, "op12": periods.collapse_runs, "op13": metric_join.similar_classes,
}


@pytest.mark.parametrize("name", list(ROWS))
def test_every_row_has_a_result(odd, name):
    docs, n = odd
    assert ROWS[name](docs).count() == n
    assert ROWS[name](docs.limit(0)).count() == 0


def test_pages_with_odd_columns(spark):
    pages = spark.createDataFrame([(None, None, None, 1, "k"), (2, "http://x.org/" + "y" * 200_000, "<p>" + "z " * 50_000, 2, "k"), (2, "", "", 3, "k")], "page_id long, url string, html string, `a.b c` int, text string")
    assert html_extract.extract_main_text(pages).count() == url_filter.judge_urls(pages).count() == 3
    assert html_extract.extract_main_text(pages.limit(0)).count() == url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_odd_columns(spark, odd, stage):
    docs, n = odd
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, "")
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert 0 < len(rows) <= 3 * n and all(str(r["my col"])[6:] == str(r["a.b"])[3:] == str(r["x`y"])[3:] for r in rows)
    assert run(spark, docs.limit(0), "").count() == 0


def test_the_last_stage_takes_odd_columns(spark, odd):
    docs, n = odd
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == n
