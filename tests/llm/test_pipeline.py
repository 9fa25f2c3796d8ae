import corpus_pipeline
from factloom.llm import bpe, mixing
from factloom.llm.queries import queries

from . import brute
from .test_operators import corpus


def test_stages_keep_whole_rows(spark):
    texts = corpus()
    rows = [(i, t, "en", ["a", "b"][i % 2], len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "source_mixing", "bpe_encoding"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, "").collect()
    failed = {i for i, t in texts.items() if (lambda e: e[0] < 50 or 100 * e[4] > 50 * e[0])(brute.base_rules(t))}
    assert {r.doc_id for r in good} == set(texts) - failed

    docs = spark.createDataFrame(good, docs.schema)
    one = stages[1](spark, docs, "").collect()
    near = brute.near({r.doc_id: r.text for r in good}, k=5)
    assert {r.doc_id for r in one} == {i for i, (_, c) in near.items() if c == i}

    docs = spark.createDataFrame(one, docs.schema)
    stripped = stages[2](spark, docs, "").collect()
    removed = brute.repeats({r.doc_id: r.text for r in one})
    for r in stripped:
        whole = removed[r.doc_id][0] - removed[r.doc_id][1]
        assert whole <= len(r.text.encode()) <= whole + 6 * removed[r.doc_id][2] and r.n_chars == len(r.text)

    docs = spark.createDataFrame(stripped, docs.schema)
    mixed = stages[3](spark, docs, "")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    counted = {r.doc_id: r.n for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert mixed.columns == docs.columns and all(abs(counted.get(i, 0) - n) <= 1 for i, n in copies.items())

    encoder = bpe.loaded(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in stripped}
    assert all(encoder.decode(bytes(b for x in r.ids for b in x.to_bytes(4, "little"))) == texts[r.doc_id] for r in stages[4](spark, mixed, "").collect())


def test_registered_queries():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
