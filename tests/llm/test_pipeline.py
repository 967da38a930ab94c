"""The pipeline: its stages against the operators' brute-force versions, and odd rows."""

import corpus_pipeline as cp
from sigweave.llm import session, toxicity
from tests.llm import test_lines, test_near


def step(spark, docs, name, sf, tmp_path):
    out = str(tmp_path / name)
    dict(cp.STAGES)[name](spark, docs, sf).write.parquet(out)
    return spark.read.parquet(out)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = step(spark, docs, "toxicity", sf, tmp_path)
    session.checkpoints(spark)
    scores = toxicity.score(docs, toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet"))))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores.collect() if r.score < 0.7}
    lined = step(spark, clean, "line_dedup", sf, tmp_path)
    want = test_lines.brute([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == {i: (x[0], len(x[0])) for i, x in want.items()}
    near = step(spark, lined, "near_dedup", sf, tmp_path)
    groups = test_near.brute([(r.doc_id, r.text) for r in lined.collect()], 5)
    assert {r.doc_id for r in near.collect()} == {i for i, x in groups.items() if x[2]}
    private = step(spark, near, "pii", sf, tmp_path)
    assert private.count() == near.count()
    for frame in (clean, lined, near, private):
        assert frame.columns == docs.columns
    packed = step(spark, private, "packing", sf, tmp_path)
    ends = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(ends) == private.count() and all(r[1] == r[2] for r in ends)
    assert cp.run(spark, sf).count() == packed.count()


def test_odd_rows(spark, sf, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "a b c d e f a@b.cd", "en", "s", 18)], "doc_id long, text string, lang string, source string, n_chars long")
    for n, rows in (("rows", docs), ("none", docs.limit(0))):
        for name, _ in cp.STAGES:
            rows = step(spark, rows, name, sf, tmp_path / n)
        assert (rows.count() > 0) == (n == "rows")
