import corpus_pipeline as cp
from llmcases import SMALL, awkward, documents, frame
from test_decontaminate import words
from test_line_dedup import expected as line_rule
from test_mixing import shared
from test_near_dup import expected as near_rule

from dealflow.llm.common import stored


def test_stages_one_after_another(spark):
    """Each stage against its plain rule, on what the stage before has kept."""
    docs = documents(spark)
    odd = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(["Съешь ещё булок, да выпей чаю", "12 34", ""])]
    one = stored(cp.STAGES[0][1](spark, docs.union(spark.createDataFrame(odd, docs.schema)), SMALL))
    want = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = stored(cp.STAGES[1][1](spark, one, SMALL))
    kept = {d: t for (d, _), (t, gone) in line_rule(rows).items() if not gone or t.strip(" ")}
    got = {r.doc_id: r for r in two.collect()}
    assert {d: r.text for d, r in got.items()} == kept and two.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got.values())

    three = stored(cp.STAGES[2][1](spark, two, SMALL))
    want = {x.split(",")[0].strip("(") for x in near_rule(list(kept.items()), 5) if "True" in x}
    assert {str(r.doc_id) for r in three.collect()} == want and three.columns == docs.columns

    four = stored(cp.STAGES[3][1](spark, three, SMALL))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [set(zip(*[words(r.text)[i:] for i in range(6)])) for r in bench.collect()]
    left = {r.doc_id for r in four.collect()}
    verbatim = {r.doc_id for r in three.collect() if any(f" {' '.join(words(b.text))} " in f" {' '.join(words(r.text))} " for b in bench.collect())}
    # No document with an item goes unseen, and none goes that shares next to nothing with any.
    gone = {r.doc_id: r.text for r in three.collect() if r.doc_id not in left}
    assert verbatim and verbatim <= set(gone) and four.columns == docs.columns
    for text in gone.values():
        own = words(text)
        grams = set(zip(*[own[i:] for i in range(6)]))
        assert max(len(grams & item) / len(item) for item in items) > 0.2

    last = cp.STAGES[4][1](spark, four, SMALL).collect()
    sizes = {}
    for r in last:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = shared(sizes)
    assert {r.doc_id for r in last} == {r.doc_id for r in four.collect()}
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in last)
    assert sorted(map(tuple, cp.run(spark, SMALL).collect())) == sorted(map(tuple, last))


def test_awkward_documents(spark):
    docs = frame(spark, awkward()).selectExpr("*", "'en' lang")
    for name, stage in cp.STAGES[:-1]:
        docs_next = stored(stage(spark, docs, SMALL))
        assert docs_next.columns == docs.columns, name
        docs = docs_next
    assert cp.STAGES[-1][1](spark, docs, SMALL).count() == docs.count() > 0


def test_empty_documents(spark):
    docs = documents(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
