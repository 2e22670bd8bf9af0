import random
from collections import Counter

import duckdb
from llmcases import SMALL, awkward, documents, frame

from dealflow.llm import oracle, queries
from dealflow.llm.mixing import Settings, mix, targets


def shared(sizes, weights=(3, 1, 2)):
    """Targets by resharing until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total >= 2 * sizes[s]}
        if not above:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in above}
        rest -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return out


def test_query_like_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(oracle.SQL["op8_mix_sources"])
    names = [d[0] for d in result.description]
    got = queries.QUERIES["op8_mix_sources"](spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, rng.randint(1, 10**9)]) for i in range(n)}
        sizes[None] = 17
        rows = [(s is None, s or "", v) for s, v in sizes.items()]
        df = spark.createDataFrame(rows, "no_source boolean, source string, source_size long")
        got = {None if r.no_source else r.source: r.target for r in targets(df).collect()}
        want = shared(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_taken_words_meet_targets(spark):
    for settings in (Settings(), Settings(slice_rows=1)):
        rows = mix(documents(spark), settings=settings).collect()
        assert len(rows) == documents(spark).count()
        taken = Counter()
        for r in rows:
            assert r.taken in (0, r.size, 2 * r.size)
            taken[r.source] += r.taken
        largest = {r.source: max(x.size for x in rows if x.source == r.source) for r in rows}
        for r in rows:
            assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1
    again = mix(documents(spark), settings=settings).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_slices_do_not_change_the_result(spark):
    few, many = (
        sorted(map(tuple, mix(documents(spark), settings=Settings(slice_rows=n)).collect()))
        for n in (10**9, 3)
    )
    assert few == many


def test_quality_is_preferred(spark):
    rows = [(i, "w " * 10) for i in range(600)]
    docs = frame(spark, rows, clashing=False).drop("source").selectExpr("*", "if(doc_id % 3 = 0, 'a', 'b') source")
    good = spark.createDataFrame([(i, 20.0) for i in range(0, 600, 2)], "doc_id long, weight double")
    got = mix(docs, good).collect()
    more = {k: [r.taken for r in got if (r.doc_id % 2 == 0) == k and r.epochs * r.source_size < r.target] for k in (True, False)}
    assert sum(more[True]) / len(more[True]) > sum(more[False]) / len(more[False])


def test_awkward_rows(spark):
    rows = awkward()
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.size for r in got if r.doc_id in (5, 6, 7, 14, 16)} == {0, 30_000, 3}
    assert any(r.source is None and r.target > 0 for r in got)
    assert mix(documents(spark).limit(0)).count() == 0
