import numpy as np
import pytest

from dealflow.llm import vector_dedup
from dealflow.llm.vector_dedup import Settings, components

SCHEMA = "vec_id long, embedding array<float>, label int, k string, n long, cell string, links int"


def table(spark, rows, kind="float"):
    """Vectors from (vec_id, values, label), with columns that clash with inner names."""
    full = [(i, None if v is None else [None if x is None else float(x) for x in v], b, "k", 5, "c", 1)
            for i, v, b in rows]
    return spark.createDataFrame(full, SCHEMA.replace("float", kind))


def expected(rows, least=0.98, kind=np.float32):
    """(vec_id, n_links, component, kept) per row, from all pairs."""
    usable = []
    for at, (i, v, b) in enumerate(rows):
        if i is None or b is None or not v or any(x is None for x in v):
            continue
        x = np.array(v, kind).astype(float)
        if np.isfinite(x).all() and x.any():
            usable.append((at, b, x / np.linalg.norm(x)))
    links = {at: set() for at in range(len(rows))}
    for p, bp, x in usable:
        for q, bq, y in usable:
            if p < q and bp == bq and len(x) == len(y) and x @ y >= least:
                links[p].add(q)
                links[q].add(p)
    out = []
    for at, (i, _, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        component = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(links[at]), component, i is None or i == component))
    return sorted(map(str, out))


def found(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(str, map(tuple, df.collect())))


def clustered(rng, n, dims, spread):
    """Vectors around few centres, many of them near the bound."""
    centres = rng.normal(size=(max(2, n // 12), dims))
    own = centres[rng.integers(0, len(centres), n)]
    return own + rng.normal(size=own.shape) * spread * rng.random((n, 1))


def some(seed, n, dims, spread=0.25, labels=2):
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, n, dims, spread)
    return [(int(i), list(v), int(rng.integers(labels))) for i, v in zip(rng.permutation(n), vectors, strict=True)]


@pytest.mark.parametrize(
    ("dims", "settings"),
    [
        (64, Settings()),
        (64, Settings(block_dims=8, cell_rows=4, tile_rows=16)),
        (20, Settings(block_dims=4, cell_rows=2, grid_dims=3)),
        (5, Settings(cosine=0.9, block_dims=2, cell_rows=8)),
        (1, Settings()),
    ],
)
def test_like_all_pairs(spark, dims, settings):
    rows = some(dims, 400, dims)
    want = expected(rows, settings.cosine)
    assert sum(not w.endswith("True)") for w in want) > 50
    assert found(components(table(spark, rows), settings=settings)) == want


def test_hot_cell_is_compared_in_tiles(spark):
    """A cluster that fills one cell, with a label of its own; few parts, each pair counted once."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    rows = [(i, list(centre + rng.normal(size=16) * 0.12), 7) for i in range(300)]
    for tile_rows in (10, 64, 1000):
        got = components(table(spark, rows), settings=Settings(tile_rows=tile_rows))
        assert found(got) == expected(rows)


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, -3.0], [1.0, 2.0, -3.01]
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, v, 1), (4, w, 1), (5, v, 2), (6, v, None), (7, None, 1), (8, [], 1), (10, [0, 0, 0], 1),
        (11, [1, None, 2], 1), (12, [nan, 1, 2], 1), (13, [inf, 1, 2], 1), (None, v, 1),
        (14, [-x for x in v], 1), (15, [x * 1e30 for x in v], 1), (16, [x * 1e-30 for x in v], 1),
        (17, v, 3), (17, v, 3), (17, w, 3), (18, [1.0, 2.0], 1), (19, [1.0, 2.0, -3.0, 0.0], 1),
        (20, v, 4), (20, v, 4),
    ]
    got = found(components(table(spark, rows)))
    assert got == expected(rows)
    assert "(4, 3, 4, True)" in got and "(20, 1, 20, True)" in got


def test_doubles_and_text_ids(spark):
    rows = [(1, [1e200, 1e199], 1), (2, [1e-200, 1e-201], 1), (3, [1.0, 5.0], 1)]
    df = table(spark, rows, "double").selectExpr("concat('v', vec_id) id", "embedding e", "string(label) l")
    got = components(df, "id", "e", "l").collect()
    assert sorted(map(tuple, got)) == [("v1", 1, "v1", True), ("v2", 1, "v1", False), ("v3", 0, "v3", True)]


def test_copies_are_a_hot_class(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(900, [1.0, 2.0, 3.02], 1)]
    got = components(table(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(500, 0)}
    assert sum(r.kept for r in got) == 1


def test_empty(spark):
    assert components(table(spark, [])).count() == 0


def test_exact_rotation():
    whole = vector_dedup.rotated(np.random.default_rng(1).normal(size=(50, 48)), Settings())
    assert (whole == np.rint(whole)).all()
    lengths = (whole * whole).sum(1) / 64
    assert np.allclose(np.sqrt(lengths), vector_dedup.SCALE, rtol=1e-3)
    parts = np.concatenate([whole[:7], whole[7:]])
    assert (parts @ parts.T == whole @ whole.T).all()


def test_budgets_cover_the_bound():
    """Pairs at the bound are within the budget of a block, however they are rounded."""
    rng = np.random.default_rng(2)
    settings = Settings()
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = settings.cosine * x + np.sqrt(1 - settings.cosine**2) * away
    a, b = vector_dedup.rotated(x, settings), vector_dedup.rotated(y, settings)
    cuts, budget = vector_dedup.blocks(64, settings)
    gaps = np.array([((a[:, c] - b[:, c]) ** 2).sum(1) for c in cuts])
    assert len(cuts) == 4 and (gaps.min(0) <= budget).all()
