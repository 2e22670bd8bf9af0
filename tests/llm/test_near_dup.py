from collections import defaultdict

import numpy as np
import pytest
from llmcases import awkward, documents, frame, prose, texts

from dealflow.llm import near_dup
from dealflow.llm.near_dup import Settings, components, deduplicated, least_matches


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ")
             .replace("\n", " ").replace("\r", " ").split(" ") if w]
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def expected(rows, n, percent=80):
    """(doc_id, shingles, component, kept) per row from all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))
    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for i in usable:
        for j in usable:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for i in usable:
        least[group[i]].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        component = min(least[group[i]]) if i in usable else d
        out.append((d, len(sets[i]), component, d is None or d == component))
    return sorted(map(str, out))


def found(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


@pytest.mark.parametrize("words", [2, 5])
def test_like_brute_force(spark, words):
    got = components(documents(spark), settings=Settings(words=words))
    assert found(got) == expected(texts(spark), words)


def test_awkward_rows(spark):
    rows = awkward()
    assert found(components(frame(spark, rows), settings=Settings(words=2))) == expected(rows, 2)


def test_text_ids(spark):
    base = prose(60, 2)
    rows = [(f"id-{i}", f"{base} {prose(3, i)}") for i in range(12)] + [("z", prose(40, 99))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(components(docs, settings=Settings(words=2))) == expected(rows, 2)


def test_large_group_with_outsiders(spark):
    """Copies around one text, some of which only reach it over others, in several blocks."""
    rng = np.random.default_rng(3)
    base = prose(150, 1).split()
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.choice(len(base), int(rng.integers(0, 16)), replace=False):
            own[at] = f"new{i}x{at}"
        rows.append((1000 - i, " ".join(own)))
    got = components(frame(spark, rows), settings=Settings(words=2, block=16))
    want = expected(rows, 2)
    assert len({w.split(",")[2] for w in want}) > 1
    assert found(got) == want


def test_chain_is_one_component(spark):
    words = prose(260, 8).split()
    rows = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(40)]
    got = components(frame(spark, rows), settings=Settings(words=2))
    assert found(got) == expected(rows, 2)
    assert got.filter("kept").count() == 1


def test_one_of_each_group_stays(spark):
    docs = frame(spark, awkward())
    left = deduplicated(docs, settings=Settings(words=2))
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and not {2, 3, 4, 9} & set(ids) and {5, 6, 7, 8, 14} <= set(ids)
    assert ids.count(None) == 2 and ids.count(12) == 2


def test_empty(spark):
    assert components(documents(spark).limit(0)).count() == 0
    assert deduplicated(documents(spark).limit(0)).count() == 0


def test_batches_prune_only_the_unlikely():
    steps = least_matches(Settings())
    assert [n for n, _ in steps] == [20, 40, 60, 80, 100]
    rng = np.random.default_rng(1)
    runs = rng.random((20000, 100)) < 0.8
    kept = np.all([runs[:, :n].sum(1) >= least for n, least in steps], axis=0)
    assert kept.mean() > 0.9995
    assert np.mean((rng.random((2000, 100)) < 0.3)[:, : steps[-1][0]].sum(1) >= steps[-1][1]) < 0.01


def test_signatures_estimate_similarity():
    settings = Settings(bands=50)
    salts = near_dup.mixed(np.arange(1, settings.hashes + 1, dtype=np.uint64))
    a = near_dup.mixed(np.arange(10_000, 10_900, dtype=np.uint64))
    b = near_dup.mixed(np.arange(10_300, 11_200, dtype=np.uint64))
    same = near_dup.signature(a, salts) == near_dup.signature(b, salts)
    assert abs(same.mean() - 0.5) < 0.12
