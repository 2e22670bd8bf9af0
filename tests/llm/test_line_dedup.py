from collections import Counter

import numpy as np
from llmcases import awkward, documents, frame, prose, texts

from dealflow.llm import line_dedup
from dealflow.llm.line_dedup import common_lines, patience


def expected(rows, settings=line_dedup.Settings()):
    """Kept texts by (id, text): each document against earlier holders of its lines."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    lines = [[x.strip(" ") for x in t.split("\n")] for _, _, t in docs]
    holders = Counter(x for own in lines for x in set(own))
    first, before, out = {}, {}, {}
    for i, (known, d, t) in enumerate(docs):
        others = set()
        for x in {x for x in lines[i] if x}:
            others.add(first.setdefault(x, i))
            if holders[x] <= settings.rare:
                others.add(before.get(x, i))
            before[x] = i
        gone = set()
        for j in others - {i}:
            gone |= set(common_lines(lines[i], lines[j], [len(x) for x in lines[i]], settings.least_chars))
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out[(d if known else None, t)] = (kept, len(gone))
    return out


def test_patience():
    assert patience("abcxde", "abcde") == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4)]
    assert patience("aXbYc", "XYabc") in ([(1, 0), (3, 1), (4, 4)], [(0, 2), (2, 3), (4, 4)])
    assert patience("", "abc") == [] and patience("aaa", "aaa") == [(0, 0), (1, 1), (2, 2)]
    long = [str(i) for i in range(5000)]
    assert len(patience(long, long[:2500] + ["new"] + long[2500:])) == 5000


def test_blocks_are_measured():
    a, b = ["p", "q", "r", "s"], ["q", "r", "x", "s"]
    assert common_lines(a, b, [9, 5, 5, 9], 10) == [1, 2]
    assert common_lines(a, b, [9, 5, 5, 9], 11) == []


def test_like_brute_force(spark):
    want = expected(texts(spark))
    got = line_dedup.shortened(documents(spark)).collect()
    old = dict(texts(spark))
    for r in got:
        assert (r.text, r.n_removed) == want[(r.doc_id, old[r.doc_id])]
    assert sum(r.n_removed for r in got) > 0


def test_awkward_rows(spark):
    rows = awkward() + [(20 + i, f"{prose(25, 7)}\nown line {i}") for i in range(150)]
    docs = frame(spark, rows)
    got = line_dedup.shortened(docs)
    assert got.columns == [*docs.columns, "_n_lines", "_n_removed"]
    have = sorted(str((r.doc_id, r.text, r._n_removed)) for r in got.collect())
    want = expected(rows)
    plain = [(d, None, 0) if t is None else (d, *want[(d, t)]) for d, t in rows]
    assert have == sorted(map(str, plain))


def test_empty(spark):
    assert line_dedup.shortened(documents(spark).limit(0)).count() == 0


def test_blocks_of_lines_that_stand_alone_elsewhere(spark):
    """The first holders of the single lines lack the block; all but its first holder lose it."""
    block = [prose(8, 40 + i)[:45] for i in range(4)]
    rows = [(i, f"{prose(9, 60 + i)}\n{line}\n{prose(9, 70 + i)}") for i, line in enumerate(block)]
    rows += [(10 + i, f"{prose(9, 100 + i)}\n" + "\n".join(block)) for i in range(120)]
    got = {r.doc_id: r.text for r in line_dedup.shortened(frame(spark, rows, False)).collect()}
    for d, text in rows:
        assert got[d] == (text if d <= 10 else text.split("\n")[0])
    # Up to 100 holders: a lone line stands between two documents with the block.
    rows = rows[:4]
    for i in range(20):
        rows.append((10 + 10 * i, f"{prose(9, 100 + i)}\n" + "\n".join(block)))
        rows += [(11 + 10 * i + j, f"{prose(9, 200 + 4 * i + j)}\n{line}") for j, line in enumerate(block)]
    got = {r.doc_id: r.text for r in line_dedup.shortened(frame(spark, rows, False)).collect()}
    for d, text in rows:
        assert got[d] == (text.split("\n")[0] if d > 10 and d % 10 == 0 else text)


def test_block_hashes_cover_common_blocks():
    """All pairs: each long enough common block has all its lines in shared runs."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(0, 60, 30)
        sizes[sizes < 8] = 0
        lines = np.where(sizes, np.arange(30) + 5, 1)
        own = set(line_dedup.block_hashes(lines, sizes, 100).tolist())
        for a in range(30):
            for b in range(a + 2, 31):
                part = line_dedup.block_hashes(lines[a:b], sizes[a:b], 100)
                assert set(part.tolist()) <= own
                assert len(part) > 0 or sizes[a:b].sum() < 100


def test_passages_that_stand_twice():
    p = ["p", "q", "r"]
    once, twice = ["u", *p, "v"], ["x", *p, "y", *p, "z"]
    assert common_lines(once, twice, [1, 40, 40, 40, 1], 100) == [1, 2, 3]
    found = common_lines(twice, once, [1, 40, 40, 40, 1, 40, 40, 40, 1], 100)
    assert found in ([1, 2, 3], [5, 6, 7])
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(2))
        sizes = rng.integers(1, 9, len(a)).tolist()
        runs = [
            sum(sizes[i : i + n])
            for n in range(1, 12)
            for i in range(len(a) - n + 1)
            if any(b[j : j + n] == a[i : i + n] for j in range(len(b)))
        ]
        size, i, j, n = line_dedup.heaviest(a, b, sizes)
        assert a[i : i + n] == b[j : j + n] and size == sum(sizes[i : i + n]) == max(runs, default=0)


def test_first_holder_has_the_passage_twice(spark):
    p = "\n".join(prose(9, 20 + i) for i in range(4))
    rows = [(1, f"{prose(5, 1)}\n{p}\n{prose(5, 2)}\n{p}\n{prose(5, 3)}")]
    rows += [(10 + i, f"{prose(5, 50 + i)}\n{p}\n{prose(5, 300 + i)}") for i in range(120)]
    got = {r.doc_id: r.text for r in line_dedup.shortened(frame(spark, rows, False)).collect()}
    for i, (d, text) in enumerate(rows):
        assert got[d] == (f"{prose(5, 49 + i)}\n{prose(5, 299 + i)}" if i else text)
