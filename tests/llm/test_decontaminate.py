import random
import re

import numpy as np
from llmcases import SMALL, awkward, documents, frame, prose, texts

from dealflow.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def test_finds_all_verbatim_items(spark):
    items = [(r.item_id, words(r.text)) for r in benchmark(spark).collect()]
    want = set()
    for d, t in texts(spark):
        own = " " + " ".join(words(t)) + " "
        want |= {(d, i) for i, w in items if " " + " ".join(w) + " " in own}
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(documents(spark), benchmark(spark)).collect()}
    assert want and want == got


def test_paraphrases_and_answers(spark):
    rng = random.Random(2)
    item = prose(40, 77).split()
    loose = [w for i, w in enumerate(item) if i % 8]  # an eighth of the words left out
    swapped = list(item)
    for i in range(0, 30, 6):
        swapped[i] = "other"
    no_answer = item[:30]  # the last quarter is the answer
    rows = awkward() + [(100 + i, prose(300, 200 + i)) for i in range(60)]
    rows += [
        (200, f"{prose(70, 5)} {' '.join(loose).upper()}. {prose(90, 6)}"),
        (201, f"{prose(33, 7)} {', '.join(swapped)} {prose(20, 8)}"),
        (202, f"{prose(50, 9)} {' '.join(no_answer)} {prose(50, 10)}"),
        (203, " ".join(rng.sample(item, len(item)))),
    ]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "?!")], "item_id long, text string"
    )
    docs = frame(spark, rows)
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect())
    assert got == [(200, 1), (201, 1)]
    left = dc.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - 2
    told = bench.filter("item_id = 1").selectExpr("item_id", "text", f"'{' '.join(item[:10])}' reply")
    found = dc.contaminated(docs, told, answer="reply").collect()
    assert {r.doc_id for r in found} == {200, 201, 202}


def test_blocks_of_items_give_the_same(spark):
    one, many = (
        sorted(
            (r.doc_id, r.item_id, r.common_words, round(r.cosine, 3))
            for r in dc.contaminated(documents(spark), benchmark(spark), settings=s).collect()
        )
        for s in (dc.Settings(), dc.Settings(block=7))
    )
    assert one == many


def test_empty(spark):
    assert dc.contaminated(documents(spark).limit(0), benchmark(spark)).count() == 0
    assert dc.contaminated(documents(spark), benchmark(spark).limit(0)).count() == 0
    assert dc.clean(documents(spark), benchmark(spark).limit(0)).count() == documents(spark).count()


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert dc.common(a, b) == plain(a, b)


def test_space_keeps_the_dominant_directions(spark):
    """The randomised directions span what an exact decomposition of the same matrix finds."""
    settings = dc.Settings(terms=512, rank=8, extra=24)
    docs = documents(spark).limit(60)
    space = dc.fit(docs, settings=settings)
    rows = []
    held = np.zeros(512)
    for r in docs.collect():
        hashes, counts = dc.words([r.text.encode()])
        starts, _ = dc.steps(counts, 64)
        for a, b in zip(starts, [*starts[1:], len(hashes)], strict=True):
            own = np.bincount(dc.term(hashes[a:b], settings), minlength=512)
            rows.append(own)
            held += own > 0
    matrix = np.array(rows) * np.log((1 + len(rows)) / (1 + held))
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:4]
    basis = np.linalg.qr(space.vectors / np.maximum(np.log((1 + len(rows)) / (1 + held)), 1e-9)[:, None])[0]
    assert (np.linalg.norm(exact @ basis, axis=1) > 0.9).all()


def test_items_of_a_hot_group_of_copies(spark):
    """A third of the rows are copies with an item; it is found in the other documents too."""
    item = prose(24, 300)
    rows = [(i, f"{prose(30, 301)} {item} {prose(30, 302)}") for i in range(60)]
    rows += [(100 + i, f"{prose(20 + i, 400 + i)} {item} {prose(90, 500 + i)}") for i in range(40)]
    rows += [(200 + i, prose(150, 600 + i)) for i in range(80)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in dc.contaminated(frame(spark, rows), bench).collect()}
    assert got == {d for d, _ in rows if d < 200}
    loose = " ".join(w for i, w in enumerate(item.split()) if i % 8)
    near = [(d, t.replace(item, loose) if d >= 100 else t) for d, t in rows]
    got = {r.doc_id for r in dc.contaminated(frame(spark, near), bench).collect()}
    assert got == {d for d, _ in rows if d < 200}


def test_passages_count_once(spark):
    rows = [(i, prose(200, 1)) for i in range(50)] + [(99, prose(64, 2))]
    held, passages = dc.frequencies(dc.different_passages(frame(spark, rows), dc.Settings()), dc.Settings())
    assert passages == 5 and held.max() <= 5


def test_short_items_at_every_offset(spark):
    """Items of 3 to 15 words, word for word at 16 offsets each; of 9 words on, also without one."""
    items = {n: prose(n, 700 + n).split() for n in range(3, 16)}
    rows, want = [(10_000 + i, prose(150, 800 + i)) for i in range(60)], set()
    for n, item in items.items():
        for offset in range(16):
            for loose in range(1 + (n > 8)):
                d = 1000 * loose + 20 * n + offset
                own = [w for i, w in enumerate(item) if not (loose and i == 1)]
                rows.append((d, f"{prose(20 + offset, d)} {' '.join(own)} {prose(60, 5000 + d)}"))
                want.add((d, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame(spark, rows), bench).collect()}
    assert got == want


def test_one_document_and_its_copies(spark):
    item = prose(40, 900)
    bench = spark.createDataFrame([(1, item), (2, prose(40, 901))], "item_id long, text string")
    for n in (1, 3):
        docs = frame(spark, [(7, item)] * n)
        got = [(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()]
        assert got == [(7, 1)] * n
        assert dc.clean(docs, bench).count() == 0
    other = frame(spark, [(8, prose(50, 902))])
    assert dc.clean(other, bench).count() == 1


def test_ids_of_any_type(spark):
    item = prose(30, 950)
    docs = frame(spark, [(1, f"{prose(40, 951)} {item}"), (2, prose(50, 952)), (None, item)])
    bench = spark.createDataFrame([(7, item), (8, prose(20, 953))], "item_id long, text string")
    for kind, want in (("int", 7), ("string", "7"), ("decimal(10,0)", 7), ("bigint", 7)):
        typed = bench.selectExpr(f"cast(item_id as {kind}) item_id", "text", "'x' cosine", "1 at")
        got = dc.contaminated(docs.withColumn("doc_id", docs.doc_id.cast("string")), typed)
        assert dict(got.dtypes)["item_id"] == kind and dict(got.dtypes)["doc_id"] == "string"
        assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == [("1", want), ("None", want)]
        assert [r.doc_id for r in dc.clean(docs, typed).collect()] == [2]


def test_recall_by_share_of_replaced_words(spark):
    """Items with words replaced at random, in documents of their own."""
    rng = random.Random(12)
    items = {i: prose(rng.randint(16, 60), 1000 + i).split() for i in range(40)}
    rows, planted = [(90_000 + i, prose(200, 3000 + i)) for i in range(80)], {}
    for share in (0, 10, 20, 30):
        for i, item in items.items():
            answer = len(item) - max(1, len(item) // 4)  # words of the answer stay
            out = set(rng.sample(range(answer), len(item) * share // 100))
            loose = " ".join(f"x{rng.randint(0, 999)}" if k in out else w for k, w in enumerate(item))
            d = 100 * share + i
            rows.append((d, f"{prose(60 + i, 5000 + d)} {loose} {prose(70, 9000 + d)}"))
            planted.setdefault(share, set()).add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(frame(spark, rows), bench).collect()}
    recall = {share: len(pairs & got) / len(pairs) for share, pairs in planted.items()}
    assert recall[0] == 1 and min(recall.values()) >= 0.9, recall
    assert not got - set().union(*planted.values())


def test_word_check_is_that_of_the_words(spark):
    """The check by terms never rules out what the exact one accepts."""
    rng = np.random.default_rng(5)
    space = dc.Space(np.ones((1 << 15, 2), np.float32), np.ones(1 << 15, bool))
    texts_ = [prose(int(n), int(n)) for n in rng.integers(3, 40, 30)]
    items = dc.prepared([(i, t, None) for i, t in enumerate(texts_)], space, dc.Settings())
    hashes, _ = dc.words([" ".join(texts_ + [prose(200, 77)]).encode()])
    left = rng.integers(0, len(hashes), 500)
    right = np.minimum(left + rng.integers(0, 60, 500), len(hashes))
    item = rng.integers(0, 30, 500)
    got = dc.enough_words(dc.term(hashes, dc.Settings()), item, left, right, items)
    exact = [np.isin(hashes[a:b], items.sorted[i]).sum() >= items.needs[i, 0] and b > a
             for i, a, b in zip(item, left, right, strict=True)]
    assert (got >= np.array(exact)).all() and 0 < got.sum() < 200
