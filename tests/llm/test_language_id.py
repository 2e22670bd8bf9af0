import unicodedata
from collections import Counter
from math import log
from zlib import crc32

import numpy as np
import pytest
from llmcases import awkward, documents, frame, texts

from dealflow.llm import language_id as li
from dealflow.llm import queries


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, folder).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if crc32(str(d).encode()) % 4 == 2}
    right = np.mean([r.lang_pred == docs[r.doc_id].lang for r in held])
    assert right > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """n-grams of 1 to 3 characters, a run of other characters than letters being a space."""
    text = (text or "").lower()
    cut = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text)
    words = cut.split()
    out = []
    for w in words:
        out += list(w)
        out += [" " + w[0], *[w[i : i + 2] for i in range(len(w) - 1)], w[-1] + " "]
        padded = f" {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return Counter(out)


def test_grams_like_brute_force():
    samples = ["Hello, world!", "a", "", "1 2", "été à l'œuvre", "ab" * 50, " x ", None, "文字 Ünï"]
    found = [Counter() for _ in samples]
    for codes, owner in li.coded(samples):
        for order, (at, row) in enumerate(li.grams(codes, owner, (1, 2, 3), 1 << 16), 1):
            for r in row.tolist():
                found[r][order] += 1
    for text, have in zip(samples, found, strict=True):
        want = Counter()
        for g, n in plain_grams(text).items():
            want[len(g)] += n
        assert have == want, text


def test_naive_bayes_like_brute_force(spark):
    train = [(i, t, "ab"[i % 2]) for i, t in enumerate(["the house", "das haus", "the mouse", "die maus", "a the"])]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = li.fit(docs)
    counts = {x: sum((plain_grams(t) for _, t, l in train if l == x), Counter()) for x in "ab"}
    for text in ("the", "haus", "mouse die the", "zzz"):
        total = {}
        for x in "ab":
            n = sum(counts[x].values()) + 0.5 * model.buckets
            total[x] = log(sum(l == x for *_, l in train) / len(train)) + sum(
                k * log((counts[x][g] + 0.5) / n) for g, k in plain_grams(text).items()
            )
        best = max(total, key=total.get)
        (name,), score = li.scored([text], model)
        assert name == best
        assert abs(score[0] - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-4


def test_unlearned_languages_go(spark):
    """Documents of the four learned languages stay; others and random letters go."""
    docs = documents(spark)
    model = li.fit(li.training_rows(docs))
    rng = np.random.default_rng(3)
    letters = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    odd = [
        "Съешь ещё этих мягких французских булок, да выпей же чаю. " * 3,
        "我能吞下玻璃而不伤身体。这是一个测试文本，用来检查语言。",
        "これは日本語の文章です。テストのために書かれました。",
        "η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
        *[letters(n) for n in (40, 100, 400)],
    ]
    plain = {r.doc_id: r.text for r in docs.collect()}
    both = frame(spark, [*plain.items(), *enumerate(odd, 10**6)])
    left = {r.doc_id for r in li.accepted(both, model, 0.5).collect()}
    assert left == {d for d, t in plain.items() if any(c.isalpha() for c in t or "")}
    # The mean log probability, by hand.
    sums, number = li.log_sums(["the house"], model)
    grams = plain_grams("the house")
    assert number[0] == sum(grams.values()) and (sums < 0).all()


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(20).selectExpr("id doc_id", "'text' text", "string(id) lang")
    settings = li.Settings(buckets=1 << 10, matrix_bytes=20 << 12)
    assert len(li.fit(docs, settings=settings).languages) == 20
    with pytest.raises(ValueError, match="matrix_bytes"):
        li.fit(docs, settings=li.Settings(buckets=1 << 10, matrix_bytes=(20 << 12) - 1))


def test_awkward_rows(spark):
    model = li.fit(documents(spark))
    docs = frame(spark, awkward())
    got = li.predict(docs, model, keep={"doc_id": "doc_id", "text": "text"}).collect()
    assert len(got) == len(awkward())
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.score > 0) == letters
    left = li.accepted(docs, model, 0.5)
    assert left.columns == docs.columns
    assert {5, 6, 7, 16} & {r.doc_id for r in left.collect()} == set()


def test_long_texts_in_parts(spark, monkeypatch):
    model = li.fit(documents(spark))
    rows = [t for _, t in texts(spark)][:30]
    whole = li.scored(rows, model)
    monkeypatch.setattr(li, "CHUNK", 400)
    names, score = li.scored(rows, model)
    assert names == whole[0]


def test_nothing_to_learn(spark):
    docs = documents(spark)
    assert li.fit(docs.limit(0)) is None
    assert li.fit(docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("text", "cast(null as string) lang")) is None
    got = li.predict(docs, None, keep={"doc_id": "doc_id"}).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("und", 0.0)]
    assert li.predict(docs.limit(0), None).count() == 0
