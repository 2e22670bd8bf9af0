import hashlib
import random
import re

import numpy as np
import pytest
from llmcases import awkward, documents, frame, texts
from pyspark.sql import functions as F

from dealflow.llm import infilling
from dealflow.llm.infilling import Settings, WaveletMatrix, restored, transformed

TOKENS = re.compile("[A-Za-z]+|[^A-Za-z]")


def expected(rows, settings):
    out = []
    for d, t in rows:
        t = t or ""
        tokens = TOKENS.findall(t)
        n = len(tokens)
        digest = hashlib.sha256(f"{settings.seed}:{'' if d is None else d}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
        if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - settings.plain:
            out.append((d, n, "plain", None, None, t))
        elif h4 % 100 < settings.spm:
            out.append((d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("settings", [Settings(), Settings(seed=5, plain=0, spm=50)])
def test_like_brute_force(spark, settings):
    want = expected(texts(spark), settings)
    assert {"psm", "spm"} <= {w.split("'")[1] for w in want}
    assert found(transformed(documents(spark), settings=settings)) == want


def marked():
    rng = random.Random(3)
    odd = ["<P>", "a<S>b", "<M", "<P<S", "< P>", "<", ">", "S>", "\U0001f600x", "İıK", "\x00a", "\r\n", "é" * 70]
    return [(100 + i, "".join(rng.choices(odd + ["ab", "C", " "], k=i % 9))) for i in range(200)]


def test_awkward_rows_and_round_trip(spark):
    rows = [*awkward(), *marked()]
    docs = frame(spark, rows)
    settings = Settings(plain=0)
    got = transformed(docs, settings=settings)
    assert found(got) == expected(rows, settings)
    back = got.select("doc_id", "form", restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(d), t or "") for d, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_boundaries_of_many_texts(spark):
    some = [t for _, t in texts(spark)[:60]] + ["", "a", "", "1", "ab"]
    bounds = infilling.Boundaries(some)
    assert list(bounds.tokens()) == [len(TOKENS.findall(t)) for t in some]
    for k in (0, 1, 5, 100):
        count = np.minimum(bounds.tokens(), k)
        assert list(bounds.after(count)) == [len("".join(TOKENS.findall(t)[:k])) for t in some]


def test_empty(spark):
    assert transformed(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
@pytest.mark.parametrize("bits", [1, 2, 4])
def test_ranks(n, bits):
    values = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint8)
    matrix = WaveletMatrix(values, bits)
    ends = np.arange(n + 1)
    for v in range(1 << bits):
        assert (matrix.rank(v, ends) == np.r_[0, np.cumsum(values == v)]).all()


def test_shares_of_forms(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'some words of text' text")
    counts = {r.form: r["count"] for r in transformed(docs).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 2000) < 200 and abs(counts["spm"] - 3600) < 250
