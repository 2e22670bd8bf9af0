import random
import time
from collections import Counter

from llmcases import awkward, documents, frame, prose, texts

from dealflow.llm import license_scan as ls
from dealflow.llm.license_texts import TEMPLATES
from dealflow.llm.shingles import words


def grams(text):
    w = words([(text or "").encode()])[0].tolist()
    return [(a, b) for a, b in zip(w, w[1:])]


def brute(text, dice, templates=TEMPLATES):
    """(licence, first word, words, coefficient) of all spans, from sets of every window."""
    own, out = grams(text), []
    for name, template in templates.items():
        all_ = grams(template)
        t = set(all_)
        most = int(len(all_) * (2 - dice) / dice + 1e-9)
        hits = [i for i, g in enumerate(own) if g in t]

        def windows(i):
            for j in (j for j in hits if i <= j < i + most):
                seen = set(own[i : j + 1])
                yield 2 * len(seen & t) / (len(seen) + len(t)), j + 1

        at = 0
        while True:
            left = [i for i in hits if i >= at]
            found = next(((i, e) for i in left for v, e in windows(i) if v >= dice), None)
            if found is None:
                break
            best = min((-v, i, e) for i in left if found[0] <= i < found[1] for v, e in windows(i))
            out.append((name, best[1], best[2] - best[1] + 1, round(-best[0], 9)))
            at = best[2]
    return sorted(out)


def rows_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.license, r.first_word, r.n_words, round(r.dice, 9)))
    return {d: sorted(x) for d, x in got.items()}


def test_like_brute_force(spark):
    got = rows_of(ls.scan(documents(spark)))
    for d, t in texts(spark):
        assert got.get(d, []) == brute(t, 0.85), d
    assert got


def test_spans_of_edited_notices_among_their_own_words(spark):
    """Random pieces, copies and edits of notices: every span, not only names."""
    rng = random.Random(2)
    short = {n: " ".join(TEMPLATES[n].split()[:18]) for n in ("MIT", "ISC", "Zlib", "BSD-3-Clause")}
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 7)):
            words_ = short[rng.choice(list(short))].split()
            start, end = sorted((rng.randint(0, 6), rng.randint(8, len(words_))))
            edit = lambda w: w if rng.random() > 0.06 else rng.choice(["odd", "the", "to"])
            parts += [edit(w) for w in words_[start:end]] + rng.choice([[], ["x"], ["and", "to", "any"]])
        docs.append((i, " ".join(parts)))
    for dice in (0.6, 0.85):
        got = rows_of(ls.scan(frame(spark, docs), templates=short, settings=ls.Settings(dice)))
        want = {d: brute(t, dice, short) for d, t in docs}
        assert got == {d: x for d, x in want.items() if x} and got


def test_many_notices_in_one_text(spark):
    """A third-party notice file: 2000 notices, one row each, in seconds."""
    mit, bsd = TEMPLATES["MIT"], TEMPLATES["BSD-3-Clause"]
    text = "\n".join(f"Package {i}\n{mit if i % 2 else bsd}" for i in range(2000))
    start = time.monotonic()
    found = ls.found([text.encode()], ls.prepared(TEMPLATES), ls.Settings())
    assert time.monotonic() - start < 60
    names = sorted(TEMPLATES)
    by_name = Counter(names[h[1]] for h in found)
    assert by_name["MIT"] == by_name["BSD-3-Clause"] == 1000
    exact = [h for h in found if names[h[1]] in ("MIT", "BSD-3-Clause")]
    assert all(h[2] == 1 for h in exact)
    starts = {"MIT": set(), "BSD-3-Clause": set()}
    for h in exact:
        starts[names[h[1]]].add(h[3])
    assert all(len(s) == 1000 for s in starts.values())


def test_every_template_is_found_whole(spark):
    docs = list(enumerate(f"{prose(30, 7)} {t} {prose(30, 9)}" for _, t in sorted(TEMPLATES.items())))
    got = rows_of(ls.scan(frame(spark, docs)))
    for i, name in enumerate(sorted(TEMPLATES)):
        # The last words may repeat bigrams that stand before them.
        long = len(words([TEMPLATES[name].encode()])[0])
        assert [g for g in got[i] if g[:2] == (name, 30) and long - 3 <= g[2] <= long and g[3] == 1]


def test_edited_texts_and_repeats(spark):
    mit = TEMPLATES["MIT"].split()
    edited = " ".join(x for i, x in enumerate(mit) if i % 25)
    rows = awkward() + [
        (50, prose(50, 1) + " " + edited.upper() + "\n" + prose(50, 2)),
        (51, " ".join(mit[: len(mit) // 2])),
        (52, "Released under the MIT License. " + prose(30, 3) + " released under the mit license"),
    ]
    got = sorted((r.doc_id, r.license, r.first_word) for r in ls.scan(frame(spark, rows)).collect())
    assert got == [(50, "MIT", 50), (52, "MIT-notice", 0), (52, "MIT-notice", 35)]


def test_no_templates_no_rows(spark):
    assert ls.scan(documents(spark), templates={"one": "word", "none": ""}).count() == 0
    assert ls.scan(documents(spark).limit(0)).count() == 0
