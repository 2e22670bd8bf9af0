"""Licence scan: Dice coefficient over word bigrams, with size bounds that prune templates.

Texts and templates are lower-cased words without punctuation. For a span of a text with u
different bigrams, of which m are among the t of a template, the coefficient is 2 m / (u + t).
As m is at most u and t, a coefficient of d needs m >= d t / (2 - d), and u <= t (2 - d) / d. The
first bound drops templates and starts of spans by counts of hits; the second, taken over the
bigrams of the template with their repeats, limits the length of spans, so that a span is one
notice and the work for it does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealflow.llm.common import chunks, columns
from dealflow.llm.license_texts import TEMPLATES
from dealflow.llm.shingles import POWER, mixed, words

CHUNK = 2 << 20


@dataclass(frozen=True)
class Settings:
    dice: float = 0.85


def bigrams(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes[:-1] * POWER + hashes[1:])


@dataclass(frozen=True)
class Templates:
    """Names, sizes (different bigrams), lengths (all of them), and the different bigrams of all
    in order with the template that each belongs to."""

    names: list[str]
    sizes: np.ndarray
    lengths: np.ndarray
    values: np.ndarray
    owners: np.ndarray


def prepared(templates: Mapping[str, str]) -> Templates:
    """Templates with two words at least; others have no bigram."""
    runs = {n: bigrams(words([t.encode()])[0]) for n, t in sorted(templates.items())}
    runs = {n: r for n, r in runs.items() if len(r)}
    sets = [np.unique(r) for r in runs.values()]
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    sizes = np.array([len(s) for s in sets], int)
    lengths = np.array([len(r) for r in runs.values()], int)
    return Templates(list(runs), sizes, lengths, values[order], owners[order])


def previous(values: np.ndarray) -> np.ndarray:
    """The place before each one that holds the same value, -1 for none."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.full(len(values), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def spans(at: np.ndarray, before: np.ndarray, size: int, length: int, dice: float):
    """(coefficient, first, end) of the spans of one template in a text, left to right.

    ``at`` are the places (bigrams of the text) that hold a bigram of the template, ``before``
    is ``previous`` of the text. Spans start and end with one of them and have no more than
    ``length * (2 - dice) / dice`` bigrams. From the first start with a span that reaches
    ``dice``, the best of all spans that start before the end of the shortest such span is
    taken (of equal ones the first, then the shortest); the search goes on after its end.
    """
    most = int(length * (2 - dice) / dice + 1e-9)
    hits = np.minimum(np.searchsorted(at, at + most) - np.arange(len(at)), size)
    starts = np.flatnonzero(hits >= dice * size / (2 - dice) - 1e-9)
    hit = np.zeros(len(before), bool)
    hit[at] = True

    def values_from(first: int) -> np.ndarray:
        end = min(first + most, int(at[-1]) + 1)
        # A bigram counts where it stands for the first time in the span.
        new = before[first:end] < first
        return 2 * np.cumsum(new & hit[first:end]) / (np.cumsum(new) + size)

    out, k = [], 0
    while k < len(starts):
        first = int(at[starts[k]])
        values = values_from(first)
        fits = np.flatnonzero(values >= dice)
        if not len(fits):
            k += 1
            continue
        best = (-values.max(), first, first + int(values.argmax()) + 1)
        for start in starts[k + 1 :]:
            later = int(at[start])
            if later > first + fits[0]:
                break
            if 2 * hits[start] / (hits[start] + size) <= -best[0]:
                continue
            values = values_from(later)
            best = min(best, (-values.max(), later, later + int(values.argmax()) + 1))
        out.append((float(-best[0]), best[1], best[2]))
        k = int(np.searchsorted(at[starts], best[2]))
    return out


def found(texts: list[bytes], templates: Templates, settings: Settings):
    """(text, template, coefficient, first word, words) of all licences in the texts."""
    hashes, counts = words(texts)
    if len(hashes) < 2 or not len(templates.values):
        return []
    pairs = bigrams(hashes)
    ends = np.cumsum(counts)
    inside = np.ones(len(pairs), bool)
    inside[ends[(ends > 0) & (ends < len(hashes))] - 1] = False
    low = np.searchsorted(templates.values, pairs, "left")
    hit = np.flatnonzero((templates.values[np.minimum(low, len(templates.values) - 1)] == pairs) & inside)
    if not len(hit):
        return []
    n = np.searchsorted(templates.values, pairs[hit], "right") - low[hit]
    at = np.repeat(hit, n)
    template = templates.owners[
        np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ]
    text = np.searchsorted(ends, at, "right")
    order = np.lexsort((at, template, text))
    at, template, text = at[order], template[order], text[order]
    begins = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (template[1:] != template[:-1])])
    out, known, before = [], -1, np.zeros(0, int)
    for first, last in zip(begins, np.r_[begins[1:], len(at)], strict=True):
        size, length = int(templates.sizes[template[first]]), int(templates.lengths[template[first]])
        if last - first < settings.dice * size / (2 - settings.dice) - 1e-9:
            continue
        which, end = int(text[first]), int(ends[text[first]])
        start = end - int(counts[which])
        if which != known:
            known, before = which, previous(pairs[start : end - 1])
        for value, a, b in spans(at[first:last] - start, before, size, length, settings.dice):
            out.append((which, int(template[first]), value, a, b - a + 1))
    return out


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    settings: Settings = Settings(),
) -> DataFrame:
    """doc_id, license, dice, first_word, n_words: one row per licence found in a whole text.

    A licence that stands several times in a text gives several rows; spans of one template do
    not overlap, those of different ones may (a text that holds a template's text within its own
    is like both; the coefficients tell). Work is linear in a text, however often a notice stands
    in it, and at most quadratic in the length of a template. Null texts and texts of less than two words give
    no rows, a repeated row gives its rows again. The number of templates is the caller's.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(prepared(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                hits = found(texts, known, settings)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                        "license": pa.array([known.names[h[1]] for h in hits], pa.string()),
                        "dice": pa.array([h[2] for h in hits], pa.float64()),
                        "first_word": pa.array([h[3] for h in hits], pa.int64()),
                        "n_words": pa.array([h[4] for h in hits], pa.int64()),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, license string, dice double, first_word long, n_words long"
    )
