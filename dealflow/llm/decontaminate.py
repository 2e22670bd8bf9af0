"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A distributed randomised SVD finds
their dominant directions: with a random matrix W, each task adds up A^T (A W) over its passages,
and the sum gives singular vectors and values by the Nystrom formula. Passages and benchmark items
are compared by cosine in that space, each direction scaled by its singular value, so that common
words do not make everything alike. All this counts a passage once, however many copies of it there
are. Items that stand in a text word for word are candidates whatever their cosine; they are found
by hashes of runs of words. Candidates are verified on words: the longest common subsequence with
the item, and with its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dealflow.llm.common import chunks, columns, stored
from dealflow.llm.shingles import prefix_sums, run_hashes, words

#: Bytes of text handled at once; larger ones push what a task works on out of the caches.
CHUNK = 1 << 18
#: Cosines of passages and items held at once.
NEAR = 1 << 22
#: Rows added up at once.
PIECE = 1 << 15


@dataclass(frozen=True)
class Settings:
    """``terms`` hashed words, ``rank`` directions from ``rank + extra`` random ones.

    Documents are read in steps of ``step`` words and passages of 2, 4, 8 and 16 steps (powers of two); an
    item is compared with passages of the longest such size that is not above its own. Terms in more than
    ``common`` of the different passages do not count as rare when candidates are ruled out. A
    candidate has at least ``cosine`` (``short_cosine`` for items of less than two of the smallest
    passages, as a passage may lie half outside them), or the item word for word; it counts if the longest common
    subsequence has ``share`` of the item's
    words (all of them below ``short`` words) and of the answer's. The answer is that of the
    benchmark or, if it has none, the last quarter of the item. Items are searched in blocks of
    about ``block``, each with a pass over the documents.
    """

    terms: int = 1 << 15
    rank: int = 56
    extra: int = 8
    step: int = 4
    sizes: tuple[int, ...] = (2, 4, 8, 16)
    common: float = 0.02
    cosine: float = 0.5
    short_cosine: float = 0.25
    share: float = 0.6
    short: int = 8
    block: int = 4096
    seed: int = 11


def term(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(33)).astype(np.int64) & (settings.terms - 1)


def steps(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each step of ``step`` words in each text, and the steps per text."""
    n = -(-counts // step)
    first = np.cumsum(counts) - counts
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + own * step, n


def segment_sums(rows: np.ndarray, picks: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Sums of ``rows[picks[s:e]]`` for each start and end, about ``PIECE`` rows at a time.

    The same as ``np.add.reduceat`` for segments that are not empty, but several times faster
    for rows of some width.
    """
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    done = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PIECE)))
        out[at:stop] = block_sums(rows, picks, starts[at:stop], ends[at:stop])
        at = stop
    return out


def block_sums(rows: np.ndarray, picks: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """``segment_sums`` at once, by blocks of 8."""
    while True:
        blocks = -(-(ends - starts) // 8)
        last = np.cumsum(blocks)
        first = np.repeat(starts, blocks) + 8 * (np.arange(last[-1]) - np.repeat(last - blocks, blocks))
        stop = np.minimum(first + 8, np.repeat(ends, blocks))
        out = rows.take(picks[first], axis=0)
        for i in range(1, 8):
            live = np.flatnonzero(first + i < stop)
            if not len(live):
                break
            if len(live) == len(first):
                out += rows.take(picks[first + i], axis=0)
            else:
                out[live] += rows.take(picks[first[live] + i], axis=0)
        if len(out) == len(starts):
            return out
        rows, picks, starts, ends = out, np.arange(len(out)), last - blocks, last


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield part, [t or b"" for t in texts]


@dataclass(frozen=True)
class Space:
    """Per term, its weighted vector in the scaled space, and whether it is a rare one."""

    vectors: np.ndarray
    rare: np.ndarray


def different_passages(docs: DataFrame, settings: Settings) -> DataFrame:
    """The terms of each different passage of ``docs`` (text), stored."""
    size = settings.step * settings.sizes[-1]
    kind = np.min_scalar_type(settings.terms - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in parts(batches):
            hashes, counts = words(texts)
            starts, _ = steps(counts, size)
            if not len(starts):
                continue
            ends = np.r_[starts[1:], len(hashes)]
            keys, one = np.unique(run_hashes(prefix_sums(hashes), starts, ends), return_index=True)
            lengths = (ends - starts)[one]
            offsets = np.r_[0, np.cumsum(lengths)]
            at = np.arange(offsets[-1]) + np.repeat(starts[one] - offsets[:-1], lengths)
            data = term(hashes[at], settings).astype(kind)
            places = pa.py_buffer((offsets * kind.itemsize).astype(np.int32))
            cells = pa.Array.from_buffers(pa.binary(), len(one), [None, places, pa.py_buffer(data)])
            yield pa.record_batch({"hash": pa.array(keys.view(np.int64)), "terms": cells})

    found = docs.mapInArrow(cut, "hash long, terms binary").dropDuplicates(["hash"])
    return stored(found.select("terms"), "passages")


def term_lists(
    batches: Iterator[pa.RecordBatch], settings: Settings
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of the passages of each batch, one after the other, and where each one starts."""
    kind = np.min_scalar_type(settings.terms - 1)
    for batch in batches:
        if batch.num_rows:
            cells = batch.column("terms").to_pylist()
            lengths = np.array([len(c) for c in cells]) // kind.itemsize
            yield np.frombuffer(b"".join(cells), kind).astype(np.int64), np.cumsum(lengths) - lengths


def frequencies(passages: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages, over all of ``passages`` (terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(settings.terms, np.int64), 0
        for terms, starts in term_lists(batches, settings):
            passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(terms)]))
            order = np.argsort(terms.astype(np.min_scalar_type(settings.terms)), kind="stable")
            terms, passage = terms[order], passage[order]
            new = np.r_[True, (terms[1:] != terms[:-1]) | (passage[1:] != passage[:-1])]
            total += np.bincount(terms[new], minlength=settings.terms)
            passages += len(starts)
        at = np.flatnonzero(total)
        yield pa.record_batch(
            {"term": pa.array(np.r_[-1, at]), "n": pa.array(np.r_[passages, total[at]])}
        )

    found = passages.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(settings.terms, np.int64)
    passages = 0
    for at, n in found.collect():
        if at < 0:
            passages = n
        else:
            out[at] = n
    return out, passages


def fit(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Space | None:
    """The space of all passages of ``docs``; None without any word.

    One pass over the texts, two over their different passages. A task sends one matrix of terms x
    directions, cut into rows of 256 terms; the driver gets the sum of them, whose size is fixed by
    the settings.
    """
    table = different_passages(columns(docs, text=text), settings)
    held, passages = frequencies(table, settings)
    if not passages:
        return None
    rare = held <= settings.common * passages
    # Little, but not nothing, for terms of all passages.
    weight = np.log((1 + passages) / np.minimum(1 + held, 0.5 + passages)).astype(np.float32)
    width, rows = settings.rank + settings.extra, 256
    noise = np.random.default_rng(settings.seed).standard_normal((settings.terms, width))
    noise = noise.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weight, weight[:, None] * noise))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, weighted = shared.value
        total = np.zeros((settings.terms, width), np.float32)
        for terms, starts in term_lists(batches, settings):
            ends = np.r_[starts[1:], len(terms)]
            passage = np.repeat(np.arange(len(starts)), ends - starts)
            out = segment_sums(weighted, terms, starts, ends)
            order = np.argsort(terms.astype(np.min_scalar_type(settings.terms)), kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            ends = np.r_[first[1:], len(terms)]
            total[terms[first]] += segment_sums(out, passage[order], first, ends)
        total *= weight[:, None]
        yield pa.record_batch(
            {
                "block": pa.array(np.arange(settings.terms // rows)),
                "sums": pa.array([x.tobytes() for x in total.reshape(-1, rows * width)]),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), batch.column("sums")):
                own = np.frombuffer(own.as_buffer(), np.float32).astype(np.float64)
                sums[block] = sums.get(block, 0) + own
        yield pa.record_batch(
            {
                "block": pa.array(list(sums), pa.int64()),
                "sums": pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary()),
            }
        )

    made = table.mapInArrow(multiply, "block long, sums binary")
    made = made.repartition(max(1, settings.terms // rows), "block").mapInArrow(add, "block long, sums binary")
    product = np.zeros((settings.terms, width))
    for block, own in made.collect():
        product[block * rows : (block + 1) * rows] = np.frombuffer(own, np.float32).reshape(rows, width)
    # Nystrom: A^T A is about Z (W^T Z)^-1 Z^T with Z = A^T A W.
    core = noise.T.astype(np.float64) @ product
    values, turns = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max() * 1e-9, 0)
    if not good.any():
        return Space(np.zeros((settings.terms, 1), np.float32), rare)
    root = turns[:, good] / np.sqrt(values[good])
    vectors, singular, _ = np.linalg.svd(product @ root, full_matrices=False)
    k = min(settings.rank, int((singular > singular[0] * 1e-6).sum()))
    scaled = weight[:, None] * vectors[:, :k] / singular[:k]
    return Space((scaled * np.sqrt(passages)).astype(np.float32), rare)


@dataclass(frozen=True)
class Items:
    """Items of a block: ids, words, answers, and per passage size the places and vectors.

    ``sorted`` has the different words of an item and its answer, ``often`` how often the item has
    each of them, ``member`` a bit per item and
    term of them. ``needs`` has the words that must be common, and how many of them rare ones. ``at`` and
    ``by_term`` list the items that hold each rare term. ``whole`` has a hash of all words of each
    item; ``begins`` has, per power of two, sorted hashes of the first so many words of the items
    with less than twice as many, those items, and the leading bits that occur.
    """

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    groups: dict[int, tuple[np.ndarray, np.ndarray]]
    sorted: list[np.ndarray]
    often: list[np.ndarray]
    member: np.ndarray
    needs: np.ndarray
    at: np.ndarray
    by_term: np.ndarray
    whole: np.ndarray
    begins: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def prepared(rows: list[tuple[object, str, str | None]], space: Space, settings: Settings) -> Items:
    """Items that have any word; one without is in no document."""
    ids, own, answers, vectors, size, needs, held = [], [], [], [], [], [], []
    for item, text, answer in rows:
        hashes, _ = words([(text or "").encode()])
        if not len(hashes):
            continue
        ids.append(item)
        own.append(hashes.tolist())
        told = words([answer.encode()])[0].tolist() if answer else []
        answers.append(told or own[-1][-max(1, len(hashes) // 4) :])
        terms = term(hashes, settings)
        vectors.append(space.vectors[terms].sum(0))
        least = len(hashes) if len(hashes) < settings.short else ceil(settings.share * len(hashes))
        rare = terms[space.rare[terms]]
        # Of `least` common words, at most those that are not rare can be others.
        needs.append((least, least - (len(terms) - len(rare))))
        held += [(int(t), len(ids) - 1) for t in set(rare.tolist())]
        fits = [s for s in settings.sizes if s * settings.step <= len(hashes)]
        size.append(max(fits, default=settings.sizes[0]))
    groups = {}
    for s in settings.sizes:
        at = np.flatnonzero(np.array(size) == s)
        if len(at):
            groups[s] = (at, unit(np.stack([vectors[i] for i in at])).T.copy())
    held.sort()
    at = np.searchsorted([t for t, _ in held], np.arange(settings.terms + 1))
    by_term = np.array([i for _, i in held], np.int64)
    known = [np.unique(np.array([*w, *a], np.uint64)) for w, a in zip(own, answers, strict=True)]
    often = [
        np.bincount(np.searchsorted(k, np.array(w, np.uint64)), minlength=len(k))
        for k, w in zip(known, own, strict=True)
    ]
    member = np.zeros((len(known), settings.terms), bool)
    for i, k in enumerate(known):
        member[i, term(k, settings)] = True
    member = np.packbits(member, axis=1, bitorder="little")
    needs = np.array(needs).reshape(-1, 2)
    return Items(ids, own, answers, groups, known, often, member, needs, at, by_term, *run_index(own))


def run_index(texts: list[list[int]]):
    """``whole`` and ``begins`` of ``Items``."""
    whole = np.zeros(len(texts), np.uint64)
    listed: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(texts):
        sums = prefix_sums(np.array(own, np.uint64))
        whole[i] = run_hashes(sums, [0], [len(own)])[0]
        size = 1 << len(own).bit_length() - 1
        listed.setdefault(size, []).append((int(run_hashes(sums, [0], [size])[0]), i))
    begins = {}
    for size, pairs in listed.items():
        pairs.sort()
        keys = np.array([k for k, _ in pairs], np.uint64)
        leading = np.zeros(1 << 18, bool)
        leading[keys >> np.uint64(46)] = True
        begins[size] = keys, np.array([i for _, i in pairs]), leading
    return whole, begins


def verbatim(hashes: np.ndarray, counts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(text, item, word) of each place where an item stands word for word."""
    sums = prefix_sums(hashes)
    word_end = np.cumsum(counts)
    lengths = np.array([len(w) for w in items.words])
    for size, (keys, who, leading) in items.begins.items():
        n = len(hashes) - size + 1
        if n <= 0:
            continue
        own = run_hashes(sums, slice(0, n), slice(size, None))
        at = np.flatnonzero(leading[own >> np.uint64(46)])
        low = np.searchsorted(keys, own[at])
        n = np.searchsorted(keys, own[at], side="right") - low
        begin = np.repeat(at, n)
        item = who[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        end = begin + lengths[item]
        text = np.searchsorted(word_end, begin, side="right")
        inside = end <= word_end[text]
        begin, end, item, text = begin[inside], end[inside], item[inside], text[inside]
        same = run_hashes(sums, begin, end) == items.whole[item]
        yield from zip(text[same].tolist(), item[same].tolist(), begin[same].tolist(), strict=True)


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; each word of ``b`` is one step on bit sets."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & places.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def rare_hits(terms: np.ndarray, step: np.ndarray, steps: int, items: Items) -> np.ndarray:
    """Sorted item * steps + step of every word that is a rare term of an item."""
    n = items.at[terms + 1] - items.at[terms]
    first = np.repeat(items.at[terms], n)
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(items.by_term[first + own] * steps + np.repeat(step, n))


def enough_words(
    terms: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray, items: Items
) -> np.ndarray:
    """Whether the words [left, right) hold as many of the item's as must be common, by terms."""
    out = np.zeros(len(item), bool)
    ends = np.cumsum(right - left)
    bits, width = items.member.ravel(), items.member.shape[1]
    at = 0
    while at < len(item):
        # About a quarter of a million words at a time, in numbers of half the size.
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18))))
        some = slice(at, stop)
        n = right[some] - left[some]
        first = np.cumsum(n) - n
        place = np.arange(n.sum(), dtype=np.int32)
        own = terms[place + np.repeat((left[some] - first).astype(np.int32), n)]
        byte = bits[np.repeat((item[some] * width).astype(np.int32), n) + (own >> 3)]
        hit = byte >> (own & 7).astype(np.uint8) & 1
        shared = np.add.reduceat(np.r_[hit, np.uint8(0)], first, dtype=np.int32)
        out[some] = (n > 0) & (shared >= items.needs[item[some], 0])
        at = stop
    return out


def candidates(
    near: np.ndarray,
    places: np.ndarray,
    first: np.ndarray,
    size: int,
    bound: float,
    reach: np.ndarray,
    begin: np.ndarray,
    end: np.ndarray,
    hits: np.ndarray,
    items: Items,
) -> tuple[np.ndarray, np.ndarray]:
    """Items (rows of ``near``) and passages (columns) near to each other, with enough of the
    item's rare words around the passage."""
    row, passage = np.nonzero(near >= bound)
    item, step = places[row], first[passage]
    left = np.maximum(step - reach[item], begin[step])
    right = np.minimum(step + size + reach[item], end[step])
    base = item * len(begin)
    rare = np.searchsorted(hits, base + right) - np.searchsorted(hits, base + left)
    enough = rare >= items.needs[item, 1]
    return row[enough], passage[enough]


def found(texts: list[bytes], space: Space, items: Items, settings: Settings):
    """(text, item, cosine, common words, first word) of each verified pair, the best passage."""
    hashes, counts = words(texts)
    starts, per_text = steps(counts, settings.step)
    if not len(starts):
        return []
    terms = term(hashes, settings)
    small = terms.astype(np.int32)
    sums = segment_sums(space.vectors, terms, starts, np.r_[starts[1:], len(terms)])
    text = np.repeat(np.arange(len(texts)), per_text)
    end = np.cumsum(per_text)[text]
    begin = end - per_text[text]
    word_end = np.cumsum(counts)
    lengths = np.diff(np.r_[starts, len(hashes)])
    hits = rare_hits(terms, np.repeat(np.arange(len(starts)), lengths), len(starts), items)
    # A passage is tried at every half of its size, so one of them lies within an item of its
    # size or more by three quarters at least, and the item ends so many words around it.
    sizes = np.zeros(len(items.words), int)
    for size, (places, _) in items.groups.items():
        sizes[places] = size * settings.step
    margin = np.array([len(w) for w in items.words]) - sizes * 3 // 4
    least = settings.sizes[0] * settings.step
    reach = -(-np.maximum(margin, 1) // least) * settings.sizes[0]

    def shared_words(item: int, left: int, right: int) -> int:
        """Common words of the item and these of the text, 0 if they or the answer's are too few."""
        own, answer, known = items.words[item], items.answers[item], items.sorted[item]
        region = hashes[left:right]
        at_known = np.minimum(np.searchsorted(known, region), len(known) - 1)
        inside = known[at_known] == region
        # No subsequence has a word more often than both.
        often = np.bincount(at_known[inside], minlength=len(known))
        if np.minimum(often, items.often[item]).sum() < items.needs[item, 0]:
            return 0
        region = region[inside].tolist()
        shared = common(own, region)
        if shared < items.needs[item, 0]:
            return 0
        return shared if common(answer, region) >= settings.share * len(answer) else 0

    # A column per step, texts apart by as many empty ones as the longest passage has, each from a
    # multiple of it on: passages of twice the size are sums of two, and a stride picks them.
    longest = max(items.groups)
    room = (-(-per_text // longest) + 1) * longest
    left_edge = np.cumsum(room) - room
    column = np.arange(len(starts)) + np.repeat(left_edge - np.cumsum(per_text) + per_text, per_text)
    step_at = np.full(room.sum(), -1)
    step_at[column] = np.arange(len(starts))
    spread = np.zeros((sums.shape[1], len(step_at)), np.float32)
    spread[:, column] = sums.T

    out = {}
    for t, i, first in verbatim(hashes, counts, items):
        if (t, i) not in out:
            begin_word, around = int(word_end[t] - counts[t]), int(reach[i]) * settings.step
            right = min(first + len(items.words[i]) + around, int(word_end[t]))
            shared = shared_words(i, max(first - around, begin_word), right)
            if shared:
                # The same words have the same vector.
                out[t, i] = (1.0, shared, first - begin_word)
    reached = 1
    for size, (places, vectors) in sorted(items.groups.items()):
        while reached < size:
            spread[:, :-reached] += spread[:, reached:]
            reached *= 2
        # Every second half of a passage starts one; the last of a text are shorter.
        stride = max(1, size // 2)
        first = step_at[::stride]
        live = np.flatnonzero(first >= 0)
        first = first[live]
        passages = spread[:, ::stride].take(live, axis=1)
        bound = settings.short_cosine if size == settings.sizes[0] else settings.cosine
        passages /= np.maximum(np.sqrt((passages * passages).sum(0)), 1e-12)
        own = max(1, NEAR // max(len(first), 1))
        for at in range(0, len(places), own):
            near = vectors.T[at : at + own] @ passages
            row, passage = candidates(
                near, places[at : at + own], first, size, bound, reach, begin, end, hits, items
            )
            cosine, step, item = np.minimum(near[row, passage], 1), first[passage], places[at + row]
            which, around = text[step], reach[item] * settings.step
            begin_word = word_end[which] - counts[which]
            left = np.maximum(starts[step] - around, begin_word)
            right = np.minimum(starts[step] + size * settings.step + around, word_end[which])
            # Too few words around rule a candidate out before they are aligned.
            for k in np.flatnonzero(enough_words(small, item, left, right, items)).tolist():
                pair, c = (int(which[k]), int(item[k])), float(cosine[k])
                if c <= out.get(pair, (0.0,))[0]:
                    continue
                shared = shared_words(pair[1], int(left[k]), int(right[k]))
                if shared:
                    out[pair] = (c, shared, int(starts[step[k]] - begin_word[k]))
    return [(*pair, *facts) for pair, facts in out.items()]


def blocks(benchmark: DataFrame, space: Space, settings: Settings) -> Iterator[Items]:
    """The items (item_id, text, answer) in blocks of bounded size."""
    n = ceil(benchmark.count() / settings.block)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        rows = benchmark.filter(part == i).orderBy("item_id", "text").collect()
        items = prepared([tuple(r) for r in rows], space, settings)
        if items.ids:
            yield items


def item_table(benchmark: DataFrame, item_id="item_id", text="text", answer=None) -> DataFrame:
    named = {"item_id": item_id, "text": text} | ({"answer": answer} if answer else {})
    items = columns(benchmark, **named).dropDuplicates()
    return items if answer else items.withColumn("answer", F.lit(None).cast("string"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    answer: str | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """doc_id, item_id, cosine, common_words, item_words, first_word of each verified pair.

    Every whole text is searched for every item; ids are of any type. ``cosine`` is that of the
    passage found, 1 where the item stands word for word. Null and empty texts hold nothing, items
    without words are in nothing; rows that are repeated give repeated pairs, repeated items
    one. Without documents, words or items there are no pairs.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    kinds = [rows.schema["doc_id"].dataType.simpleString(), dict(benchmark.dtypes)["item_id"]]
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, common_words long, "
        "item_words long, first_word long"
    )
    out = docs.sparkSession.createDataFrame([], schema)
    space = fit(docs, text, settings)
    if space is None:
        return out
    for items in blocks(item_table(benchmark, answer=answer), space, settings):
        shared = docs.sparkSession.sparkContext.broadcast((space, items))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for part, texts in parts(batches):
                hits = sorted(found(texts, space, items, settings))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                        "item_id": pa.array([items.ids[h[1]] for h in hits], item_kind),
                        "cosine": pa.array([h[2] for h in hits], pa.float64()),
                        "common_words": pa.array([h[3] for h in hits], pa.int64()),
                        "item_words": pa.array([len(items.words[h[1]]) for h in hits], pa.int64()),
                        "first_word": pa.array([h[4] for h in hits], pa.int64()),
                    }
                )

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    answer: str | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item."""
    space = fit(docs, text, settings)
    if space is None:
        return docs
    for items in blocks(item_table(benchmark, answer=answer), space, settings):
        shared = docs.sparkSession.sparkContext.broadcast((space, items))

        def free(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                for part in chunks(batch, text, CHUNK):
                    texts = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
                    hit = {h[0] for h in found(texts, space, items, settings)}
                    keep = [i not in hit for i in range(len(texts))]
                    yield part.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(free, docs.schema)
    return docs
