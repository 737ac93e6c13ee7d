"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams, all of which are seeds, however common they are. One pass over
the corpus finds the seeds in each document and aligns the item with the words around them, which
also scores edited copies. An alignment cannot match more of an item's words than occur in the
document, and in the part around the seeds; items that this bound rules out are not aligned, which
loses nothing and keeps common phrases cheap. The test set is the query side: it goes to the tasks in
blocks of a bounded number of words, the corpus is never shuffled, and nothing about a document leaves
its task but its matches. Items shorter than an n-gram are looked up by their whole word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import free_name, ship, utf8
from tidelab.llm.licenses import words_of

MATCH, MISMATCH, GAP = 2, -1, -1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def word_hashes(text: bytes, cache: dict[bytes, int]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if len(cache) > 200_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxh64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ (out >> np.uint64(29))) * _FACTOR + words[i : len(words) - n + 1 + i]
        return (out ^ (out >> np.uint64(32))) * _FACTOR


@dataclass
class Items:
    """A block of test items, equal ones as one: their ids, words, and n-grams with their places."""

    ids: list[list[int]]
    words: list[np.ndarray]
    n: int
    grams: np.ndarray = None
    owner: np.ndarray = None
    place: np.ndarray = None
    bloom: np.ndarray = None
    flat: np.ndarray = None
    sizes: np.ndarray = None
    short: dict[int, tuple[np.ndarray, np.ndarray]] = None

    def index(self) -> Items:
        grams = [gram_hashes(w, self.n) for w in self.words]
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        bloom = np.zeros(1 << _FILTER_BITS, bool)
        bloom[flat & np.uint64((1 << _FILTER_BITS) - 1)] = True
        words = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        sizes = np.array([len(w) for w in self.words], np.int64)
        short = {}
        for size in range(1, self.n):
            nos = np.flatnonzero(sizes == size)
            if len(nos):
                whole = np.concatenate([gram_hashes(self.words[no], size) for no in nos])
                by = np.argsort(whole, kind="stable")
                short[size] = whole[by], nos[by]
        return Items(self.ids, self.words, self.n, flat[order], owner[order], place[order], bloom, words, sizes, short)

    def known_words(self, nos: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many words of each of the items ``nos`` are among ``words``."""
        sizes = self.sizes[nos]
        first = np.cumsum(sizes) - sizes
        at = np.repeat((np.cumsum(self.sizes) - self.sizes)[nos] - first, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(np.isin(self.flat[at], words), first, dtype=np.int64)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions in ``grams`` of those that are in the index."""
        maybe = np.flatnonzero(self.bloom[grams & np.uint64((1 << _FILTER_BITS) - 1)])
        if not len(maybe) or not len(self.grams):
            return maybe[:0]
        at = np.searchsorted(self.grams, grams[maybe])
        return maybe[self.grams[np.minimum(at, len(self.grams) - 1)] == grams[maybe]]


def item_blocks(items: DataFrame, n: int, id_col: str, text_col: str, block_words: int) -> Iterator[Items]:
    """The test items in blocks of about ``block_words`` words, on the driver one at a time. Null
    items and those without words are passed over."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    key = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for b in range(blocks):
        cache: dict[bytes, int] = {}
        same: dict[bytes, list] = {}
        for r in rows.where(key == b).collect():
            same.setdefault(b" ".join(words_of(r["text"].encode())), []).append(r["id"])
        kept = sorted((t, sorted(i, key=lambda x: (x is None, x))) for t, i in same.items() if t)
        yield Items([i for _, i in kept], [word_hashes(t, cache) for t, _ in kept], n).index()


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman with linear gaps: the best local score and the number of ``words`` up to its
    end. Rows are vectors; the chain of gaps along a row is a running maximum."""
    ramp = -GAP * np.arange(len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best = end = 0
    for w in item:
        here = np.zeros(len(words) + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(words == w, MATCH, MISMATCH), above[1:] + GAP)
        here = np.maximum.accumulate(np.maximum(here, 0) + ramp) - ramp
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def shared_words(item: np.ndarray, words: np.ndarray) -> int:
    """The most words that an alignment of the best local score matches: ``align`` over scores that
    carry the count in their low bits."""
    unit = 1 << 24
    ramp = -GAP * unit * np.arange(len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best = 0
    for w in item:
        here = np.zeros(len(words) + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(words == w, MATCH * unit + 1, MISMATCH * unit), above[1:] + GAP * unit)
        above = np.maximum.accumulate(np.maximum(here, 0) + ramp) - ramp
        best = max(best, int(above.max()))
    return best % unit


def least_shared(size, least_words: int):
    """Words that a copy of an item of ``size`` words shares with it at least: half of them and
    ``least_words``, or all of a shorter item."""
    return np.minimum(size, np.maximum(least_words, -(-size // 2)))


def short_matches(words: np.ndarray, items: Items) -> list[tuple[int, float, int, int]]:
    """The first whole copy of each item shorter than an n-gram."""
    out = []
    for size, (whole, nos) in items.short.items():
        grams = gram_hashes(words, size)
        at = np.searchsorted(whole, grams)
        found = np.flatnonzero(whole[np.minimum(at, len(whole) - 1)] == grams)
        _, first = np.unique(grams[found], return_index=True)
        for a in found[first].tolist():
            out.append((int(nos[at[a]]), 1.0, a, a + size))
    return out


def matches(words: np.ndarray, items: Items, least: float, least_words: int) -> list[tuple[int, float, int, int]]:
    """``(item, score, first word, word after the last)`` of the items found in a text, the best
    place of each. The score is the alignment's share of a full match."""
    out = short_matches(words, items)
    grams = gram_hashes(words, items.n)
    at = items.hits(grams)
    if not len(at):
        return out
    lo = np.searchsorted(items.grams, grams[at], side="left")
    hi = np.searchsorted(items.grams, grams[at], side="right")
    where = np.repeat(at, hi - lo)
    entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
    owner, begin = items.owner[entry], where - items.place[entry]
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    nos, first = np.unique(owner, return_index=True)
    ends = np.r_[first[1:], len(owner)]
    known, sizes = items.known_words(nos, words), items.sizes[nos]
    likely = (known / sizes >= least) & (known >= least_shared(sizes, least_words))
    for no, x, y in zip(nos[likely].tolist(), first[likely].tolist(), ends[likely].tolist(), strict=True):
        item = items.words[no]
        size, slack, need = len(item), max(8, len(item) // 2), least_shared(len(item), least_words)
        starts = np.unique(begin[x:y])
        best = (0.0, 0, 0)
        cuts = np.flatnonzero(np.diff(starts) > size + slack) + 1
        for group in np.split(starts, cuts):  # neighbouring seeds share one window
            for a in group.tolist():
                if 0 <= a <= len(words) - size and np.array_equal(words[a : a + size], item):
                    best = (1.0, a, a + size)
                    break
            if best[0] == 1.0:
                break
            a, b = max(0, int(group[0]) - slack), min(len(words), int(group[-1]) + size + slack)
            known = np.isin(item, words[a:b]).sum()
            if known < need or known / size < least:
                continue
            score, end = align(item, words[a:b])
            share = score / (MATCH * size)
            if share >= least and share > best[0]:
                _, back = align(item[::-1], words[a : a + end][::-1])
                if shared_words(item, words[a + end - back : a + end]) >= need:
                    best = (share, a + end - back, a + end)
        if best[0]:
            out.append((no, *best))
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, n: int = 4, least: float = 0.4, least_words: int = 8, block_words: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and test item found in it: ``(doc_id, item_id, score, first_word,
    last_word)``; ``score`` is the alignment's share of a full match, from ``least`` to 1.
    The alignment shares at least half of the item's words and ``least_words`` with it, or all of an
    item of fewer; items shorter than ``n`` words are found where they stand whole and unedited.

    Null and empty texts match nothing; repeated documents each give their rows, and so do repeated
    items; items that are null or hold no words match nothing; other columns are not read;
    without documents or items there are no rows."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    ship(docs.sparkSession)
    for block in item_blocks(items, n, item_id, item_text, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, int] = {}
            for batch in batches:
                got = [
                    (i, item, score, a, b - 1)
                    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True)
                    for no, score, a, b in matches(word_hashes(t.as_py(), cache), block, least, least_words)
                    for item in block.ids[no]
                ]
                if got:
                    cols = zip(*got, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                        ["doc_id", "item_id", "score", "first_word", "last_word"],
                    )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_leaked(
    docs: DataFrame, items: DataFrame, n: int = 4, least: float = 0.4, least_words: int = 8, block_words: int = 1_000_000, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without the rows in which a test item is found; all columns stay. The same decisions
    as ``find_leaks``, taken where each row lies."""
    at = docs.columns.index(text_col)
    name = free_name(docs.columns, "_leaked")
    schema = docs.withColumn(name, F.lit(False)).schema
    out = docs
    ship(docs.sparkSession)
    for block in item_blocks(items, n, item_id, item_text, block_words):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, int] = {}
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                bad = [bool(matches(word_hashes(t.as_py() or b"", cache), block, least, least_words)) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bad)], [*batch.schema.names, name])

        out = out.mapInArrow(run, schema).where(~F.col(name)).drop(name)
    return out
