"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of every order up to ``order`` and a uniform share for unseen words are
mixed; the weights depend on a bucket of the context's frequency (the longest context seen, by powers
of two). One training document in ``deletion`` is taken out ("deleted"): the estimates of the others
are mixed so that the deleted documents become likeliest, by expectation-maximisation. Scores use those
weights with the counts of all training documents.

How it runs. Documents are dealt into blocks (``blocks``); each is stored as one row: its distinct
words and, per token, the word's number. A block's distinct words and n-grams with their counts are
cut into key ranges, as many as the corpus is large, and shuffled once by range; the range's task sums
them and answers each block with the totals, in the order asked, so the way back carries no keys. An
n-gram stands there once a block, so a hot one is spread over the blocks. Words are compared as text;
longer n-grams by 56-bit fingerprints (of 10**9 n-grams one meets another's with probability 1e-8).
Every weight update is one pass over the deleted documents' counts and a small sum.

Nulls: a null text is empty (its only token is the end), a null id is never held out and counts as
training. Repeated rows count each. Without training documents N = V = 0 and every token has
probability 1; without deleted documents the weights stay equal. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.blocks import pack, pack_sorted, split_words, text_blocks, unpack, unpack_sorted
from tidelab.llm.common import drop_path, ship, stored

#: Text per key range, in bytes: what a range's task holds is in proportion.
RANGE_BYTES = 2 << 20
_LEVELS = 64  # powers of two of a context's frequency

_BLOCKS = "block long, ids binary, known_ids binary, lengths binary, flags binary, words array<string>, codes binary"
_PARTS = "range long, block long, words array<string>, train array<binary>, kept array<binary>, grams array<binary>"
_SUMS = (
    "range long, block long, train array<binary>, kept array<binary>, train_tokens long, train_types long, "
    "kept_tokens long, kept_types long"
)
_COUNTS = "ids binary, known_ids binary, lengths binary, flags binary, train array<binary>, kept array<binary>"


def _rows(kinds: str, *columns) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in kinds.split(", ")]
    return pa.RecordBatch.from_arrays(list(columns), names)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a block is large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes half of the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _word_keys(words) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False).astype(np.uint64)


def _gram_keys(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Fingerprints of the n-grams that end at each token, for n = 2 .. ``order``; before a document
    stand start marks. ``words`` are the tokens' fingerprints, ``starts`` the documents' first tokens."""
    with np.errstate(over="ignore"):
        out, last, mark = [], words, np.uint64(0x5851F42D4C957F2D)
        for _ in range(2, order + 1):
            before = np.empty_like(last)
            before[1:] = last[:-1]
            before[starts] = mark
            last = _mix(before * np.uint64(0x2545F4914F6CDD1D) + words)
            mark = _mix(np.array([mark], np.uint64))[0]
            out.append(last >> np.uint64(8))
    return out


def _flagged(docs: DataFrame, held_out: int, parts: int, deletion: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, flag, text)``; flags: 1 held out, 2 training and deleted, 0 training and kept."""
    crc = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(held_out + 1))
    flag = (
        F.when(F.pmod(crc, F.lit(parts)) == held_out, 1)
        .when(F.pmod(F.xxhash64(crc), F.lit(deletion)) == 0, 2).otherwise(0).cast("byte")
    )
    return docs.select(F.col(id_col).cast("long").alias("id"), flag.alias("flag"), F.col(text_col).cast("string").alias("text"))


def _read_blocks(rows: DataFrame, ranges: int) -> DataFrame:
    """One row a block."""
    shift = np.uint64(64 - int(math.log2(ranges)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for a, b in text_blocks(batch.column(2)):
                part = batch.slice(a, b - a)
                words, sizes = split_words(pc.ascii_lower(part.column(2)))
                coded = words.dictionary_encode()
                known = coded.dictionary
                keys = _word_keys(known.to_numpy(zero_copy_only=False))
                place = np.argsort(keys >> shift, kind="stable")  # words numbered range by range
                code = np.empty(len(place), np.int64)
                code[place] = np.arange(len(place))
                tokens = np.full(len(words) + len(sizes), len(place), np.int64)  # the end's number: last
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(sizes + 1) - 1] = False
                tokens[inner] = code[coded.indices.to_numpy()]
                ids = part.column(0)
                one = lambda x: pa.array([x], pa.binary())
                yield _rows(
                    _BLOCKS, pa.array([number], pa.int64()),
                    one(pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes()),
                    one(np.asarray(ids.is_valid(), np.uint8).tobytes()), one(pack(sizes + 1)),
                    one(part.column(1).to_numpy().astype(np.uint8).tobytes()),
                    pa.array([known.take(pa.array(place)).to_pylist()], pa.list_(pa.string())), one(pack(tokens)),
                )
                number += 1

    return rows.mapInArrow(read, _BLOCKS)


def _decode(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, first token of each document, and each token's training and kept marks."""
    tokens, lengths = unpack(row["codes"]).astype(np.int64), unpack(row["lengths"]).astype(np.int64)
    flags = np.repeat(np.frombuffer(row["flags"], np.uint8), lengths)
    return tokens, np.cumsum(lengths) - lengths, (flags != 1), (flags == 0)


def _block_grams(row: dict, order: int):
    """The block's distinct n-grams of each order: ``(keys ascending, place of each token's among
    them)``; order 1 has the words' numbers and no keys."""
    tokens, starts, train, kept = _decode(row)
    end = np.uint64(0x632BE59BD9B4E019)
    fingerprints = np.append(_word_keys(row["words"]), end)
    grams = [np.unique(k, return_inverse=True) for k in _gram_keys(fingerprints[tokens], starts, order)]
    return tokens, starts, train, kept, grams


def _cut(order: int, ranges: int):
    """Task body: a block's words and n-grams with their counts, cut into key ranges."""
    edges = [(r << 56) // ranges for r in range(ranges + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                tokens, _, train, kept, grams = _block_grams(row, order)
                words = row["words"]
                keys = _word_keys(words) >> np.uint64(8)
                bounds = np.array(edges[1:-1], np.uint64)
                at = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]) for k in (keys, *(g[0] for g in grams))]
                place = [tokens, *(g[1] for g in grams)]
                size = [len(words) + 1, *(len(g[0]) for g in grams)]
                n_train = [np.bincount(p[train], minlength=s) for p, s in zip(place, size, strict=True)]
                n_kept = [np.bincount(p[kept], minlength=s) for p, s in zip(place, size, strict=True)]
                out: list[list] = [[], [], [], [], [], []]
                for r in range(ranges):
                    cuts = [slice(int(a[r]), int(a[r + 1])) for a in at]
                    out[0].append(r)
                    out[1].append(row["block"])
                    out[2].append(words[cuts[0]])
                    out[3].append([pack(n[c]) for n, c in zip(n_train, cuts, strict=True)])
                    out[4].append([pack(n[c]) for n, c in zip(n_kept, cuts, strict=True)])
                    out[5].append([pack_sorted(g[0][c]) for g, c in zip(grams, cuts[1:], strict=True)])
                lists = pa.list_(pa.binary())
                yield _rows(
                    _PARTS, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())),
                    *(pa.array(c, lists) for c in out[3:]),
                )

    return cut


def _total(order: int):
    """Task body: sums over a range's parts, handed back to each block in the order it asked."""

    def total(parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        words = pa.array([w for row in rows for w in row["words"]], pa.string()).dictionary_encode()
        places = [words.indices.to_numpy().astype(np.int64)]
        sizes = [[len(row["words"]) for row in rows]]
        types = [len(words.dictionary)]
        for n in range(order - 1):
            lists = [unpack_sorted(row["grams"][n]) for row in rows]
            distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
            places.append(place)
            sizes.append([len(x) for x in lists])
            types.append(len(distinct))
        answers: dict[str, list[list[bytes]]] = {"train": [], "kept": []}
        facts = {}
        for kind, answer in answers.items():
            for n in range(order):
                given = np.concatenate([unpack(row[kind][n]).astype(np.int64) for row in rows])
                sums = np.zeros(types[n], np.int64)
                np.add.at(sums, places[n], given)
                if n == 0:
                    facts |= {f"{kind}_tokens": int(sums.sum()), f"{kind}_types": int((sums > 0).sum())}
                ends = np.cumsum(sizes[n])
                answer.append([pack(x) for x in np.split(sums[places[n]], ends[:-1])])
        first = [1] + [0] * (len(rows) - 1)
        lists = pa.list_(pa.binary())
        return pa.table({
            "range": parts.column("range"), "block": parts.column("block"),
            "train": pa.array([list(x) for x in zip(*answers["train"], strict=True)], lists),
            "kept": pa.array([list(x) for x in zip(*answers["kept"], strict=True)], lists),
        } | {name: pa.array([fact * f for f in first], pa.int64()) for name, fact in facts.items()})

    return total


def _place(order: int, ends: int, kept_ends: int):
    """Task body: per token of a block the corpus counts of the n-grams that end there."""

    def place(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        out: list[dict] = []
        order_of = sums.sort_by("range").select(["train", "kept"]).to_pylist()
        for row in blocks.to_pylist():
            tokens, _, _, _, grams = _block_grams(row, order)
            got = {}
            for kind, end in (("train", ends), ("kept", kept_ends)):
                every = [np.concatenate([unpack(r[kind][n]) for r in order_of]) for n in range(order)]
                every[0] = np.append(every[0], np.uint64(end))
                got[kind] = [pack(e[p]) for e, p in zip(every, (tokens, *(g[1] for g in grams)), strict=True)]
            deleted = np.repeat(np.frombuffer(row["flags"], np.uint8) == 2, unpack(row["lengths"]).astype(np.int64))
            got["kept"] = [pack(unpack(x)[deleted]) for x in got["kept"]]  # used for deleted documents alone
            out.append({k: row[k] for k in ("ids", "known_ids", "lengths", "flags")} | got)
        kinds = pa.schema([(k, pa.binary()) for k in ("ids", "known_ids", "lengths", "flags")]
                          + [(k, pa.list_(pa.binary())) for k in ("train", "kept")])
        return pa.Table.from_pylist(out, kinds)

    return place


def _estimates(counts: list[np.ndarray], starts: np.ndarray, tokens: int, types: int, documents: int):
    """Per token the bucket of its context and the estimates of order 0 (uniform) to the highest; an
    order whose context was never seen has estimate 0 and gets no weight."""
    n = len(counts[0])
    parts = [np.full(n, 1.0 / (types + 1))]
    bucket = np.zeros(n, np.int64)
    for m, count in enumerate(counts, 1):
        if m == 1:
            context = np.full(n, float(tokens))
        else:
            context = np.empty(n)
            context[1:] = counts[m - 2][:-1]
            context[starts] = documents
        seen = context > 0
        parts.append(np.where(seen, count / np.maximum(context, 1.0), 0.0))
        bucket = np.where(seen, m * _LEVELS + np.log2(np.maximum(context, 1.0)).astype(np.int64), bucket)
    return bucket, np.stack(parts, 1)


def _open_weights(order: int) -> np.ndarray:
    """Equal weights over the orders that a bucket's context allows."""
    allowed = np.arange(order + 1)[None, :] <= (np.arange((order + 1) * _LEVELS) // _LEVELS)[:, None]
    return allowed / allowed.sum(1, keepdims=True)


def _learn(counted: DataFrame, order: int, totals: tuple[int, int, int], rounds: int) -> np.ndarray:
    """Expectation-maximisation over the deleted documents. Every allowed order gets one expected
    token beforehand, so no weight comes out zero."""
    weights = _open_weights(order)
    allowed = weights > 0
    deleted = counted.select("lengths", "flags", "kept")

    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(weights)
            for batch in batches:
                for row in _each(batch):
                    counts = [unpack(x).astype(np.float64) for x in row["kept"]]
                    lengths = unpack(row["lengths"]).astype(np.int64)[np.frombuffer(row["flags"], np.uint8) == 2]
                    if not len(lengths):
                        continue
                    bucket, parts = _estimates(counts, np.cumsum(lengths) - lengths, *totals)
                    share = weights[bucket] * parts
                    share /= share.sum(1, keepdims=True)
                    for n in range(order + 1):
                        sums[:, n] += np.bincount(bucket, share[:, n], len(sums))
            b, n = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n), pa.array(sums[b, n])], ["bucket", "part", "expected"])

        got = deleted.mapInArrow(expect, "bucket long, part long, expected double").groupBy("bucket", "part").agg(F.sum("expected").alias("e"))
        sums = allowed.astype(float)
        for row in got.toLocalIterator():
            sums[row["bucket"], row["part"]] += row["e"]
        new = sums / sums.sum(1, keepdims=True)
        moved, weights = float(np.abs(new - weights).max()), new
        if moved < 1e-4:
            break
    return weights


def _score(weights: np.ndarray, facts: tuple[int, int, int]):
    """Task body: the rows of a block's documents."""
    tokens, types, _ = facts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                counts = [unpack(x).astype(np.float64) for x in row["train"]]
                lengths = unpack(row["lengths"]).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                bucket, parts = _estimates(counts, starts, *facts)
                model = np.log10((weights[bucket] * parts).sum(1))
                base = np.log10((counts[0] + 1) / (tokens + (types + 1)))
                flags = np.frombuffer(row["flags"], np.uint8)
                absent = np.frombuffer(row["known_ids"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["ids"], "<i8"), mask=absent), pa.array(flags == 1), pa.array(lengths),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(lengths), tokens, np.int64)),
                        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def score_texts(
    docs: DataFrame, order: int = 2, held_out: int = 2, parts: int = 7, deletion: int = 8, rounds: int = 12,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    Documents with ``crc32(id as text) mod parts = held_out`` are scored only; the others train, one in
    ``deletion`` of them being the deleted ones. ``base_score`` is the add-one unigram score, ``score``
    the interpolated model's log10 probability of the text with its end. ``rounds`` bounds the weight
    updates, which end earlier once no weight moves by 1e-4."""
    spark = docs.sparkSession
    ship(spark)
    rows = _flagged(docs, held_out, parts, deletion, id_col, text_col)
    size = rows.agg(
        F.sum(F.octet_length("text")).alias("text"), F.count_if(F.col("flag") != 1).alias("train"), F.count_if(F.col("flag") == 0).alias("kept")
    ).first()
    ranges = 1 << max(3, math.ceil(math.log2(max(1, (size["text"] or 0) / RANGE_BYTES))))
    blocks, blocks_path = stored(_read_blocks(rows, ranges), "lm-blocks", compression="zstd")
    sums, sums_path = stored(
        blocks.select("block", "lengths", "flags", "words", "codes").mapInArrow(_cut(order, ranges), _PARTS)
        .groupBy("range").applyInArrow(_total(order), _SUMS), "lm-sums", compression="zstd",
    )
    counted, _ = stored(
        blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_place(order, size["train"], size["kept"]), _COUNTS),
        "lm-counts", compression="zstd",
    )
    facts = {}
    told = sums.agg(*(F.sum(f"{kind}_{what}").alias(f"{kind}_{what}") for kind in ("train", "kept") for what in ("tokens", "types"))).first()
    for kind in ("train", "kept"):  # the end is a token too: one a document, and one more type
        facts[kind] = ((told[f"{kind}_tokens"] or 0) + size[kind], (told[f"{kind}_types"] or 0) + (size[kind] > 0), size[kind])
    drop_path(spark, blocks_path)
    drop_path(spark, sums_path)
    weights = _learn(counted, order, facts["kept"], rounds)
    return counted.select("ids", "known_ids", "lengths", "flags", "train").mapInArrow(
        _score(weights, facts["train"]),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
