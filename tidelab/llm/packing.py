"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A gene is a whole bin. Crossover injects well-filled bins of one parent into the other, removes the
bins that hold the same documents again, and best-fits the documents displaced by that; mutation
opens the emptiest bins and best-fits what they held. Islands evolve apart and hand their elite to
the next island between epochs.

At scale the pieces are dealt at random into blocks of a bounded number of pieces, and each block
has its own islands, each a row of a DataFrame, so blocks and islands run on all executors. A block
wastes less than a bin or two of thousands; a second level gathers the bins that stayed short of
full, from all blocks, and packs them anew in blocks of the same bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import drop_path, parallel_slots, ship, stored, utf8
from tidelab.llm.tokens import encoder, slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, tokenizer: str, kind: str = "words", end_id: int = 0, capacity: int = 2048,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, narrow: bool = False,
) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, and cut only what is longer than
    ``capacity`` into pieces of ``capacity`` ids, the last one maybe shorter. One row per piece;
    ``with_ids`` adds the ids (little-endian unsigned 32-bit, or as wide as the encoder's if
    ``narrow``) as ``ids binary``. Repeated rows give
    repeated pieces, a null id stays null, an empty text is the one end id, an empty table gives
    no rows; other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                out = []
                for key, raw in zip(keys[a:b], enc.encode(texts[a:b]), strict=True):
                    ids = np.append(np.frombuffer(raw, enc.dtype), end_id).astype("<u4")
                    for no, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        held = part.astype(enc.dtype) if narrow else part
                        out.append((key, no, at, len(part), zlib.crc32(part.tobytes()), held.tobytes() if with_ids else None))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


class _Bins:
    """Open bins by room left, for best fit: a bit per room value that some bin has."""

    def __init__(self, rooms: np.ndarray):
        self.by_room: dict[int, list[int]] = {}
        self.bits = 0
        self.count = len(rooms)
        for b, room in enumerate(rooms.tolist()):
            self._put(b, room)

    def _put(self, b: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.bits |= 1 << room

    def place(self, size: int, capacity: int) -> int:
        """The bin with least room that fits ``size``, or a new one."""
        fits = self.bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = self.by_room[room]
            b = held.pop()
            if not held:
                self.bits &= ~(1 << room)
        else:
            b, room = self.count, capacity
            self.count += 1
        self._put(b, room - size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, bin_of: np.ndarray, rooms: np.ndarray, capacity: int) -> np.ndarray:
    """Place the items of ``order`` one by one; ``bin_of`` and ``rooms`` describe what is placed."""
    bins = _Bins(rooms)
    out = bin_of.copy()
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[i] = bins.place(size, capacity)
    return out


def fills(sizes: np.ndarray, bin_of: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=sizes).astype(np.int64)


def fitness(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> float:
    """Mean square of the bins' filling: fewer bins, and fuller ones, score higher."""
    f = fills(sizes, bin_of) / capacity
    return float((f * f).sum() / len(f))


def _again(sizes, bin_of, gone: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Empty the bins flagged in ``gone`` and best-fit what they held, largest first."""
    used = fills(sizes, bin_of)
    number = np.cumsum(~gone) - 1
    freed = gone[bin_of]
    kept = np.where(freed, -1, number[bin_of])
    loose = np.flatnonzero(freed)
    loose = loose[np.argsort(-(sizes[loose] + rng.random(len(loose)) * 0.9), kind="stable")]
    return best_fit(sizes, loose, kept, capacity - used[~gone], capacity)


def crossover(sizes, ours: np.ndarray, theirs: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject a random part of the well-filled bins of ``theirs`` into ``ours``."""
    filled = fills(sizes, theirs)
    good = np.flatnonzero(filled >= np.quantile(filled, 0.25))
    take = np.zeros(len(filled), bool)
    take[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.6))), replace=False)] = True
    injected = take[theirs]
    n_ours = int(ours.max()) + 1
    hit = np.zeros(n_ours, bool)
    hit[ours[injected]] = True  # bins that hold an injected document again
    displaced = hit[ours] & ~injected
    number = np.cumsum(~hit) - 1
    base = int((~hit).sum())
    inner = np.cumsum(take) - 1
    bin_of = np.where(injected, base + inner[theirs], np.where(displaced, -1, number[ours]))
    rooms = np.concatenate([capacity - fills(sizes, ours)[~hit], capacity - filled[take]])
    loose = np.flatnonzero(displaced)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    return best_fit(sizes, loose, bin_of, rooms, capacity)


def mutate(sizes, bin_of: np.ndarray, capacity: int, rng) -> np.ndarray:
    f = fills(sizes, bin_of)
    gone = np.zeros(len(f), bool)
    gone[np.argsort(f, kind="stable")[: max(2, len(f) // 50)]] = True
    gone[rng.random(len(f)) < 0.02] = True
    return _again(sizes, bin_of, gone, capacity, rng)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on bins: by total, and by pairs that cannot share (larger than half)."""
    big = np.sort(sizes[2 * sizes > capacity])
    bound = -(-int(sizes.sum()) // capacity)
    for t in np.unique(sizes[2 * sizes <= capacity])[:64].tolist():
        wide = big > capacity - t
        mid = sizes[(sizes >= t) & (sizes <= capacity - t)]
        bound = max(bound, int(wide.sum()) + -(-int(mid.sum()) // capacity))
    return max(bound, len(big))


def evolve(sizes: np.ndarray, members: list[np.ndarray], capacity: int, population: int, generations: int, seed: int):
    """One epoch of one island: the members, best first. Ends early when the lower bound is met."""
    rng = np.random.default_rng(seed)
    floor = least_bins(sizes, capacity)
    none, no_room = np.full(len(sizes), -1), np.zeros(0, np.int64)
    pool = [np.asarray(m) for m in members]
    score = lambda m: fitness(sizes, m, capacity)
    if not pool:
        first = best_fit(sizes, np.argsort(-sizes, kind="stable"), none, no_room, capacity)
        pool = [first]
    pool.sort(key=score, reverse=True)
    if int(pool[0].max()) + 1 <= floor:
        return pool[:1]
    while len(pool) < population:
        noisy = sizes * (1 + rng.uniform(-0.15, 0.15, len(sizes)))
        pool.append(best_fit(sizes, np.argsort(-noisy, kind="stable"), none, no_room, capacity))
    pool.sort(key=score, reverse=True)
    for _ in range(generations):
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(sizes, pool[min(a, b)], pool[max(a, b)], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(sizes, child, capacity, rng)
        if score(child) > score(pool[-1]):
            pool[-1] = child
            pool.sort(key=score, reverse=True)
        if int(pool[0].max()) + 1 <= floor:
            break
    return pool


_STATE = "block long, island int, sizes array<int>, members array<array<long>>"


def _epoch(state: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes = np.asarray(row.sizes, np.int64)
                members = [np.unique(np.asarray(m), return_inverse=True)[1] for m in row.members]
                seed = zlib.crc32(f"{row.block}:{row.island}:{epoch}".encode())
                pool = evolve(sizes, members, capacity, population, generations, seed)
                yield pd.DataFrame(
                    {"block": [row.block], "island": [row.island], "sizes": [row.sizes],
                     "members": [[m.astype(np.int64) for m in pool[:2]]]}
                )

    return state.mapInPandas(run, _STATE)


def _lay_out(best: DataFrame) -> DataFrame:
    """Where each item begins in its bin, and how full the bin is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            offsets, filled = [], []
            for sizes, bins in zip(frame["sizes"], frame["bins"], strict=True):
                sizes, bins = np.asarray(sizes, np.int64), np.asarray(bins)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                heads = np.r_[True, bins[order][1:] != bins[order][:-1]]
                begin = (ends - sizes[order])
                at = np.empty(len(sizes), np.int64)
                at[order] = begin - np.maximum.accumulate(np.where(heads, begin, 0))
                offsets.append(at)
                filled.append(fills(sizes, bins)[bins])
            yield pd.DataFrame({"block": frame["block"], "bins": frame["bins"], "offsets": offsets, "filled": filled})

    return best.mapInPandas(run, "block long, bins array<long>, offsets array<long>, filled array<long>")


def pack_blocks(
    items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int, tag: int,
) -> DataFrame:
    """Pack ``items(block, bin, length, ...)`` block by block; ``bin`` is null, or the sequence the
    item is in so far, which then seeds every island. Returns the columns but ``block`` and ``bin``
    with ``sequence_id``, ``offset`` and ``filled`` (ids in the sequence). Whoever assigns the
    blocks bounds them: a block is one row, worked on in one task."""
    spark = items.sparkSession
    cols = [c for c in items.columns if c != "block"]
    n = parallel_slots(spark)
    blocks, _ = stored(items.groupBy("block").agg(F.collect_list(F.struct(*cols)).alias("items")), "packing-blocks")
    state = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)).cast("array<int>")).alias("island"),
        F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"),
        F.when(
            F.forall("items", lambda x: x["bin"].isNotNull()), F.array(F.transform("items", lambda x: x["bin"]))
        ).otherwise(F.expr("cast(array() as array<array<bigint>>)")).alias("members"),
    ).repartition(n, "block", "island")
    for epoch in range(epochs):
        if epoch:  # the elite of an island joins the next one
            elite = state.select(
                "block", ((F.col("island") + 1) % islands).cast("int").alias("island"),
                F.slice("members", 1, 1).alias("guest"),
            )
            state = (
                state.join(elite, ["block", "island"])
                .select("block", "island", "sizes", F.concat("members", "guest").alias("members"))
                .repartition(n, "block", "island")
            )
        state, _ = stored(_epoch(state, capacity, population, generations, epoch), "packing-state")
    elite = state.select("block", "sizes", F.col("members")[0].alias("bins"), F.array_max(F.col("members")[0]).alias("top"), "island")
    best = elite.groupBy("block").agg(
        F.min_by("bins", F.struct("top", "island")).alias("bins"), F.any_value("sizes").alias("sizes")
    )
    laid = _lay_out(best)
    rows = blocks.join(laid, "block").select(
        "block", F.explode(F.arrays_zip("items", "bins", "offsets", "filled")).alias("z")
    )
    return rows.select(
        *[F.col("z.items")[c].alias(c) for c in cols if c != "bin"],
        (((F.col("block") * (1 << 24)) + F.col("z.bins")) * 4 + tag).alias("sequence_id"),
        F.col("z.offsets").alias("offset"), F.col("z.filled").alias("filled"),
    )


def pack(
    pieces: DataFrame, capacity: int = 2048, block_pieces: int = 4096, islands: int = 3, epochs: int = 2,
    population: int = 4, generations: int = 10, near_full: float = 0.985,
) -> DataFrame:
    """Give every row of ``pieces`` (with ``length`` from 1 to ``capacity``) a ``sequence_id`` and a
    gapless ``offset``. Blocks hold about ``block_pieces`` rows however large the table or its hot
    keys are, as rows are dealt to blocks at random. All other columns stay, whatever their names:
    those that clash with the three made here are rejected. An empty table gives no rows."""
    clash = {"sequence_id", "offset", "filled", "block", "bin"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"columns in use by packing: {sorted(clash)}")
    kept, _ = stored(pieces, "pieces")
    n = _blocks(kept.where(F.col("length") < capacity).count(), block_pieces)
    block = F.floor(F.rand(29) * n).cast("long")
    return _placed(kept, block, n, capacity, block_pieces, islands, epochs, population, generations, near_full)


def _blocks(pieces: int, block_pieces: int) -> int:
    return max(1, -(-pieces // block_pieces))


def _placed(
    kept: DataFrame, block: Column, n: int, capacity: int = 2048, block_pieces: int = 4096, islands: int = 3,
    epochs: int = 2, population: int = 4, generations: int = 10, near_full: float = 0.985,
) -> DataFrame:
    """The two levels of ``pack``: the rows of ``kept`` below ``capacity`` go to the ``n`` blocks that
    ``block`` names. ``sequence_id`` mod 4 tells the level: 1 a block's own, 2 packed across blocks, 3 whole."""
    cols = kept.columns
    whole = kept.where(F.col("length") >= capacity).select(
        *cols, (F.monotonically_increasing_id() * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    first = pack_blocks(
        kept.where(F.col("length") < capacity).select(*cols, F.lit(None).cast("long").alias("bin"), block.alias("block")),
        capacity, islands, epochs, population, generations, 1,
    )
    if n == 1:
        return whole.unionByName(first.select(*cols, "sequence_id", "offset"))
    first, _ = stored(first, "packed")
    full = F.col("filled") >= int(capacity * near_full)
    short = first.where(~full)
    m = _blocks(short.count(), block_pieces)
    again = pack_blocks(
        short.select(
            *cols, F.col("sequence_id").alias("bin"), F.pmod(F.xxhash64("sequence_id"), F.lit(m)).alias("block")
        ),
        capacity, islands, epochs, population, generations, 2,
    )
    out = ["sequence_id", "offset"]
    return whole.unionByName(first.where(full).select(*cols, *out)).unionByName(again.select(*cols, *out))


def _join_ids(names: list[str]):
    """Task body: a block's pieces with their places, sequence by sequence, ids widened to 32 bits."""

    def join(pieces: pa.Table, placed: pa.Table) -> pa.Table:
        by_row = lambda t: t.take(pc.sort_indices(t.column("row")))
        pieces, placed = by_row(pieces), by_row(placed)
        for name in ("sequence_id", "offset"):
            pieces = pieces.append_column(name, placed.column(name))
        pieces = pieces.select(names).sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        raw = pieces.column("ids").cast(pa.large_binary()).combine_chunks()
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        width = int(ends[-1] - ends[0]) // pc.sum(pieces.column("length")).as_py()
        ids = np.frombuffer(raw.buffers()[2], f"<u{width}", count=int(ends[-1] - ends[0]) // width, offset=int(ends[0]))
        ends = ((ends - ends[0]) // width * 4).astype(np.int32)
        wide = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
        return pieces.set_column(names.index("ids"), "ids", wide)

    return join


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, block_pieces: int = 4096) -> DataFrame:
    """Documents to packed sequences, in shared storage: a row per piece as ``cut_pieces`` gives them,
    with ``ids``, ``sequence_id`` and ``offset``. The rows of a sequence lie together in one file, in
    the order of their offsets, so that their ids in a row are the sequence. Pieces are packed by
    their lengths alone; the ids join the placements by a number of their own, as document ids
    may repeat or be null.

    That number deals the pieces to the blocks too, so the ids are shuffled once, to their block, where
    the sequences it filled come together. Only the pieces of the sequences packed across blocks are
    shuffled again."""
    spark = docs.sparkSession
    cut = cut_pieces(docs, tokenizer, capacity=capacity, with_ids=True, narrow=True)
    pieces, path = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces-with-ids", compression="zstd")
    told = pieces.agg(F.count_if(F.col("length") < capacity).alias("rest"), F.count_if(F.col("length") >= capacity).alias("whole")).first()
    n, n_whole = (_blocks(told[k], block_pieces) for k in ("rest", "whole"))
    deal = lambda count: F.pmod(F.xxhash64("row"), F.lit(count))
    placed, placed_path = stored(_placed(pieces.select("row", "length"), deal(n), n, capacity, block_pieces), "placed")
    block = F.when(F.col("length") < capacity, deal(n)).otherwise(deal(n_whole) + n).alias("key")
    names = [c for c in pieces.columns if c != "row"]
    out = [*names, "sequence_id", "offset"]
    kinds = f"{PIECE_SCHEMA}, ids binary, sequence_id long, offset long"
    sequences, _ = stored(
        pieces.select(block, *pieces.columns).groupBy("key")
        .cogroup(placed.select(block, "row", "sequence_id", "offset").groupBy("key"))
        .applyInArrow(_join_ids(out), kinds),
        "sequences", compression="zstd",
    )
    drop_path(spark, path)
    drop_path(spark, placed_path)
    if n == 1:
        return sequences
    level = F.pmod(F.col("sequence_id"), F.lit(4))
    across, _ = stored(
        sequences.where(level == 2).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset"),
        "sequences-across", compression="zstd",
    )
    return sequences.where(level != 2).unionByName(across)
