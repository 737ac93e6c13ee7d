"""SimHash near-duplicates, found exactly with vantage-point trees over Hamming distance.

A tree node holds a vantage fingerprint and rings: the rows by their distance to it, taken over the
bits of the node's mask. By the triangle bound two fingerprints that differ in ``k`` bits of a mask
lie at most ``k`` rings apart; masks of one level after another share no bits, so a pair within
``radius`` bits spends at most ``radius`` rings over all levels together. Whole 64-bit distances lie
so close together that one ring bound prunes little; several masks, with one budget, prune well.

The top levels are the shards: each distinct fingerprint has one home cell (its ring at each level)
and is sent as a visitor to those cells, among the ones in use, that the budget reaches and that come
after its own, so every pair meets in exactly one cell. Cells that hold a large group of copies
are cut into tiles (home rows by visitors) of bounded size. Inside a tile a task goes on down the
tree, on finer masks, and compares what is left bit by bit. Nothing is capped: the pairs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import components, free_name, local_forest, parallel_slots, ship, stored, utf8

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the word shingles of ``text`` (UTF-8): XXH64 with seed 42, a bit is set if it is
    set in over half of the shingles, repeats included. Zero for a text without words."""
    from xxhash import xxh64_intdigest

    w = text.translate(LOWER).split()
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= words:
        return xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n = len(w) - words + 1
    hashes = np.fromiter(
        (xxh64_intdigest(flat[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[words - 1 :].tolist(), strict=True)),
        np.uint64, n,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; null texts count as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = utf8(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def even_masks(parts: int) -> list[int]:
    """64 bits cut into ``parts`` masks of neighbouring bits, as even as can be."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_pairs(
    home: np.ndarray, visitors: np.ndarray, radius: int, vantage: int, masks: list[int], level: int = 0,
    budget: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (home, visitor) of at most ``radius`` differing bits, going down the tree while it
    pays: each level deals the home rows to rings and admits a visitor to the rings its remaining
    budget reaches."""
    if not len(home) or not len(visitors):
        return
    if budget is None:
        budget = np.full(len(visitors), radius, np.int64)
    if level == len(masks) or len(home) * len(visitors) <= 1 << 16 or len(home) < 32:
        rows = max(1, (1 << 20) // len(visitors))
        for at in range(0, len(home), rows):
            block = home[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(block[:, None] ^ visitors[None, :]) <= radius)
            if len(i):
                yield block[i], visitors[j]
        return
    mask, v = np.uint64(masks[level]), np.uint64(vantage)
    mine = np.bitwise_count((home ^ v) & mask).astype(np.int64)
    theirs = np.bitwise_count((visitors ^ v) & mask).astype(np.int64)
    for ring in np.unique(mine).tolist():
        left = budget - np.abs(theirs - ring)
        go = left >= 0
        yield from close_pairs(home[mine == ring], visitors[go], radius, vantage, masks, level + 1, left[go])


def _join_tiles(frame: pd.DataFrame, radius: int, vantage: int) -> pd.DataFrame:
    """Links within the tiles of a frame, thinned to a spanning forest per tile."""
    masks = even_masks(8)
    out_a, out_b = [], []
    keys = frame[["cell", "row", "col"]].to_numpy()
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    keys, fp = keys[order], frame["fp"].to_numpy()[order].view(np.uint64)
    guest = frame["guest"].to_numpy()[order]
    cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        home, visitors = fp[a:b][~guest[a:b]], fp[a:b][guest[a:b]]
        if keys[a, 2] == 0:  # the first column of a row of tiles also pairs the home rows
            visitors = np.concatenate([visitors, home])
        got: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x, y in close_pairs(home, visitors, radius, vantage, masks):
            keep = x != y
            got.append((x[keep], y[keep]))
            size += int(keep.sum())
            if size > 1 << 20:
                got = [local_forest(*(np.concatenate(c) for c in zip(*got, strict=True)))]
                size = 0
        if got:
            x, y = local_forest(*(np.concatenate(c) for c in zip(*got, strict=True)))
            out_a.append(x)
            out_b.append(y)
    none = np.zeros(0, np.uint64)
    return pd.DataFrame(
        {"a": np.concatenate([none, *out_a]).view(np.int64), "b": np.concatenate([none, *out_b]).view(np.int64)}
    )


def near_pairs(prints: DataFrame, radius: int = 3, levels: int = 3, tile: int = 16384) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``prints(fp long)`` that connect exactly
    what pairs within ``radius`` bits connect (a forest of true links' components per tile)."""
    spark = prints.sparkSession
    first = prints.agg(F.min_by("fp", F.xxhash64("fp"))).first()[0]
    vantage = (first or 0) & (1 << 64) - 1
    masks = even_masks(levels)
    rings = [F.bit_count((F.col("fp").bitwiseXOR(F.lit(_signed(vantage)))).bitwiseAND(F.lit(_signed(m)))) for m in masks]
    number = lambda cols: sum((c.cast("long") * (128 ** (levels - 1 - i)) for i, c in enumerate(cols)), F.lit(0).cast("long"))
    homes = prints.select("fp", *[r.alias(f"r{i}") for i, r in enumerate(rings)])
    homes = homes.withColumn("cell", number([F.col(f"r{i}") for i in range(levels)]))
    # At most 23^3 cells for three levels, whatever the data: safe to broadcast.
    cells = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.ceil(F.col("n") / tile))
    steps = [
        d for d in product(range(-radius, radius + 1), repeat=levels)
        if sum(map(abs, d)) <= radius and d > (0,) * levels
    ]
    inside = [
        F.array(*[F.struct(*[(F.col(f"r{i}") + d[i]).alias(f"r{i}") for i in range(levels)]) for d in steps])
    ][0]
    visits = homes.select("fp", F.explode(inside).alias("at"))
    for i, m in enumerate(masks):
        visits = visits.where(F.col(f"at.r{i}").between(0, bin(m).count("1")))
    visits = visits.select("fp", number([F.col(f"at.r{i}") for i in range(levels)]).alias("cell"))
    guests = visits.join(F.broadcast(cells.select("cell", "rows")), "cell")
    counts = guests.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    grid = cells.join(counts, "cell", "left").select(
        "cell", "rows", F.greatest(F.lit(1), F.ceil(F.coalesce("m", F.lit(0)) / (4 * tile))).alias("cols")
    )
    grid, _ = stored(grid, "vantage-grid")
    grid = F.broadcast(grid)
    mine = homes.select("fp", "cell").join(grid, "cell").withColumn("row", F.pmod(F.xxhash64("fp", F.lit(1)), "rows"))
    home_rows = mine.select(
        "cell", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("col"), "fp", F.lit(False).alias("guest")
    )
    own_guests = mine.where(F.col("row") + 1 < F.col("rows")).select(
        "cell", F.explode(F.sequence(F.col("row") + 1, F.col("rows") - 1)).alias("row"),
        F.pmod(F.xxhash64("fp", F.lit(2)), "cols").alias("col"), "fp", F.lit(True).alias("guest"),
    )
    far_guests = visits.join(grid, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"),
        F.pmod(F.xxhash64("fp", F.lit(2)), "cols").alias("col"), "fp", F.lit(True).alias("guest"),
    )
    tiles = home_rows.unionByName(own_guests).unionByName(far_guests)
    units = parallel_slots(spark) * 4
    ship(spark)
    return (
        tiles.withColumn("unit", F.pmod(F.xxhash64("cell", "row", "col"), F.lit(units)))
        .groupBy("unit")
        .applyInPandas(lambda f: _join_tiles(f, radius, vantage), "a long, b long")
    )


def grouped(docs: DataFrame, words: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` for every row; ``root`` is the smallest
    fingerprint of a component, which names it even where no row of it has an id."""
    rows, _ = stored(with_fingerprint(docs, words, id_col, text_col), "fingerprints")
    classes, _ = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_pairs(classes.select("fp"), radius))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id)``, the fingerprint as 16
    hex digits and the component as the smallest doc_id reachable over links of at most ``radius``
    bits, itself included.

    Null and empty texts have fingerprint zero and link like any other; equal fingerprints link, so
    repeated rows share a component; a null id is passed over when the smallest is taken (null only
    if its whole component has none); other columns are not read; an empty table gives no rows."""
    return grouped(docs, words, radius, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each group: one with the group's smallest id, of several such rows
    the one whose text has the smallest hash, of rows that repeat id and text one. A group without any
    id leaves one row too. All columns stay.

    The texts are shuffled once, to meet the chosen ids and hashes; only rows that repeat, if there
    are any, are aggregated after that."""
    key, hash_ = free_name(docs.columns, "_id"), free_name(docs.columns, "_hash")
    first = (
        grouped(docs, words, radius, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", F.col("doc_id").alias(key), F.col("text_hash").alias(hash_)).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("root", key).agg(F.min_by("n", hash_).alias("n"), F.min(hash_).alias(hash_))
    )
    chosen, _ = stored(first, "chosen")
    own_key, own_hash = free_name([*docs.columns, key, hash_], "_own_id"), free_name([*docs.columns, key, hash_], "_own_hash")
    tagged = docs.withColumns({own_key: F.col(id_col).cast("long"), own_hash: F.xxhash64(utf8(text_col))})

    def meet(ids: DataFrame) -> DataFrame:
        same = F.col(own_key).eqNullSafe(F.col(key)) & (F.col(own_hash) == F.col(hash_))
        # The same plan at every size: both sides are shuffled, the texts are not sorted.
        return tagged.join(ids.select(key, hash_).hint("shuffle_hash"), same, "left_semi")

    kept = meet(chosen.where("n = 1"))
    repeated = chosen.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(meet(repeated).dropDuplicates([own_key, own_hash]))
    return kept.select(*docs.columns)
