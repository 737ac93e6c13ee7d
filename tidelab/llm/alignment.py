"""Cross-tokenizer alignment: where the tokens of two tokenizers cover the same bytes.

Side A encodes blank + text with a byte-level vocabulary, side B the text with a piece vocabulary that
puts the blank itself. Per batch the tokens of all documents stand in two pandas tables keyed by
document and byte offset, and two ``merge_asof`` joins find for each token start the token of the other
side that covers it. Both directions together are all overlaps. Where a token starts exactly with its
covering token, both sides ended a token before it: there the groups are cut.

Links are all A-B pairs of tokens inside a group. An id pair's count is the number of documents that hold
it linked; pairs are counted once a block of documents, summed by Spark, and answered to the blocks.

Both vocabularies split at blanks and line ends before merging, so texts with plain single blanks are
encoded word by word, each distinct word once a worker as long as a bounded table holds it (``Aligned
words``); other texts are encoded whole. Null and empty texts, and texts whose joined token bytes differ from
blank + text on either side, have no tokens: zeros and an empty digest. Repeated rows are documents
each. Very long groups (no common cut) are linked by distinct ids and their counts instead of one by
one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelab.llm.blocks import pack, text_blocks, unpack
from tidelab.llm.common import ship, stored

_SPACE = r"[\s\x0b\x1c-\x1f\x85\pZ]"
_ODD = rf"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|\r"
_LONG_GROUP = 1 << 12  # links of a group that are still written out one by one
_STEP = 2 << 20  # bytes of text aligned in one table
#: How the byte-level vocabulary shows each byte as a letter.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_STORED = (
    "kind byte, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, a int, b int, place int, documents long"
)
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NAMES = [c.split(" ")[0] for c in _STORED.split(", ")]


class TwoSides:
    """Both encoders, their tokens' bytes by id, and a bounded table of words already encoded."""

    def __init__(self, byte_path: str, piece_path: str, capacity: int = 500_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {chr(c): c for c in _SHOWN} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
        shown = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [
            bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
            for t in (shown.get(i, "") for i in range(max(shown) + 1))
        ]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.blank = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        free = [c for c in ",." if not any(c in p and p.strip("▁") != c and not self.b.is_byte(i) for i, p in enumerate(pieces) if any(map(str.isalpha, p)))]
        self.signs = {
            c: (array("H", self.a.encode(c, add_special_tokens=False).ids).tobytes(), array("H", [self.b.piece_to_id(c)]).tobytes())
            for c in free
        }
        self.capacity, self.words = capacity, {}
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids")

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of blank + text and of the text, as native 32-bit numbers."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        return [(array("I", x.ids).tobytes(), array("I", y).tobytes()) for x, y in zip(a, b, strict=True)]

    def _spell(self, side: int, ids) -> bytes:
        known = (self.a_bytes, self.b_bytes)[side]
        return b"".join([known[i] for i in ids])

    def _learn(self, words: list[str]) -> None:
        """A word is encoded behind a blank; one that begins with a line end stands without it, and
        the blank that side B puts is then a token of its own, taken off. Kept: the number of A's ids
        (255: the tokens do not spell the word), then both sides' ids in 16 bits."""
        shown = [w if w[:1] == "\n" else " " + w for w in words]
        a = [x.ids for x in self.a.encode_batch_fast(shown, add_special_tokens=False)]
        b = self.b.encode(words, num_threads=1)
        b = [y[1:] if w[:1] == "\n" and y[:1] == [self.blank] else y for w, y in zip(words, b, strict=True)]
        want = [w.encode() for w in shown]
        right = self._right(a, b, want)
        for w, x, y, ok in zip(words, a, b, right, strict=True):
            if ok and len(x) < 255:
                self.words[w] = bytes((len(x),)) + array("H", x).tobytes() + array("H", y).tobytes()
            else:
                self.words[w] = b"\xff"

    def _right(self, a: list, b: list, want: list[bytes]) -> list[bool]:
        """Whether both sides' tokens spell each text: all at once, one by one where that fails."""
        sizes = np.array([len(w) for w in want])
        every = True
        for side, ids in enumerate((a, b)):
            flat = [i for x in ids for i in x]
            size = (self.a_size, self.b_size)[side][np.array(flat, np.int64)]
            owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            every = every and bool((np.bincount(owner, size, len(ids)) == sizes).all()) and self._spell(side, flat) == b"".join(want)
        if every:
            return [True] * len(want)
        return [self._spell(0, x) == w and self._spell(1, y) == w for x, y, w in zip(a, b, want, strict=True)]

    def _look_up(self, words: list[str]) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Both sides' ids of each word and whether they spell it. A sign at the end of a word of
        letters is looked up by itself where neither vocabulary joins it to letters."""
        signs = self.signs
        bases = [w[:-1] if w[-1:] in signs and w[:-1].lstrip("\n").isalpha() else w for w in words]
        if len(self.words) > self.capacity:  # the longer words come back least
            for longest in range(12, -1, -1):
                self.words = {w: x for w, x in self.words.items() if len(w) <= longest}
                if len(self.words) <= self.capacity * 3 // 4:
                    break
        self._learn(list(set(bases).difference(self.words)))
        a, b, right = [], [], []
        for w, base in zip(words, bases, strict=True):
            got = self.words[base]
            n = got[0]
            if n == 255:
                right.append(False)
                a.append(b"")
                b.append(b"")
                continue
            right.append(True)
            cut = 1 + 2 * n
            if len(base) != len(w):
                x, y = signs[w[-1]]
                a.append(got[1:cut] + x)
                b.append(got[cut:] + y)
            else:
                a.append(got[1:cut])
                b.append(got[cut:])
        return a, b, np.array(right, bool)

    def encode(self, texts: pa.Array):
        """``(ids of A, number of each text's, ids of B, number of each text's)``, all texts' ids end
        to end; texts without tokens have none."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        units = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd & filled)), "\n", " \n"), " ")
        owner = np.repeat(np.flatnonzero(~odd & filled), pc.list_value_length(units).to_numpy(zero_copy_only=False))
        coded = units.flatten().dictionary_encode()
        places = coded.indices
        *known, right = self._look_up(coded.dictionary.to_pylist())
        # A text with a word that is not spelled, and every odd text, is encoded whole.
        alone = odd & filled
        alone[owner[~right[places.to_numpy()]]] = True
        lone = np.flatnonzero(alone)
        strings = texts.take(pa.array(lone)).to_pylist()
        wholes = ([x.ids for x in self.a.encode_batch_fast([" " + t for t in strings], add_special_tokens=False)], self.b.encode(strings, num_threads=1))
        good = filled.copy()
        good[lone] = self._right(*wholes, [b" " + t.encode() for t in strings])
        out = []
        for side in (0, 1):
            ids = pa.array(known[side], pa.binary()).take(places)
            size = pc.binary_length(ids).to_numpy(zero_copy_only=False) // 2
            per_text = np.bincount(owner, size, n).astype(np.int64)
            flat = np.frombuffer(ids.buffers()[2] or b"", np.uint16, int(size.sum())).astype(np.int64)
            if len(lone):
                pieces = np.split(flat, np.cumsum(per_text)[:-1])
                for i, whole in zip(lone.tolist(), wholes[side], strict=True):
                    pieces[i] = np.array(whole, np.int64)
                per_text = np.array([len(x) if ok else 0 for x, ok in zip(pieces, good.tolist(), strict=True)])
                flat = np.concatenate([x for x, ok in zip(pieces, good.tolist(), strict=True) if ok] or [flat[:0]])
            out += [flat, per_text]
        return out


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray):
    """For each token start the token of the other side that covers it, keyed by document:
    ``(for each A token its B token, for each B token its A token)``. Starts ascend over all documents."""
    a = pd.DataFrame({"start": start_a, "doc": doc_a, "own": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "doc": doc_b, "other": np.arange(len(start_b))})
    to_b = pd.merge_asof(a, b, on="start", by="doc")["other"].to_numpy()
    to_a = pd.merge_asof(b, a, on="start", by="doc")["own"].to_numpy()
    return to_b.astype(np.int64), to_a.astype(np.int64)


def groups(start_a: np.ndarray, start_b: np.ndarray, to_b: np.ndarray, to_a: np.ndarray):
    """Group numbers of A's and B's tokens, counted over all documents of the tables."""
    cut = start_b[to_b] == start_a
    group_a = np.cumsum(cut) - 1
    return group_a, group_a[to_a]


def links(group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
    """``(group, a id, b id, times)`` of the pairs of tokens that share a group."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_b = np.cumsum(in_b) - in_b
    long = in_a * in_b > _LONG_GROUP
    at = np.flatnonzero(~long[group_a]) if long.any() else np.arange(len(group_a))
    reach = in_b[group_a[at]]
    left = np.repeat(at, reach)
    right = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first_b[group_a[at]], reach)
    out = [(group_a[left], ids_a[left], ids_b[right], np.ones(len(left), np.int64))]
    for g in np.flatnonzero(long).tolist():
        x, nx = np.unique(ids_a[np.searchsorted(group_a, g) : np.searchsorted(group_a, g, "right")], return_counts=True)
        y, ny = np.unique(ids_b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)), in_a, in_b


def spell(sides: TwoSides, ids_a, ids_b, group_a, group_b, in_a, in_b) -> np.ndarray:
    """Decimal ids with the sign that follows each, in the order ``a1,a2|b1;a3|b2,b3;``."""
    both = in_a + in_b
    first = np.cumsum(both) - both
    at_a = np.arange(len(ids_a)) - (np.cumsum(in_a) - in_a)[group_a]
    at_b = np.arange(len(ids_b)) - (np.cumsum(in_b) - in_b)[group_b]
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    out[first[group_a] + at_a] = sides.decimal[ids_a * 3 + (at_a == in_a[group_a] - 1)]
    out[first[group_b] + in_a[group_b] + at_b] = sides.decimal[ids_b * 3 + 2 * (at_b == in_b[group_b] - 1)]
    return out


_made: dict[tuple, TwoSides] = {}


def _sides(byte_path: str, piece_path: str) -> TwoSides:
    """One pair of encoders a worker process."""
    key = (byte_path, piece_path)
    if key not in _made:
        _made.clear()
        made = _made[key] = TwoSides(byte_path, piece_path)
        most = max(len(made.a_bytes), len(made.b_bytes))
        made.decimal = np.array([f"{i}{sign}" for i in range(most) for sign in ",|;"], dtype=object)
    return _made[key]


def align_batch(sides: TwoSides, texts: pa.Array):
    """Align texts. Returns per text ``(n_a, n_b, n_groups, n_links)``, the written groups (``None``:
    without tokens), and the links as ``(text, a id, b id, times)``."""
    n = len(texts)
    ids_a, size_a, ids_b, size_b = sides.encode(pc.fill_null(texts, ""))
    facts = np.zeros((n, 4), np.int64)
    written: list[str | None] = [None] * n
    if not len(ids_a):
        return facts, written, (np.zeros(0, np.int64),) * 4
    doc_a, doc_b = np.repeat(np.arange(n), size_a), np.repeat(np.arange(n), size_b)
    bytes_a, bytes_b = sides.a_size[ids_a], sides.b_size[ids_b]
    start_a, start_b = np.cumsum(bytes_a) - bytes_a, np.cumsum(bytes_b) - bytes_b
    group_a, group_b = groups(start_a, start_b, *overlaps(doc_a, start_a, doc_b, start_b))
    (g, a, b, times), in_a, in_b = links(group_a, group_b, ids_a, ids_b)
    parts = spell(sides, ids_a, ids_b, group_a, group_b, in_a, in_b)
    owner = np.empty(len(in_a), np.int64)
    owner[group_a] = doc_a
    ends = np.cumsum(size_a + size_b).tolist()
    for i in np.flatnonzero(size_a).tolist():
        written[i] = "".join(parts[(ends[i - 1] if i else 0) : ends[i]].tolist())[:-1]
    facts[:, 0], facts[:, 1] = size_a, size_b
    facts[:, 2] = np.bincount(owner, minlength=n)
    facts[:, 3] = np.bincount(owner, in_a * in_b, n).astype(np.int64)
    return facts, written, (owner[g], a, b, times)


def _distinct(doc: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray):
    """Links summed by (document, id pair), in that order."""
    key = (doc << 32) | (a << 16) | b if len(a) and max(int(a.max()), int(b.max())) < 1 << 16 else None
    if key is None:
        order = np.lexsort((b, a, doc))
        doc, a, b, times = doc[order], a[order], b[order], times[order]
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
    else:
        order = np.argsort(key)
        key, doc, a, b, times = key[order], doc[order], a[order], b[order], times[order]
        new = np.ones(len(doc), bool)
        new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return doc[at], a[at], b[at], (np.add.reduceat(times, at) if len(at) else times)


def _align(byte_path: str, piece_path: str):
    """Task body: rows of two kinds, the documents with their id pairs (by place in the block's list)
    and the block's list of id pairs with the number of its documents that hold each."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_path, piece_path)
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for lo, hi in text_blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                facts, digests, found, base = [], [], [], 0
                for x, y in text_blocks(part.column(1), _STEP):
                    one, written, (doc, a, b, times) = align_batch(sides, part.column(1).slice(x, y - x))
                    facts.append(one)
                    digests += ["" if w is None else hashlib.sha256(w.encode()).hexdigest() for w in written]
                    doc, a, b, times = _distinct(doc, a, b, times)
                    found.append((doc + base, a.astype(np.uint32), b.astype(np.uint32), times))
                    base += y - x
                doc, a, b, times = (np.concatenate(c) for c in zip(*found, strict=True))
                pairs, place, held = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True, return_counts=True)
                yield _documents(block, part.column(0), np.concatenate(facts), digests, doc, place, times)
                yield _pairs(block, pairs, held)
                block += 1

    return align


def _batch(n: int, kind: int, block: int, **columns) -> pa.RecordBatch:
    empty = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
             "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary(), "a": pa.int32(), "b": pa.int32(),
             "place": pa.int32(), "documents": pa.int64()}
    fixed = {"kind": pa.array(np.full(n, kind, np.int8)), "block": pa.array(np.full(n, block, np.int64))}
    return pa.RecordBatch.from_arrays([fixed.get(c) if c in fixed else columns.get(c, pa.nulls(n, empty.get(c))) for c in _NAMES], _NAMES)


def _documents(block: int, ids, facts, digests, doc, place, times) -> pa.RecordBatch:
    n = len(ids)
    ends = np.searchsorted(doc, np.arange(n), "right")
    cuts = [slice(a, b) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
    return _batch(
        n, 0, block, doc_id=ids, **{c: pa.array(facts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        groups_sha256=pa.array(digests, pa.string()), pairs=pa.array([pack(place[c]) for c in cuts], pa.binary()),
        times=pa.array([pack(times[c]) for c in cuts], pa.binary()),
    )


def _pairs(block: int, pairs: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    return _batch(
        len(pairs), 1, block, a=pa.array((pairs >> 32).astype(np.int32)), b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
        place=pa.array(np.arange(len(pairs), dtype=np.int32)), documents=pa.array(held.astype(np.int64)),
    )


def _answer(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with their links' counts."""
    places = counts.column("place").to_numpy()
    count, best = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    count[places], best[places] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    total, top = [], []
    for pairs, times in zip(documents.column("pairs").to_pylist(), documents.column("times").to_pylist(), strict=True):
        at, n = unpack(pairs).astype(np.int64), unpack(times).astype(np.int64)
        total.append(int((count[at] * n).sum()))
        top.append(int(n[best[at]].sum()))
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(top, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column(
        "groups_sha256", documents.column("groups_sha256")
    )


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Align every whole text. Returns the documents ``(doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256)`` and the corpus's id pairs ``(a, b, count, best)``: ``best`` marks the pairs
    with their A id's highest count, ties included."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept, path = stored(rows.mapInArrow(_align(byte_path, piece_path), _STORED), "alignment", compression="zstd")
    asked = kept.where("kind = 1").select("block", "a", "b", "place", "documents")
    summed, _ = stored(asked.groupBy("a", "b").agg(F.sum("documents").alias("count")), "pair-counts")
    # An A id meets at most as many B ids as B's vocabulary has.
    top = F.max("count").over(Window.partitionBy("a"))
    pairs = summed.withColumn("best", F.col("count") == top)
    counts = asked.join(pairs, ["a", "b"]).select("block", "place", "count", "best")
    documents = spark.read.schema(kept.schema).parquet(path).where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return documents.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_answer, _ALIGNED), pairs


def write_alignments(docs: DataFrame, byte_path: str, piece_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``(doc_id, groups)`` as Parquet under ``path`` and read it back: per text the groups as
    ``a1,a2|b1;a3|b2,b3`` (null: no tokens)."""
    spark = docs.sparkSession
    ship(spark)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_path, piece_path)
        for batch in batches:
            for x, y in text_blocks(batch.column(1), _STEP):
                part = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(align_batch(sides, part.column(1))[1], pa.string())], ["doc_id", "groups"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(spelled, "doc_id long, groups string").write.parquet(path)
    return spark.read.schema("doc_id long, groups string").parquet(path)
