"""Toxicity classifier: a factorization machine over hashed terms.

Each text is the set of its terms, words and word beginnings (so that inflected forms share a term),
hashed. A term has a weight and a short vector; a text's score is the sum of its terms' weights plus
the inner products of all pairs of their vectors, which learn what terms mean together, such as an
insult with a group named beside it, where a sum of weights alone cannot. Terms that the sample does
not tell apart by class are left out before fitting, which keeps long harmless texts harmless: a term
stays if a likelihood-ratio test tells its classes apart, or if it is a word that does so together with
another one, tested on all pairs of words. However many pass are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import drop_path, free_name, parallel_slots, ship, stored, utf8
from tidelab.llm.labelled import fit_platt, held_out, sigmoid, training_sample
from tidelab.llm.licenses import words_of

BITS = 20
_MASK = (1 << BITS) - 1
#: Lengths in bytes of the word beginnings that are terms.
BEGINNINGS = (4, 5, 6)


def terms_of(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings, each tagged by its length."""
    out = [crc32(word) & _MASK]
    out += [crc32(word[:n], n) & _MASK for n in BEGINNINGS if len(word) > n]
    return out


def all_terms(text: bytes, cache: dict[bytes, list[int]]) -> set[int]:
    words = set(words_of(text))
    if len(cache) > 100_000:
        cache.clear()
    for w in words.difference(cache):
        cache[w] = terms_of(w)
    return set().union(*(cache[w] for w in words)) if words else set()


class Model:
    """Kept terms (hash to row), weights, vectors, bias and calibration."""

    def __init__(self, rows: dict[int, int], weight: np.ndarray, factor: np.ndarray, bias: float, a: float, b: float):
        self.rows, self.weight, self.factor, self.bias, self.a, self.b = rows, weight, factor, bias, a, b

    def margin(self, found: list[int]) -> float:
        if not found:
            return self.bias
        v = self.factor[found]
        total = v.sum(0)
        return float(self.bias + self.weight[found].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, found: list[int]) -> float:
        return sigmoid(self.a * self.margin(found) + self.b)

    def found(self, text: bytes, cache: dict[bytes, tuple]) -> list[int]:
        """Rows of the kept terms in a text; ``cache`` keeps them per word."""
        words = set(words_of(text))
        if len(cache) > 200_000:
            cache.clear()
        for w in words.difference(cache):
            cache[w] = tuple(r for t in terms_of(w) if (r := self.rows.get(t)) is not None)
        got: set[int] = set()
        for rows in filter(None, map(cache.__getitem__, words)):
            got.update(rows)
        return sorted(got)


def fit_machine(
    rows: list[list[int]], label: np.ndarray, each: np.ndarray, width: int, factors: int = 8, epochs: int = 40,
    rate: float = 0.15, decay: float = 1e-5, pair_decay: float = 2e-3, batch: int = 256, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, vectors and bias by AdaGrad on the weighted logistic loss; a step touches the terms of
    its batch alone. Vectors shrink faster than weights, so that pairs explain what weights do not."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(width), rng.normal(0, 0.02, (width, factors)), 0.0
    gw, gv, gb = np.full(width, 1e-4), np.full((width, factors), 1e-2), 1e-2
    y = np.where(label == 1, 1.0, -1.0)
    sizes = np.array([len(r) for r in rows])
    flat = np.array([t for r in rows for t in r], np.int64)
    begins = np.cumsum(sizes) - sizes
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            n = sizes[pick]
            who = np.repeat(np.arange(len(pick)), n)
            terms = flat[np.repeat(begins[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            mine = v[terms]
            s = np.zeros((len(pick), factors))
            np.add.at(s, who, mine)
            squares = np.bincount(who, (mine * mine).sum(1), len(pick))
            z = bias + np.bincount(who, w[terms], len(pick)) + 0.5 * ((s * s).sum(1) - squares)
            d = each[pick] * -y[pick] / (1 + np.exp(np.clip(y[pick] * z, -35, 35))) / len(pick)
            on, place = np.unique(terms, return_inverse=True)
            dw = np.bincount(place, d[who], len(on)) + decay * w[on]
            dv = np.zeros((len(on), factors))
            np.add.at(dv, place, d[who][:, None] * (s[who] - mine))
            dv += pair_decay * v[on]
            db = d.sum()
            gw[on] += dw * dw
            gv[on] += dv * dv
            gb += db * db
            w[on] -= rate * dw / np.sqrt(gw[on])
            v[on] -= rate * dv / np.sqrt(gv[on])
            bias -= rate * db / np.sqrt(gb)
    return w, v, float(bias)


def fit_model(rows: list[list[int]], label: np.ndarray, weight: dict[int, float], hashes: list[int]) -> Model:
    """Fit the machine on four fifths of the sample, the calibration on the rest."""
    calib = np.arange(len(rows)) % 5 == 0
    each = np.where(label == 1, weight[1], weight[0])
    train = np.flatnonzero(~calib)
    w, v, bias = fit_machine([rows[i] for i in train], label[train], each[train], max(1, len(hashes)))
    model = Model({h: i for i, h in enumerate(hashes)}, w, v, bias, 1.0, 0.0)
    margin = np.array([model.margin(rows[i]) for i in np.flatnonzero(calib)])
    model.a, model.b = fit_platt(margin, label[calib], each[calib])
    return model


def telling_terms(sample: DataFrame, n_pos: int, n_neg: int, least_df: int, least_z: float) -> list[int]:
    """Hashes of all terms whose rows differ in class from the rest by a likelihood ratio of ``least_z``
    deviations or more, from counts over the whole sample. Terms of one class alone are no exception."""
    counts = (
        sample.select("label", F.explode("ids").alias("term")).groupBy("term")
        .agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q"))
        .where(F.col("p") + F.col("q") >= least_df)
    )
    found = counts.orderBy("term").toArrow()
    p, q = found.column("p").to_numpy(), found.column("q").to_numpy()
    return found.column("term").to_numpy()[likelihood_ratio(p, q, n_pos, n_neg) >= least_z**2].tolist()


def likelihood_ratio(p: np.ndarray, q: np.ndarray, n_pos, n_neg) -> np.ndarray:
    """Twice the log likelihood ratio (G) of ``p`` of ``n_pos`` and ``q`` of ``n_neg`` rows against
    one share in both."""

    def plogp(x):
        x = np.asarray(x, np.float64)
        return x * np.log(np.where(x > 0, x, 1.0))

    inner = plogp(p) + plogp(q) + plogp(n_pos - p) + plogp(n_neg - q) + plogp(n_pos + n_neg)
    return 2 * (inner - plogp(p + q) - plogp(n_pos + n_neg - p - q) - plogp(n_pos) - plogp(n_neg))


def telling_pairs(spark, own: list[np.ndarray], label: np.ndarray, least_df: int, least_z: float) -> list[int]:
    """Hashes of the words that tell the classes apart with another word: in the rows of either one
    the other one's likelihood ratio passes. As each word is tested with all others, the bar is
    higher by ``2 ln`` of the words. Equal rows count once, as each copy would confirm all its pairs.
    Each word is counted against the words of its rows, in tasks; the sample goes to all of them."""
    kept = sorted({(y, r.tobytes()) for r, y in zip(own, label.tolist(), strict=True)})
    rows, label = [np.frombuffer(r, np.int32) for _, r in kept], np.array([y for y, _ in kept])
    df = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=_MASK + 1)
    words = np.flatnonzero(df >= least_df)
    if len(words) < 2:
        return []
    number = np.full(_MASK + 1, -1, np.int32)
    number[words] = np.arange(len(words))
    rows = [n[n >= 0] for n in (number[r] for r in rows)]
    size = np.array([len(r) for r in rows])
    flat, begin = np.concatenate(rows), np.cumsum(size) - size
    holder = np.repeat(np.arange(len(rows), dtype=np.int32), size)[np.argsort(flat, kind="stable")]
    ends = np.cumsum(df[words])
    n_pos = np.bincount(flat, np.repeat(label, size), len(words))
    bar, n_all = least_z**2 + 2 * np.log(len(words)), df[words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: set[int] = set()
            for a in batch.column(0).to_pylist():
                docs = holder[ends[a] - n_all[a] : ends[a]]
                n = size[docs]
                others = flat[np.repeat(begin[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                toxic = np.repeat(label[docs], n)
                later = others > a
                on, place = np.unique(others[later], return_inverse=True)
                p = np.bincount(place, toxic[later], len(on))
                q = np.bincount(place, minlength=len(on)) - p
                often = p + q >= least_df
                on, p, q = on[often], p[often], q[often]
                least = np.minimum(
                    likelihood_ratio(p, q, n_pos[a], n_all[a] - n_pos[a]), likelihood_ratio(p, q, n_pos[on], n_all[on] - n_pos[on])
                )
                if (least >= bar).any():
                    got.update([a, *on[least >= bar].tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.int64())], ["word"])

    parts = parallel_slots(spark) * 4
    anchors = spark.range(len(words)).select("id").repartition(parts, F.xxhash64("id"))
    return [int(words[r["word"]]) for r in anchors.mapInArrow(run, "word long").distinct().collect()]


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 8000, modulus: int = 4, remainder: int = 2,
    label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    least_df: int = 5, least_z: float = 4.0,
) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out. Terms are taken
    from whole texts and counted in Spark; the driver gets the sample's word hashes, for the pairs, and
    its kept terms. Where the sample cannot tell the classes apart (one class or none is labelled, or no
    term does), every text gets the same low score and nothing is rejected."""
    spark = docs.sparkSession
    ship(spark)
    sample, weight = training_sample(docs, labels, label_col, modulus, remainder, per_class, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, list[int]] = {}
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2).cast(pa.binary())]
            ids = [sorted(all_terms(t, cache)) for t in texts]
            own = [sorted({crc32(w) & _MASK for w in words_of(t)}) for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, kind), pa.array(own, kind)], ["doc_id", "label", "ids", "own"]
            )

    terms = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ids array<int>, own array<int>")
    terms, path = stored(terms, "toxicity-sample")
    cannot_tell = Model({}, np.zeros(1), np.zeros((1, 1)), 0.0, 0.0, -4.0)
    size = {r["label"]: r["n"] for r in terms.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        drop_path(spark, path)
        return cannot_tell
    words = terms.select("label", "own").toArrow()
    own = [np.asarray(r.values.to_numpy(zero_copy_only=False), np.int32) for r in words.column("own")]
    pairs = telling_pairs(spark, own, words.column("label").to_numpy(), least_df, least_z)
    hashes = sorted({*telling_terms(terms, size[1], size[0], least_df, least_z), *pairs})
    if not hashes:
        drop_path(spark, path)
        return cannot_tell
    row = {h: i for i, h in enumerate(hashes)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[row[t] for t in r if t in row] for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "ids"])

    got = terms.select("doc_id", "label", "ids").mapInArrow(keep, "doc_id long, label int, ids array<int>").collect()
    drop_path(spark, path)
    got = sorted(got, key=lambda r: (crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit_model([r["ids"] for r in got], np.array([r["label"] for r in got]), weight, hashes)


def with_score(docs: DataFrame, model: Model, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text (null: empty) as a column of that name."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple] = {}
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            scores = [model.score(model.found(t.as_py() or b"", cache)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column]
            )

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def score_toxicity(
    docs: DataFrame, model: Model, modulus: int = 4, remainder: int = 2, threshold: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from its whole text alone. Null texts
    count as empty and get the score of a text without terms; repeated rows each get their row;
    other columns are not read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return with_score(rows, model, "score").select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay. Null texts are scored
    as empty ones, repeated rows stay or go together, an empty table stays empty; a model that cannot tell
    the classes apart rejects nothing."""
    name = free_name(docs.columns, "_toxicity")
    return with_score(docs, model, name, text_col).where(F.col(name) < threshold).drop(name)
