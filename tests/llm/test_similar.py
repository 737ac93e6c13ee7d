"""SimHash groups, embedding links, shards and components against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from xxhash import xxh64_intdigest

from tidelab.llm import embeddings, sharding, simhash
from tidelab.llm.common import components


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)]
    edges += [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3)]
    sets = Sets(2200)
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == sets.find(n) for n in range(2200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rnd = random.Random(8)
    for _ in range(200):
        text = "".join(rnd.choice(["Aé", "b", " ", "\n", "\x0b", " ", "C c ", "\x1c"]) for _ in range(rnd.randint(0, 40)))
        assert simhash.fingerprint(text.encode(), 3) == brute_print(text), repr(text)


def test_fingerprint_is_sparks_xxhash(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("one two")).alias("h")).first().h
    assert got & (1 << 64) - 1 == simhash.fingerprint(b"One  TWO", 3)


def check_groups(docs):
    rows = docs.collect()
    prints = np.array([brute_print(r.text) for r in rows], np.uint64)
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3):
            sets.join(i, i + 1 + int(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[sets.find(i)].append(r.doc_id)
    want = sorted(
        (r.doc_id is not None, r.doc_id or 0, f"{int(prints[i]):016x}", min(least[sets.find(i)], default=-1))
        for i, r in enumerate(rows)
    )
    got = sorted(
        (r.doc_id is not None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id)
        for r in simhash.simhash_groups(docs).collect()
    )
    assert got == want


def test_simhash_groups(documents, odd_documents, no_documents):
    check_groups(documents)
    check_groups(odd_documents)
    assert simhash.simhash_groups(no_documents).count() == 0


def test_near_pairs_small_tiles(spark):
    """A dense group cut into many tiles connects what all pairs connect."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:12].tolist():
        for _ in range(60):
            x = b
            for bit in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    links = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, tile=16).collect()
    at = {p: i for i, p in enumerate(signed)}
    got, want = Sets(len(prints)), Sets(len(prints))
    for r in links:
        got.join(at[r.a], at[r.b])
    arr = np.array(prints, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3):
            want.join(i, i + 1 + int(j))
    assert [got.find(i) for i in range(len(arr))] == [want.find(i) for i in range(len(arr))]


def test_keep_one(odd_documents):
    kept = simhash.keep_one(odd_documents)
    assert kept.schema == odd_documents.schema
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {None, 1, 2} <= set(ids) and not {3, 4} & set(ids)


def test_keep_one_of_tangled_ids(spark):
    a, b = "one two three four five six", "quite another text of seven words here"
    rows = [(5, a), (5, b), (3, b), (None, "nothing like it one"), (None, "nothing like it one"), (None, "else wholly different x"), (9, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [
        (-1, "else wholly different x"), (-1, "nothing like it one"), (3, b), (5, a)]


def test_keep_one_leaves_columns_of_its_own_names_alone(spark):
    names = ["_id", "_hash", "_id2", "_hash2", "_own_id", "_own_hash"]
    rows = [(i, t, *[100 * i + j for j in range(3)], *["u"] * 3) for i, t in [(1, "a b c d"), (1, "a b c d"), (2, "quite other words here")]]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names[:1], *names[2:3], *names[4:5], names[1], names[3], names[5]])
    kept = simhash.keep_one(df)
    assert kept.schema == df.schema
    assert sorted(tuple(r) for r in kept.collect()) == sorted(set(rows))


def brute_links(rows, least=0.93):
    sets, links = Sets(len(rows)), [0] * len(rows)
    vecs = [
        None if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float)
        for _, v, label in rows
    ]
    for i, a in enumerate(vecs):
        for j in range(i):
            b = vecs[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                sets.join(i, j)
                links[i] += 1
                links[j] += 1
    least_id = defaultdict(list)
    for i, r in enumerate(rows):
        least_id[sets.find(i)].append(r[0])
    return sorted((rows[i][0], links[i], min(least_id[sets.find(i)])) for i in range(len(rows)))


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((n, (centre + rng.normal(size=16) * 0.05).tolist(), label))
                n += 1
    crowd = rng.normal(size=16)
    rows += [(n + i, (crowd + rng.normal(size=16) * 0.03).tolist(), 1) for i in range(150)]
    n = len(rows)
    rows += [(n, crowd.tolist(), 1), (n + 1, crowd.tolist(), 1), (n + 2, crowd.tolist(), None), (n + 3, None, 1),
             (n + 4, [0.0] * 16, 1), (n + 5, [float("nan")] + [1.0] * 15, 1), (n + 6, [None] + [1.0] * 15, 1),
             (n + 7, [1.0] * 15, 1), (n + 8, [], 1)]
    rows = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = embeddings.near_vectors(df, tile=40).collect()
    want = brute_links(rows)
    found = sum(r.n_links for r in got)
    assert found >= 0.97 * sum(w[1] for w in want)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    brute = {w[0]: w for w in want}
    assert all(r.n_links <= brute[r.vec_id][1] for r in got)
    assert sum(r.component_id == brute[r.vec_id][2] for r in got) >= 0.98 * len(got)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_embeddings_table_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(vectors).collect())
    assert got == brute_links(rows)


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * sharding.LCG_MULTIPLIER + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rnd.randrange(-(2**62), 2**62) for _ in range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 100, 5000):
        got = df.select("k", sharding.jump_shard(F.col("k"), shards, unrolled=6 if shards < 5000 else 48).alias("s")).collect()
        assert all(r.s == jump(r.k % 2**64, shards) for r in got)


def test_shards(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = sharding.shard_documents(docs, 8, slot_rows=5).collect()
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            key = (r.doc_id or 0) % 2**64
            assert (r.shard, r.grown_shard) == (jump(key, 8), jump(key, 9)) and r.law == "key"
            assert r.grown_shard in (r.shard, 8)
            if r.doc_id is not None:
                assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_documents).count() == 0


def test_sharding_is_native(documents):
    plan = sharding.shard_documents(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_vectors_in_a_narrow_cone(spark):
    """All vectors near one reference point, more of them than a tile holds."""
    rng = np.random.default_rng(12)
    x = np.r_[20.0, np.zeros(11)] + rng.normal(0, 1.6, (90, 12))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert (unit @ unit.T).min() > 0.7 and 0 < close.sum() < close.size - len(x)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, tile=16).collect()}
    assert got == dict(enumerate(close.sum(1).tolist()))


def test_vectors_of_any_magnitude(spark):
    vecs = [[1e200, 1e200], [1e200, 1.01e200], [1e-200, 1e-200], [1.0, 0.1], [3e-310, 3e-310], [1.7e308, 0.0], [1e-300, -1e-300]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 4: (3, 0), 3: (1, 3), 5: (1, 3), 6: (0, 6)}
