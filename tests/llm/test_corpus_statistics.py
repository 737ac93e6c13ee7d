"""Collocations, alignment and language-model scores against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers

from tidelab.llm.alignment import _sides, align_documents, links, write_alignments
from tidelab.llm.blocks import pack, pack_sorted, unpack, unpack_sorted
from tidelab.llm.collocations import BLOCK, Trie, _encode, _texts, collocations
from tidelab.llm.language_model import _flagged, _open_weights, score_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 0]), rng.integers(0, 2**63, 500), np.array([2**64 - 1], np.uint64)):
        assert unpack(pack(x)).tolist() == x.tolist()
    keys = np.unique(rng.integers(0, 2**64 - 1, 999, dtype=np.uint64))
    assert unpack_sorted(pack_sorted(keys)).tolist() == keys.tolist()


def test_double_array_holds_exactly_its_strings():
    rnd = random.Random(3)
    strings = {(11,), (12,)}
    for _ in range(300):
        s = (rnd.choice([11, 12]), *(rnd.randint(1, 9) for _ in range(rnd.randint(1, 4))))
        strings |= {s[:i] for i in range(1, len(s) + 1)}
    strings = sorted(strings)
    trie, states = Trie.build(strings, {"x": 11, "y": 12, "z": 13}, 14)
    assert len(set(states.tolist())) == len(strings)
    codes = np.array([rnd.choice([0, *range(1, 10)]) for _ in range(4000)])
    for lang, symbol in (("x", 11), ("y", 12), ("z", 13)):
        got = {(int(p), n + 1): int(s) for n, (at, to) in enumerate(trie.levels(lang, codes, 5)) for p, s in zip(at, to, strict=True)}
        want = {}
        for p in range(len(codes)):
            for n in range(1, 6):
                key = (symbol, *codes[p : p + n].tolist())
                if len(key) == n + 1 and key in strings:
                    want[(p, n)] = int(states[strings.index(key)])
        assert got == want


def brute_collocations(rows, longest, least, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if len(p) >= 2 and c >= least}
        rows_out = []
        for p, a in found.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_out.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows_out)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("trie_nodes", [500_000, 40])
def test_collocations_against_brute_force(spark, documents, trie_nodes):
    docs = documents.limit(60).select("text", "lang")
    odd = spark.createDataFrame(
        [(None, "en"), ("", None), ("a a a a a a a a. A a;a", None), ("x\ty  x\x0by . x y x\x1cy", None), ("a a a a a a", "und"), (" .,;", "zz")],
        "text string, lang string",
    )
    both = docs.unionByName(odd)
    rows = [(r["lang"], r["text"]) for r in both.collect()]
    got = collocations(both.selectExpr("*", "1 as n", "'c' as codes", "2 as trie", "text as word"), least=4, first=30, trie_nodes=trie_nodes)
    assert rows_of(got, *"lang rank phrase a l r n score".split()) == brute_collocations(rows, 5, 4, 30)


def test_collocations_without_candidates(spark, no_documents):
    assert collocations(no_documents).count() == 0
    assert collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_collocation_blocks_are_small(spark):
    """A task's arrays are in proportion to a block: 5 MB of text are several of at most 2 MB."""
    docs = spark.range(5, numPartitions=1).selectExpr("repeat('ab ', 350000) as text", "'en' as lang")
    blocks = [len(unpack(r["codes"])) for r in _encode(_texts(docs, "text", "lang"), []).collect()]
    assert sum(blocks) == 5 * 350_001 and max(blocks) <= (2 << 20) / 3 + 1 and BLOCK == 2 << 20


def brute_alignment(texts):
    sides, out, held = _sides(BYTE, PIECE), [], Counter()
    for text in texts:
        want = b" " + (text or "").encode()
        a, b = sides.a.encode(want.decode(), add_special_tokens=False).ids, sides.b.encode(text or "")
        if not text or any(b"".join(k[i] for i in x) != want for k, x in ((sides.a_bytes, a), (sides.b_bytes, b))):
            out.append(None)
            continue
        ends = [np.cumsum([len(k[i]) for i in x]).tolist() for k, x in ((sides.a_bytes, a), (sides.b_bytes, b))]
        cuts, groups = sorted(set(ends[0]) & set(ends[1])), []
        before = 0
        for cut in cuts:
            groups.append(tuple([i for i, e in zip(x, es, strict=True) if before < e <= cut] for x, es in zip((a, b), ends, strict=True)))
            before = cut
        linked = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(linked))
        out.append((len(a), len(b), groups, linked))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for one in out:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, linked = one
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((n_a, n_b, len(groups), len(linked), sum(held[p] == best[p[0]] for p in linked), sum(held[p] for p in linked),
                     hashlib.sha256(written.encode()).hexdigest()))
    return rows


def test_alignment_against_brute_force(spark, documents):
    texts = [r["text"] for r in documents.limit(40).collect()]
    texts += [None, "", " ", "a  b\n\n c", " x", "x ", "é\ttab", "a\nb c\n", "\n", "日本 語 café", "<s> x <|endoftext|> y", "a▁b", "a\r\nb", "x\xa0y",
              "word, word. Word,", "▁", "\x00 \x7f", texts[0], "z" * 3000, "é" * 40, "😀😃 ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as block", "'q' as pairs", "1.5 as a")
    got, pairs = align_documents(df.repartition(3), BYTE, PIECE)
    want = [(i, *row) for i, row in enumerate(brute_alignment(texts))]
    assert rows_of(got, *"doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()) == want
    assert pairs.where("best").groupBy("a").count().count() == pairs.select("a").distinct().count()


def test_written_groups(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in write_alignments(docs, BYTE, PIECE, str(tmp_path / "g")).collect()}
    assert got[2] is None and got[1].count("|") == got[1].count(";") + 1 and "|" in got[None]


def test_long_groups_are_linked_by_distinct_ids():
    group = np.zeros(300, np.int64)
    ids = np.arange(300) % 7
    (g, a, b, times), in_a, in_b = links(group, group, ids, ids)
    assert len(g) == 49 and times.sum() == 300 * 300 == (in_a * in_b).sum()


def test_alignment_of_odd_tables(spark, odd_documents, no_documents):
    assert align_documents(no_documents, BYTE, PIECE)[0].count() == 0
    assert align_documents(odd_documents, BYTE, PIECE)[0].count() == odd_documents.count()


def brute_model(rows, order, rounds):
    """``rows`` of (id, flag, text): (n_tokens, n_known, N, base, score) of each, by dictionaries."""
    docs = [[w for w in re.split("[ \t-\r]+", (t or "").translate(LOWER)) if w] + [None] for _, _, t in rows]

    def model(flags):
        counts, contexts = Counter(), Counter()
        for words, (_, flag, _) in zip(docs, rows, strict=True):
            if flag in flags:
                padded = ["<"] * (order - 1) + words
                for i in range(order - 1, len(padded)):
                    for m in range(1, order + 1):
                        gram = tuple(padded[i - m + 1 : i + 1])
                        counts[gram] += 1
                        contexts[(m, gram[:-1])] += 1
        return counts, contexts, len([g for g in counts if len(g) == 1])

    def parts(words, i, counts, contexts, types):
        padded = ["<"] * (order - 1) + words
        i += order - 1
        out, bucket = [1 / (types + 1)], 0
        for m in range(1, order + 1):
            gram = tuple(padded[i - m + 1 : i + 1])
            c = contexts[(m, gram[:-1])]
            out.append(counts[gram] / c if c else 0.0)
            if c:
                bucket = m * 64 + int(math.log2(c))
        return bucket, out

    weights = _open_weights(order).tolist()
    kept = model({0})
    deleted = [parts(w, i, *kept) for w, (_, f, _) in zip(docs, rows, strict=True) if f == 2 for i in range(len(w))]
    for _ in range(rounds):
        sums = [[float(x > 0) for x in row] for row in weights]
        for bucket, p in deleted:
            share = [w * x for w, x in zip(weights[bucket], p, strict=True)]
            for n, s in enumerate(share):
                sums[bucket][n] += s / sum(share)
        new = [[x / sum(row) for x in row] for row in sums]
        moved = max(abs(x - y) for a, b in zip(new, weights, strict=True) for x, y in zip(a, b, strict=True))
        weights = new
        if moved < 1e-4:
            break
    full = model({0, 2})
    total = sum(c for g, c in full[0].items() if len(g) == 1)
    out = []
    for words in docs:
        known = [full[0][(w,)] for w in words]
        base = sum(math.log10((c + 1) / (total + full[2] + 1)) for c in known)
        score = 0.0
        for i in range(len(words)):
            bucket, p = parts(words, i, *full)
            score += math.log10(sum(w * x for w, x in zip(weights[bucket], p, strict=True)))
        out.append((len(words), sum(c > 0 for c in known), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(spark, documents, odd_documents, order):
    docs = documents.limit(60).select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text").where("doc_id is null or doc_id <> 6"))
    rows = [tuple(r) for r in _flagged(docs, 2, 7, 8, "doc_id", "text").collect()]
    want = sorted((i is not None, i or 0, f == 1, *rest) for (i, f, _), rest in zip(rows, brute_model(rows, order, 4), strict=True))
    got = score_texts(docs.selectExpr("*", "1 as block", "2 as flag", "'x' as words").repartition(3), order=order, rounds=4).collect()
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6:] for g in got], [w[6:] for w in want], rtol=1e-9)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = score_texts(docs).where("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert row["s"] > row["b"]


def test_language_model_of_odd_tables(spark, no_documents, odd_documents):
    assert score_texts(no_documents).count() == 0
    assert score_texts(odd_documents).count() == odd_documents.count()
    held = spark.createDataFrame([(i, "some words") for i in range(200)], "doc_id long, text string").where("crc32(cast(doc_id as string)) % 7 = 2")
    row = score_texts(held).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)


def test_no_block_is_lost_between_partitions(spark, documents):
    one, many = (score_texts(documents.repartition(n)).selectExpr("count(*) n", "sum(n_tokens) t", "round(sum(score), 3) s").first() for n in (1, 9))
    assert one == many
