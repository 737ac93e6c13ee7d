"""Secret and licence scans against Python's own regular expressions and plain search."""

import hashlib
import random
import re
from itertools import pairwise

from tidelab.llm import licenses, secrets


def base_secrets(text):
    text = text or ""
    out = [
        (m.start(), m.end(), 0)
        for m in re.finditer(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text)
        if len(m[1]) >= 12
    ]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_automaton_equals_regexes():
    scanner = secrets.compile_rules()
    rnd = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_", "=", ":", " ", "  ", "'", '"', "a",
             "0123456789abcdef", "ABCDEF", "AKIA", "AKIAAKIA", "Z9", "deadbeef", "é", "漢", "\n", "\r", ",", ".", "-", "==",
             "ghp_", "A" * 20, "ſ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts.append("x" * 50_000 + "token=" + "q" * 40)
    for text, spans in zip(texts, secrets.scan_texts([t.encode() for t in texts], scanner), strict=True):
        assert [s for s in spans if s[2] < 3] == base_secrets(text), text


def test_minimised_automaton_has_no_equal_states():
    a = secrets.compile_rules().shared
    again = secrets.minimise(a)
    assert again.table.shape == a.table.shape


def test_secret_digest(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = secrets.digest(secrets.find_secrets(docs)).collect()
        texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id is None:
                continue
            want = base_secrets(texts[r.doc_id])
            shown = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, b, k in want)
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for *_, k in want) for n in range(3)]
            assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))
    assert secrets.find_secrets(no_documents).count() == 0


def test_redaction(odd_documents):
    rows = secrets.redact(odd_documents)
    assert rows.schema == odd_documents.schema and rows.count() == odd_documents.count()
    one = rows.where("doc_id = 1").first()
    assert one.text == "Released under the MIT License. [SECRET]'" and one.n_chars == len(one.text)
    assert rows.where("doc_id = 2").first().text is None
    assert secrets.digest(secrets.find_secrets(rows)).where("n_assign + n_access + n_hex > 0").count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_places(text):
    words = plain_words(text)
    return words, sorted(
        (i, label)
        for phrase, label in licenses.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )


def test_license_base_equals_search(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = licenses.scan_licenses(docs)
        assert rows.count() == docs.count()
        texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
        for r in rows.where("doc_id is not null").collect():
            words, places = base_places(texts[r.doc_id])
            starts = [p for p, _ in places]
            assert (r.n_words, r.n_base) == (len(words), len(places))
            assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(no_documents).count() == 0


def test_matching_statistics_equal_brute_force():
    sam = licenses.build(licenses.TEMPLATES, licenses.PHRASES)
    texts = [licenses.words_of(t.encode()) for t, _ in (*licenses.PHRASES, *licenses.TEMPLATES)]
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, min(len(t), i + 12) + 1)}
    rnd = random.Random(2)
    for _ in range(300):
        words = []
        while len(words) < 30:
            t = rnd.choice(texts)
            a = rnd.randrange(len(t))
            words += t[a : a + rnd.randint(1, 7)]
            if rnd.random() < 0.2:
                words.append(b"zzz")
        ids = [sam.words.get(w, -1) for w in words]
        for i, (_, length) in enumerate(licenses.matching_statistics(ids, sam)):
            brute = max((k for k in range(1, min(i + 1, 12) + 1) if tuple(words[i - k + 1 : i + 1]) in parts), default=0)
            assert min(length, 12) == brute


def test_edited_template_is_chained(spark):
    notice = licenses.TEMPLATES[4][0].split()
    edited = [w for i, w in enumerate(notice) if i % 9 != 8]
    docs = spark.createDataFrame([(1, "before it " + " ".join(edited) + " and after", None), (2, "nothing of the kind", None)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert rows[1].labels == "mit-notice" and rows[1].score > 0.7 and rows[1].spans[0].begin == 2
    assert rows[2].labels == "" and rows[2].score < 0.3
    assert all(a.begin <= b.begin for a, b in pairwise(rows[1].spans))
