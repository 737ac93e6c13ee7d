"""Phrase collocation mining with double-array tries of Apriori-safe candidates.

A phrase of 2 to ``longest`` words is a candidate if it stands ``least`` times in its language. Every part
of a candidate is then frequent too (Apriori), which bounds the search level by level:

1. Words are counted per language; the frequent ones are numbered, and the texts are stored as those
   numbers, 0 standing for other words and for the breaks between pieces.
2. Level by level, the frequent phrases found so far are laid out as double-array tries and broadcast.
   All text positions advance through them together, one array step a level. Where a position and the
   next one both reach the last level, the phrase one word longer may be frequent: its places are
   counted within the block (at most ``least``, all that the decision needs) and summed by Spark.
3. The tries of all frequent phrases are broadcast; positions advance level by level, the states they
   reach are counted with ``bincount``, and the counts are summed over the blocks. These are the counts that
   scores are made of.

A trie holds the phrases of one share of the first words (by number), at most about ``trie_nodes`` of them, so that
every broadcast and every array is bounded; with more phrases there are more tries, and a task takes one
after the other over the same text. Numbered words reach the tasks in lists of at most ``trie_nodes``
too. Scores are exact: products are taken in 38-digit decimals.

A null text is empty, a null language is ``und``; repeated rows count each; ids are not read. A table
without candidates gives no rows.
"""

from __future__ import annotations

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
from tidelab.llm.common import drop_path, ship, stored

#: What parts a text into pieces; a full stop can stand for a break, as no word holds one.
BREAKS = "[.,;:!?\\n-\\r]"
#: Bytes of text in a block. A task holds some twenty arrays of a block's words beside the tries, so blocks are
#: smaller than elsewhere; what several of them hold is added up before the shuffle.
BLOCK = 2 << 20
#: Sums that a task holds (64 MB).
HELD = 8 << 20
#: States in a run of sums.
RUN = 1 << 12


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words with a ``.`` at each break and after each text, and each text's number of them."""
    shown = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS, " . ")
    lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(shown, " .", ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words.filter(pa.array(real))
    return words, sizes


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where("text is not null")


def count_words(rows: DataFrame) -> DataFrame:
    """``(lang, word, n)``, summed within a block first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_blocks(batch.column(1), BLOCK):
                words, sizes = piece_words(batch.column(1).slice(a, b - a))
                coded = words.dictionary_encode()
                langs = batch.column(0).slice(a, b - a).dictionary_encode()
                wide = len(coded.dictionary)
                key = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes) * wide + coded.indices.to_numpy()
                found, n = np.unique(key, return_counts=True)
                names = coded.dictionary.take(pa.array(found % wide))
                real = pc.not_equal(names, ".")
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(found // wide)).filter(real), names.filter(real), pa.array(n).filter(real)],
                    ["lang", "word", "n"],
                )

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(frequent: DataFrame, lists: int) -> tuple[DataFrame, list]:
    """Frequent words of any language with a number from 1, and the number of words of each list."""
    words = frequent.select("word").distinct().withColumn("list", F.pmod(F.xxhash64("word"), F.lit(lists)).cast("int"))
    sizes = {r["list"]: r["n"] for r in words.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, bases = 1, []
    for i in range(lists):
        bases.append(base)
        base += sizes.get(i, 0)
    rank = F.row_number().over(Window.partitionBy("list").orderBy("word"))  # a list is bounded
    offset = F.element_at(F.array(*[F.lit(b) for b in bases]), F.col("list") + 1)
    return words.withColumn("code", (offset + rank - 1).cast("int")), bases


def _encode(rows: DataFrame, shares: list) -> DataFrame:
    """``(lang, codes)`` a block and language: the texts as word numbers, 0 for breaks and other words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_blocks(batch.column(1), BLOCK):
                words, sizes = piece_words(batch.column(1).slice(a, b - a))
                coded = words.dictionary_encode()
                number = np.zeros(len(coded.dictionary), np.int64)
                for share in shares:
                    known, first = share.value
                    at = pc.index_in(coded.dictionary, value_set=known)
                    hit = at.is_valid().to_numpy(zero_copy_only=False)
                    number[hit] = at.drop_null().to_numpy() + first
                codes = number[coded.indices.to_numpy()]
                langs = batch.column(0).slice(a, b - a).dictionary_encode()
                owner = np.repeat(langs.indices.to_numpy(), sizes)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([pack(codes[owner == i])], pa.binary())], ["lang", "codes"]
                    )

    return rows.mapInArrow(encode, "lang string, codes binary")


class Trie:
    """A double array: from state ``s`` symbol ``c`` leads to ``t = base[s] + c`` if ``check[t] = s``.
    State 0 is the root; languages are symbols above the words' numbers."""

    def __init__(self, base: np.ndarray, check: np.ndarray, langs: dict[str, int], top: int):
        self.base, self.check, self.langs, self.top = base, check, langs, top

    @classmethod
    def build(cls, phrases: list[tuple[int, ...]], langs: dict[str, int], top: int) -> tuple["Trie", np.ndarray]:
        """Lay out symbol strings (closed under prefixes). Returns the trie and each string's state.

        Nodes with several children are placed first, those with the most first, each at the first base
        that leaves its children's places free; the only children then fill the places left over."""
        children: dict[tuple, list[int]] = {}
        for p in sorted(phrases):
            children.setdefault(p[:-1], []).append(p[-1])
        used = np.zeros(2 * top + 4 * len(phrases) + 2, bool)
        used[0] = True
        bases: dict[tuple, int] = {}
        begin = 1
        for prefix in sorted((p for p, c in children.items() if len(c) > 1), key=lambda p: -len(children[p])):
            symbols = np.array(children[prefix])
            window = max(16, min(512, (1 << 20) // len(symbols)))
            at = begin
            while True:
                if at + window + top >= len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                tried = np.arange(at, at + window)
                fits = ~used[tried[:, None] + symbols].any(1)
                if fits.any():
                    bases[prefix] = b = int(tried[np.argmax(fits)])
                    used[b + symbols] = True
                    break
                at += window
                begin = at  # a crowded stretch is left to nodes with one child
        single = sorted((c[0], p) for p, c in children.items() if len(c) == 1)
        free = top + 1 + np.flatnonzero(~used[top + 1 :])
        if len(free) < len(single):
            free = np.append(free, len(used) + np.arange(len(single)))
        for (symbol, prefix), place in zip(single, free.tolist(), strict=False):
            bases[prefix] = place - symbol
        state: dict[tuple, int] = {(): 0}
        size = 1 + max([0, *(bases[p] + c[-1] for p, c in children.items())])
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for p in sorted(phrases, key=len):  # parents before children
            state[p] = t = bases[p[:-1]] + p[-1]
            check[t] = state[p[:-1]]
        for p, b in bases.items():
            base[state[p]] = b
        return cls(base, check, langs, top), np.array([state[p] for p in phrases], np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of them exist."""
        to = self.base[states] + symbols
        inside = to < len(self.check)
        to = np.where(inside, to, 0)
        return to, inside & (self.check[to] == states) & (symbols > 0)

    def levels(self, lang: str, codes: np.ndarray, longest: int, at: np.ndarray | None = None):
        """Advance all positions (or those in ``at``) at once: per level the positions still inside and
        their states."""
        at = np.flatnonzero(codes > 0) if at is None else at
        start, known = self.step(np.zeros(1, np.int64), np.array([self.langs.get(lang, 0)]))
        if not known[0]:
            return
        states = np.full(len(at), start[0])
        codes = np.append(codes, np.zeros(longest, codes.dtype))
        for level in range(longest):
            to, alive = self.step(states, codes[at + level])
            at, states = at[alive], to[alive]
            yield at, states
            if not len(at):
                return


def _positions(codes: np.ndarray, shares: int) -> list[np.ndarray]:
    """Positions of words by the trie that holds the phrases which begin with them."""
    at = np.flatnonzero(codes > 0)
    share = codes[at] % shares
    at = at[np.argsort(share, kind="stable")]
    return np.split(at, np.cumsum(np.bincount(share, minlength=shares))[:-1])


def _tries(phrases: DataFrame, shares: int, top: int, langs: dict[str, int]) -> tuple[DataFrame, str]:
    """A row a trie with its arrays, and the states of its phrases, stored."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        strings = [(langs[lang], *codes) for lang, codes in zip(group["lang"], group["codes"], strict=True)]
        roots = sorted({s[0] for s in strings})
        trie, states = Trie.build([(r,) for r in roots] + strings, langs, top)
        return pd.DataFrame({
            "trie": int(group["trie"].iloc[0]), "base": [pack(trie.base)], "check": [pack(trie.check + 1)],
            "lang": [group["lang"].tolist()], "codes": [[list(c) for c in group["codes"]]],
            "state": [states[len(roots):].tolist()],
        })

    share = F.pmod(F.col("codes")[0], F.lit(shares)).cast("int")
    out = phrases.select("lang", "codes").withColumn("trie", share).groupBy("trie").applyInPandas(
        build, "trie int, base binary, check binary, lang array<string>, codes array<array<int>>, state array<long>"
    )
    return stored(out, "tries")


def _broadcast(spark, tries: DataFrame, langs: dict[str, int], top: int) -> list:
    """One bounded broadcast a trie; the driver holds one at a time."""
    out = []
    for row in tries.select("trie", "base", "check").toLocalIterator():
        trie = Trie(unpack(row["base"]).astype(np.int32), unpack(row["check"]).astype(np.int32) - 1, langs, top)
        out.append((row["trie"], spark.sparkContext.broadcast(trie)))
    return out


def _states(tries: DataFrame) -> DataFrame:
    """``(trie, state, lang, codes)`` of every phrase in the tries."""
    return tries.select("trie", F.explode(F.arrays_zip("lang", "codes", "state")).alias("p")).select("trie", "p.state", "p.lang", "p.codes")


def _longer(texts: DataFrame, tries: list, shares: int, level: int, least: int) -> DataFrame:
    """``(trie, state, code)`` of the phrases of ``level`` + 1 words whose parts of ``level`` words are
    frequent and that stand ``least`` times."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = unpack(packed.as_py()).astype(np.int64)
                reached = np.zeros(len(codes) + 1, bool)
                last, places = [], _positions(codes, shares)
                for number, trie in tries:
                    steps = list(trie.value.levels(lang, codes, level, places[number]))
                    if len(steps) == level:
                        at, states = steps[-1]
                        reached[at] = True
                        last.append((number, at, states))
                for number, at, states in last:
                    both = reached[at + 1]
                    key = (states[both].astype(np.int64) << 32) | codes[np.minimum(at[both] + level, len(codes) - 1)]
                    found, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), number, np.int32)), pa.array(found), pa.array(np.minimum(n, least))],
                        ["trie", "key", "n"],
                    )

    found = texts.mapInArrow(find, "trie int, key long, n long").groupBy("trie", "key").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least).select(
        "trie", F.shiftright("key", 32).alias("state"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("code")
    )


def _counts(texts: DataFrame, tries: list, shares: int, longest: int) -> DataFrame:
    """``(trie, state, n)``: how many positions reach each state. A task hands over its sums at its end, or
    before they pass ``HELD`` numbers, as runs of ``RUN`` states; Spark adds the runs up in two steps."""

    def told(held: dict[int, np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
        for number, sums in held.items():
            runs = [sums[i : i + RUN] for i in range(0, len(sums), RUN)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(runs), pa.int32()), pa.array(range(len(runs)), pa.int32()),
                 pa.array([task % 64] * len(runs), pa.int32()), pa.array([pack(r) for r in runs], pa.binary())],
                ["trie", "run", "share", "sums"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            for lang, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = unpack(packed.as_py()).astype(np.int64)
                places = _positions(codes, shares)
                for number, trie in tries:
                    if number not in held:
                        if sum(map(len, held.values())) + len(trie.value.base) > HELD:
                            yield from told(held, task)
                            held = {}
                        held[number] = np.zeros(len(trie.value.base), np.int64)
                    steps = [states for _, states in trie.value.levels(lang, codes, longest, places[number])]
                    if steps:
                        held[number] += np.bincount(np.concatenate(steps), minlength=len(held[number]))
        yield from told(held, task)

    def add(parts: pa.Table) -> pa.Table:
        sums = unpack(parts.column("sums")[0].as_py()).astype(np.int64)
        for packed in parts.column("sums")[1:]:
            sums = sums + unpack(packed.as_py()).astype(np.int64)
        return parts.slice(0, 1).select(["trie", "run", "share"]).append_column("sums", pa.array([pack(sums)], pa.binary()))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = unpack(row["sums"]).astype(np.int64)
                state = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(state), row["trie"], np.int32)), pa.array(state + row["run"] * RUN), pa.array(n[state])], ["trie", "state", "n"]
                )

    kinds = "trie int, run int, share int, sums binary"
    some = texts.mapInArrow(count, kinds).groupBy("trie", "run", "share").applyInArrow(add, kinds)
    return some.groupBy("trie", "run").applyInArrow(add, kinds).mapInArrow(unfold, "trie int, state long, n long")


def phrase_counts(
    docs: DataFrame, longest: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", trie_nodes: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """``(lang, codes, words, n)`` of every frequent phrase of 1 to ``longest`` words, and ``(lang, n)``,
    the word occurrences of each language."""
    spark = docs.sparkSession
    ship(spark)
    rows = _texts(docs, text_col, lang_col)
    words, words_path = stored(count_words(rows), "phrase-words")
    totals, _ = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent, _ = stored(words.where(F.col("n") >= least).select("lang", "word"), "phrase-frequent")
    drop_path(spark, words_path)
    lists = max(1, -(-frequent.count() // trie_nodes))
    numbered, _ = stored(_numbered(frequent, lists)[0], "phrase-numbers")
    top = numbered.count()
    # One symbol a language: the languages are the table's own labels.
    langs = {r["lang"]: top + 1 + i for i, r in enumerate(totals.select("lang").orderBy("lang").toLocalIterator())}
    shares = []
    for i in range(lists):
        part = numbered.where(F.col("list") == i).orderBy("code").toArrow()
        if part.num_rows:
            shares.append(spark.sparkContext.broadcast((part.column("word").combine_chunks(), part.column("code")[0].as_py())))
    texts, _ = stored(_encode(rows, shares), "phrase-texts", compression="none")
    every = frequent.join(numbered, "word").select("lang", F.array("code").alias("codes"), F.array("word").alias("words"))
    for level in range(1, longest + 1):
        every, _ = stored(every, "phrases")
        held = every.count()
        parts = max(1, -(-held // trie_nodes))
        tries, _ = _tries(every, parts, top + 1 + len(langs), langs)
        sent = _broadcast(spark, tries, langs, top + 1 + len(langs))
        if level == longest:
            break
        code = numbered.select("code", "word")
        longer = _longer(texts, sent, parts, level, least).join(_states(tries), ["trie", "state"]).join(code, "code").select(
            "lang", F.concat("codes", F.array("code")).alias("codes"), "word"
        )
        shorter = every.where(F.size("codes") == level).select("lang", "codes", "words")
        found = longer.withColumn("start", F.slice("codes", 1, level)).join(
            shorter.select("lang", F.col("codes").alias("start"), "words"), ["lang", "start"]
        )
        every = every.unionByName(found.select("lang", "codes", F.concat("words", F.array("word")).alias("words")))
    counted, _ = stored(
        _counts(texts, sent, parts, longest).join(_states(tries), ["trie", "state"]).join(every, ["lang", "codes"]).select("lang", "codes", "words", "n"),
        "phrase-counts",
    )
    for _, b in sent:
        b.destroy()
    return counted, totals


def collocations(
    docs: DataFrame, longest: int = 5, least: int = 100, first: int = 2000, text_col: str = "text", lang_col: str = "lang",
    trie_nodes: int = 100_000,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases by score, count and
    words. A phrase is scored at its weakest cut, ``floor(1000 a n / (l r))``, the shortest first part
    among equals; phrases that stand only inside longer ones are dropped."""
    counted, totals = phrase_counts(docs, longest, least, text_col, lang_col, trie_nodes)
    phrases = counted.where(F.size("codes") >= 2)
    # Counts fall from part to whole, so a phrase inside a longer one with its own count is inside one a
    # word longer with that count.
    inner = phrases.where(F.size("codes") >= 3)
    inside = inner.select("lang", F.col("n").alias("a"), F.expr("slice(codes, 1, size(codes) - 1)").alias("codes")).unionByName(
        inner.select("lang", F.col("n").alias("a"), F.expr("slice(codes, 2, size(codes) - 1)").alias("codes"))
    )
    free = phrases.withColumnRenamed("n", "a").join(inside.distinct(), ["lang", "codes", "a"], "left_anti")
    cuts = free.select("lang", "codes", "words", "a", F.explode(F.expr("sequence(1, size(codes) - 1)")).alias("k"))
    left, right = (counted.select("lang", F.col("codes").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    cuts = (
        cuts.withColumn("left", F.expr("slice(codes, 1, k)")).withColumn("right", F.expr("slice(codes, k + 1, size(codes) - k)"))
        .join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
        .withColumn("whole", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")))
        .withColumn("parts", F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)"))
        .withColumn("score", F.expr("whole div parts"))
    )
    scored = cuts.groupBy("lang", "codes").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n", "words")).alias("s")
    ).select("lang", F.concat_ws(" ", "s.words").alias("phrase"), "s.a", "s.l", "s.r", "s.n", "s.score")
    # Ties end by the words' UTF-8 bytes. Each task keeps its own first rows before the one of the language.
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.encode("phrase", "UTF-8"))
    part = Window.partitionBy("lang", "share").orderBy(F.desc("score"), F.desc("a"), F.encode("phrase", "UTF-8"))
    short = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("p", F.row_number().over(part)).where(F.col("p") <= first)
    return short.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= first).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
