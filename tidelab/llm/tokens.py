"""Whole-text encoding with the ``tokenizers`` library inside tasks.

Both vocabularies split a text at white space before merging, so a word's ids do not depend on its
neighbours. ``WordwiseEncoder`` uses that: it has the library encode each distinct word once, keeps
the ids in a bounded table, and joins them per text. They split letters from signs too, so a word with
a comma or a full stop after it is the word's ids and the sign's. Texts whose white space is not plain
single blanks and line ends (where a run of white space is a token of its own) are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WIDE_SPACE = re.compile(r"\s\s|^\s|\s$")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_GROUP = 400  # words handed to the library in one string


def _wide(text: str) -> bool:
    """Whether white space other than single blanks and line ends inside stands in ``text``; a search for
    the usual two goes first, as it is several times faster than the expression."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace():
        return True
    return _OTHER_SPACE.search(text) is not None and (_WIDE_SPACE.search(text) is not None or "\r" in text)


class WordwiseEncoder:
    """``encode(texts) -> list[bytes]``: little-endian ids of each text, ``width`` bytes an id.

    ``kind`` is ``"bytes"`` (byte-level BPE: a blank belongs to the word after it) or ``"words"``
    (white space and letter case are dropped). ``capacity`` bounds the table of words; at the bound
    the longer words, which come back least, are dropped.
    """

    def __init__(self, path: str, kind: str, capacity: int = 800_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads; the library's own hold memory
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind, self.capacity = kind, capacity
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.mark = "\n" if kind == "bytes" else "\x01"
        self.mark_ids = self.tok.encode(self.mark, add_special_tokens=False).ids
        self.signs = dict(zip(",.", self.whole([",", "."]), strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, self.dtype).tobytes()
            for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn(self, table: dict[str, bytes], words: list[str], shown: list[str]) -> None:
        """Encode ``shown[i]`` as the ids of ``words[i]``, many in a string where a mark that is a
        token by itself can tell them apart."""
        mark, one_id = self.mark, len(self.mark_ids) == 1
        apart = [not one_id or mark in s or not s or s.isspace() for s in shown]
        if any(apart):
            alone = [i for i, x in enumerate(apart) if x]
            table.update(zip([words[i] for i in alone], self.whole([shown[i] for i in alone]), strict=True))
            words = [w for w, x in zip(words, apart, strict=True) if not x]
            shown = [s for s, x in zip(shown, apart, strict=True) if not x]
        between = mark if self.kind == "bytes" else f" {mark} "
        at = range(0, len(words), _GROUP)
        joined = self.tok.encode_batch_fast([between.join(shown[i : i + _GROUP]) for i in at], add_special_tokens=False)
        for i, e in zip(at, joined, strict=True):
            block = words[i : i + _GROUP]
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark_ids[0])
            if len(cuts) != len(block) - 1:  # the mark's id came up inside a word
                table.update(zip(block, self.whole(shown[i : i + _GROUP]), strict=True))
                continue
            raw = ids.tobytes()
            begin, end = [0, *((cuts + 1) * self.width).tolist()], [*(cuts * self.width).tolist(), len(raw)]
            table.update(zip(block, map(raw.__getitem__, map(slice, begin, end)), strict=True))

    def _learn_inner(self, words: list[str]) -> dict[str, bytes]:
        """The ids of ``words``. Their base forms (without a sign at the end, in the case the vocabulary
        sees) go into the table; the other forms do not."""
        signs, lower = self.signs, self.kind == "words"
        bases, ends = [], []
        for w in words:
            if w[-1:] in signs and w[:-1].lstrip("\n").isalpha():
                base = w[:-1]
                ends.append(signs[w[-1]])
            else:
                base = w
                ends.append(b"")
            bases.append(base.lower() if lower and base.isascii() else base)
        new = list(set(bases).difference(self.inner))
        self._learn(self.inner, new, new if lower else [w if w[:1] == "\n" else " " + w for w in new])
        get = self.inner.__getitem__
        return {w: get(base) + end for w, base, end in zip(words, bases, ends, strict=True)}

    def _trim(self) -> None:
        """Drop the longer words, then shorter ones, until a third of the table is free."""
        longest = 9
        while len(self.inner) > 2 * self.capacity // 3 and longest >= 0:
            self.inner = {w: ids for w, ids in self.inner.items() if len(w) <= longest}
            longest -= 1

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = range(len(texts))
        if self.kind == "bytes":
            wide = [_wide(t) for t in texts]
            plain = [i for i, w in enumerate(wide) if not w]
            odd = [i for i, w in enumerate(wide) if w]
            for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
        if len(self.inner) > self.capacity:
            self._trim()
        if len(self.first) > self.capacity:
            self.first.clear()
        shown = pa.array([texts[i] for i in plain], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(shown, "\n", " " if self.kind == "words" else " \n"), " ")
        begin = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads: list[str] = []
        if self.kind == "bytes":  # no blank stands before a text's first word
            at = begin[:-1]
            heads = [words[c] for c in codes[at].tolist()]
            new = list(set(heads).difference(self.first))
            self._learn(self.first, new, new)
            codes[at] = len(words)
            used = np.bincount(codes, minlength=len(words) + 1)[:-1] > 0
            place = np.cumsum(used) - 1
            words = [w for w, u in zip(words, used.tolist(), strict=True) if u]
            codes = np.append(place, 0)[codes]
            codes[at] = len(words) + np.arange(len(heads))
        ids = list(map(self.inner.get, words))
        learnt = self._learn_inner([w for w, i in zip(words, ids, strict=True) if i is None])
        ids = [learnt[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        ids += map(self.first.__getitem__, heads)
        # Taken in the order of the words, the ids of a text lie one after the other.
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64)[taken.offset : taken.offset + len(taken) + 1]
        cuts = ends[begin].tolist()
        joined = memoryview(data if data is not None else b"")
        for i, a, b in zip(plain, cuts, cuts[1:], strict=False):
            out[i] = bytes(joined[a:b])
        return out


_made: dict[tuple, WordwiseEncoder] = {}


def encoder(path: str, kind: str) -> WordwiseEncoder:
    """One encoder per worker process, so its table serves task after task."""
    if (path, kind) not in _made:
        _made[(path, kind)] = WordwiseEncoder(path, kind)
    return _made[(path, kind)]


def release() -> None:
    """Forget the encoders of this worker process; a later task that encodes makes them anew."""
    _made.clear()


def slices(texts: list, most: int = 5 << 19):
    """Index ranges of ``texts`` with about ``most`` characters each (a longer text alone)."""
    yield from runs(map(len, texts), most)


def runs(sizes, most: int):
    """Index ranges whose ``sizes`` add up to about ``most`` each (a larger one alone)."""
    at = size = i = 0
    for i, n in enumerate(sizes, 1):
        if i - 1 > at and size + n > most:
            yield at, i - 1
            at, size = i - 1, 0
        size += n
    if at < i:
        yield at, i
