"""Secret scans with one deterministic automaton for all rules.

Each rule is a head (a regular expression) followed by a run of tail bytes, of which a passing match
has a least number. The rules are compiled together: Thompson construction from the parsed
expressions, subset construction over classes of bytes that no rule tells apart, then minimisation,
into one transition array whose accepting state is absorbing. Scanning is one pass over the bytes:
bytes that lead every state back to the start (line ends, most punctuation, all non-ASCII bytes) cut
the text into segments, and the segments of many texts step through the array together. Segments that
reach the accepting state, few, are walked again with each rule's own automaton, which gives the
leftmost non-overlapping matches per rule; those with too short a tail are dropped after they have
consumed their text.
"""

from __future__ import annotations

import re._parser as regex_parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelab.llm.common import ship, utf8

#: Kind, head, tail class, least tail. The first three are the base rules.
RULES = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]", 12),
    ("access", r"AKIA", r"[A-Z0-9]", 14),
    ("hex", r"", r"[0-9a-f]", 16),
    ("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    ("slack", r"xox[abprs]-", r"[A-Za-z0-9-]", 24),
    ("google", r"AIza", r"[0-9A-Za-z_-]", 35),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY", r"[-]", 5),
)
BASE = ("assign", "access", "hex")
#: Tail bytes of the rules beyond the base ones that the shared pass waits for; the walk checks the rest.
EARLY_TAIL = 4
#: Segments that step together at least; fewer go on one by one.
FEW = 12


class _Nfa:
    """Thompson automaton over bytes, grown from Python's own parse of an expression."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def grow(self, tree, at: int, fold: bool = False) -> int:
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN"):
                end = self.state()
                self.arcs[at].append((_byte_set(name, arg, fold), end))
                at = end
            elif name == "SUBPATTERN":
                at = self.grow(arg[3], at, fold or bool(arg[1] & 2))
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    begin = self.state()
                    self.eps[at].append(begin)
                    self.eps[self.grow(branch, begin, fold)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low):
                    at = self.grow(body, at, fold)
                if high == regex_parser.MAXREPEAT:
                    loop = self.state()
                    self.eps[at].append(loop)
                    self.eps[self.grow(body, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.eps[at].append(end)
                    for _ in range(high - low):
                        at = self.grow(body, at, fold)
                        self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules may not use {name}")
        return at

    def close(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.eps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _byte_set(name: str, arg, fold: bool) -> frozenset:
    if name == "LITERAL":
        got = {arg}
    else:
        got = set()
        for op, value in arg:
            if str(op) == "LITERAL":
                got.add(value)
            elif str(op) == "RANGE":
                got |= set(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"rules may not use {op} in a class")
    if fold:
        got |= {ord(f(chr(c))) for c in got if c < 128 for f in (str.lower, str.upper)}
    return frozenset(c for c in got if c < 128)


@dataclass
class Automaton:
    """``table[state, class]`` is the next state, ``classes[byte]`` a byte's class; start state 0."""

    table: np.ndarray
    classes: np.ndarray
    accepting: np.ndarray


def _byte_classes(arcs) -> tuple[np.ndarray, list[int]]:
    sets = list({s for of in arcs for s, _ in of})
    named: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    for b in range(256):
        classes[b] = named.setdefault(tuple(b in s for s in sets), len(named))
    first = [int(np.flatnonzero(classes == c)[0]) for c in range(len(named))]
    return classes, first


def determinise(nfa: _Nfa, start: int, finals: set[int], search: bool) -> Automaton:
    """Subset construction. ``search`` begins anew at every byte and stops at the first acceptance
    (one absorbing accepting state); otherwise matching is anchored and state -1 is failure."""
    classes, first = _byte_classes(nfa.arcs)
    begin = nfa.close({start})
    hit = frozenset({-1})
    number = {begin: 0}
    todo, rows, accepts = [begin], [], []
    while todo:
        here = todo.pop(0)
        accepts.append(here == hit or bool(here & finals))
        row = []
        for byte in first:
            if here == hit:
                there = hit
            else:
                moved = {t for s in here for on, t in nfa.arcs[s] if byte in on}
                there = nfa.close(moved | ({start} if search else set()))
                if search and there & finals:
                    there = hit
            if not there:
                row.append(-1)
                continue
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        rows.append(row)
    return minimise(Automaton(np.array(rows, np.int32), classes, np.array(accepts)))


def minimise(a: Automaton) -> Automaton:
    """Merge states that no input tells apart, refining blocks until they are stable."""
    block = a.accepting.astype(np.int64)
    while True:
        after = np.where(a.table >= 0, block[a.table], -1)
        _, new = np.unique(np.column_stack([block, after]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    order = np.full(block.max() + 1, len(block))
    np.minimum.at(order, block, np.arange(len(block)))
    rank = np.argsort(np.argsort(order))  # the start state's block comes first
    block, keep = rank[block], np.sort(order)
    table = np.where(a.table[keep] >= 0, block[a.table[keep]], -1)
    return Automaton(table.astype(np.int32), a.classes, a.accepting[keep])


@dataclass
class Rule:
    kind: str
    head: list[list[int]]
    classes: bytes
    ends: list[bool]
    tail: frozenset
    begins: frozenset
    least: int


@dataclass
class Scanner:
    shared: Automaton
    resets: np.ndarray
    rules: list[Rule]
    shortest: int


@lru_cache(maxsize=4)
def compile_rules(rules: tuple = RULES) -> Scanner:
    nfa = _Nfa()
    start, finals = nfa.state(), set()
    walks = []
    for kind, head, tail, least in rules:
        begin = nfa.state()
        nfa.eps[start].append(begin)
        wait = least if kind in BASE else min(least, EARLY_TAIL)
        finals.add(nfa.grow(regex_parser.parse(f"{head}{tail}{{{wait}}}"), begin))
        own = _Nfa()
        first = own.state()
        alone = determinise(own, first, {own.grow(regex_parser.parse(head), first)}, search=False)
        op, of = regex_parser.parse(tail)[0]
        run = _byte_set(str(op), of, False)
        begins = frozenset(b for b in range(256) if alone.table[0, alone.classes[b]] >= 0) if head else run
        walks.append(Rule(kind, alone.table.tolist(), alone.classes.tobytes(), alone.accepting.tolist(), run, begins, least))
    shared = determinise(nfa, start, finals, search=True)
    open_rows = shared.table[~shared.accepting]
    back = (open_rows == 0).all(0)
    # Fewest bytes to acceptance: shorter segments need no scan.
    reached, shortest = np.zeros(len(shared.table), bool), 0
    reached[0] = True
    while not (reached & shared.accepting).any():
        reached[np.unique(shared.table[reached])] = True
        shortest += 1
    return Scanner(shared, back[shared.classes], walks, shortest)


def _hit_segments(data: np.ndarray, scanner: Scanner) -> list[tuple[int, int]]:
    """Segments of ``data`` in which the shared automaton accepts, in order."""
    cuts = np.flatnonzero(scanner.resets[data])
    begins = np.r_[0, cuts + 1]
    sizes = np.r_[cuts, len(data)] - begins
    long = sizes >= scanner.shortest
    begins, sizes = begins[long], sizes[long]
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    classes = scanner.shared.classes[data]
    width = scanner.shared.table.shape[1]
    flat = (scanner.shared.table * width).ravel()  # states premultiplied: one addition a step
    state = np.zeros(len(begins), np.int32)
    lanes = len(begins)
    steps = int(sizes[FEW - 1]) if lanes >= FEW else 0  # beyond them fewer than FEW segments go on
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right").tolist()
    for step, k in enumerate(active):
        state[:k] = flat[state[:k] + classes[begins[:k] + step]]
    rows = scanner.shared.table.tolist()
    for i in range(int((sizes > steps).sum())):  # the few longest go on alone
        s = int(state[i]) // width
        for c in classes[begins[i] + steps : begins[i] + sizes[i]].tobytes():
            s = rows[s][c]
        state[i] = s * width
    hit = np.flatnonzero(scanner.shared.accepting[state // width])
    return sorted((int(begins[i]), int(begins[i] + sizes[i])) for i in hit)


def _walk(data: bytes, begin: int, end: int, rule: Rule) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule in a segment whose tail is long enough."""
    at = begin
    while at < end:
        if data[at] not in rule.begins:
            at += 1
            continue
        state, stop, i = 0, (at if rule.ends[0] else -1), at
        while i < end:
            state = rule.head[state][rule.classes[data[i]]]
            if state < 0:
                break
            i += 1
            if rule.ends[state]:
                stop = i
        if stop < 0:
            at += 1
            continue
        i = stop
        while i < end and data[i] in rule.tail:
            i += 1
        if i == stop:
            at += 1
            continue
        if i - stop >= rule.least:
            yield at, i
        at = i


def scan_texts(texts: list[bytes], scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text: ``(start, end, rule number)`` in code points, by start and then rule."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    data = b"\n".join(texts)
    view = np.frombuffer(data, np.uint8)
    heads = np.cumsum([0] + [len(t) + 1 for t in texts])
    for begin, end in _hit_segments(view, scanner):
        no = int(np.searchsorted(heads, begin, side="right")) - 1
        head = int(heads[no])
        for k, rule in enumerate(scanner.rules):
            for a, b in _walk(data, begin, end, rule):
                found[no].append((a - head, b - head, k))
    for no, spans in enumerate(found):
        if spans:
            spans.sort(key=lambda s: (s[0], s[2]))
            head = int(heads[no])
            lead = np.cumsum((view[head : head + len(texts[no])] & 0xC0) != 0x80)
            point = lambda at: int(lead[at - 1]) if at else 0
            # Matches are ASCII, so a span's length is the same in bytes and code points.
            found[no] = [(point(a), point(a) + b - a, k) for a, b, k in spans]
    return found


SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _batches(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    from tidelab.llm.tokens import slices

    return slices(texts, most)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """``(doc_id, spans)`` for every row: all spans by start and then rule, in code points, end
    exclusive. Null and empty texts have no spans, repeated rows each get their row, other columns
    are not read, an empty table gives no rows."""
    ship(docs.sparkSession)
    scanner = compile_rules(rules)  # sent with the task: its size depends on the rules alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = []
            for a, b in _batches(texts):
                out += [
                    [{"kind": rules[k][0], "start": s, "end": e} for s, e, k in spans]
                    for spans in scan_texts(texts[a:b], scanner)
                ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN_TYPE)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """``docs`` with every secret in its texts replaced by ``mark``; ``n_chars``, where it is a
    column, is counted anew for the texts that changed. All rows and columns stay."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    count_at = names.index("n_chars") if "n_chars" in names else None
    scanner = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]
            new, count = None, None
            for a, b in _batches(texts):
                for no, spans in enumerate(scan_texts(texts[a:b], scanner), a):
                    if not spans:
                        continue
                    if new is None:
                        new = column.to_pylist()
                        count = batch.column(count_at).to_pylist() if count_at is not None else None
                    text, parts, last = new[no], [], 0
                    for start, end, _ in spans:
                        if start >= last:
                            parts += [text[last:start], mark]
                        last = max(last, end)
                    new[no] = "".join(parts) + text[last:]
                    if count is not None:
                        count[no] = len(new[no])
            if new is not None:
                arrays = list(batch.columns)
                arrays[at] = pa.array(new, column.type)
                if count is not None:
                    arrays[count_at] = pa.array(count, arrays[count_at].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``: per base rule a count, the SHA-256 of the base spans
    as ``kind:start:end`` joined by commas, and all spans joined alike."""
    shown = lambda of: F.array_join(
        F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[of_kind(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
