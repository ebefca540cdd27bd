"""Secret scans: base patterns plus probabilistic automata inferred from labelled credentials.

For every format of the labelled credentials a prefix tree over character
classes is grown and its states are merged while their outgoing frequencies
agree within Hoeffding's bound, which leaves a small stochastic automaton; the
same is done for the plain tokens.  Every candidate token of every text is
scored by each automaton, whether base patterns touch it or not; one whose best
format beats the plain automaton by `margin` nats becomes a span of its own.
Where a whole run of candidate characters is plain, its pieces between `/`, `=`
and `.` are candidates too, so that a path or a key does not hide what it leads to.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import require

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{16,}")
PLAIN = "plain"
REDACTED = "[SECRET]"
MARGIN = 12.0
#: With fewer tokens left, arrays cost more than they save.
FEW = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns: leftmost, not overlapping within a kind, short matches dropped.

    A run of hexadecimal digits or capitals lies inside one candidate run, so
    those two kinds are looked for there only.
    """
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for c in CANDIDATE.finditer(text):
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text, *c.span())]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text, *c.span())]
    return found


CLASSES = (string.digits, "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
CLASS_OF = np.full(128, -1, dtype=np.int8)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[[ord(c) for c in _chars]] = _k
END = len(CLASSES)


def labelled_credentials(n: int = 400, seed: int = 42) -> list[tuple[str, str]]:
    """(format, token) training rows, drawn from a rule for each format; the format `plain` is no credential.

    A user with credentials of their own passes those instead.
    """
    r = random.Random(seed)
    b64, b62, up = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    draw = lambda chars, k: "".join(r.choices(chars, k=k))
    syllables = [a + b for a in "bcdfghlmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "on", "th", "ou", "st")]
    word = lambda k: "".join(r.choices(syllables, k=k))
    rules = {
        "access": lambda: "AKIA" + draw(up, 16),
        "hexadecimal": lambda: draw("0123456789abcdef", r.choice((32, 40, 64))),
        "base64": lambda: draw(b64, r.choice((32, 40, 44, 64))),
        "prefixed": lambda: r.choice(("ghp_", "gho_", "sk_live_", "pk_live_", "glpat-")) + draw(b62, r.choice((20, 24, 36))),
        "dashed": lambda: "xoxb-" + draw(string.digits, 12) + "-" + draw(b62, 24),
        "dotted": lambda: ".".join("eyJ" + draw(b62 + "_-", r.randint(16, 40)) for _ in range(2)) + "." + draw(b62 + "_-", 43),
    }
    plain = (
        lambda: word(r.randint(5, 14)),
        lambda: word(r.randint(5, 9)).upper(),
        lambda: word(r.randint(4, 9)).capitalize() + r.choice((".", "", "...")),
        lambda: "-".join(word(r.randint(2, 4)) for _ in range(r.randint(2, 4))),
        lambda: "_".join(word(r.randint(2, 4)) for _ in range(r.randint(2, 4))),
        lambda: f"{word(3)}{r.randint(0, 99)}.example.com/{word(2)}/{r.randint(1, 9999)}.html",
        lambda: f"{word(3)}.{word(3)}.example.org",
        lambda: f"20{draw(string.digits, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}-{word(3)}",
        lambda: draw(string.digits, r.randint(16, 19)),
        lambda: draw("-=_.", 1) * r.randint(16, 40),
        lambda: word(3).capitalize() + word(3).capitalize() + word(2).capitalize(),
        lambda: "".join(word(r.randint(1, 3)).capitalize() for _ in range(r.randint(3, 6))) + r.choice(("", "", "2", "V1")) + word(1).capitalize(),
        lambda: word(2) + "".join(word(r.randint(1, 2)).capitalize() for _ in range(r.randint(2, 4))),
        lambda: "_".join(word(r.randint(1, 3)).upper() for _ in range(r.randint(3, 5))),
        lambda: "__".join(word(r.randint(2, 4)) for _ in range(2)) + r.choice(("__", "_1", "2")),
        lambda: ".".join("_".join(word(r.randint(1, 3)) for _ in range(r.randint(1, 2))) for _ in range(r.randint(2, 4))),
        lambda: "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: "/".join(word(r.randint(1, 3)) for _ in range(r.randint(3, 6))) + r.choice(("", ".py", ".html", "/")),
        lambda: f"{word(r.randint(2, 3))}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}.{word(1)}.{word(1)}",
    )
    rows = [(name, rule()) for name, rule in rules.items() for _ in range(n)]
    return rows + [(PLAIN, p()) for p in plain for _ in range(n)]


@dataclass
class Automaton:
    """Row s of `step` and `cost` hold, for each class and for the end, the next state and the natural log of the probability."""

    step: np.ndarray
    cost: np.ndarray


def infer(tokens: Iterable[str], alpha: float = 0.05, smooth: float = 1.0) -> Automaton:
    """The automaton of `tokens`: a prefix tree whose statistically compatible states are merged.

    States are taken in breadth-first order; each is folded into the first
    kept state of the same incoming class whose outgoing frequencies, and those
    of the states below both, differ by less than Hoeffding's bound at `alpha`.
    A state seen once cannot differ from anything by that much.
    """
    strings = [[int(CLASS_OF[ord(c)]) for c in t if ord(c) < 128 and CLASS_OF[ord(c)] >= 0] for t in tokens]
    child: list[dict[int, int]] = [{}]
    count: list[Counter] = [Counter()]
    into = [END]
    for s in strings:
        at = 0
        for c in s:
            count[at][c] += 1
            if c not in child[at]:
                child[at][c] = len(child)
                child.append({})
                count.append(Counter())
                into.append(c)
            at = child[at][c]
        count[at][END] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = sum(count[x].values()), sum(count[y].values())
            if not n or not m or m <= bound**2:
                continue  # no share can differ by that much, here or in the tree below y
            far = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(count[x][k] / n - count[y][k] / m) > far for k in count[x].keys() | count[y].keys()):
                return False
            todo += [(child[x][k], child[y][k]) for k in child[x].keys() & child[y].keys()]
        return True

    def fold(a: int, b: int) -> None:
        """Add the subtree of b to a; `child` of a kept state may lead anywhere, that of b only down its tree."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            count[x] += count[y]
            for k, down in child[y].items():
                if k in child[x]:
                    todo.append((child[x][k], down))
                else:
                    child[x][k] = down

    kept, at = [0], 0
    while at < len(kept):
        state = kept[at]
        at += 1
        for k in sorted(child[state]):
            down = child[state][k]
            if down in kept:
                continue
            same = next((x for x in kept if into[x] == k and alike(x, down)), None)
            if same is None:
                kept.append(down)
            else:
                child[state][k] = same
                fold(same, down)
    number = {s: i for i, s in enumerate(kept)}
    # what a state has not seen has `smooth` tokens' weight, spread as in all tokens, and leads where that class mostly leads
    overall = Counter(c for s in strings for c in [*s, END])
    share = [(overall[k] + 1) / (sum(overall.values()) + END + 1) for k in range(END + 1)]
    usual = [max((s for s in kept if into[s] == k), key=lambda s: sum(count[s].values()), default=0) for k in range(END + 1)]
    step = np.zeros((len(kept), END + 1), dtype=np.int32)
    cost = np.zeros((len(kept), END + 1))
    for s, i in number.items():
        total = sum(count[s].values()) + smooth
        for k in range(END + 1):
            size = len(CLASSES[k]) if k < END else 1
            cost[i, k] = math.log((count[s][k] + smooth * share[k]) / total / size)
            step[i, k] = number.get(child[s].get(k, -1), number[usual[k]])
    return Automaton(step, cost)


class Grammar:
    """One automaton for each format, and scoring of many tokens at once."""

    def __init__(self, labelled: Iterable[tuple[str, str]]) -> None:
        by = defaultdict(list)
        for name, token in labelled:
            by[name].append(token)
        if PLAIN not in by or len(by) < 2:
            raise ValueError("labelled credentials need the format 'plain' and one more")
        self.formats = [PLAIN, *sorted(set(by) - {PLAIN})]
        self.automata = [infer(by[f]) for f in self.formats]
        # one table of all automata: the entry of a state and a class is at state + class
        size = [len(a.cost) * (END + 1) for a in self.automata]
        self.first = np.cumsum([0, *size[:-1]])
        self.cost = np.concatenate([a.cost.ravel() for a in self.automata])
        self.step = np.concatenate([a.step.ravel().astype(np.int64) * (END + 1) + f for a, f in zip(self.automata, self.first, strict=True)])
        self.cost_list, self.step_list = self.cost.tolist(), self.step.tolist()

    def score(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of ASCII: its best format's index, and that format's log-likelihood over that of `plain`.

        All automata take a symbol of all tokens at a time; the rest of the few
        longest tokens is stepped through without arrays, so a long run costs
        time in proportion to its length.
        """
        if not tokens:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        order = np.argsort(-length, kind="stable")
        data = CLASS_OF[np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)].astype(np.int64)
        start, length = (np.cumsum(length) - length)[order], length[order]
        state, total = np.repeat(self.first[:, None], len(tokens), axis=1), np.zeros((len(self.first), len(tokens)))
        together = int(length[min(FEW, len(tokens)) - 1]) if len(tokens) >= FEW else 0
        for k in range(together):
            n = int(np.searchsorted(-length, -k, side="left"))
            at = state[:, :n] + data[start[:n] + k]
            total[:, :n] += self.cost[at]
            state[:, :n] = self.step[at]
        cost, step = self.cost_list, self.step_list
        for i in range(int(np.searchsorted(-length, -together, side="left"))):
            rest = data[start[i] + together : start[i] + length[i]].tolist()
            for a in range(len(self.first)):
                at, sum_ = int(state[a, i]), 0.0
                for c in rest:
                    sum_ += cost[at + c]
                    at = step[at + c]
                state[a, i] = at
                total[a, i] += sum_
        total += self.cost[state + END]
        best = total[1:].argmax(axis=0) + 1
        lift = total[best, np.arange(len(tokens))] - total[0]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return best[back], lift[back]


def grammar_spans(text: str, grammar: Grammar, margin: float) -> list[tuple[int, int, int]]:
    """Candidate tokens that score as a credential: whole runs, and pieces of the runs that do not."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    _, lift = grammar.score([text[a:b] for a, b in runs])
    found = [r for r, x in zip(runs, lift.tolist(), strict=True) if x > margin]
    pieces = [m.span() for r, x in zip(runs, lift.tolist(), strict=True) if x <= margin for m in PIECE.finditer(text, *r) if m.span() != r]
    if pieces:
        _, lift = grammar.score([text[a:b] for a, b in pieces])
        found += [r for r, x in zip(pieces, lift.tolist(), strict=True) if x > margin]
    return [(a, b, 3) for a, b in found]


def _spans(text: str, grammar: Grammar, margin: float) -> list[tuple[int, int, int]]:
    """Base spans, and grammar spans that no base span covers, by start, then kind."""
    base = base_spans(text)
    added = grammar_spans(text, grammar, margin)
    if base and added:
        # in order of start, the furthest end so far is that of a span that starts no later
        starts = sorted((s, e) for s, e, _ in base)
        first, ends = [s for s, _ in starts], list(accumulate((e for _, e in starts), max))
        added = [(a, b, k) for a, b, k in added if not (i := bisect_right(first, a)) or ends[i - 1] < b]
    return sorted(base + added, key=lambda s: (s[0], s[2]))


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: Iterable[tuple[str, str]] | None = None, margin: float = MARGIN) -> DataFrame:
    """Every secret of every row: (doc_id, spans array<struct<kind, start, end>>), in order of start, then kind.

    Offsets are code points, ends exclusive.  Null texts count as empty;
    repeated rows give repeated rows; an empty table gives an empty table;
    other columns are left out.
    """
    kind = f"doc_id {_id(docs, id_col, text_col)}, spans array<struct<kind:string,start:int,end:int>>"
    grammar = _shared(docs, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in _spans(t or "", grammar.value, margin)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return _rows(docs, id_col, text_col).mapInArrow(run, kind)


def scan_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: Iterable[tuple[str, str]] | None = None, margin: float = MARGIN) -> DataFrame:
    """As `scan`, reduced to counts of the base kinds, a digest of the base spans and one string of all spans."""
    kind = f"doc_id {_id(docs, id_col, text_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long"
    grammar = _shared(docs, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"]
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                spans = _spans(t or "", grammar.value, margin)
                n = Counter(k for _, _, k in spans)
                base = _digest([s for s in spans if s[2] < 3])
                rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), _digest(spans), n[3]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return _rows(docs, id_col, text_col).mapInArrow(run, kind)


def redact(docs: DataFrame, text_col: str = "text", labelled: Iterable[tuple[str, str]] | None = None, margin: float = MARGIN, mark: str = REDACTED) -> DataFrame:
    """`docs` with every secret in `text_col` replaced by `mark`, overlapping ones by one mark.

    Other columns and null texts stay as they are; so do repeated rows and null
    ids; an empty table gives an empty table.
    """
    require(docs, text_col)
    grammar, at = _shared(docs, labelled), docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for a, b, _ in _spans(text, grammar.value, margin):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _id(docs: DataFrame, id_col: str, text_col: str) -> str:
    require(docs, id_col, text_col)
    return docs.schema[id_col].dataType.simpleString()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _shared(docs: DataFrame, labelled: Iterable[tuple[str, str]] | None):
    """The automata, broadcast; their size is that of the labelled credentials' grammar."""
    return docs.sparkSession.sparkContext.broadcast(Grammar(labelled_credentials() if labelled is None else labelled))
