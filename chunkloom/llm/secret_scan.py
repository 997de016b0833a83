"""Operator 6: secret scans by grammar inference.

``labelled`` gives credentials of well-known public formats and ordinary long strings of several
sorts, each with its kind. For each kind a prefix tree of its strings is built and its states are merged
while they are statistically compatible (Hoeffding bound on the frequencies of ending and of
each next symbol, applied to all futures of both states; red-blue order): a probabilistic
finite automaton. Symbols are characters in a string's first ``LITERAL`` places and character
classes after it, so that prefixes count and random bodies generalise.

A text's runs are its maximal runs of at least ``LEAST`` characters of [A-Za-z0-9+/_-] (the shortest
labelled credential has 20). Candidates are all parts of a run that begin at the run's begin or behind a
separator (+ / _ -), end at the run's end or before a separator, and have ``LEAST`` characters,
inside the run with a letter or digit at either end. A
candidate's score is its log likelihood under the best automaton of a credential format less that
under the best one of ordinary strings, which reads the whole run, so that a part of a path, a
name or encoded data is held against what it is a part of. Runs of over ``ENCODED`` characters are also
held against an automaton of encoded data, as a part of such data looks like a credential
without a prefix. From ``THRESHOLD`` on a candidate is a secret; of those that overlap the one with the
highest score counts.

Every begin is followed through the run until its score is ``DROP`` below the best it had, which
happens after a few characters where a format's prefix is missing, so the work is in
proportion to the run's length, and its middle is read like its ends.

The automata are learned on the driver from ``per_kind`` strings of each kind (a parameter)
and are a few hundred states; runs are found with NumPy on the bytes of a slice of
documents, and only they are looked at one by one.

Defined results: null and empty texts hold no secret; a secret that repeats has a row for each
place; very long texts and runs are read whole; of candidates with one score the first counts; encoded
data as a whole is no secret; a credential without a prefix of its own (aws_secret) inside a
run of over ``ENCODED`` characters can't be told from encoded data and is left; an empty table gives an
empty result; further columns are ignored, and kept by ``redact``; repeated rows give repeated
results; a null doc_id stays null.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEAST, LITERAL, THRESHOLD, DROP, ENCODED = 16, 4, 8.0, 30.0, 80
ORDINARY = "ordinary "
SEPARATORS = frozenset("+/_-")
MASK = "[SECRET]"
_SCHEMA = "doc_id bigint, start int, end int, kind string, score double, sha string"
_RUN = np.array([chr(b) in string.ascii_letters + string.digits + "+/_-" if b < 128 else False for b in range(256)])
_SMOOTH, _ALPHABET, _RARE = 0.05, 80, 1e-5


# --- labelled strings


def labelled(per_kind: int = 300, seed: int = 11) -> list[tuple[str, str]]:
    """(kind, string): ``per_kind`` strings of each credential format and of each ordinary sort."""
    r = random.Random(seed)
    hexa, b36, b62 = "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    b64 = b62 + "+/"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    formats = {
        "hex_token": lambda: some(hexa, r.choice([32, 40, 40, 40, 64])),
        "aws_access_key": lambda: r.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + "234567", 16),
        "aws_secret": lambda: some(b64, 40),
        "github_token": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(b62, 36),
        "google_key": lambda: "AIza" + some(b62 + "-_", 35),
        "slack_token": lambda: f"{r.choice(['xoxb', 'xoxp'])}-{some(string.digits, 12)}-{some(string.digits, 12)}-{some(b62, 24)}",
        "stripe_key": lambda: f"{r.choice(['sk_live_', 'rk_live_', 'sk_test_'])}{some(b62, r.choice([24, 32]))}",
        "jwt_part": lambda: "eyJ" + some(b62 + "-_", r.randint(20, 120)),
        "lower_token": lambda: some(b36, r.choice([24, 32, 36])),
    }
    onset = ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "th", "sh", "ch", "qu", "pr", "bl", "", ""]
    rime = ["a", "e", "i", "o", "u", "an", "en", "in", "on", "er", "or", "es", "ing", "ent", "ion", "able", "ed", "ly", "at", "ou", "eau", "ung", "ich", "ar", "os", "as", "nd", "nt", "st"]

    def word(n: int) -> str:
        w = ""
        while len(w) < n:
            w += r.choice(onset) + r.choice(rime)
        return w

    ordinary = {
        "word": lambda: word(r.randint(LEAST, 36)),
        "title": lambda: word(r.randint(LEAST, 36)).capitalize(),
        "upper": lambda: word(r.randint(LEAST, 36)).upper(),
        "dashed": lambda: r.choice("-=/+").join(word(r.randint(2, 9)) for _ in range(r.randint(3, 6))),
        "snake": lambda: "_".join(word(r.randint(2, 9)) for _ in range(r.randint(3, 6))),
        "constant": lambda: "_".join(word(r.randint(2, 9)) for _ in range(r.randint(3, 6))).upper(),
        "camel": lambda: "".join(word(r.randint(3, 9)).capitalize() for _ in range(r.randint(3, 5))),
        "number": lambda: some(string.digits, r.randint(LEAST, 24)),
        "rule": lambda: r.choice("-=_+/") * r.randint(LEAST, 60),
        "dated": lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{word(6)}-{word(5)}",
        "numbers": lambda: r.choice("-_/").join(some(string.digits, r.randint(2, 6)) for _ in range(r.randint(3, 6))),
        "encoded": lambda: some(b62 + r.choice(["+/", "-_"]), r.randint(ENCODED, 2 * ENCODED)),
    }
    out = [(kind, make()) for kind, make in formats.items() for _ in range(per_kind)]
    out += [(ORDINARY + kind, make()) for kind, make in ordinary.items() for _ in range(per_kind)]
    return [(kind, s) for kind, s in out if len(s) >= LEAST]


# --- inference


def symbols(s: str) -> list[str]:
    out = []
    for i, c in enumerate(s):
        if i < LITERAL:
            out.append(c)
        elif "0" <= c <= "9":
            out.append("digit")
        elif "a" <= c <= "f":
            out.append("hex")
        elif c in "eiou":
            out.append("vowel")
        elif "g" <= c <= "z":
            out.append("lower")
        elif "A" <= c <= "F":
            out.append("HEX")
        elif "G" <= c <= "Z":
            out.append("UPPER")
        else:
            out.append(c)
    return out


_SIZE = {"digit": 10, "hex": 6, "vowel": 3, "lower": 17, "HEX": 6, "UPPER": 20}


class Automaton:
    """A probabilistic automaton: counts of visits, of endings and of each next symbol at each state."""

    def __init__(self) -> None:
        self.visits, self.ends, self.next, self.taken, self.body = [0], [0], [{}], [{}], 0
        self.lengths: Counter[int] = Counter()
        self._of_length: dict[int, float] = {}

    def add(self, seq: list[str]) -> None:
        at = 0
        for c in seq:
            self.visits[at] += 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
                self.taken.append({})
            self.taken[at][c] = self.taken[at].get(c, 0) + 1
            at = self.next[at][c]
        self.visits[at] += 1
        self.ends[at] += 1
        self.lengths[len(seq)] += 1

    def of_length(self, n: int) -> float:
        """Log probability of a string of about ``n`` symbols; merged states forget how long the strings were."""
        if n not in self._of_length:
            d = n // 20
            self._of_length[n] = math.log((sum(self.lengths[k] for k in range(n - d, n + d + 1)) / (2 * d + 1) + _RARE) / (self.lengths.total() + _RARE * _ALPHABET))
        return self._of_length[n]


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: Automaton, p: int, q: int, bound: float) -> bool:
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        n1, n2 = a.visits[p], a.visits[q]
        if not n1 or not n2 or p == q:
            continue
        if _differ(a.ends[p], n1, a.ends[q], n2, bound):
            return False
        for c in a.taken[p].keys() | a.taken[q].keys():
            if _differ(a.taken[p].get(c, 0), n1, a.taken[q].get(c, 0), n2, bound):
                return False
            if c in a.next[p] and c in a.next[q]:
                todo.append((a.next[p][c], a.next[q][c]))
    return True


def _fold(a: Automaton, red: int, blue: int) -> None:
    """Adds the tree below ``blue`` to the automaton at ``red``."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        a.visits[p] += a.visits[q]
        a.ends[p] += a.ends[q]
        for c, child in a.next[q].items():
            a.taken[p][c] = a.taken[p].get(c, 0) + a.taken[q][c]
            if c in a.next[p]:
                todo.append((a.next[p][c], child))
            else:
                a.next[p][c] = child


def _compact(a: Automaton, red: list[int]) -> Automaton:
    """The automaton of the states that are left."""
    out, at = Automaton(), {s: i for i, s in enumerate(red)}
    out.lengths = a.lengths
    out.visits, out.ends = [a.visits[s] for s in red], [a.ends[s] for s in red]
    out.taken = [dict(a.taken[s]) for s in red]
    out.next = [{c: at[t] for c, t in a.next[s].items()} for s in red]
    out.body = max(range(len(red)), key=lambda i: (out.visits[i], i))
    return out


def infer(strings: list[str], alpha: float = 0.02) -> Automaton:
    """Prefix tree of ``strings``, its compatible states merged."""
    a = Automaton()
    for s in strings:
        a.add(symbols(s))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red = [0]
    while True:
        known = set(red)
        blue = {child: (p, c) for p in red for c, child in a.next[p].items() if child not in known}
        if not blue:
            return _compact(a, red)
        q = max(blue, key=lambda s: (a.visits[s], -s))
        p, c = blue[q]
        for r in red:
            if _compatible(a, r, q, bound):
                a.next[p][c] = r
                _fold(a, r, q)
                break
        else:
            red.append(q)


def learn(rows: list[tuple[str, str]]) -> dict[str, Automaton]:
    kinds: dict[str, list[str]] = {}
    for kind, s in rows:
        kinds.setdefault(kind, []).append(s)
    return {kind: infer(strings) for kind, strings in sorted(kinds.items())}


def _followed(a: Automaton, literal: str, seq: list[str]) -> list[float]:
    """Log likelihood of each prefix of a string, without the chance of its ending."""
    at, total, out, log = 0, 0.0, [0.0], math.log
    for i, c in enumerate(seq):
        c = literal[i] if i < LITERAL else c
        total += log((a.taken[at].get(c, 0) + _SMOOTH) / (a.visits[at] + _SMOOTH * _ALPHABET))
        at = a.next[at].get(c, a.body)
        out.append(total)
    return out


def candidates(model: dict[str, Automaton], s: str) -> list[tuple[float, int, int, str]]:
    """(score, begin, end, kind) of each part of the run ``s`` that scores over 0 under a format, best first."""
    n, log = len(s), math.log
    classes = symbols(" " * LITERAL + s)[LITERAL:]
    plain = [kind for kind in model if kind.startswith(ORDINARY) and (n > ENCODED or kind != ORDINARY + "encoded")]
    base = np.array([_followed(model[kind], s, classes) for kind in plain])
    # a part's first characters are read as such, where the run's are known by class alone
    spelt = np.cumsum([0.0] * (min(n, LITERAL) + 1) + [-log(_SIZE.get(c, 1)) for c in classes[LITERAL:]])
    cuts = [i for i in range(1, n) if s[i - 1] in SEPARATORS and s[i] not in SEPARATORS and n - i >= LEAST]
    formats = [(kind, a) for kind, a in model.items() if not kind.startswith(ORDINARY)]
    out = []
    for begin in [0, *cuts]:
        low: list[float] = []  # ordinary log likelihood of the part, by its length
        for kind, a in formats:
            at, total, best, rest = 0, 0.0, 0.0, a.body
            taken, visits, nxt = a.taken, a.visits, a.next
            for i in range(begin, n):
                c = s[i] if i - begin < LITERAL else classes[i]
                total += log((taken[at].get(c, 0) + _SMOOTH) / (visits[at] + _SMOOTH * _ALPHABET))
                at = nxt[at].get(c, rest)
                k = i - begin
                if k >= len(low):
                    stop = min(n, begin + max(16, 2 * k + 2))
                    more = (base[:, begin + len(low) + 1 : stop + 1] - base[:, begin, None]).max(0)
                    low += (more + spelt[np.minimum(np.arange(begin + len(low) + 1, stop + 1), begin + LITERAL)] - spelt[begin]).tolist()
                ratio = total - low[k]
                if ratio < best - DROP:
                    break
                best = max(best, ratio)
                if k + 1 >= LEAST and (i + 1 == n or s[i + 1] in SEPARATORS and s[i] not in SEPARATORS):
                    score = ratio + a.of_length(k + 1)
                    if score > 0:
                        out.append((float(score), begin, i + 1, kind))
    return sorted(out, key=lambda c: (-c[0], c[1], -c[2], c[3]))


def judge(model: dict[str, Automaton], s: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, kind, score) of the secrets in a run, in order."""
    out: list[tuple[int, int, str, float]] = []
    for score, begin, end, kind in candidates(model, s):
        if score < THRESHOLD:
            break
        if all(end <= b or begin >= e for b, e, _, _ in out):
            out.append((begin, end, kind, score))
    return sorted(out)


@functools.lru_cache(1)
def standard() -> dict[str, Automaton]:
    """The automata of ``labelled``."""
    return learn(labelled())


# --- scan


def _places(text: pa.Array) -> Iterator[tuple[int, int, int, memoryview]]:
    """(row, first byte, end byte, bytes of the text) of all runs, bytes counted from the text's begin."""
    whole = pc.fill_null(text, "").cast(pa.large_string())
    off = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if whole.buffers()[2] is None or off[0] == off[-1]:
        return
    data = memoryview(whole.buffers()[2])
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    run = np.zeros(len(raw) + 2, np.int8)
    run[1:-1] = _RUN[raw]
    edge = np.diff(run)
    cut = (off - off[0])[1:-1]  # a run that goes on over a text's begin is two
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    cut = cut[(run[cut] == 1) & (run[cut + 1] == 1)]
    start = np.sort(np.r_[np.flatnonzero(edge == 1), cut])
    end = np.sort(np.r_[np.flatnonzero(edge == -1), cut])
    long = end - start >= LEAST
    start, end = start[long], end[long]
    rows = np.searchsorted(off - off[0], start, side="right") - 1
    for r, a, b in zip(rows.tolist(), start.tolist(), end.tolist()):
        base = int(off[r] - off[0])
        yield r, a - base, b - base, data[int(off[r]) : int(off[r + 1])]


def _characters(data: memoryview, byte: int) -> int:
    return int(np.count_nonzero((np.frombuffer(data[:byte], np.uint8) & 0xC0) != 0x80)) if byte else 0


def found(model: dict[str, Automaton], text: pa.Array, judged=None) -> list[tuple[int, int, int, str, float, str]]:
    """(row, start, end, kind, score, string) of the secrets of each text, offsets in characters."""
    judged = judged or functools.lru_cache(1 << 16)(functools.partial(judge, model))
    out = []
    for row, a, b, data in _places(text):
        s = bytes(data[a:b]).decode("ascii")
        for begin, end, kind, score in judged(s):
            start = _characters(data, a)
            out.append((row, start + begin, start + end, kind, score, s[begin:end]))
    return out


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = functools.lru_cache(1 << 16)(functools.partial(judge, shared.value))
        for b in C.slices(batches, "text"):
            hits = found(shared.value, b.column("text"), judged)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([h[1] for h in hits], pa.int32()),
                    pa.array([h[2] for h in hits], pa.int32()),
                    pa.array([h[3] for h in hits], pa.string()),
                    pa.array([round(h[4], 6) for h in hits], pa.float64()),
                    pa.array([hashlib.sha256(h[5].encode()).hexdigest()[:16] for h in hits], pa.string()),
                ],
                ["doc_id", "start", "end", "kind", "score", "sha"],
            )

    return run


def secrets(docs: DataFrame, model: dict[str, Automaton] | None = None) -> DataFrame:
    """(doc_id, start, end, kind, score, sha): a row for each secret; ``sha`` instead of the secret."""
    shared = docs.sparkSession.sparkContext.broadcast(model or standard())
    few = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_find(shared), _SCHEMA)


def _masked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = functools.lru_cache(1 << 16)(functools.partial(judge, shared.value))
        for b in C.slices(batches, "text"):
            places: dict[int, list[tuple[int, int]]] = {}
            for row, start, end, *_ in found(shared.value, b.column("text"), judged):
                places.setdefault(row, []).append((start, end))
            if places:
                column = b.column("text").to_pylist()
                for row, spans in places.items():
                    t, at, parts = column[row], 0, []
                    for start, end in sorted(spans):
                        parts += [t[at:start], MASK]
                        at = end
                    column[row] = "".join(parts) + t[at:]
                k = b.schema.get_field_index("text")
                b = b.set_column(k, b.schema.field(k), pa.array(column, b.schema.field(k).type))
            yield b

    return run


def redact(docs: DataFrame, model: dict[str, Automaton] | None = None) -> DataFrame:
    """``docs`` with each secret replaced by MASK, and n_chars, if there, counted again."""
    shared = docs.sparkSession.sparkContext.broadcast(model or standard())
    docs = C.with_text(docs)
    out = docs.mapInArrow(_masked(shared), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(C.table(spark, sf_dir, "documents"))
