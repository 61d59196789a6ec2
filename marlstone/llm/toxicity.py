"""Toxicity: a string-subsequence-kernel support vector machine with Nystroem landmarks.

Kernel of strings: two strings share every subsequence of three symbols that each spells within a
span of seven, weighted by decay ** span, so ``idiot``, ``id.iot`` and ``idxiot`` stay close; it is
normalised by the root of each string's kernel with itself. Kernel of sentences: the sum over all
pairs of their words' kernels, divided by the roots of both word counts (of ``LEAST_WORDS`` at least).
Sentences of over ``WINDOW`` words are read in overlapping windows of that many. Landmarks are toxic
and harmless sentences; a sentence's Nystroem features are its kernel values against them times
the inverse square root of the landmarks' own kernel matrix, and a linear squared-hinge machine is
trained on them. As the kernel is an inner product over subsequences, the trained machine folds
into one weight for each subsequence: scoring a sentence is a sum over its words' subsequences,
equal to the sum over landmarks.

Labelled sentences: labels mark documents, so the sentences of clean documents are clean, and of a
toxic document those are toxic that hold a string which tells toxic documents from clean ones, and
later its worst sentence, where the machine trained so far finds one (multiple-instance learning).
Copies with letters inserted into such strings teach evasions.

Words: a token is read in several ways (marks taken out, parts joined, look-alikes as letters;
numbers aren't words) and counts as its worst reading; letters set apart are joined again
and every stretch of them is a sentence of its own. A document scores as its worst sentences do: a
logistic curve whose cut is fitted on training documents turns them into its score.

Training takes a bounded sample of labelled documents (``per_class``, ``chars`` long at most);
scoring covers every sentence of every text. Null text: empty, and an empty text scores as a harmless
one. Repeated rows are each scored. Without labels of both classes every score is the share of
toxic labels (0 without any). An empty table gives an empty table. Extra columns are carried;
those named as the output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.shared import quoted, slices, with_fields, without

DECAY, SPAN, ORDER = 0.6, 7, 3
#: Words of a window of a sentence, half of it apart; fewest words that a sentence counts as.
WINDOW, LEAST_WORDS = 3, 2
#: Windows of toxic documents that training takes as they come, and of each telling string.
SHOWN, PER_STRING = 1000, 16
#: Longer strings are read in stretches of at most this many symbols.
WIDEST = 24
#: Stretches of longer strings: how many symbols, and how far apart.
_STRETCHES = ((5, 1), (6, 1), (8, 1), (10, 1), (WIDEST, WIDEST // 2))
#: Bytes of tokens that a worker keeps the values of, with about so many of overhead each.
_KEPT_BYTES, _OVERHEAD = 64 << 20, 150

# Symbols that stand in for letters.
_LOOKS = str.maketrans("0134578@$!", "oieastb" + "asi")
#: 0 ends, 1-26 letters, then accented letters of Latin-1, then everything else.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_BASE = len(_LETTERS) + 2
_CODES = np.full(0x250, _BASE - 1, np.int64)
for _i, _c in enumerate(_LETTERS):
    _CODES[ord(_c)] = _i + 1

_END = re.compile(r"[.!?][\"')\]]*$")
_MARKS = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_APART = re.compile(r"(?:(?<=\s)|^)(?:[^\W_][\W_]+){3,}[^\W_](?=\W|$)")


def readings(raw: str) -> list[str]:
    """The strings that a lower-case token may spell: as it is, without marks, joined, as look-alikes."""
    if raw.isalpha():
        return [raw]
    bare = raw.strip(".,;:!?\"'()[]{}|#*$%&<>-")
    if bare.isalpha():
        return [bare]
    parts = [x for x in _MARKS.split(bare) if x]
    found = {p for p in parts if len(p) > 2 and p.isalpha()} | _joined(parts)
    looks = bare.translate(_LOOKS)
    if looks != bare:
        # Part by part, whether look-alikes are symbols of a part or marks between two.
        found.update(p.translate(_LOOKS) for p in parts if not p.isalpha() and _LETTER.search(p))
        if _LETTER.search(bare):
            spelt = [x for x in _MARKS.split(looks) if x]
            found.update(spelt)
            found |= _joined(spelt)
    return sorted(found - {""})


def _joined(parts: list[str]) -> set[str]:
    """A token's marked-off parts joined: runs of parts of one or two symbols, then neighbours as
    far as WIDEST symbols go."""
    runs: list[str] = []
    short = False
    for p in parts:
        if len(p) <= 2 and short:
            runs[-1] += p
        else:
            runs.append(p)
        short = len(p) <= 2
    found = set(runs)
    for i, whole in enumerate(runs):
        for p in runs[i + 1 :]:
            whole += p
            if len(whole) > WIDEST:
                break
            found.add(whole)
    return {x for x in found if _LETTER.search(x)}


def set_apart(low: str) -> list[str]:
    """Runs of letters set apart, joined."""
    return [_MARKS.sub("", run) for run in _APART.findall(low)]


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lower-case tokens; a line or a mark at a token's end closes one."""
    out: list[list[str]] = []
    for line in text.lower().split("\n"):
        tokens = line.split()
        at = 0
        for i, token in enumerate(tokens, 1):
            last = token[-1]
            if last in ".!?" or last in "\"')]" and _END.search(token):
                out.append(tokens[at:i])
                at = i
        if at < len(tokens):
            out.append(tokens[at:])
    return out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of consecutive sentences with so many words."""
    ends = np.cumsum(lengths)
    many = np.maximum(1, -(-(lengths - WINDOW) // (WINDOW // 2)) + 1)
    of = np.repeat(np.arange(len(lengths)), many)
    at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    starts = (ends - lengths)[of] + at * (WINDOW // 2)
    return starts, np.minimum(starts + WINDOW, ends[of])


def _pieces(string: str) -> list[str]:
    if len(string) <= WIDEST:
        return [string]
    return [string[a : a + wide] for wide, step in _STRETCHES for a in range(0, max(1, len(string) - wide + step), step)]


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples within a span, and their weights, of a string of so many symbols (ends included)."""
    at = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN)) for k in range(j + 1, min(length, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


_SHAPES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _shape(length: int) -> tuple[np.ndarray, np.ndarray]:
    """_triples, kept."""
    if length not in _SHAPES:
        _SHAPES[length] = _triples(length)
    return _SHAPES[length]


def _codes(some: list[str]) -> np.ndarray:
    """Symbols of strings of one length, with ends."""
    points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), -1)
    body = _CODES[np.minimum(points, 0x24F)]
    ends = np.zeros((len(some), 1), np.int64)
    return np.concatenate([ends, body, ends], axis=1)


def _by_length(some: Iterable[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(some):
        groups[len(s)].append(i)
    return groups


def expanded(some: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each string (at most WIDEST long) as subsequence codes and weights, of unit length."""
    out: list = [None] * len(some)
    for length, where in _by_length(some).items():
        at, weight = _shape(length + 2)
        for a in range(0, len(where), 2048):
            part = where[a : a + 2048]
            x = _codes([some[i] for i in part])
            code = (x[:, at[:, 0]] * _BASE + x[:, at[:, 1]]) * _BASE + x[:, at[:, 2]]
            key, inverse = np.unique(code + np.arange(len(part))[:, None] * _BASE**3, return_inverse=True)
            total = np.bincount(inverse.ravel(), np.broadcast_to(weight, code.shape).ravel(), len(key))
            row, code = key // _BASE**3, key % _BASE**3
            total /= np.sqrt(np.bincount(row, total**2, len(part)))[row]
            cuts = np.searchsorted(row, np.arange(1, len(part)))
            for i, c, w in zip(part, np.split(code.astype(np.int32), cuts), np.split(total, cuts)):
                out[i] = c, w
    return out


@dataclass
class Machine:
    """The folded machine: a weight for each subsequence, a bias, and the document's curve.

    ``support`` are the landmarks, as strings, and their multipliers; scoring doesn't need them.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_BASE**3, np.float32))
    bias: float = -1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, repr=False)
    held: int = field(default=0, repr=False)
    support: list[tuple[list[str], float]] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "curve": self.curve, "known": {}, "held": 0, "support": []}

    def values(self, some: list[str]) -> np.ndarray:
        """What strings of at most WIDEST symbols add to a sentence."""
        out = np.zeros(len(some))
        for length, where in _by_length(some).items():
            at, weight = _shape(length + 2)
            for a in range(0, len(where), 4096):
                part = where[a : a + 4096]
                x = _codes([some[i] for i in part]).astype(np.int32)
                code = (x[:, at[:, 0]] * _BASE + x[:, at[:, 1]]) * _BASE + x[:, at[:, 2]]
                # The norm counts what a string spells twice together: equal codes are neighbours when sorted.
                order = np.argsort(code, axis=1)
                sorted_, mass = np.take_along_axis(code, order, 1), weight[order]
                new = np.ones(code.shape, bool)
                new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
                starts = np.flatnonzero(new.ravel())
                sums = np.add.reduceat(mass.ravel(), starts)
                norm = np.sqrt(np.bincount(starts // code.shape[1], sums**2, len(part)))
                out[part] = (self.weights[code] @ weight.astype(np.float32)) / norm
        return out

    def learn(self, tokens: Iterable[str]) -> None:
        """Put the values of new tokens, that of their worst reading, into the table; nan where there is none."""
        new = [t for t in tokens if t not in self.known]
        pieces = [[p for s in readings(t) for p in _pieces(s)] for t in new]
        distinct = list({p for ps in pieces for p in ps})
        of = dict(zip(distinct, self.values(distinct).tolist()))
        for t, ps in zip(new, pieces):
            self.known[t] = max(map(of.__getitem__, ps), default=math.nan)
            self.held += len(t) + _OVERHEAD

    def forget(self) -> None:
        """Drop the later part of a table that has outgrown its bytes; the tokens met first are the common ones."""
        if self.held <= _KEPT_BYTES:
            return
        kept, self.held = {}, 0
        for t, v in self.known.items():
            self.held += len(t) + _OVERHEAD
            if self.held > _KEPT_BYTES // 2:
                break
            kept[t] = v
        self.known = kept

    def _worst_sentences(self, said: list[list[str]], apart: list[str]) -> np.ndarray:
        """The three greatest values of a document's windows and runs set apart, -3 where there are fewer."""
        flat = [t for s in said for t in s]
        value = np.fromiter(map(self.known.__getitem__, flat), float, len(flat))
        word = ~np.isnan(value)
        total = np.concatenate([[0.0], np.cumsum(np.where(word, value, 0.0))])
        count = np.concatenate([[0], np.cumsum(word)])
        found = np.zeros(0)
        if said:
            a, b = windows(np.fromiter(map(len, said), np.int64, len(said)))
            some = count[b] > count[a]
            found = (total[b] - total[a])[some] / np.sqrt(np.maximum(count[b] - count[a], LEAST_WORDS))[some]
        if apart:
            found = np.concatenate([found, [self.known[x] / math.sqrt(LEAST_WORDS) for x in apart]])
        out = np.full(3, -3.0)
        top = np.sort(found)[::-1][:3] if len(found) < 8 else np.sort(np.partition(found, -3)[-3:])[::-1]
        out[: len(top)] = np.maximum(top + self.bias, -3.0)
        return out

    def worst(self, texts: list[str]) -> np.ndarray:
        """The three greatest values of each text's sentences, -3 where there are fewer."""
        out = np.full((len(texts), 3), -3.0)
        at = 0
        while at < len(texts):
            read, chars, end = [], 0, at
            while end < len(texts) and (end == at or chars < 1_000_000):
                read.append((sentences(texts[end]), [x for x in set_apart(texts[end].lower()) if readings(x)]))
                chars += len(texts[end])
                end += 1
            self.forget()
            known = self.known
            self.learn({t for said, apart in read for s in [*said, apart] for t in s if t not in known})
            for i, (said, apart) in enumerate(read):
                out[at + i] = self._worst_sentences(said, apart)
            at = end
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities that texts are toxic."""
        z = self.curve[0] + self.worst(texts) @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grams(string: str) -> set[str]:
    s = f"^{string}$"
    return {s, *(s[i : i + 4] for i in range(len(s) - 3))}


def _witnesses(toxic: Collection[set[str]], clean: Collection[set[str]]) -> tuple[list[str], list[str]]:
    """Strings that tell toxic documents from clean ones, and strings of clean documents.

    A string itself or a four-symbol gram of it tells if it is in three or more toxic documents and its share of them is
    over twenty times its share of clean ones; a witness holds such a gram and is in no clean
    document. Of each toxic document only the most telling strings are taken.
    """
    in_toxic = Counter(g for d in toxic for g in set().union(*map(_grams, d)))
    in_toxic = {g: a for g, a in in_toxic.items() if a >= 3}
    in_clean = Counter(g for d in clean for g in set().union(*map(_grams, d)) & in_toxic.keys())
    weight = {g: math.log((a + 0.5) / (len(toxic) + 1)) - math.log((in_clean[g] + 0.5) / (len(clean) + 1)) for g, a in in_toxic.items()}
    harmless: set[str] = set()
    for d in clean:
        harmless |= d
    found: Counter[str] = Counter()
    for d in toxic:
        told = [(max((weight.get(g, 0.0) * min(1.0, in_toxic.get(g, 0) / 8) for g in _grams(w)), default=0.0), w) for w in d if w not in harmless]
        top = max(told, default=(0.0, ""))[0]
        found.update(w for v, w in told if v > math.log(20) and v >= 0.8 * top)
    return [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))], sorted(harmless)


def _disguised(word: str, rng: np.random.Generator) -> str:
    """A copy with one or two letters inserted, as evasions have."""
    for _ in range(1 + int(rng.integers(0, 4) == 0)):
        at = int(rng.integers(1, max(2, len(word))))
        word = word[:at] + _LETTERS[int(rng.integers(0, 26))] + word[at:]
    return word


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], landmarks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Kernel values of rows against landmarks, both as codes and weights: products over the landmarks' codes."""
    codes = np.unique(np.concatenate([c for c, _ in landmarks]))
    table = np.zeros((len(codes) + 1, len(landmarks)), np.float32)  # the last row stands for all other codes
    for j, (code, weight) in enumerate(landmarks):
        table[np.searchsorted(codes, code), j] = weight
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        code, weight = np.concatenate([c for c, _ in part]), np.concatenate([w for _, w in part]).astype(np.float32)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        at = np.where(codes[at] == code, at, len(codes))
        starts = np.cumsum([0, *(len(c) for c, _ in part[:-1])])
        out[a : a + len(part)] = np.add.reduceat(table[at] * weight[:, None], starts, axis=0)
    return out


def _sentence(strings: list[str], of: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A sentence's codes and weights: its strings' summed, over the root of their count."""
    code = np.concatenate([of[s][0] for s in strings])
    unique, inverse = np.unique(code, return_inverse=True)
    weight = np.bincount(inverse, np.concatenate([of[s][1] for s in strings]), len(unique))
    return unique, weight / math.sqrt(max(len(strings), LEAST_WORDS))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Squared-hinge machine by Newton steps; the last column of x is one and its weight the bias. y is -1 or 1."""
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        slack = 1 - y * (x @ w.astype(x.dtype)).astype(float)
        hessian, gradient = np.diag(keep), keep * w
        on = np.flatnonzero(slack > 0)
        for a in range(0, len(on), 4096):  # in parts, so no second copy of x is held
            some = on[a : a + 4096]
            xs = x[some].astype(float)
            hessian = hessian + (xs * cost[some, None]).T @ xs
            gradient = gradient - xs.T @ (cost[some] * y[some] * slack[some])
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _curve(worst: np.ndarray, y: np.ndarray, second: float = 0.1, slope: float = 8.0, weights: dict[int, float] | None = None) -> tuple[float, ...]:
    """A logistic curve over the worst strings, cut where mistakes cost least.

    A false alarm costs as much as one and a half misses. Wrong labels would flatten a fitted curve, so only
    the cut is fitted: of the values between which the cost is least, three fifths of the way up.
    Each mistake counts for the documents of its class that the example stands for (``weights``).
    """
    of = weights or {}
    t = worst[:, 0] + second * worst[:, 1]
    order = np.argsort(t, kind="stable")
    t, toxic = t[order], y[order] == 1
    missed = np.concatenate([[0.0], np.cumsum(toxic)])
    alarms = (~toxic).sum() - np.concatenate([[0.0], np.cumsum(~toxic)])
    loss = of.get(1, 1.0) * missed + 1.5 * of.get(0, 1.0) * alarms
    edges = np.concatenate([[t[0] - 1], t, [t[-1] + 1]])
    loss[1:-1][np.diff(t) <= 1e-9] = np.inf  # no cut between equal values
    best = np.flatnonzero(loss <= loss.min() * (1 + 1e-12) + 1e-12)
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    low, high = edges[widest], edges[widest + 1]
    return -slope * float(low + 0.6 * (high - low)), slope, slope * second, 0.0


class _Readings:
    """The sets of strings of documents, made from numbers one at a time."""

    def __init__(self, names: list[str], held: list[np.ndarray]):
        self.names, self.held = names, held

    def __len__(self) -> int:
        return len(self.held)

    def __iter__(self) -> Iterator[set[str]]:
        return ({self.names[i] for i in some.tolist()} for some in self.held)


class _Corpus:
    """Training documents as numbers: each word's string, and the windows of all sentences.

    A word counts as its longest reading here; ``held`` are the numbers of all readings of each document.
    """

    def __init__(self, texts: list[str], number: dict[str, int], read: dict[str, tuple[int, ...]]):
        flat, starts, ends, of, self.held = [], [], [], [], []
        at = 0
        for d, text in enumerate(texts):
            said, apart = sentences(text), set_apart(text.lower())
            tokens = {t for s in [*said, apart] for t in s}
            for t in tokens:
                if t not in read:
                    some = sorted((r for r in readings(t) if len(r) <= WIDEST), key=len, reverse=True)
                    read[t] = tuple(number.setdefault(r, len(number)) for r in some)
            self.held.append(np.array(sorted({r for t in tokens for r in read[t]}), np.int32))
            some = [[read[t][0] for t in s if read[t]] for s in [*said, *([x] for x in apart)]]
            some = [s for s in some if s]
            if some:
                a, b = windows(np.fromiter(map(len, some), np.int64, len(some)))
                flat.append(np.array([x for s in some for x in s], np.int32))
                starts.append((a + at).astype(np.int32))
                ends.append((b + at).astype(np.int32))
                of.append(np.full(len(a), d, np.int32))
                at += len(flat[-1])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        self.flat, self.starts, self.ends, self.of = join(flat), join(starts), join(ends), join(of)

    def __len__(self) -> int:
        return len(self.starts)

    def window(self, i: int) -> list[int]:
        return self.flat[self.starts[i] : self.ends[i]].tolist()

    def values(self, by_string: np.ndarray, bias: float) -> np.ndarray:
        """Decision values of all windows from what each string adds."""
        total = np.concatenate([[0.0], np.cumsum(by_string[self.flat])])
        return (total[self.ends] - total[self.starts]) / np.sqrt(np.maximum(self.ends - self.starts, LEAST_WORDS)) + bias


def train(examples: list[tuple[str, int]], landmarks: int = 480, negatives: int = 8_000, rounds: int = 3, seed: int = 7, weights: dict[int, float] | None = None) -> Machine:
    """A machine from (text, label) pairs, each standing for ``weights`` documents of its class."""
    texts = [t or "" for t, _ in examples]
    y = np.array([label for _, label in examples], float)
    machine = Machine()
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        machine.curve = (math.log(share / (1 - share)), 0.0, 0.0, 0.0)
        return machine
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    read: dict[str, tuple[int, ...]] = {}
    toxic, clean = (_Corpus([t for t, v in zip(texts, y) if v == label], number, read) for label in (1, 0))
    names = list(number)
    del read, number
    bad, harmless = _witnesses(_Readings(names, toxic.held), _Readings(names, clean.held))
    del toxic.held, clean.held
    if not bad or not harmless or not len(toxic) or not len(clean):
        machine.curve = _curve(machine.worst(texts), y, weights=weights)
        return machine
    told = set(bad)
    # Windows as they come, and some of every telling string, so that rare ones are learned too.
    holding: dict[str, list[int]] = defaultdict(list)
    telling = np.array([x in told for x in names])
    many = np.concatenate([[0], np.cumsum(telling[toxic.flat])])
    for i in np.flatnonzero(many[toxic.ends] > many[toxic.starts]):
        for x in {names[j] for j in toxic.window(i)} & told:
            holding[x].append(i)
    any_of = sorted({i for some in holding.values() for i in some})
    draw = lambda some, n: [some[i] for i in rng.choice(len(some), min(n, len(some)), replace=False)] if len(some) else []
    spelt = lambda corpus, some: [[names[j] for j in corpus.window(i)] for i in some]
    hard_at: set[int] = set()
    found_at: list[int] = []
    for turn in range(rounds):
        alone = [[w] for w in bad[:1500]]
        shown = spelt(toxic, draw(any_of, SHOWN) + draw([w for x in bad[:1500] for w in draw(holding[x], PER_STRING)], 3 * SHOWN))
        disguised = [[_disguised(x, rng) if x in told else x for x in w] for w in [*shown, *alone, *alone]]
        disguised = [w for w in disguised if max(map(len, w)) <= WIDEST]
        hard = spelt(clean, sorted(hard_at))
        picked = spelt(clean, rng.choice(len(clean), min(negatives, len(clean)), replace=False)) + [[w] for w in draw(harmless, negatives // 4)] + hard
        # Stretches of clean words without their spaces, as runs of letters set apart have them.
        for i in rng.integers(0, len(clean), negatives // 4):
            joined = "".join(names[j] for j in clean.flat[clean.starts[i] : clean.starts[i] + 4].tolist())
            wide, _ = _STRETCHES[int(rng.integers(0, len(_STRETCHES) - 1))]
            at = int(rng.integers(0, max(1, len(joined) - wide + 1)))
            picked.append([joined[at : at + wide]])
        toxic_rows = shown + alone + spelt(toxic, found_at) + disguised
        rows = toxic_rows + picked
        sign = np.where(np.arange(len(rows)) < len(toxic_rows), 1.0, -1.0)
        cost = np.where(sign > 0, 1 / len(toxic_rows), 1 / len(picked))
        marks = draw(shown, landmarks // 4) + alone[: landmarks // 4] + draw(disguised, landmarks // 6) + draw(hard, landmarks // 8)
        marks = (marks + draw(picked, landmarks))[:landmarks]
        machine.weights, machine.bias, machine.support = _fitted(rows, sign, cost, marks)
        machine.known, machine.held = {}, 0
        if turn < rounds - 1:
            # Clean sentences that score high come back as hard examples; the worst sentence of a
            # toxic document joins the toxic ones if it scores as one.
            by_string = machine.values(names)
            value = clean.values(by_string, machine.bias)
            order = np.argpartition(-value, min(1500, len(value) - 1))[:1500]
            hard_at.update(order[value[order] > -0.6].tolist())
            value = toxic.values(by_string, machine.bias)
            best = np.lexsort((-value, toxic.of))
            best = best[np.unique(toxic.of[best], return_index=True)[1]]
            found_at = best[value[best] > 0.3].tolist()
    machine.curve = _curve(machine.worst(texts), y, weights=weights)
    machine.known, machine.held = {}, 0
    return machine


def _fitted(rows: list[list[str]], sign: np.ndarray, cost: np.ndarray, marks: list[list[str]]) -> tuple[np.ndarray, float, list[tuple[list[str], float]]]:
    """Folded weights, bias, and the landmarks with their multipliers, from sentences as strings."""
    names = list({x for w in [*rows, *marks] for x in w})
    number = {x: i for i, x in enumerate(names)}
    expansions = [(c, w.astype(np.float32)) for c, w in expanded(names)]
    of = dict(zip(names, expansions))
    own = [_sentence(w, of) for w in marks]
    kernel = np.hstack([_dense(own, own[a : a + 96]) for a in range(0, len(own), 96)]).astype(float)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    half = vector * (1 / np.sqrt(np.maximum(value, 1e-6)))
    # A sentence's kernel values are its strings' summed, so each string is compared once; landmarks
    # are taken in blocks, so that few of these values are held at a time.
    flat = np.array([number[x] for w in rows for x in w], np.int32)
    size = np.array([len(w) for w in rows])
    starts = np.concatenate([[0], np.cumsum(size)])
    features = np.ones((len(rows), len(marks) + 1), np.float32)
    for first in range(0, len(marks), 96):
        by_string = _dense(expansions, own[first : first + 96])
        for a in range(0, len(rows), 4096):
            b = min(a + 4096, len(rows))
            summed = np.add.reduceat(by_string[flat[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
            features[a:b, first : first + by_string.shape[1]] = summed / np.sqrt(np.maximum(size[a:b], LEAST_WORDS))[:, None]
    del by_string
    for a in range(0, len(rows), 4096):
        features[a : a + 4096, :-1] = features[a : a + 4096, :-1] @ half
    w = _svm(features, sign, cost)
    alpha = half @ w[:-1]
    folded = np.zeros(_BASE**3)
    for a, (code, weight) in zip(alpha, own):
        folded[code] += a * weight
    return folded.astype(np.float32), float(w[-1]), list(zip(marks, alpha.tolist()))


def scored(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with each whole text's probability of being toxic."""
    slim = without(docs, out_col).withColumn(text_col, quoted(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size: the weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(texts))], [*batch.schema.names, out_col])

    return slim.mapInArrow(run, with_fields(slim, (out_col, "double")))
