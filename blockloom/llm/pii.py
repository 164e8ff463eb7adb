"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field labels the tokens of each line, blank-separated and cut after commas, semicolons and bars, with a kind or
with none. A token's features, all of the whole token, are its shape
(letters, digits and marks, with the lengths of runs), its number of digits and whether it is one of a few cue words;
its neighbours' coarser shapes count as well. Weights are trained by maximum likelihood from a small labelled table
that a rule writes; lines are decoded by Viterbi, many at once in numpy. Spans of the field are kept where they touch
no span of the patterns and hold what their kind needs (enough digits, a valid check digit, an ``at`` and a ``dot``).
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE, parts, slices, table, with_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns that meet their kind's condition, by start, then in the order of ``KINDS``."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Features of tokens.

CUES = frozenset("at dot (at) [at] (dot) [dot] mail email e-mail phone tel tel. call fax mobile card visa ip host address version page since until room".split())


class Kinds(dict):
    """For ``str.translate``: the character that stands for each code point's class."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = self[point] = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return kind


_kinds = Kinds()
RUN = re.compile(r"(.)\1*", re.S)


def shape(token: str) -> str:
    """Runs of capitals (X), letters (x) and digits (d) with lengths up to 5, runs of a mark as one."""
    return RUN.sub(lambda m: m[1] + (str(min(len(m[0]), 5)) if m[1] in "dXx" else ""), token.translate(_kinds))


def coarse(token: str) -> str:
    """The shape without lengths, and of letters only that they are letters."""
    return re.sub(r"a(?:a)+", "a", re.sub(r"[Xx]", "a", re.sub(r"[0-9]", "", shape(token))))


def digits_of(token: str) -> str:
    n = sum(map(str.isdigit, token))
    return str(n) if n < 5 else "5-6" if n < 7 else "7-9" if n < 10 else "10-11" if n < 12 else "12-19" if n < 20 else "20+"


def own_features(token: str) -> list[str]:
    low = token.lower().strip(",;:!?")
    out = ["bias", "shape=" + shape(token), "coarse=" + coarse(token), "digits=" + digits_of(token), "dots=" + str(min(4, token.count(".")))]
    return out + ["cue=" + low] * (low in CUES)


def side_features(token: str) -> list[str]:
    low = token.lower().strip(",;:!?")
    return ["coarse=" + coarse(token), "digits=" + digits_of(token)] + ["cue=" + low] * (low in CUES)


LABELS = ("none", *KINDS)


def labelled_table(n: int = 600, seed: int = 17) -> list[tuple[list[str], list[int]]]:
    """Lines with labels, written by rule: words, personal data in plain and disguised forms, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(["ba", "re", "ti", "on", "th", "er", "sch", "ou", "ñe", "ç", "lo", "mi", "ka"]) for _ in range(rng.integers(1, 5)))
    host = lambda: pick(["mail", "example", "post", word()]) + num(int(rng.integers(0, 2)))
    tld = lambda: pick(["com", "org", "net", "de", "fr", "es"])
    at, dot = (lambda: pick(["at", "(at)", "[at]", "AT"])), (lambda: pick(["dot", "(dot)", "[dot]", "DOT"]))

    def card() -> str:
        body = pick("3456") + num(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def grouped(digits: str, mark: str) -> str:
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    private = {
        1: [lambda: f"{word()}.{num(2)}@{host()}.{host()}.{tld()}", lambda: f"{word()} {at()} {host()} {dot()} {tld()}", lambda: f"{word()} {dot()} {word()} {at()} {host()} {dot()} {tld()}", lambda: f"{word()}[at]{host()}[dot]{tld()}"],
        2: [lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)), lambda: "[.]".join(str(rng.integers(1, 256)) for _ in range(4))],
        3: [card, lambda: grouped(card(), " "), lambda: grouped(card(), "-"), lambda: grouped(card(), ".")],
        4: [lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"00{num(2)} {num(3)} {num(6)}"],
    }
    other = [
        lambda: f"{rng.integers(1900, 2030)}", lambda: f"{rng.integers(1, 10)}.{rng.integers(0, 10)}", lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        lambda: f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1990, 2030)}", lambda: f"{rng.integers(0, 24):02}:{rng.integers(0, 60):02}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(2)}%",
        lambda: num(int(rng.integers(1, 9))), lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"AKIA{num(2)}ZQ{num(2)}XW{num(1)}", lambda: f"password={num(4)}ab{num(3)}c{num(2)}f", lambda: f"v{num(1)}.{num(1)}.{num(1)}",
        lambda: f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{word()}{num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"at {num(1)} pm", lambda: f"§{num(1)}.{num(1)}", lambda: f"{num(1)} + {num(1)}",
        lambda: f"https://{host()}.{tld()}/{num(4)}", lambda: f"look at {word()} dot {word()}s", lambda: f"room {num(3)}", lambda: f"page {num(3)}-{num(3)}", lambda: "|", lambda: "***", lambda: "!!", lambda: f"{word()} at {word()}",
    ]
    lines = []
    for _ in range(n):
        tokens: list[str] = []
        labels: list[int] = []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 6))):
                w = word()
                tokens.append(pick([w, w, w.capitalize(), w.upper(), w + ",", w + "."]))
                labels.append(0)
            kind = int(rng.integers(0, 9))
            kind = kind if kind < 5 else 0
            text = (pick(other) if kind == 0 else pick(private[kind]))() + pick(["", "", "", ".", ","])
            parts = text.split()
            tokens += parts
            labels += [kind] * len(parts)
        lines.append((tokens, labels))
    return lines


def pack(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences stored one after the other, longest first: where each step's rows start, and how many there are."""
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    return np.concatenate(([0], np.cumsum(active)))[:-1].astype(np.int64), active


class Caches:
    """Rows of scores by token. Tokens with the same classes and cue share a row; both maps are bounded, and hold of
    tokens above 256 characters only a digest."""

    def __init__(self, vector):
        self.vector = vector
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.signatures: dict[tuple[str, str], int] = {}
        self.rows = np.zeros((1_024, 3 * len(LABELS)))

    def add(self, token: str) -> int:
        low = token.lower().strip(",;:!?")
        classes = token.translate(_kinds)
        if len(token) > 256:
            classes = hashlib.sha256(classes.encode("utf-8", "surrogatepass")).hexdigest()
        signature = classes, low if low in CUES else ""
        row = self.signatures.get(signature)
        if row is None:
            row = self.signatures[signature] = len(self.signatures)
            if row == len(self.rows):
                self.rows = np.vstack((self.rows, np.zeros_like(self.rows)))
            self.rows[row] = self.vector(token)
        if len(token) <= 256:
            self.ids[token] = row
        return row

    def lookup(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > 200_000 or len(self.signatures) > 50_000:
            self.clear()
        get = self.ids.get
        found = [get(t, -1) for t in tokens]
        if -1 in found:
            found = [get(t) if i < 0 and t in self.ids else self.add(t) if i < 0 else i for t, i in zip(tokens, found)]
        return np.array(found, np.int64)


@dataclass
class Field:
    """Weights of features for the token itself and for its neighbours, and of transitions. Bounded by the table."""


    own: dict[str, np.ndarray]
    before: dict[str, np.ndarray]
    after: dict[str, np.ndarray]
    moves: np.ndarray
    first: np.ndarray
    caches: Caches | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "caches": None}

    def vector(self, token: str) -> np.ndarray:
        """The scores of labels that a token gives itself, the token after it and the token before it."""
        zero = np.zeros(len(LABELS))
        sums = [sum((w[f] for f in names if f in w), zero) for names, w in ((own_features(token), self.own), (side_features(token), self.before), (side_features(token), self.after))]
        return np.concatenate(sums)

    def slack(self) -> float:
        """The most that transitions can speak for any kind against none, whatever the labels on both sides."""
        A, B, none = self.moves, self.first, 0
        gain_in = np.vstack((A - A[:, [none]], B - B[none]))  # from each label before, or at the start
        gain_out = np.hstack((A - A[[none], :], np.zeros((len(LABELS), 1))))  # to each label after, or at the end
        return float((gain_in.max(axis=0) + gain_out.max(axis=1)).max())

    def emissions(self, tokens: list[str], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score of each label for each token, with what its neighbours in the sequence add."""
        if self.caches is None:
            self.caches = Caches(self.vector)
        ids, k = self.caches.lookup(tokens), len(LABELS)
        weights = self.caches.rows
        score = weights[ids, :k]
        left, right = weights[ids, k : 2 * k], weights[ids, 2 * k :]
        left[ends] = 0
        right[starts] = 0
        score[1:] += left[:-1]
        score[:-1] += right[1:]
        return score

    def label(self, tokens: list[str], lengths: np.ndarray) -> np.ndarray:
        """The best labels of tokens that form sequences of ``lengths``, all at least 1.

        Where each token's score for none is ahead of every kind by more than transitions could make up, the best
        path is none throughout; the other sequences are decoded by Viterbi, all at once."""
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        score = self.emissions(tokens, starts, ends)
        doubt = score[:, 0] - score[:, 1:].max(axis=1) <= self.slack() + 1e-6
        open_ = np.flatnonzero(np.logical_or.reduceat(doubt, starts))
        out = np.zeros(len(tokens), np.int8)
        self.viterbi(score, starts[open_], lengths[open_], out)
        return out

    def viterbi(self, score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        """Write the best labels of the sequences into ``out``: step by step over those that are long enough."""
        if not len(starts):
            return
        order = np.argsort(-lengths, kind="stable")
        offset, active = pack(lengths[order])
        begin = starts[order]
        back = np.empty((int(lengths.sum()), len(LABELS)), np.int8)
        best = score[begin] + self.first
        for t in range(1, len(active)):
            a = active[t]
            paths = best[:a, :, None] + self.moves
            come = paths.argmax(axis=1)
            back[offset[t] : offset[t] + a] = come
            best[:a] = np.take_along_axis(paths, come[:, None, :], axis=1)[:, 0] + score[begin[:a] + t]
        now = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            out[begin[:a] + t] = now[:a]
            if t:
                now[:a] = back[offset[t] + np.arange(a), now[:a]]


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Likelihood:
    """The mean negative log-likelihood of labelled lines with an L2 penalty, and its gradient, by forward-backward.

    A point ``w`` holds the weights of ``names`` for each label, then those of transitions, then those of starts."""

    def __init__(self, lines: list[tuple[list[str], list[int]]], decay: float):
        lines = sorted((x for x in lines if x[0]), key=lambda x: -len(x[0]))
        n, k, width = len(lines), len(LABELS), max(len(t) for t, _ in lines)
        self.names: dict[tuple[int, str], int] = {}
        rows, columns = [], []
        for i, (tokens, _) in enumerate(lines):
            for t, token in enumerate(tokens):
                seen = [(0, f) for f in own_features(token)]
                seen += [(1, f) for f in side_features(tokens[t - 1])] if t else []
                seen += [(2, f) for f in side_features(tokens[t + 1])] if t + 1 < len(tokens) else []
                rows += [i * width + t] * len(seen)
                columns += [self.names.setdefault(s, len(self.names)) for s in seen]
        self.rows, self.columns = np.array(rows), np.array(columns)
        gold, self.mask = np.zeros((n, width), int), np.zeros((n, width), bool)
        for i, (_, labels) in enumerate(lines):
            gold[i, : len(labels)], self.mask[i, : len(labels)] = labels, True
        self.lengths, self.shape, self.decay = self.mask.sum(axis=1), (n, width, k), decay
        self.one = np.eye(k)[gold] * self.mask[:, :, None]
        self.pairs = np.einsum("ita,itb->ab", self.one[:, :-1], self.one[:, 1:])
        self.size = len(self.names) * k

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.shape[2]
        return w[: self.size].reshape(-1, k), w[self.size : self.size + k * k].reshape(k, k), w[self.size + k * k :]

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        (n, width, k), mask, one, rows, columns = self.shape, self.mask, self.one, self.rows, self.columns
        W, A, B = self.parts(w)
        E = np.stack([np.bincount(rows, W[columns, y], minlength=n * width) for y in range(k)], axis=1).reshape(n, width, k)
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = E[:, 0] + B
        for t in range(1, width):
            alpha[:, t] = logsum(alpha[:, t - 1, :, None] + A, 1) + E[:, t]
        for t in range(width - 2, -1, -1):
            new = logsum(A + (E[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = logsum(alpha[np.arange(n), self.lengths - 1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        joint = np.exp(alpha[:, :-1, :, None] + A + (E[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        over = (p - one).reshape(-1, k)
        gW = np.stack([np.bincount(columns, over[rows, y], minlength=len(self.names)) for y in range(k)], axis=1)
        g = np.concatenate((gW.ravel(), (joint.sum(axis=(0, 1)) - self.pairs).ravel(), (p[:, 0] - one[:, 0]).sum(axis=0))) / n
        told = (E * one).sum() + (A * self.pairs).sum() + (one[:, 0] * B).sum()
        return float((z.sum() - told) / n + self.decay * (w * w).sum() / 2), g + self.decay * w


def train(lines: list[tuple[list[str], list[int]]], steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by Adam, over all lines at once."""
    risk = Likelihood(lines, decay)
    w = np.zeros(risk.size + len(LABELS) * (len(LABELS) + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, g = risk(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    W, A, B = risk.parts(w)
    tables: list[dict[str, np.ndarray]] = [{}, {}, {}]
    for (place, name), i in risk.names.items():
        tables[place][name] = W[i]
    return Field(*tables, A, B)


EDGES = ".,;:!?\"'()[]<>|"
DISGUISED = re.compile(
    r"[\w+-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)[\w+-]+)*"
    r"(?:\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)[\w-]+)+|\sat\s[\w-]+(?:(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)[\w-]+)+)",
    re.I,
)


def sound(kind: str, text: str) -> bool:
    """Whether a span of the field holds what its kind needs: a disguised address has both its at and its dot, spelt
    out if the at is a bare word; numbers have only digits and marks, as many digits as their kind, and check digits."""
    digits = "".join(DIGIT.findall(text))
    if kind == "email":
        return len(text) <= 254 and bool(DISGUISED.fullmatch(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9.()\[\] ]", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-]", text)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+/\-]", text)


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its edges; an opening bracket of digits and a plus stay."""
    while b > a and text[b - 1] in EDGES and not (text[b - 1] in ")]" and text[a:b].count("(") + text[a:b].count("[") >= text[a:b].count(")") + text[a:b].count("]")):
        b -= 1
    while a < b and text[a] in EDGES and not (text[a] in "([" and text[a + 1 : b].find(")" if text[a] == "(" else "]") > 0):
        a += 1
    return a, b


TOKEN = re.compile(r"\S+")
INNER = re.compile(r"[,;|](?=[^\s,;|])")
CUT = re.compile(r"(?<=[,;|])(?![,;|])(?!(?<=[0-9],)[0-9])")  # after marks of lists, but not within a number


def words_of(line: str) -> list[str]:
    """The tokens of a line: its blank-separated words, cut after commas, semicolons and bars."""
    words = line.split()
    if INNER.search(line):
        return [part for w in words for part in CUT.split(w) if part]
    return words


def places_of(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the tokens of ``words_of`` are."""
    for m in TOKEN.finditer(text, start, end):
        at = m.start()
        for part in CUT.split(m.group()):
            if part:
                yield at, at + len(part)
                at += len(part)


@dataclass
class Part:
    """A sequence: the tokens of ``start`` to ``end`` of a text, of which those from ``own`` to ``own_end`` are judged
    here and the others are their context."""

    text: int
    start: int
    end: int
    own: int
    own_end: int
    tokens: int = 0


def parts_of(text: str, number: int, size: int, context: int = 2_000) -> Iterator[Part]:
    """A part for each line of a text. A line above ``size`` characters is cut at white space into parts of about
    ``size``, each with ``context`` characters of the line on either side."""
    at = 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if stop - at <= size:
            yield Part(number, at, stop, at, stop)
        else:
            own = at
            for part in slices(text[at:stop], SPACE, size):
                own_end = own + len(part)
                before = SPACE.search(text, max(at, own - context), own) if own - context > at else None
                after = SPACE.search(text, min(stop, own_end + context), stop)
                yield Part(number, before.start() if before else own if own - context > at else at, after.start() if after else stop, own, own_end)
                own = own_end
        at = stop + 1


def find(texts: list[str], model: Field, chars: int = 1_000_000) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and these with what the field adds."""
    base = [base_spans(t) for t in texts]
    extra: list[list[Span]] = [[] for _ in texts]
    tokens: list[str] = []
    where: list[Part] = []
    size = 0

    def decode() -> None:
        nonlocal size
        if where:
            lengths = np.array([p.tokens for p in where])
            labels = model.label(tokens, lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            for i in np.unique(np.searchsorted(starts, np.flatnonzero(labels), side="right") - 1).tolist():
                extra[where[i].text] += part_spans(texts[where[i].text], where[i], labels[starts[i] : starts[i + 1]])
        tokens.clear()
        where.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in parts_of(text, i, chars):
            words = words_of(text[part.start : part.end])
            if words:
                tokens += words
                part.tokens = len(words)
                where.append(part)
                size += part.end - part.start
            if size > chars:
                decode()
    decode()
    out = []
    for b, e in zip(base, extra):
        new = outside(e, b)
        out.append((b, sorted(b + new, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def outside(new: list[Span], base: list[Span]) -> list[Span]:
    """The spans of ``new`` that touch none of ``base``, which is ordered by start."""
    reach = np.maximum.accumulate([s[2] for s in base]) if base else []
    starts = [s[1] for s in base]
    kept = []
    for s in new:
        before = bisect.bisect_left(starts, s[2])  # those that start before its end
        if not before or reach[before - 1] <= s[1]:
            kept.append(s)
    return kept


def part_spans(text: str, part: Part, labels: np.ndarray) -> list[Span]:
    """Runs of equal labels that start with a token that the part owns, as spans of the text; no kind goes on beyond
    the mark of a list."""
    runs: list[list] = []  # label, start, end, number of the last token
    for n, (a, b) in enumerate(places_of(text, part.start, part.end)):
        if labels[n]:
            if runs and runs[-1][3] == n - 1 and runs[-1][0] == labels[n] and text[runs[-1][2] - 1] not in ",;|":
                runs[-1][2:] = [b, n]
            else:
                runs.append([labels[n], a, b, n])
    out = []
    for label, a, b, _ in runs:
        if part.own <= a < part.own_end:
            a, b = trim(text, a, b)
            if sound(LABELS[label], text[a:b]):
                out.append((LABELS[label], a, b))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_fields: list[Field] = []


def default_field() -> Field:
    """The field trained from the rule's table; the same in every process, trained once on the driver."""
    if not _fields:
        _fields.append(train(labelled_table()))
    return _fields[0]


def detect(docs: DataFrame, keep: list[str], model: Field | None = None, text_col: str = "text", masked: bool = False) -> DataFrame:
    """Columns ``keep`` of each row with ``base`` and ``spans``, arrays of (kind, start, end) in code points, end
    exclusive, and, if asked for, the ``masked`` text.

    A line above a million characters is decoded in parts cut at white space, each with 2,000 characters of its line on
    either side as context, so that what a task holds does not grow with a line.

    Defined results: a null text is read as an empty one, which has no span, and is masked as a null; equal texts
    have equal spans; an empty table stays empty. ``keep`` may not name the added columns.
    """
    model = model or default_field()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    ddl = "array<struct<kind:string,start:int,end:int>>"
    added = f"pii__a {ddl}, pii__b {ddl}" + (", pii__m string" if masked else "")
    from pyspark.sql.types import StructType

    sent, text = with_text(docs, keep, text_col)
    schema = docs.select(*keep).schema
    for f, name in zip(StructType.fromDDL(added), ("base", "spans", "masked")):
        schema = schema.add(name, f.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "pii"):
            texts = text(b).to_pylist()
            found = find([t or "" for t in texts], model)
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in pair[i]] for pair in found], pa.list_(span)) for i in (0, 1)]
            hidden = [pa.array([None if t is None else mask(t, pair[1]) for t, pair in zip(texts, found)], pa.string())] if masked else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *lists, *hidden], names=schema.names)

    return sent.mapInArrow(run, schema)


def op7_random_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
