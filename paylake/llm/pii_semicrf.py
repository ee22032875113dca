"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and
non-overlapping per kind.  A semi-Markov CRF adds spans: over *islands* of a
text, which are maximal runs of tokens with a digit or an at sign (and the
single tokens between them, which no entity begins or ends with), it scores whole candidate segments of up to
``MOST_TOKENS`` tokens by features of the whole span (digits, separators,
groups, alphabet, length, the words before it) and chooses boundaries and types
jointly, with a weight for each kind after each other: forward and backward sums for training, and a dynamic programme over segment ends
with bounded entity length for decoding.  A decoded entity is added if no base
span touches it and its marginal probability is ``CERTAIN`` or more.

Training: islands of a bounded sample of texts (the first ``SAMPLE_DOCS`` by a
hash, of ``SAMPLE_CHARS`` characters at most), with the base spans, and long hexadecimal or mixed tokens after a word
for a secret, as labels.  All their islands are used, up to ``SAMPLE_TOKENS``
tokens; beyond that they are chosen by hash, each set of kinds in its turn.
Near forms are learned from the sample itself: every base span is written once more
in a form that the patterns don't take (``near_form``: other separators, brackets,
without the plus sign), in its own surroundings and under its kind's label, and its
digits once as a quantity, a date and a time, without a label.
Islands of more than ``TRAIN_TOKENS`` tokens are learned in pieces cut between
segments (a piece begins as an island does), and an island with a label that doesn't begin and end with tokens is
left out.  The features leave out what only the fixed patterns test (check
digits), so that near forms are found too.

Null and empty texts have no spans; repeated rows each get their own result, and
further columns are passed through by name or not read.  Texts and islands are handled whole: a
segment's scores are made when its first token is reached and kept for no longer,
so of a long island only some numbers per token stay in memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in their order; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SAMPLE_DOCS = 1500
#: Texts of more characters are not used for training (all are searched whole).
SAMPLE_CHARS = 20_000
#: The most number tokens of a base form: a card of 19 digits with a blank after each.
MOST_TOKENS = 19
CERTAIN = 0.8
#: Characters around a span that its near form is learned with.
NEAR_CHARS = 60
#: Training: an island of more tokens than TRAIN_TOKENS is cut between segments, and
#: the islands have SAMPLE_TOKENS tokens at most (a sample of sf0.1 has about 1,500);
#: of more, islands are chosen by hash, each set of kinds in its turn.
TRAIN_TOKENS = 64
SAMPLE_TOKENS = 100_000
BATCH_TOKENS = 20_000
#: Islands of so many tokens keep their scores from one pass to the next; a segment has MOST_FEATURES at most.
KEEP_TOKENS = 10_000
MOST_FEATURES = 16
EPOCHS = 60
RATE = 0.3
#: Words that announce a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a run of digits that it would take whole
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[0-9@]")
# one token and at most two blanks on each side, on one line
_BETWEEN = re.compile(r"[^\S\n]{1,2}(\S+)[^\S\n]{1,2}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``,
    found from the at signs, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        elif a < at:
            end = max(end, 0)
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *s) for s in ips(text)]
    out += [("card", *s) for s in cards(text)]
    return out + [("phone", *s) for s in phones(text)]


# ---- the semi-Markov model -------------------------------------------------------------------------------------

_MARKS = "#$%&*!?,.;:|\"'()[]{}<>="


class Token:
    __slots__ = ("a", "b", "key", "before")

    def __init__(self, a: int, b: int, key: bool, before: str):
        self.a, self.b, self.key, self.before = a, b, key, before


def islands(text: str) -> list[list[Token]]:
    """Runs of tokens with a digit or an at sign, with the single tokens between
    them; marks around a token aren't part of it."""
    out: list[list[Token]] = []
    last_end, stop = -10, 0
    for m in _TOKEN.finditer(text):
        s = m[0]
        if not _NUMBER.search(s):
            continue
        a, b = m.span()
        lead = len(s) - len(s.lstrip(_MARKS.replace("(", "")))
        trail = len(s) - len(s.rstrip(_MARKS.replace(")", "")))
        a, b = a + lead, b - trail
        # the two words before the token, letters only
        back = text[max(0, m.start() - 24):m.start()].split()
        token = Token(a, b, True, " ".join(back[-2:]).lower() if back else "")
        word = _BETWEEN.fullmatch(text, stop, m.start()) if out else None
        if out and a - last_end <= 2 and "\n" not in text[last_end:a]:
            out[-1].append(token)
        elif word and word.start(1) - last_end <= 2 and a - word.end(1) <= 2:
            out[-1] += [Token(*word.span(1), False, ""), token]
        else:
            out.append([token])
        last_end, stop = b, m.end()
    return out


def features(text: str, first: Token, last: Token, n: int) -> list[str]:
    """Features of the whole span from one token to another."""
    s = text[first.a:last.b]
    groups, chars = re.findall(r"[0-9]+", s), set(s)
    digits = sum(map(len, groups))
    letters = any(map(str.isalpha, chars))
    rest = "".join(sorted(c for c in chars if not c.isalnum() and c != " "))
    out = [f"n={n}", f"digits={min(digits, 20)}", f"groups={min(len(groups), 6)}", f"rest={rest[:6]}",
           f"at={min(s.count('@'), 2)}", f"dots={min(s.count('.'), 5)}", f"plus={s[:1] == '+'}", f"blank={' ' in s}",
           f"letters={'none' if not letters else 'some' if digits else 'all'}",
           f"length={min(len(s) // 4, 12)}", "shape=" + "-".join(str(min(len(g), 9)) for g in groups[:6])]
    if letters and len(s) >= 16 and " " not in s:
        out.append(f"hex={all(c in '0123456789abcdefABCDEF' for c in chars)}")
        out.append(f"variety={min(len(chars) // 4, 6)}")
    words = re.findall(r"[a-z_]+", first.before)
    out.append(f"announced={any(w in SECRET_WORDS for w in words)}")
    if "@" in s:
        host = s.rsplit("@", 1)[1]
        out.append(f"host={bool(_DOMAIN.fullmatch(host))}")
    return out


def scores_of(tokens: int, table: dict) -> np.ndarray:
    """(first token, tokens - 1, kind) scores of a table of segments."""
    out = np.full((tokens, MOST_TOKENS, len(KINDS) + 1), -np.inf)
    for (s, n), (_, score) in table.items():
        out[s, n - 1] = score
    return out


def segments(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(tokens, features) of the candidate segments that begin with token i: those
    that begin and end with a number token, and a single token between."""
    if not tokens[i].key:
        yield 1, ("between",)
        return
    for n in range(1, min(MOST_TOKENS, len(tokens) - i) + 1):
        if tokens[i + n - 1].key:
            yield n, tuple(features(text, tokens[i], tokens[i + n - 1], n))


class Sums:
    """Forward and backward log-sums of several islands at once, from scores
    (island, first token, tokens - 1, kind) that are -inf where no segment is."""

    def __init__(self, score: np.ndarray, length: np.ndarray, pairs: np.ndarray):
        n, tokens, most, size = score.shape
        self.ahead = np.full((n, tokens + 1, size), -np.inf)
        self.ahead[:, 0, 0] = 0.0
        self.into = np.empty((n, tokens, size))
        for s in range(tokens):
            self.into[:, s] = np.logaddexp.reduce(self.ahead[:, s, :, None] + pairs, axis=1)
            m = min(most, tokens - s)
            to = self.ahead[:, s + 1:s + 1 + m]
            np.logaddexp(to, self.into[:, s, None] + score[:, s, :m], out=to)
        self.back = np.full((n, tokens + 1, size), -np.inf)
        self.back[np.arange(n), length] = 0.0
        self.onto = np.empty((n, tokens, size))
        for s in range(tokens - 1, -1, -1):
            m = min(most, tokens - s)
            self.onto[:, s] = np.logaddexp.reduce(score[:, s, :m] + self.back[:, s + 1:s + 1 + m], axis=1)
            self.back[:, s] = np.where((length == s)[:, None], 0.0, np.logaddexp.reduce(pairs + self.onto[:, s, None], axis=2))
        self.z = np.logaddexp.reduce(self.ahead[np.arange(n), length], axis=1)

    def segments(self, score: np.ndarray) -> np.ndarray:
        """P(segment is chosen with each kind), in the shape of ``score``."""
        out = np.zeros_like(score)
        for s in range(score.shape[1]):
            m = min(score.shape[2], score.shape[1] - s)
            out[:, s, :m] = np.exp(np.minimum(self.into[:, s, None] + score[:, s, :m] + self.back[:, s + 1:s + 1 + m]
                                              - self.z[:, None, None], 0))
        return out

    def transitions(self, pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The expected numbers of (kind, next kind), with the first kind after "none", over all islands."""
        p = self.ahead[:, :-1, :, None] + pairs + self.onto[:, :, None, :] - self.z[:, None, None, None]
        return np.einsum("isab,i->ab", np.exp(np.minimum(p, 0)), weight)


class SemiMarkov:
    """Weights of (kind, feature); kind 0 is "none" and spans one token."""

    def __init__(self, weights: dict[tuple[int, str], float] | None = None, pairs: np.ndarray | None = None):
        self.weights = weights or {}
        self.rows: dict[str, int] | None = None
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1)) if pairs is None else pairs

    def scores(self, text: str, tokens: list[Token], i: int) -> np.ndarray:
        """(tokens - 1, kind) scores of the segments that begin with token i."""
        if self.rows is None:
            names = {x for _, x in self.weights}
            self.rows = {x: k + 1 for k, x in enumerate(sorted(names))}          # row 0: features without weights
            self.matrix = np.zeros((len(names) + 1, len(KINDS) + 1))
            for (y, x), w in self.weights.items():
                self.matrix[self.rows[x], y] = w
        out = np.full((min(MOST_TOKENS, len(tokens) - i), len(KINDS) + 1), -np.inf)
        get, at, ids = self.rows.get, [], []
        for n, f in segments(text, tokens, i):
            at.append(n - 1)
            ids.append([get(x, 0) for x in f] + [0] * (MOST_FEATURES - len(f)))
        if at:
            out[at] = self.matrix[np.array(ids)].sum(axis=1)
        if tokens[i].key:
            out[1:, 0] = -np.inf
        else:
            out[:, 1:] = -np.inf
        return out

    def sums(self, tokens: int, table: dict) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward log-sums at (token boundary, kind of the segment
        ending / beginning there), and the log partition function."""
        sums = Sums(scores_of(tokens, table)[None], np.array([tokens]), self.pairs)
        return sums.ahead[0], sums.back[0], float(sums.z[0])

    def marginals(self, tokens: int, table: dict) -> dict[tuple[int, int], np.ndarray]:
        """P(segment is chosen with each kind)."""
        score = scores_of(tokens, table)[None]
        p = Sums(score, np.array([tokens]), self.pairs).segments(score)[0]
        return {(s, n): p[s, n - 1] for s, n in table}

    def decode(self, text: str, tokens: list[Token]) -> list[tuple[str, int, int, float]]:
        """The best segmentation's entities with their marginals."""
        size, n_tokens = len(KINDS) + 1, len(tokens)
        kept = []
        ahead, best = np.full((n_tokens + 1, size), -np.inf), np.full((n_tokens + 1, size), -np.inf)
        ahead[0, 0] = best[0, 0] = 0.0
        come = np.zeros((n_tokens + 1, size, 2), np.int8)
        for s in range(n_tokens):
            score = self.scores(text, tokens, s)
            if n_tokens <= KEEP_TOKENS:
                kept.append(score)
            m = len(score)
            to = ahead[s + 1:s + 1 + m]
            np.logaddexp(to, np.logaddexp.reduce(ahead[s][:, None] + self.pairs, axis=0) + score, out=to)
            into = best[s][:, None] + self.pairs
            reach = into.max(0) + score
            n, y = np.nonzero(reach > best[s + 1:s + 1 + m])
            best[s + 1 + n, y] = reach[n, y]
            come[s + 1 + n, y, 0], come[s + 1 + n, y, 1] = n + 1, into.argmax(0)[y]
        e, y, found = n_tokens, int(best[n_tokens].argmax()), {}
        while e > 0:
            n, prev = (int(x) for x in come[e, y])
            if y:
                found[e - n] = n, y
            e, y = e - n, prev
        if not found:
            return []
        # backward, with as many boundaries as a segment has tokens, down to the first entity
        z, first, out = np.logaddexp.reduce(ahead[n_tokens]), min(found), []
        back = np.full((MOST_TOKENS, size), -np.inf)                 # of the boundaries after s
        back[0] = 0.0
        for s in range(n_tokens - 1, first - 1, -1):
            score = kept[s] if kept else self.scores(text, tokens, s)
            rest = score + back[:len(score)]
            if s in found:
                n, y = found[s]
                p = np.exp(min(np.logaddexp.reduce(ahead[s] + self.pairs[:, y]) + rest[n - 1, y] - z, 0.0))
                out.append((KINDS[y - 1], tokens[s].a, tokens[s + n - 1].b, float(p)))
            back[1:] = back[:-1].copy()
            back[0] = np.logaddexp.reduce(self.pairs + np.logaddexp.reduce(rest, axis=0), axis=1)
        return out[::-1]


def gold(text: str, tokens: list[Token], spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]] | None:
    """The island's training segments (first token, tokens, kind), or none if a
    labelled span doesn't end at tokens."""
    at = {t.a: i for i, t in enumerate(tokens)}
    ends = {t.b: i for i, t in enumerate(tokens)}
    lo, hi = tokens[0].a, tokens[-1].b
    marks: dict[int, tuple[int, int]] = {}
    for kind, a, b in spans:
        if b > lo and a < hi:
            if a not in at or b not in ends or ends[b] - at[a] + 1 > MOST_TOKENS:
                return None
            marks[at[a]] = (ends[b] - at[a] + 1, KINDS.index(kind) + 1)
    out, i = [], 0
    while i < len(tokens):
        n, y = marks.get(i, (1, 0))
        out.append((i, n, y))
        i += n
    return out


def secrets(text: str, tokens: list[list[Token]]) -> list[tuple[str, int, int]]:
    """Training labels for secrets: one token of 24 or more letters and digits after an announcing word."""
    out = []
    for island in tokens:
        for t in island:
            s = text[t.a:t.b]
            if len(s) >= 24 and s.isalnum() and any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s) \
                    and any(w in SECRET_WORDS for w in re.findall(r"[a-z_]+", t.before)):
                out.append(("secret", t.a, t.b))
    return out


def near_form(kind: str, span: str, pick: int) -> str:
    """A way of writing a span that the base patterns don't match."""
    groups = re.findall(r"[0-9]+", span)
    if kind == "email":
        name, _, host = span.rpartition("@")
        return (f"{name}[@]{host}", f"{name}(@){host}", f"{name}@[{host}]")[pick % 3]
    if kind == "ip":
        return ("[.]", "(.)", " . ")[pick % 3].join(groups)
    if kind == "card":
        digits = "".join(groups)
        return (".", "/", "  ")[pick % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    rest = groups[1:] or [groups[0][2:]]
    first = groups[0] if groups[1:] else groups[0][:2]
    return (f"00{first} {' '.join(rest)}", f"({first}) {'.'.join(rest)}", "/".join([first, *rest]))[pick % 3]


def plain_number(span: str, pick: int) -> str:
    """The digits of a span as a quantity, a date or a time: no personal data."""
    d = ("".join(re.findall(r"[0-9]+", span)) + "31415926")[:8]
    return (f"{d[:3]},{d[3:6]}.{d[6:8]}", f"{1 + int(d[:2]) % 28:02d}.{1 + int(d[2:4]) % 12:02d}.20{d[4:6]}",
            f"{int(d[:2]) % 24:02d}:{int(d[2:4]) % 60:02d}", f"20{d[:2]}-{1 + int(d[2:4]) % 12:02d}-{1 + int(d[4:6]) % 28:02d}")[pick % 4]


def rewritten(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(text, labels) of each base span written in a near form and as a plain
    number, between the words around it."""
    for k, (kind, a, b) in enumerate(spans):
        head, tail = text[max(0, a - NEAR_CHARS):a], text[b:b + NEAR_CHARS]
        head = head[head.find(" ") + 1:] if a > NEAR_CHARS else head
        tail = tail[:tail.rfind(" ")] if b + NEAR_CHARS < len(text) and " " in tail else tail
        near = near_form(kind, text[a:b], k)
        made = head + near + tail
        labels = [("near", len(head), len(head) + len(near))]
        if not any(x < labels[0][2] and y > labels[0][1] for _, x, y in base_spans(made)):
            yield made, [(kind, *labels[0][1:]), *base_spans(made)]
        plain = head + plain_number(text[a:b], k) + tail
        yield plain, base_spans(plain)


def pieces(want: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(first token, tokens, segments) of an island's pieces for training: a piece
    ends with the segment that brings it to ``TRAIN_TOKENS`` tokens."""
    part: list[tuple[int, int, int]] = []
    for s, n, y in want:
        part.append((s, n, y))
        start = part[0][0]
        if s + n - start >= TRAIN_TOKENS or (s, n, y) == want[-1]:
            yield start, s + n - start, [(q - start, k, z) for q, k, z in part]
            part = []


def chosen(cases: list[tuple], most: int) -> list[tuple]:
    """The cases (hash, tokens, want, ...) within ``most`` tokens: cases with the same
    kinds by hash, and each set of kinds in its turn, so that none crowds out another."""
    if sum(len(c[1]) for c in cases) <= most:
        return cases
    strata: dict[tuple[int, ...], list] = {}
    for c in sorted(cases, key=lambda c: c[0]):
        strata.setdefault(tuple(sorted({y for _, _, y in c[2]})), []).append(c)
    out, total = [], 0
    for _, _, c in sorted((i, kinds, c) for kinds, group in strata.items() for i, c in enumerate(group)):
        total += len(c[1])
        if total > most:
            break
        out.append(c)
    return out


class Cases:
    """Islands of about one length for training: the numbers of their segments
    (island, first token, tokens - 1), -1 where there is none."""

    def __init__(self, group: list[tuple]):
        size = max(len(c[0]) for c in group)
        self.length = np.array([len(c[0]) for c in group])
        self.weight = np.array([1.0 + np.log(c[2]) for c in group])
        self.segment = np.full((len(group), size, MOST_TOKENS), -1, np.int32)
        for i, (rows, _, _) in enumerate(group):
            for s, row in enumerate(rows):
                self.segment[i, s, :len(row)] = row


def fit(texts: list[str]) -> SemiMarkov:
    """Conditional maximum likelihood by AdaGrad over the islands of the sample, all
    of them up to ``SAMPLE_TOKENS`` tokens."""
    cases, labelled = [], []
    for text in texts:
        spans = base_spans(text)
        labelled += [(text, spans), *rewritten(text, spans)]
    for text, spans in labelled:
        found = islands(text)
        spans = spans + secrets(text, found)
        name = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        for tokens in found:
            want = gold(text, tokens, spans)
            for a, n, part in pieces(want) if want is not None else ():
                mark = hashlib.blake2b(name + tokens[a].a.to_bytes(8), digest_size=8).digest()
                cases.append((mark, tokens[a:a + n], part, text))
    # segments and islands that are alike stand once, islands with their number
    number: dict[tuple[str, ...], int] = {}
    names: dict[str, int] = {}
    flat: list[list[int]] = []
    groups: dict[tuple, int] = {}
    for _, tokens, want, text in chosen(cases, SAMPLE_TOKENS):
        rows = []
        for i in range(len(tokens)):
            row = [-1] * min(MOST_TOKENS, len(tokens) - i)
            for n, f in segments(text, tokens, i):
                if f not in number:
                    number[f] = len(flat)
                    flat.append([names.setdefault(x, len(names)) for x in f])
                row[n - 1] = number[f]
            rows.append(tuple(row))
        key = tuple(rows), tuple(want)
        groups[key] = groups.get(key, 0) + 1
    if not groups:
        return SemiMarkov()
    size = len(KINDS) + 1
    seg_of = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    name_of = np.array([x for f in flat for x in f])
    between = np.array([f == ("between",) for f in number])
    single = between | np.array(["n=1" in f for f in number])
    batches: list[Cases] = []
    observed, follows = np.zeros((len(flat), size)), np.zeros((size, size))
    part: list[tuple] = []
    for (rows, want), count in sorted(groups.items(), key=lambda g: len(g[0][0])):
        before = 0
        for s, n, y in want:
            observed[rows[s][n - 1], y] += 1.0 + np.log(count)
            follows[before, y] += 1.0 + np.log(count)
            before = y
        if part and (len(rows) > 1.25 * len(part[0][0]) or len(part) * len(rows) > BATCH_TOKENS):
            batches.append(Cases(part))
            part = []
        part.append((rows, want, count))
    batches.append(Cases(part))

    weights, seen = np.zeros((len(names), size)), np.full((len(names), size), 1e-8)
    pairs, seen_pairs = np.zeros((size, size)), np.full((size, size), 1e-8)
    for _ in range(EPOCHS):
        score = np.full((len(flat) + 1, size), -np.inf)
        for y in range(size):
            score[:-1, y] = np.bincount(seg_of, weights[name_of, y], len(flat))
        score[:-1, 0][~single] = -np.inf
        score[:-1, 1:][between] = -np.inf
        left, left_pairs = observed.copy(), follows - 0.02 * pairs
        for batch in batches:
            at = score[batch.segment]
            sums = Sums(at, batch.length, pairs)
            p = sums.segments(at) * batch.weight[:, None, None, None]
            left_pairs -= sums.transitions(pairs, batch.weight)
            real = batch.segment >= 0
            for y in range(size):
                left[:, y] -= np.bincount(batch.segment[real], p[..., y][real], len(flat))
        grad = np.stack([np.bincount(name_of, left[seg_of, y], len(names)) for y in range(size)], axis=1) - 0.02 * weights
        seen += grad * grad
        weights += RATE * grad / np.sqrt(seen)
        seen_pairs += left_pairs * left_pairs
        pairs += RATE * left_pairs / np.sqrt(seen_pairs)
    return SemiMarkov({(y, x): float(w) for x, i in names.items() for y, w in enumerate(weights[i]) if w}, pairs)


def train(docs: DataFrame) -> SemiMarkov:
    """Fit on a bounded sample: the first texts by a hash of id and text among
    those with a digit or an at sign and at most ``SAMPLE_CHARS`` characters."""
    text = F.col("text").cast("string")
    some = (docs.select(text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
            .filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")))
    # hashes first, so that tasks send numbers and not texts
    last = some.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])
    rows = some.filter(F.col("h") <= last).dropDuplicates(["h"]).limit(SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r.h, r.text))
    return fit([r.text for r in rows])


def spans_of(text: str, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) by kind in order, then start."""
    base = base_spans(text)
    taken: list[list[int]] = []                              # where base spans are, joined
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]

    def touched(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i < len(taken) and taken[i][0] < b

    added = []
    for tokens in islands(text):
        # an island that base spans explain whole has nothing to add
        if all(touched(t.a, t.b) for t in tokens if t.key):
            continue
        for kind, a, b, p in model.decode(text, tokens):
            if p >= CERTAIN and not touched(a, b):
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: SemiMarkov, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with base (string), spans (string) and
    redacted (the text with every span replaced by its kind in angle brackets)."""
    common.prepare(docs.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("__text"), "")
            some = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            base, spans, clean = [], [], []
            for i, has in enumerate(some):
                text = texts[i].as_py()
                b, s = spans_of(text, model) if has else ([], [])
                base.append(joined(b))
                spans.append(joined(s))
                clean.append(redact(text, s))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(base, pa.string()), pa.array(spans, pa.string()),
                                              pa.array(clean, pa.string())], names=[*keep, "base", "spans", "redacted"])

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(
        common.released(run), f"{schema}, base string, spans string, redacted string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced from left to right; of overlapping ones the earlier, then the longer."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:                                     # the rest of a span that an earlier one covers in part
            at = b
    return "".join([*out, text[at:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone
    (base spans), base_sha256, spans."""
    docs = common.table(spark, sf_dir, "documents")
    common.prepare(spark)
    model = train(docs)
    out = detect(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"])
    counts = [(F.regexp_count("base", F.lit(f"{k}:"))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
