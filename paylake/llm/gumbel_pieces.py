"""Sampled SentencePiece encodings without replacement (Gumbel top-k), and decoding.

The lattice of a text has the vocabulary's pieces as edges; pieces follow a
unigram model, ``log p`` of a piece being ``-log(OFFSET + rank)`` by its rank in
the vocabulary (the model file has merge ranks, no probabilities).  Characters
outside the vocabulary are their UTF-8 byte pieces, a single path.

The ``k`` segmentations with the largest Gumbel-perturbed log-probabilities are
``k`` draws without replacement.  They are found by A-star search from the top:
a node is a prefix of a segmentation and stands for all its completions, with
the exact log-mass as its bound; the root's Gumbel is drawn, the Gumbels below a
node under the condition that their maximum is the node's.  The best child keeps
its parent's value, so following it draws an exact sample of the rest.  At each
place of that path the edges not taken go to the queue together, with one
Gumbel of their joint mass, truncated at the parent's value (only the largest
that the results still wanted can need); the next result starts from the
queue's best node: one of its edges is drawn, the edges left go back.

Pieces never join a word end with the next word's blank, so the lattice of a
text is the chain of its words' lattices and the masses of words multiply.  A
lattice node is a suffix of a word, shared by all words that end so; its tables
(edges, backward mass) are made once and kept until the task ends or they hold
``WORD_MEMORY`` words.  All random numbers are hashes of the row key, the draw and the place, so
reruns and other partitionings give the same segmentations.

Each result has its log-probability, its perturbed value, and its inclusion
score: the estimated probability of being among the results, from the largest
perturbed value left out (kappa): ``1 - exp(-exp(log_prob - kappa))``; with all
segmentations given it is 1.

Null and empty texts have one segmentation, the empty one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Results per text and the offset of ranks in the unigram model.
K = 2
OFFSET = 100
SEED = 8
#: Distinct words whose lattices a worker keeps; beyond it they start anew.
WORD_MEMORY = 150_000
#: New words whose lattices are made at once.
NEW_WORDS = 5_000
#: Edges from here on stand for characters outside the vocabulary.
CHAR = 1 << 20
#: Leading bits of hashes that a table resolves at once.
LEAD_BITS = 20
BLANK = "▁"
_BASE = 0x9E3779B97F4A7C15
_models: dict = {}


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _longer(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character longer."""
    return common.mix64(h * np.uint64(31) + char + np.uint64(1))


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {}
        self.ids: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("pieces across words: the lattice isn't a chain of words")
        self.longest = max(map(len, self.ids))
        self.logp = -np.log(OFFSET + np.arange(n, dtype=float))
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        #: bytes of the pieces, and once more without their first one (a text's first piece has the blank in front)
        self.raw = pa.array(raw + [r[1:] for r in raw], pa.large_binary())
        # every prefix of a piece by its hash, and the piece that it is (or -1)
        keys = list(self.ids)
        sizes = np.array([len(w) for w in keys])
        text = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        start, piece = np.cumsum(sizes) - sizes, np.array([self.ids[w] for w in keys])
        h, prefixes = np.zeros(len(keys), np.uint64), []
        for size in range(1, self.longest + 1):
            on = sizes >= size
            start, sizes, piece = start[on], sizes[on], piece[on]
            h = _longer(h[on], text[start + size - 1])
            prefixes.append((h, np.full(len(h), size), np.where(sizes == size, piece, -1)))
        h, size, piece = (np.concatenate(x) for x in zip(*prefixes))
        order = np.lexsort((-piece, h))
        order = order[np.concatenate([[True], np.diff(h[order]) != 0])]
        self.hashes, self.hash_len, self.hash_piece = h[order], size[order], piece[order]
        # where the hashes with the same leading bits begin, and the most of them
        self.begins = np.searchsorted(self.hashes, np.arange(1 << LEAD_BITS, dtype=np.uint64) << np.uint64(64 - LEAD_BITS)).astype(np.int32)
        self.crowd = int(np.diff(np.append(self.begins, len(self.hashes))).max())
        self._words()

    def _place(self, h: np.ndarray) -> np.ndarray:
        """Where hashes stand among those of the prefixes (any place if they don't)."""
        last = len(self.hashes) - 1
        k = np.minimum(self.begins[(h >> np.uint64(64 - LEAD_BITS)).view(np.int64)], last)
        for _ in range(self.crowd - 1):
            k = np.minimum(k + (self.hashes[k] < h), last)
        return k

    def _words(self) -> None:
        """Tables of known words' lattice nodes, in growing arrays: ``first`` edge
        and number of edges of a node, log mass of its completions, its suffix's first
        character and the node of the suffix after it; the nodes by hashes of
        their suffixes; of an edge its piece, the node it leads to
        (-1 at the word's end), its probability summed up over the node's edges,
        and the log-probabilities given the node of it and of all other edges."""
        self.number = _Numbers()
        self.root = np.zeros(0, np.int64)
        self.nodes = 0
        self.edges = 0
        self.first = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.beta = np.zeros(1 << 16)
        self.char = np.zeros(1 << 16, np.int32)
        self.after = np.zeros(1 << 16, np.int32)
        self.keys, self.key_node = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.piece = np.zeros(1 << 18, np.int32)
        self.to = np.zeros(1 << 18, np.int32)
        self.upto = np.zeros(1 << 18)
        self.given = np.zeros(1 << 18)
        self.side = np.zeros(1 << 18)

    def _lattice(self, word: str) -> list[list[tuple[int, int]]]:
        """Edges (piece, end) of each place of a word, one at a time: for tests.
        A piece from ``CHAR`` on is a character outside the vocabulary."""
        out = []
        for a in range(len(word)):
            out.append([(self.ids[word[a:b]], b) for b in range(a + 1, min(len(word), a + self.longest) + 1) if word[a:b] in self.ids])
            if word[a] not in self.ids:
                out[a].append((CHAR + ord(word[a]), a + 1))
        return out

    def cost(self, piece: int) -> float:
        """log p of a piece, or of a character's byte pieces."""
        return float(self.logp[piece]) if piece < CHAR else float(sum(self.logp[self.bytes[c]] for c in chr(piece - CHAR).encode("utf-8", "surrogatepass")))

    def _suffixes(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal suffixes of words: (hash, a position, and of every position its suffix's number).

        The hashes only propose; suffixes are the same if their first characters
        and what follows are.  Should hashes collide, every position stays alone."""
        n = len(text)
        power = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        inverse = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 2**64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(common.mix64(text.astype(np.uint64) + np.uint64(_BASE)) * power)])
        h = common.mix64((sums[np.arange(n) + left] - sums[:-1]) * inverse + left.astype(np.uint64))
        keys, at, which = np.unique(h, return_index=True, return_inverse=True)
        after = np.where(left > 1, np.append(which[1:], -1), -1)
        if ((text == text[at][which]) & (after == after[at][which])).all():
            return keys, at, which
        return np.zeros(n, np.uint64), np.arange(n), np.arange(n)

    def _known(self, keys: np.ndarray, char: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Lattice nodes of suffixes (hash, first character, number of the suffix after it) that
        are known, else -1; all are new if hashes collide."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        node = np.where(self.keys[k] == keys, self.key_node[k], -1)
        hit = node >= 0
        then = np.where(after >= 0, node[after], -1)
        good = (self.char[node] == char) & (self.after[node] == then)
        return node if good[hit].all() else np.full(len(keys), -1)

    def _add(self, words: list[str]) -> None:
        """Lattices of new distinct words, all at once: a node is a suffix of a word (what may
        follow a place depends on it only) and is shared by the words that end so; its edges
        are the pieces that it begins with, found by hashes of substrings."""
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = len(text)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)        # characters up to the word's end
        keys, rep, which = self._suffixes(text, left)
        after = np.where(left[rep] > 1, which[np.minimum(rep + 1, n - 1)], -1)
        node = self._known(keys, text[rep], after)
        new = np.flatnonzero(node < 0)
        pos, m = rep[new], len(new)
        node[new] = self.nodes + np.arange(m)
        node_at = node[which]
        # suffixes whose text so far is a prefix of some piece, longer by one with each turn
        at, h, found = np.arange(m), np.zeros(m, np.uint64), []
        for size in range(1, self.longest + 1):
            if not len(at):
                break
            p = pos[at]
            h = _longer(h, text[p + size - 1].astype(np.uint64))
            k = self._place(h)
            hit = (self.hashes[k] == h) & (self.hash_len[k] == size)
            piece = np.where(hit, self.hash_piece[k], -1)
            if size == 1:                                   # characters outside the vocabulary
                piece = np.where(piece < 0, CHAR + text[p], piece)
            is_piece = piece >= 0
            found.append((at[is_piece], size, piece[is_piece]))
            go = hit & (left[p] > size)
            at, h = at[go], h[go]
        count = np.zeros(m, np.int64)
        for at, _, _ in found:
            count[at] += 1
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(m), count)
        size, piece, filled = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), first.copy()
        for at, length, pieces in found:
            size[filled[at]], piece[filled[at]] = length, pieces
            filled[at] += 1
        cost = self.logp[np.minimum(piece, len(self.logp) - 1)].copy()
        odd = np.flatnonzero(piece >= CHAR)
        if len(odd):
            kinds, kind = np.unique(piece[odd], return_inverse=True)
            cost[odd] = np.array([self.cost(int(c)) for c in kinds])[kind]
        a, e0 = self.nodes, self.edges
        self._room(m, len(row))
        to = np.where(left[pos][row] == size, -1, node_at[np.minimum(pos[row] + size, n - 1)])
        # backward masses, by characters left, in all words together
        beta, total = self.beta, cost
        by = np.argsort(left[pos], kind="stable")
        lengths, cut = np.unique(left[pos][by], return_index=True)
        for p, q in zip(cut.tolist(), [*cut[1:].tolist(), m]):
            at = by[p:q]
            num = count[at]
            begin = np.cumsum(num) - num
            e = np.repeat(first[at] - begin, num) + np.arange(int(num.sum()))
            total[e] += np.where(to[e] < 0, 0.0, beta[to[e]])
            t = total[e]
            top = np.maximum.reduceat(t, begin)
            beta[a + at] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, num)), begin))
        if m:
            given = total - beta[a + row]
            prob = np.exp(given)
            run = np.cumsum(prob)
            upto = run - np.repeat(run[first] - prob[first], count)
            upto[first + count - 1] = 2.0
            # mass of a node's other edges; only the one above a half is summed from the others
            over = prob > 0.5
            others = np.add.reduceat(np.where(over, 0.0, prob), first)
            with np.errstate(divide="ignore"):
                side = np.log(np.where(over, others[row], 1.0 - prob))
            e1 = e0 + len(row)
            self.first[a:a + m], self.count[a:a + m] = first + e0, count
            self.char[a:a + m], self.after[a:a + m] = text[pos], np.where(after[new] >= 0, node[after[new]], -1)
            self.piece[e0:e1], self.to[e0:e1] = piece, to
            self.upto[e0:e1], self.given[e0:e1], self.side[e0:e1] = upto, given, side
            self.nodes, self.edges = a + m, e1
            if keys[-1]:                                    # hashes of no use aren't kept
                where = np.searchsorted(self.keys, keys[new])
                self.keys, self.key_node = np.insert(self.keys, where, keys[new]), np.insert(self.key_node, where, node[new])
        self.root = np.append(self.root, node_at[np.cumsum(sizes) - sizes])

    def ids_of(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths, characters outside the vocabulary as their bytes; ids per edge."""
        piece = self.piece[edges]
        odd = np.flatnonzero(piece >= CHAR)
        if not len(odd):
            return piece, np.ones(len(piece), np.int64)
        kinds, which = np.unique(piece[odd], return_inverse=True)
        codes = [[self.bytes[c] for c in chr(p - CHAR).encode("utf-8", "surrogatepass")] for p in kinds.tolist()]
        sizes = np.array([len(c) for c in codes])
        starts = np.cumsum(sizes) - sizes
        n = np.ones(len(piece), np.int64)
        n[odd] = sizes[which]
        out, at = np.repeat(piece, n), (np.cumsum(n) - n)[odd]
        code = np.concatenate(codes).astype(np.int32)
        for k in range(int(sizes.max())):
            more = sizes[which] > k
            out[at[more] + k] = code[starts[which[more]] + k]
        return out, n

    def _room(self, nodes: int, edges: int) -> None:
        while self.nodes + nodes > len(self.first):
            for name in ("first", "count", "beta", "char", "after"):
                setattr(self, name, _wider(getattr(self, name), self.nodes))
        while self.edges + edges > len(self.piece):
            for name in ("piece", "to", "upto", "given", "side"):
                setattr(self, name, _wider(getattr(self, name), self.edges))

    def begin(self) -> None:
        if len(self.number) > WORD_MEMORY:
            self._words()

    def roots(self, words: list[str]) -> np.ndarray:
        """First lattice node of each word."""
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = self.number.new
        for k in range(0, len(new), NEW_WORDS):
            self._add(new[k:k + NEW_WORDS])
        new.clear()
        return self.root[numbers]


def _wider(x: np.ndarray, used: int) -> np.ndarray:
    """The array with twice the room; what isn't used yet takes no memory."""
    out = np.zeros(2 * len(x), x.dtype)
    out[:used] = x[:used]
    return out


class _Numbers(dict):
    """Numbers of words, from 0; words get one when first asked for, and are listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def words_of(text: str) -> list[str]:
    """Words with the blanks before them; the text gets a blank in front.  One text, for tests."""
    return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of texts: the distinct ones, of every word in text order its number, and where texts begin."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), BLANK, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, off = common.buffers(texts)
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    blank = data == 32
    blank[1:] &= data[:-1] != 32
    blank[off[:-1][np.diff(off) > 0]] = True
    at = np.flatnonzero(blank)
    cut = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
    coded = pa.LargeStringArray.from_buffers(len(at), cut, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return (pc.replace_substring(coded.dictionary, " ", BLANK).to_pylist(), coded.indices.to_numpy(zero_copy_only=False),
            np.searchsorted(at, off))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def draws(seed: np.ndarray, draw: np.ndarray, what: int, sizes: np.ndarray) -> np.ndarray:
    """Random numbers of several texts: ``sizes`` of each, by its seed, draw, purpose and place."""
    base = common.mix64(seed + (draw * 1_000_003 + what).astype(np.uint64))
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return common.mix64(np.repeat(base, sizes) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def paths(voc: Vocabulary, roots: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
    """One exact sample through the lattices that begin at ``roots``, all at once.

    Returns root index, node and edge of the paths' steps, in order of the roots."""
    index, node, seed = np.arange(len(roots)), roots, seeds
    steps, length = [], np.zeros(len(roots), np.int64)
    while len(node):
        seed = common.mix64(seed + np.uint64(0x9E3779B97F4A7C15))
        u = _uniform(seed)
        edge = voc.first[node]
        more = np.flatnonzero(voc.upto[edge] < u)
        while len(more):
            edge[more] += 1
            more = more[voc.upto[edge[more]] < u[more]]
        steps.append((index, node, edge))
        length[index] += 1
        node = voc.to[edge]
        go = node >= 0
        index, node, seed = index[go], node[go], seed[go]
    start = np.cumsum(length) - length
    nodes, edges = np.zeros(int(length.sum()), np.int32), np.zeros(int(length.sum()), np.int32)
    for k, (index, node, edge) in enumerate(steps):
        at = start[index] + k
        nodes[at], edges[at] = node, edge
    return np.repeat(np.arange(len(roots)), length), nodes, edges


class Sampler:
    """Top-down search of one text.  A queue node stands for a prefix of edges
    and the edges of its next lattice node but those given before."""

    def __init__(self, voc: Vocabulary, words: np.ndarray, seed: int):
        self.voc, self.words, self.seed = voc, words, seed

    def _draws(self, draw: int, what: int, n: int) -> np.ndarray:
        return draws(np.array([self.seed % 2**64], np.uint64), np.array([draw]), what, np.array([n]))

    def run(self, k: int) -> list[dict]:
        """Up to ``k`` results, largest value first: edges, log_prob, value, inclusion."""
        return search(self.voc, [self], k)[0]

    def steps(self, k: int) -> Iterator[tuple[np.ndarray, int]]:
        """The search: yields (lattice nodes, draw) whose paths it needs, gets them
        sent as (index, node, edge, log p of the edges, Gumbels of the edges not
        taken, less the path's mass), and returns the results."""
        voc = self.voc
        if not len(self.words):
            return [{"edges": np.zeros(0, np.int32), "log_prob": 0.0, "value": 0.0, "inclusion": 1.0}]
        root = float(-np.log(-np.log(_uniform(self._draws(0, 1, 1))[0])))
        # queue nodes: (-value, number, prefix, log mass of the prefix, lattice node or -1, edges given before, next word)
        queue: list[tuple] = [(-root, 0, np.zeros(0, np.int32), 0.0, -1, (), 0)]
        number, results, kappa = 0, [], None
        for draw in range(k):
            if not queue:
                break
            value, _, prefix, mass, at, given_before, word = heapq.heappop(queue)
            value, inner = -value, -1
            if at >= 0:
                # one of the edges left, and what then is left of them
                u = _uniform(self._draws(draw, 4, 2))
                left = [e for e in range(voc.first[at], voc.first[at] + voc.count[at]) if e not in given_before]
                p = np.exp(voc.given[left])
                i = min(int(np.searchsorted(np.cumsum(p), u[0] * p.sum(), side="right")), len(left) - 1)
                rest = float(np.delete(p, i).sum())
                if rest > 0:
                    number += 1
                    heapq.heappush(queue, (-float(_under(mass + np.log(rest) - np.log(-np.log(u[1])), value)), number,
                                           prefix, mass, at, (*given_before, left[i]), word))
                prefix, mass, inner = np.append(prefix, np.int32(left[i])), mass + float(voc.given[left[i]]), int(voc.to[left[i]])
            todo = self.words[word:] if inner < 0 else np.concatenate([[inner], self.words[word:]])
            index, node, edge, given, side = yield todo, draw
            upto = mass + np.cumsum(given) - given
            results.append({"edges": np.concatenate([prefix, edge]), "log_prob": float(mass + given.sum()), "value": value})
            # the edges not taken, by place; only as many can be wanted as results are left, and one for kappa
            g = upto + side
            want = k - draw
            best = np.argpartition(-g, want - 1)[:want] if len(g) > want else np.arange(len(g))
            for s in best.tolist():
                if g[s] > -np.inf:
                    number += 1
                    heapq.heappush(queue, (-float(_under(g[s], value)), number, np.concatenate([prefix, edge[:s]]), float(upto[s]),
                                           int(node[s]), (int(edge[s]),), word + int(index[s]) + (0 if inner >= 0 else 1)))
        if queue and len(results) == k:
            kappa = -queue[0][0]
        for r in results:
            r["inclusion"] = 1.0 if kappa is None else float(-np.expm1(-np.exp(min(r["log_prob"] - kappa, 700.0))))
        return results


def _under(g: np.ndarray | float, at_most: float) -> np.ndarray | float:
    """A Gumbel under the condition to be at most ``at_most``: grows with ``g``."""
    return -np.logaddexp(-at_most, -g)


def search(voc: Vocabulary, samplers: list[Sampler], k: int) -> list[list[dict]]:
    """Results of several texts; each turn draws the paths of all texts at once."""
    results: list = [None] * len(samplers)
    live: list[tuple] = []

    def turn(i: int, run: Iterator, paths_: tuple | None) -> None:
        try:
            live.append((i, run, *run.send(paths_)))
        except StopIteration as end:
            results[i] = end.value

    for i, s in enumerate(samplers):
        turn(i, s.steps(k), None)
    while live:
        wanted, live = live, []
        sizes = np.array([len(w[2]) for w in wanted])
        seed = np.array([samplers[w[0]].seed % 2**64 for w in wanted], np.uint64)
        draw = np.array([w[3] for w in wanted])
        index, node, edge = paths(voc, np.concatenate([w[2] for w in wanted]), draws(seed, draw, 2, sizes))
        ends = np.cumsum(sizes)
        cut = np.searchsorted(index, np.concatenate([[0], ends]))
        given = voc.given[edge]
        side = voc.side[edge] - np.log(-np.log(_uniform(draws(seed, draw, 3, np.diff(cut)))))
        cut = cut.tolist()
        for j, (i, run, _, _) in enumerate(wanted):
            p, q = cut[j], cut[j + 1]
            turn(i, run, (index[p:q] - (ends[j] - sizes[j]), node[p:q], edge[p:q], given[p:q], side[p:q]))
    return results


def _voc(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


def sample(docs: DataFrame, k: int = K, seed: int = SEED, model: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, th, draw (from 1), ids, log_prob, value, inclusion: ``k`` distinct
    segmentations of every whole text (fewer if it has fewer).  The row key is
    the id and a hash of the text; equal rows get equal draws.  ``decoded`` adds the
    text that :func:`decode` makes of the ids, in the same Python worker."""
    common.prepare(docs.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _voc(path)
        for batch in batches:
            texts = batch.column("text")
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a, b in common.slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 500_000):
                voc.begin()
                words, which, cut = split(texts.slice(a, b - a))
                flat, cut = voc.roots(words)[which], cut.tolist()
                samplers = [Sampler(voc, flat[cut[i]:cut[i + 1]], int(keys[a + i] ^ np.uint64(seed * 0x2545F491))) for i in range(b - a)]
                found = search(voc, samplers, k)
                doc = [a + i for i, rs in enumerate(found) for _ in rs]
                draw = [n + 1 for rs in found for n in range(len(rs))]
                results = [r for rs in found for r in rs]
                ids, per_edge = voc.ids_of(np.concatenate([np.zeros(0, np.int32), *(r["edges"] for r in results)]))
                upto = np.concatenate([[0], np.cumsum(per_edge)])
                off = upto[np.concatenate([[0], np.cumsum([len(r["edges"]) for r in results], dtype=np.int64)])].astype(np.int32)
                at = pa.array(doc, pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(draw, pa.int32()), lists,
                     *(pa.array([r[c] for r in results], pa.float64()) for c in ("log_prob", "value", "inclusion")),
                     *([pa.array(texts_of(voc, lists), pa.string())] if decoded else [])], names=names)
            common.release()
        voc._words()                                    # a worker's next task may be another one

    docs = docs.select(*common.text_key()).withColumn("key", F.xxhash64("doc_id", "th"))
    schema = "doc_id long, th long, draw int, ids array<int>, log_prob double, value double, inclusion double" + ", decoded string" * decoded
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(common.released(run), schema)


def texts_of(voc: Vocabulary, lists: pa.ListArray) -> list[str]:
    """The text of each list of ids."""
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    piece = lists.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64)
    off = off - off[0]
    texts = []
    for a, b in common.slices(np.diff(off), 500_000):
        ids, cut = piece[off[a]:off[b]].copy(), off[a:b + 1] - off[a]
        ids[cut[:-1][np.diff(cut) > 0]] += len(voc.pieces)
        joined = voc.raw.take(pa.array(ids))              # its bytes are the texts, one after the other
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        data = joined.buffers()[2].to_pybytes() if len(ids) else b""
        at = ends[cut].tolist()
        texts += [data[p:q].decode("utf-8", "replace") for p, q in zip(at[:-1], at[1:])]
    return texts


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``: pieces joined, blanks
    as spaces, the blank in front taken off."""
    common.prepare(rows.sparkSession)
    path = model or default_model()
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _voc(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts_of(voc, batch.column("ids")), pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, f"{schema}, decoded string")


def round_trip() -> F.Column:
    """Whether ``decoded`` is the row's text, by the text's hash ``th`` (a null
    text decodes to the empty one)."""
    same = F.col("th").isin(F.xxhash64("decoded"), F.when(F.col("decoded") == "", F.xxhash64(F.lit(None).cast("string"))))
    return F.coalesce(same, F.lit(False))


def op8_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text: doc_id, draw, n_tokens, ids_hash,
    log_prob, value, inclusion, and whether decoding the ids gives the text back."""
    rows = sample(common.table(spark, sf_dir, "documents"), decoded=True)
    return rows.select("doc_id", "draw", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       "log_prob", "value", "inclusion",
                       round_trip().alias("round_trip"))
