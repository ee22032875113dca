"""Byte-level BPE ids of whole texts, long ones by tree concatenation, and back.

Texts up to ``LEAF`` characters are encoded where they stand, stretch by stretch
(the tokenizer always cuts before the blanks that follow a word, and between a
letter and ASCII punctuation), and each worker remembers the stretches it has met.  A longer text is cut into leaves,
which Spark deals out over the tasks and encodes in parallel:

* at white space after a character that isn't: the tokenizer cuts there whatever
  stands around it, so such leaves only need to be put one after the other;
* a stretch without such a place (``2 * LEAF`` characters of unsplit text) is cut
  into its words by the tokenizer's own pattern; a word longer than ``LEAF`` is
  halved until its parts are short enough.

The parts of one word are joined as a tree: two neighbours' ids are joined by
re-encoding a window of ids around the join, which doubles on the side that
doesn't agree, until its first id is the left part's id there and its last id
the right part's (or a part's end is reached).  A sequence of ids is BPE's own
result exactly if each pair of neighbours is, so agreement on both sides proves
the joined ids.

Results for odd input: a null or empty text has no ids, and decodes to the empty
text.  Strings of special tokens become their ids, as the library does.  Repeated
rows, repeated ids and a null ``doc_id`` each give their own row.  An empty table
gives no rows; further columns are not read.  One task holds one whole text and
its ids at the end, as the table's row does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a leaf; texts up to this length are encoded whole.
LEAF = 65_536
#: Ids on each side of a join that are encoded anew at first.
WINDOW = 4
#: Characters that one call of the library encodes.
CALL_CHARS = 2_000_000
#: Stretches that a worker remembers before it forgets those not met since it last did.
MEMORY = 400_000

#: Fixed value: a space in the byte alphabet.
_SPACE = "\u0120"
#: What a leaf holds: whole text, words in the tokenizer's byte alphabet (one a
#: line), one id, or a later part of the word before it.
TEXT, WORDS, ID, PART = "text", "words", "id", "part"

_coders: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """A byte-level BPE tokenizer without normalizer; others are refused."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if (spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
                or spec["model"].get("dropout") or spec["model"].get("end_of_word_suffix")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])
                       for t in spec["added_tokens"])):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.added_re = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.piece = {i: p for p, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.text = {i: str(i) for i in self.piece}
        self.memory: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}
        alphabet = _byte_alphabet()
        self.raw = {i: p.encode() if i in added else bytes(alphabet[c] for c in p) for i, p in self.piece.items()}

    def word(self, mapped: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        return [t.id for t in self.model.tokenize(mapped)] if mapped else []

    def texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of whole texts, a bounded number of characters a call."""
        for a, b in common.slices(np.fromiter(map(len, texts), np.int64, len(texts)), CALL_CHARS):
            for e in self.tok.encode_batch_fast(texts[a:b], add_special_tokens=False):
                yield e.ids

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        """(n_tokens, SHA-256 of the ids, SHA-256 of the decoded text)."""
        text = self.text
        decoded = self.tok.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(",".join([text[i] for i in ids]).encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """``digest`` of whole texts from their remembered stretches."""
        out = []
        for a, b in common.slices(np.fromiter(map(len, texts), np.int64, len(texts)), CALL_CHARS):
            cut = [None if _ODD_BLANK.search(t) else _STRETCH.findall(t) for t in texts[a:b]]
            self.remember({s for stretches in cut if stretches for s in stretches})
            get = self.memory.__getitem__
            for text, stretches in zip(texts[a:b], cut):
                if stretches is None:
                    out.append(self.digest(self.tok.encode(text, add_special_tokens=False).ids))
                    continue
                n, ids, raw = zip(*map(get, stretches)) if stretches else ((), (), ())
                decoded = b"".join(raw).decode("utf-8", "replace")
                out.append((sum(n), hashlib.sha256(b",".join(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out

    def remember(self, stretches: set[str]) -> None:
        """(number of ids, ids as text, bytes that they decode to) of stretches."""
        if len(self.memory) + len(stretches) > MEMORY:
            self.memory, self.older = {}, self.memory
        memory, older, new = self.memory, self.older, []
        for s in stretches:
            if s not in memory:
                if s in older:
                    memory[s] = older[s]
                else:
                    new.append(s)
        text, raw, rest = self.text, self.raw, []

        def put(s: str, ids: list[int]) -> None:
            memory[s] = (len(ids), ",".join([text[i] for i in ids]).encode(), b"".join([raw[i] for i in ids]))

        # ASCII letters after a space or none are one word to the tokenizer: to its model at once
        for s in new:
            w = s[1:] if s[0] == " " else s
            if w.isascii() and w.isalpha():
                put(s, self.word(_SPACE + w if w is not s else w))
            else:
                rest.append(s)
        for k in range(0, len(rest), 20_000):
            part = rest[k:k + 20_000]
            for s, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                put(s, e.ids)

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """Ids of the word whose halves have the ids ``left`` and ``right``."""
        a = b = window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            ids = self.word("".join([self.piece[i] for i in left[len(left) - a:]] + [self.piece[i] for i in right[:b]]))
            left_ok = a == len(left) or ids[0] == left[len(left) - a]
            right_ok = b == len(right) or ids[-1] == right[b - 1]
            if left_ok and right_ok:
                return left[:len(left) - a] + ids + right[b:]
            a, b = (a if left_ok else 2 * a), (b if right_ok else 2 * b)

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Ids of a word from those of its parts, neighbours joined level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        """(kind, content) of the leaves of a text, in order."""
        start = 0
        while start < len(text):
            if len(text) - start <= leaf:
                yield TEXT, text[start:]
                return
            # the first safe place from half a leaf on, within two leaves
            m = _SAFE.search(text, start + leaf // 2, min(len(text), start + 2 * leaf))
            if m:
                yield TEXT, text[start:m.start() + 1]
                start = m.start() + 1
                continue
            m = _SAFE.search(text, start + leaf // 2)
            stop = m.start() + 1 if m else len(text)
            yield from self.unsplit(text[start:stop], leaf)
            start = stop

    def unsplit(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        """Leaves of a stretch without a safe place: words, parts of words, special ids."""
        at = 0
        for m in [*self.added_re.finditer(text), None]:
            yield from self.words(text[at:m.start() if m else len(text)], leaf)
            if m:
                yield ID, str(self.added[m.group()])
                at = m.end()

    def words(self, text: str, leaf: int) -> Iterator[tuple[str, str]]:
        held, size = [], 0
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text) if text else ():
            if held and size + len(word) > leaf:
                yield WORDS, "\n".join(held)
                held, size = [], 0
            if len(word) > leaf:
                for k, part in enumerate(halves(word, leaf)):
                    yield (PART if k else WORDS), part
            else:
                held.append(word)
                size += len(word)
        if held:
            yield WORDS, "\n".join(held)

    def leaf_ids(self, kinds: list[str], contents: list[str]) -> list[list[int]]:
        whole = self.texts([c for k, c in zip(kinds, contents) if k == TEXT])
        out = []
        for kind, content in zip(kinds, contents):
            if kind == TEXT:
                out.append(next(whole))
            elif kind == ID:
                out.append([int(content)])
            else:
                out.append([i for w in content.split("\n") for i in self.word(w)])
        return out


#: Blanks and the Latin letters after them, up to a blank or ASCII punctuation; or
#: blanks and all that follows up to the next blank.  White space of another kind
#: may be cut in other ways: a text that holds some is encoded whole.
_STRETCH = re.compile(r"[ \n\t]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+(?=[ \n\t!-/:-@\[-`{-~]|\Z)"
                      r"|[ \n\t]*[^ \n\t]+|[ \n\t]+")
_ODD_BLANK = re.compile(r"[^\S \n\t]")
#: A character that is no white space before ASCII white space: always a cut.
_SAFE = re.compile(r"[\w!-~](?=[ \n\t])")


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    bytes that print stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def halves(word: str, leaf: int) -> list[str]:
    """A word halved until no part is longer than ``leaf``."""
    if len(word) <= leaf:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], leaf) + halves(word[mid:], leaf)


def _coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _batch(ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def leaf_rows(long_docs: DataFrame, path: str, leaf: int) -> DataFrame:
    """(row, doc_id, seq, kind, content): the leaves of texts, ``row`` telling texts apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                kinds, contents = zip(*coder.leaves(text, leaf))
                n = len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array(kinds, pa.string()), pa.array(contents, pa.string())],
                    names=["row", "doc_id", "seq", "kind", "content"])

    return (long_docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
            .mapInArrow(run, "row long, doc_id long, seq int, kind string, content string"))


def encoded_leaves(leaves: DataFrame, path: str) -> DataFrame:
    """The leaves dealt out over the tasks, with ids in place of contents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for a, b in common.slices(pc.utf8_length(batch.column("content")).to_numpy(), CALL_CHARS):
                part = batch.slice(a, b - a)
                ids = coder.leaf_ids(part.column("kind").to_pylist(), part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "seq", "kind")),
                                                  pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["row", "doc_id", "seq", "kind", "ids"])

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves.repartition(n, "row", "seq").mapInArrow(run, "row long, doc_id long, seq int, kind string, ids array<int>")


def whole_ids(coder: Coder, kinds: list[str], ids: list[list[int]]) -> list[int]:
    """Ids of a text from those of its leaves in order."""
    out, k = [], 0
    while k < len(kinds):
        stop = k + 1
        while stop < len(kinds) and kinds[stop] == PART:
            stop += 1
        out += coder.tree(ids[k:stop])
        k = stop
    return out


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (see the module)."""
    common.prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            yield _batch(batch.column("doc_id"), coder.digests(batch.column("text").to_pylist()))

    def join_leaves(table: pa.Table) -> pa.Table:
        coder = _coder(path)
        table = table.sort_by("seq")
        ids = whole_ids(coder, table.column("kind").to_pylist(), table.column("ids").to_pylist())
        return pa.Table.from_batches([_batch(table.column("doc_id").combine_chunks().slice(0, 1), [coder.digest(ids)])])

    is_long = F.length("text") > leaf
    leaves = encoded_leaves(leaf_rows(docs.filter(is_long), path, leaf), path)
    return docs.filter(~is_long).mapInArrow(short, _OUT).unionByName(leaves.groupBy("row").applyInArrow(join_leaves, _OUT))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text and the text decoded from them, as digests."""
    return encode(common.table(spark, sf_dir, "documents"))
