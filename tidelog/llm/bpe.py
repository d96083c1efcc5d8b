"""Byte-pair encoding and decoding by a deterministic token automaton.

The automaton reads *tokens*; its accepted paths are exactly the tokenizations
that byte-pair merging yields.  It starts as one state with an arc for every
base symbol and is changed by one gadget for each merge ``(a, b) -> c``, in
order of rank:

* every arc labelled ``a`` is redirected to a copy of its target that lacks the
  arc ``b`` (after the merge ``a b`` can no longer be read one by one), and
* every state with an arc ``a`` gets an arc ``c`` that leads where ``b`` led.

All arcs with one label therefore lead to one state, so a state is named by the
last token read; the state of ``c`` is a copy, as of that moment, of the state
of ``b``, and the arcs ``c`` stand, as of that moment, wherever arcs ``a``
stand.  A copy is stored as a reference and its moment, and an entry of the
transition table is resolved from these references on first use and kept.

A word is encoded by one run over its symbols.  Two tables drive it: one leads
from symbol to symbol through the labels' letters and names the labels that end
at each place, the other tells whether a state has an arc.  The state after so
many symbols is the target of the one arc that ends there and that the state
where its label began has; every prefix has one path at most, so the run is
deterministic and takes nothing back.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = ""  # stands for the end-of-word suffix inside symbol strings
#: Words kept by each Python worker; the cache is emptied when full, so memory is bounded.
CACHE_WORDS, CACHE_PIECES = 300_000, 150_000
#: Entries of each table that are kept once they are resolved; others are resolved whenever they are met.
TABLE_ENTRIES = 400_000
#: Rows and bytes of text after which a batch of results is handed on.
OUT_ROWS, OUT_BYTES = 1024, 4 << 20


class Automaton:
    """Token automaton compiled from a vocabulary and ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        self.suffix = suffix or ""
        inner = (lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s) if suffix else (lambda s: s)
        ids = {inner(s): i for s, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.spelled: list[str] = [""] * size
        for s, i in ids.items():
            self.spelled[i] = s
        never = len(merges) + 1
        #: The moment at which arc b was cut from state a, by a << 20 | b.
        self.cut: dict[int, int] = {}
        #: Per token: the state its own state was copied from, the label its arcs stand in for, and the moment.
        self.row_of, self.column_of, self.made = [-1] * size, [-1] * size, [never] * size
        dead: set[int] = set()
        merged: set[int] = set()
        for rank, (left, right) in enumerate(merges):
            a, b, c = ids[inner(left)], ids[inner(right)], ids[inner(left + right)]
            reachable = a not in dead and b not in dead and not self._is_cut(a, b)
            self.cut.setdefault(a << 20 | b, rank)
            if c in merged:
                continue
            merged.add(c)
            if not reachable:
                dead.add(c)
            self.row_of[c], self.column_of[c], self.made[c] = b, a, rank
        self.arcs_from_start = {s: i for s, i in ids.items() if i not in dead and (i in merged or len(s.removesuffix(END)) <= 1)}
        self._table: dict[int, bool] = {}
        self._read_labels()

    def _read_labels(self) -> None:
        """The letters of all labels as a trie with links to the longest proper suffixes, and the labels that end at each of its nodes, longest first."""
        self.step: dict[int, int] = {}  # node << 21 | symbol to node
        self.suffix_of, label, made = [0], [-1], [(0, 0, 0, 0)]
        for s, token in self.arcs_from_start.items():
            node = 0
            for depth, c in enumerate(map(ord, s), 1):
                after = self.step.get(node << 21 | c)
                if after is None:
                    after = self.step[node << 21 | c] = len(label)
                    self.suffix_of.append(0)
                    label.append(-1)
                    made.append((depth, node, c, after))
                node = after
            label[node] = token
        self.most_steps = len(self.step) + TABLE_ENTRIES
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(label)
        for depth, before, c, node in sorted(made)[1:]:  # shorter ones first
            if before:
                self.suffix_of[node] = self._to(self.suffix_of[before], c)
            shorter = self.ending[self.suffix_of[node]]
            self.ending[node] = ((label[node], depth), *shorter) if label[node] >= 0 else shorter

    def _to(self, node: int, c: int) -> int:
        """The node of the longest suffix that some label continues."""
        while (after := self.step.get(node << 21 | c)) is None and node:
            node = self.suffix_of[node]
        return after or 0

    def _is_cut(self, x: int, y: int) -> bool:
        """Whether state x lacks an arc y: it does if an original of x lost an original of y before both were copied."""
        cut, row_of, column_of, made = self.cut, self.row_of, self.column_of, self.made
        u, before_u = x, len(made) + len(cut) + 2
        while u >= 0:
            v, before = y, before_u
            while v >= 0:
                rank = cut.get(u << 20 | v)
                if rank is not None and rank < before:
                    return True
                # an arc c stands where a stood after the cut, a moment later than b's state was copied
                before = min(before, made[v] + 1)
                v = column_of[v]
            before_u = min(before_u, made[u])
            u = row_of[u]
        return False

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        found = self._table.get(key)
        if found is None:
            found = not self._is_cut(state, token)
            if len(self._table) < TABLE_ENTRIES:
                self._table[key] = found
        return found

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pre-split word, given as its base symbols."""
        if not symbols:
            return []
        step, ending, table, node = self.step, self.ending, self._table, 0
        states = [-1]  # after so many symbols; -1: no path
        for end, c in enumerate(map(ord, symbols + END if self.suffix else symbols), 1):
            after = step.get(node << 21 | c)
            if after is None:
                after = self._to(node, c)
                if len(step) < self.most_steps:
                    step[node << 21 | c] = after
            node, state = after, -1
            for token, length in ending[node]:
                if length == end:
                    state = token
                    break
                before = states[end - length]
                if before >= 0:
                    found = table.get(before << 20 | token)
                    if found or (found is None and self.has_arc(before, token)):
                        state = token
                        break
            states.append(state)
        path, spelled, at = [], self.spelled, len(states) - 1
        while at:
            if states[at] < 0:
                raise ValueError("no tokenization")
            path.append(states[at])
            at -= len(spelled[states[at]])
        path.reverse()
        return path


#: Words of Basic Latin and Latin-1 letters and signs, in which nothing is left to compose.
PLAIN = regex.compile(r"[!-~¡-ÿ]+").fullmatch


def _byte_symbols() -> list[str]:
    """Byte-level symbols: a printable byte stands for itself, the others in turn for the characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


SYMBOLS = _byte_symbols()


def as_symbols(piece: str) -> str:
    return piece if piece.isascii() else "".join([SYMBOLS[b] for b in piece.encode()])


class _Words(dict):
    """Word to ids (bytes), computed when first met; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) < 200:
            if len(self) >= self.most:
                self.clear()
            self[key] = made
        return made


class WordCodec:
    """Text to ids and ids to text, for a tokenizer file with an end-of-word suffix and no decoder.

    Words are the runs between white space; the file's own normalizer and
    pre-tokenizer split a word further when it is met first.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = model["vocab"] | self.special
        self.labels: list[str] = [""] * (max(labels.values()) + 1)
        for s, i in labels.items():
            self.labels[i] = s
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        encode = self.automaton.encode
        self.pieces = _Words(lambda piece: array("I", encode(piece)).tobytes(), CACHE_PIECES)
        self.words = _Words(lambda word: b"".join(self._parts(word)), CACHE_WORDS)

    def _parts(self, word: str) -> Iterator[bytes]:
        hits = [(word.find(s), s) for s in self.special if s in word]
        if hits:
            at, s = min(hits)
            yield from self._parts(word[:at])
            yield array("I", [self.special[s]]).tobytes()
            yield from self._parts(word[at + len(s) :])
        elif PLAIN(word):  # composed already, lower-cased and split alike by Python
            for piece in self.split(word.lower()):
                yield self.pieces[piece if piece.isascii() else as_symbols(piece)]
        elif word:
            for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word)):
                yield self.pieces[piece]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, split_words(text)))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The characters that str.split() takes for white space though Unicode's White_Space property does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def split_words(text: str) -> list[str]:
    if any(c in text for c in NOT_SPACE):
        return regex.findall(r"\S+", text)
    return text.split()


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One automaton for each Python worker and tokenizer file."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens (long), token_ids (binary, little-endian unsigned 32-bit), decoded (string).

    One row for each input row; other columns are not read.  Null text counts
    as empty: no tokens, empty decoded text.  Long texts are encoded whole.
    Repeated rows give repeated rows.  The path must be readable on every worker.
    """
    schema = pa.schema([("id", docs.schema[id_col].dataType.typeName() == "string" and pa.string() or pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = c.encode(text.as_py() or "")
                decoded = c.decode(ids)
                for column, value in zip(rows, (key, len(ids) // 4, ids, decoded), strict=True):
                    column.append(value)
                size += len(ids) + len(decoded)
                if len(rows[0]) >= OUT_ROWS or size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = [[], [], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    kind = "string" if schema.field("id").type == pa.string() else "long"
    out = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, token_ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
