"""Byte-level BPE as a compiled tokenization automaton.

Merges are compiled into a deterministic automaton over token arcs by one gadget per merge, in order of rank: the
gadget of (u, v) -> w puts an arc w wherever u v could be read and forbids v directly after u. What is left after
the last gadget accepts exactly the tokenizations that the merge procedure yields.

A state is what may follow. All arcs lead to the state of their token, so a gadget works on rows (states) and columns
(arcs that are alike to every state): w starts in the state of v and in the column of u, and the cell (u, v) is cleared.
States and columns that tokens share are split only where a gadget tells the tokens apart, which keeps the automaton
small: about 15,000 states by 11,000 columns of one bit each for 50,000 merges. The driver compiles it once and
broadcasts it; its size depends on the vocabulary alone.

Encoding runs the bytes of a pre-split word through the trie of arc labels and the table: every prefix has exactly one
accepted path, hence one last arc. Decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the public vocabularies are, unless a path is given.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: how the public vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words whose paths a worker keeps.
KEEP_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Compiled:
    """The automaton of a vocabulary: labels, state and column by token id (-1: no arc), and the cells in bits."""

    name: str
    labels: list[bytes]
    state: np.ndarray
    column: np.ndarray
    cells: bytes
    width: int


class _Cells:
    """Cells of states by columns while gadgets are put in; states and columns are shared by tokens until split."""

    def __init__(self, basic: list[int], n_tokens: int):
        self.bits = np.full((1024, 256), 255, np.uint8)
        self.state, self.column = np.full(n_tokens, -1), np.full(n_tokens, -1)
        self.state[basic] = self.column[basic] = 0
        self.states, self.columns = [len(basic)], [len(basic)]  # how many tokens share each

    def allowed(self, u: int, v: int) -> bool:
        c = self.column[v]
        return bool(self.bits[self.state[u], c >> 3] >> (c & 7) & 1)

    def own_state(self, u: int) -> int:
        s = self.state[u]
        if self.states[s] > 1:
            n = len(self.states)
            if n == len(self.bits):
                self.bits = np.concatenate([self.bits, np.full_like(self.bits, 255)])
            self.bits[n] = self.bits[s]
            self.states[s] -= 1
            self.states.append(1)
            self.state[u] = s = n
        return s

    def own_column(self, v: int) -> int:
        c = self.column[v]
        if self.columns[c] > 1:
            n, rows = len(self.columns), len(self.states)
            if n == 8 * self.bits.shape[1]:
                self.bits = np.concatenate([self.bits, np.full_like(self.bits, 255)], axis=1)
            gone = 1 - (self.bits[:rows, c >> 3] >> (c & 7) & 1)
            self.bits[:rows, n >> 3] &= ~(gone << (n & 7)).astype(np.uint8)
            self.columns[c] -= 1
            self.columns.append(1)
            self.column[v] = c = n
        return c

    def forbid(self, u: int, v: int) -> None:
        s, c = self.own_state(u), self.own_column(v)
        self.bits[s, c >> 3] &= 255 ^ (1 << (c & 7))

    def gadget(self, u: int, v: int, w: int) -> None:
        """w wherever u v is read; then u is no longer followed by v, nor, where runs merge from the left, by v v."""
        if not self.allowed(u, v):
            return  # an earlier merge always comes between
        if self.state[w] >= 0:
            raise ValueError(f"two merges make the token {w}")
        self.state[w], self.column[w] = self.state[v], self.column[u]
        self.states[self.state[v]] += 1
        self.columns[self.column[u]] += 1
        self.forbid(u, v)
        if u == v:
            self.forbid(u, w)


def compile_automaton(labels: dict[int, bytes], merges: list[tuple[bytes, bytes]]) -> Compiled:
    """The automaton of the merges, which come in order of rank; labels by token id."""
    ids = {b: i for i, b in labels.items()}
    n = max(labels, default=-1) + 1
    made = {a + b for a, b in merges}
    cells = _Cells([i for i, b in labels.items() if len(b) == 1 and b not in made], n)
    for a, b in merges:
        cells.gadget(ids[a], ids[b], ids[a + b])
    width = (len(cells.columns) + 7) // 8
    bits = np.ascontiguousarray(cells.bits[: len(cells.states), :width])
    return Compiled(uuid.uuid4().hex, [labels.get(i, b"") for i in range(n)], cells.state.astype(np.int32), cells.column.astype(np.int32), bits.tobytes(), width)


@lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    """The automaton of a vocabulary file (vocabulary and merges in JSON)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    label = lambda s: bytes(letters[c] for c in s)
    labels = {i: label(s) for s, i in model["vocab"].items() if all(c in letters for c in s)}
    return compile_automaton(labels, [tuple(label(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]])


class Automaton:
    """Runs a compiled automaton."""

    def __init__(self, made: Compiled):
        self.labels, self.cells = made.labels, made.cells
        self.row = [s * made.width for s in made.state.tolist()]  # where the cells of a token's state begin
        self.column = made.column.tolist()
        self.next: dict[int, int] = {}  # the trie: node << 8 | byte -> node
        self.arc: dict[int, int] = {}  # node -> the arc whose label ends there
        nodes = 0
        for i, b in enumerate(self.labels):
            if self.column[i] < 0:
                continue
            at = 0
            for x in b:
                to = self.next.get(at << 8 | x)
                if to is None:
                    nodes += 1
                    to = self.next[at << 8 | x] = nodes
                at = to
            self.arc[at] = i
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT).findall

    def run(self, word: bytes) -> list[int]:
        """The accepted path of one word's bytes."""
        n, step, arc_of, cells, column = len(word), self.next.get, self.arc.get, self.cells, self.column
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):
            if begin:
                if last[begin] < 0:
                    continue
                row = self.row[last[begin]]
            node = 0
            for end in range(begin, n):
                node = step(node << 8 | word[end])
                if node is None:
                    break
                arc = arc_of(node)
                if arc is not None and (not begin or cells[row + (column[arc] >> 3)] >> (column[arc] & 7) & 1):
                    last[end + 1], start[end + 1] = arc, begin
        path = []
        while n:
            path.append(last[n])
            n = start[n]
        return path[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; of null and empty text the empty list."""
        ids: list[int] = []
        if not text:
            return ids
        words, known = self.words, self.words.get
        for w in self.split(text):
            got = known(w)
            if got is None:
                got = self.run(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= KEEP_WORDS:
                        words.clear()
                    words[w] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", errors="replace")


_running: dict[str, Automaton] = {}


def automaton(made: Compiled) -> Automaton:
    """One automaton per worker process and vocabulary."""
    if made.name not in _running:
        _running.clear()
        _running[made.name] = Automaton(made)
    return _running[made.name]


def encode_table(df: DataFrame, id_col: str, text_col: str, path: str | None = None, counts_only: bool = False) -> DataFrame:
    """(id_col, ids) of every row of `df`, or (id_col, n_tokens).

    Null and empty texts give an empty list (0 tokens). Repeated rows give repeated rows; other columns are not read.
    One pass without a shuffle. Only the driver reads the vocabulary.
    """
    sent = df.sparkSession.sparkContext.broadcast(compiled(path or os.path.join(TOKENIZERS, VOCABULARY)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(sent.value)
        for b in batches:
            ids = [a.encode(t) for t in b.column(1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.record_batch([b.column(0), out], names=["id", "out"])

    kind = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {kind}, out {'long' if counts_only else 'array<int>'}")
    return got.select(F.col("id").alias(id_col), F.col("out").alias("n_tokens" if counts_only else "ids"))
