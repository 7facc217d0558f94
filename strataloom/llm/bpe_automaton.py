"""Byte-level BPE as a deterministic tokenization automaton.

The merges are compiled by successive merge gadgets. The automaton starts with
one state per byte, all arcs present. The gadget of a merge ``(a, b) -> c`` adds
state ``c``, which takes over the in-arcs that ``a`` and the out-arcs that ``b``
have at that time, and removes the arc ``a -> b``. A state is named by the label
(token) read last, so after all gadgets an input has exactly one path: its BPE
encoding.

The result is two tables. The arcs that a state lacks: an out-arc of ``t`` is gone
if a gadget removed it from ``t`` itself, or from a right part of ``t`` before the gadget
that took it over; so a state keeps, per label ``y``, the first such gadget, and an arc to ``u``
is absent if ``u`` or a left part ``y`` of it is listed with a gadget no later than the one that made
``y`` part of it. For 50,000 labels these are 943,000 entries. And the byte transitions: a trie of the
labels with failure links, whose states know the longest label that ends there, and per label the
next shorter one that ends with it.

Encoding a word is one walk over its bytes: a transition per byte, then the labels that end there
from the longest on until one has an arc from the state of the prefix before it. It is linear in the
length of the word, as labels have bounded length. Decoding emits the labels' bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words kept encoded per Python worker; a full cache is emptied, which changes only speed.
CACHED_WORDS = 500_000


class MergeGadgets:
    """The gadgets of one vocabulary, one per label in order of rank: ``left`` and ``right`` are the parts it joins (-1: a byte)."""

    def __init__(self, labels: list[bytes]):
        self.labels = labels
        self.ids = {x: i for i, x in enumerate(labels)}
        self.longest = max(map(len, labels), default=0)
        self.merge: dict[tuple[int, int], int] = {}
        self.left, self.right = [-1] * len(labels), [-1] * len(labels)
        for i, label in enumerate(labels):
            self.present = i
            if len(label) > 1:
                parts = self.encode(label)
                if len(parts) != 2:
                    raise ValueError(f"label {i} is no merge of two earlier labels")
                self.left[i], self.right[i] = parts
                self.merge[parts[0], parts[1]] = i
        self.present = len(labels)

    def arc(self, t: int, u: int) -> bool:
        """Whether label u may follow label t: back through the gadgets, the later one first."""
        left, right, merge = self.left, self.right, self.merge
        before = self.present
        while True:
            merged = merge.get((t, u))
            if merged is not None and merged < before:
                return False
            if t > u and right[t] >= 0:
                t, before = right[t], t  # t took over the out-arcs that its right part had before gadget t
            elif left[u] >= 0:
                u, before = left[u], u + 1  # of equal pairs side by side the first merges: gadget u itself counts
            elif right[t] >= 0:
                t, before = right[t], t
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """By the labels and gadgets so far, without tables: for compiling, and as a second opinion."""
        n = len(word)
        state, back = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                label = self.ids.get(word[start:end])
                if label is not None and (label < self.present or end - start == 1) and (not start or self.arc(state[start], label)):
                    state[end], back[end] = label, start
                    break
        out = []
        while n:
            out.append(state[n])
            n = back[n]
        return out[::-1]

    def absent_arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, label, gadget): of state t the entries from bounds[t] to bounds[t + 1]."""
        starting: dict[int, list[tuple[int, int]]] = {}
        for (x, y), gadget in self.merge.items():
            starting.setdefault(x, []).append((gadget, y))
        for found in starting.values():
            found.sort()
        bounds, labels, gadgets = [0], [], []
        for t in range(len(self.labels)):
            first: dict[int, int] = {}
            x, taken = t, len(self.labels)
            while x >= 0:
                for gadget, y in starting.get(x, ()):
                    if gadget >= taken:
                        break
                    first[y] = min(gadget, first.get(y, gadget))
                x, taken = self.right[x], x
            labels += first.keys()
            gadgets += first.values()
            bounds.append(len(labels))
        return np.array(bounds, np.int32), np.array(labels, np.int32), np.array(gadgets, np.int32)


class MergeAutomaton:
    """The compiled tables; ``labels[i]`` is the bytes of id i."""

    def __init__(self, labels: list[bytes], left: list[int] | None = None, absent: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        if left is None or absent is None:
            gadgets = MergeGadgets(labels)
            left, absent = gadgets.left, gadgets.absent_arcs()
        self.labels, self.left, self.absent = labels, left, absent
        self.lengths = [len(x) for x in labels]
        self.barred: dict[int, dict[int, int]] = {}
        self._trie()

    def _trie(self) -> None:
        self.step: dict[int, int] = {}  # state * 256 + byte to state
        ends = [-1]
        for i, label in enumerate(self.labels):
            node = 0
            for byte in label:
                key = node * 256 + byte
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.fail, self.longest = [0] * len(ends), ends[:]
        self.shorter = [-1] * len(self.labels)
        level = [0]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        while level:
            below = []
            for node in level:
                for byte, child in children.get(node, ()):
                    self.fail[child] = self._go(self.fail[node], byte) if node else 0
                    suffix = self.longest[self.fail[child]]
                    if ends[child] >= 0:
                        self.shorter[ends[child]] = suffix
                    else:
                        self.longest[child] = suffix
                    below.append(child)
            level = below

    def _go(self, node: int, byte: int) -> int:
        while True:
            found = self.step.get(node * 256 + byte)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.fail[node]

    def _bars(self, t: int) -> dict[int, int]:
        """The row of state t in the table of absent arcs."""
        found = self.barred.get(t)
        if found is None:
            bounds, labels, gadgets = self.absent
            a, b = bounds[t], bounds[t + 1]
            found = self.barred[t] = dict(zip(labels[a:b].tolist(), gadgets[a:b].tolist()))
        return found

    def arc(self, t: int, u: int) -> bool:
        """Whether label u may follow label t."""
        bars, left = self._bars(t), self.left
        made = len(self.labels)
        while u >= 0:
            if bars.get(u, made + 1) <= made:
                return False
            u, made = left[u], u
        return True

    def encode(self, word: bytes) -> list[int]:
        step, fail, longest, shorter, lengths = self.step, self.fail, self.longest, self.shorter, self.lengths
        n, node = len(word), 0
        state = [-1] * (n + 1)
        for end, byte in enumerate(word, 1):
            while (found := step.get(node * 256 + byte)) is None:
                if not node:
                    raise ValueError(f"byte {byte} has no label")
                node = fail[node]
            node = found
            label = longest[node]
            while True:
                start = end - lengths[label]
                if not start or self.arc(state[start], label):
                    break
                label = shorter[label]
            state[end] = label
        out = []
        while n:
            out.append(state[n])
            n -= lengths[state[n]]
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def read_labels(vocabulary: str = DEFAULT_VOCABULARY) -> list[bytes]:
    """The labels of a rank file in order of rank."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    labels = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in labels] != list(range(len(labels))):
        raise ValueError("the ranks have gaps")
    return labels


_compiled: dict[str, MergeAutomaton] = {}


def compile_vocabulary(vocabulary: str = DEFAULT_VOCABULARY) -> MergeAutomaton:
    if vocabulary not in _compiled:
        _compiled[vocabulary] = MergeAutomaton(read_labels(vocabulary))
    return _compiled[vocabulary]


class _Words(dict):
    """Text of a word to its ids, filled at first use."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = self.automaton.encode(word.encode("utf-8", "surrogatepass"))
        return found


_held: tuple[tuple, _Words] | None = None


def _words_of(tables: tuple) -> _Words:
    """The automaton and the encoded words of this Python worker, kept from task to task."""
    global _held
    if _held is None or _held[0] is not tables:
        _held = tables, _Words(MergeAutomaton(*tables))
    return _held[1]


def encode_texts(documents: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, one narrow pass without a shuffle.

    The compiled tables are broadcast; their size is bounded by the vocabulary.
    Defined results: null and empty text give an empty list; a null key stays null;
    repeated rows are encoded each; other columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    made = compile_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast((made.labels, made.left, made.absent))
    source = documents.select(key, text)
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words = _words_of(shared.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                flat: list[int] = []
                ends = [0]
                for value in part.column(1).to_pylist():
                    if value:
                        for word in split(value):
                            flat += words[word]
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def decode_texts(encoded: DataFrame, key: str, ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the inverse of ``encode_texts`` (a null text comes back empty)."""
    spark: SparkSession = encoded.sparkSession
    shared = spark.sparkContext.broadcast(compile_vocabulary(vocabulary).labels)
    source = encoded.select(key, ids)
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = shared.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(label, x or ())).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"`{key}` {key_type}, text string")
