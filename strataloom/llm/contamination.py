"""Evaluation texts leaking into a corpus, by template canonicalisation.

Both sides are reduced to canonical words: lower case, punctuation and layout dropped, numbers,
words that mix letters and digits, units after a number and currencies before one replaced by typed
placeholders. In a second reading capitalised words inside a sentence are names and get a placeholder
too, so that a question re-asked with other names, numbers and units reads the same; a text in another
letter case reads the same in the first. Windows of ``WINDOW`` canonical words of the items are
hash-joined with those of the documents; beside the plain windows there are gapped ones, which leave
one inner word open, so an item of which every fifth word was changed is still met; they count where they
go on for ``CHAIN`` words or more, as phrases of one mould differ in single words too. Every document
with a window is verified: words that match on one diagonal form runs, runs are joined over small
edits, placeholder slots must be filled consistently (one value of the item always by one value of the
document), and the share of the item's own words covered decides.

Sentences that stand in several items (stock openings) are not an item's own
wording and give no windows.

Scale. The items are a stated query set: they are broadcast in blocks of at most ``ITEM_CHARS``
characters, and a block is held against all documents in one narrow pass without a shuffle; a
document is handled whole. Up to that size, as here, there is one block and one pass.

Defined results: null, empty and blank texts match nothing; items without own
wording leak nowhere; repeated items (equal texts) share their sentences and are
therefore compared by all sentences they have in common too; repeated documents
are reported each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import cut

WINDOW = 5
#: Characters of item texts broadcast at once.
ITEM_CHARS = 32_000_000
#: Edits bridged between two runs, in words of the item.
EDIT = 3
#: Least words of a chain of gapped windows.
CHAIN = 2 * WINDOW
#: Documents looked at in one stroke; changes only speed.
STROKE = 256
#: Offsets of the words of a window: plain, and with one inner word left open.
PATTERNS = [tuple(range(WINDOW))] + [tuple(k for k in range(WINDOW + 1) if k != gap) for gap in range(1, WINDOW)]
_PIECE = re.compile(r"[^\W_]+|[.!?:\n。！？]")
_MARKS = frozenset(".!?:\n。！？")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
#: Units that follow a number, and currencies that stand before one.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years b kb mb gb tb px percent km m cm mm kg g mg".split())
CURRENCIES = frozenset("usd eur gbp jpy cny inr chf pln rub try vnd".split())
NUMBER, NAME, UNIT, FIRST_WORD = 1, 2, 3, 4
_DIGITS, _UNIT_AFTER, _UNIT_BEFORE, _CAPITAL, _MARK, _BITS = 1, 2, 4, 8, 16, 5


class Codes(dict):
    """A piece of text as written to the id of its canonical word (0: in no item) and what it may be by its place."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, piece: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        word = piece.lower()
        if piece in _MARKS:
            code = _MARK
        elif not word.isalpha():
            code = (NUMBER << _BITS | _DIGITS) if word.isdigit() else NAME << _BITS
        else:
            capital = piece[0].isupper() and len(piece) > 1 and not piece.isupper()
            code = self.known.get(word, 0) << _BITS | _UNIT_AFTER * (word in UNITS) | _UNIT_BEFORE * (word in CURRENCIES) | _CAPITAL * capital
        self[piece] = code
        return code


def read_words(pieces: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pieces are words, ids in the first reading, ids with names as placeholders)."""
    code = np.fromiter(map(codes.__getitem__, pieces), dtype=np.uint64, count=len(pieces))
    word = np.flatnonzero((code & _MARK) == 0)
    after_mark = np.ones(len(pieces), dtype=bool)
    after_mark[1:] = (code[:-1] & _MARK) > 0
    code, starts = code[word], after_mark[word]
    plain = code >> _BITS
    digits = (code & _DIGITS) > 0
    plain[1:][digits[:-1] & ((code[1:] & _UNIT_AFTER) > 0)] = UNIT
    plain[:-1][digits[1:] & ((code[:-1] & _UNIT_BEFORE) > 0)] = UNIT
    named = plain.copy()
    named[((code & _CAPITAL) > 0) & ~starts] = NAME
    return word, plain, named


def window_hashes(ids: np.ndarray, offsets: Sequence[int], seed: int, same: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash per place; 0 where a word is unknown (id 0) or the window leaves its text (``same``: number of the text)."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, seed + 1, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in offsets:
            part = ids[k : k + n]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= part != 0
    if same is not None:
        known &= same[:n] == same[offsets[-1] :]
    h[~known] = 0
    return h


def _readings(plain: np.ndarray, named: np.ndarray, short: Sequence[int], same: np.ndarray | None = None) -> Iterator[tuple[int, tuple[int, ...], np.ndarray]]:
    """(seed, offsets, hashes) of every kind of window; in the second reading only those that a name makes different."""
    for seed, offsets in enumerate(PATTERNS):
        yield seed, offsets, window_hashes(plain, offsets, seed, same)
    unlike = np.flatnonzero(plain != named)
    if len(unlike):
        offsets, seed = PATTERNS[0], len(PATTERNS)
        h = window_hashes(named, offsets, seed, same)
        near = np.zeros(len(h), dtype=bool)
        for k in offsets:
            at = unlike - k
            near[at[(at >= 0) & (at < len(h))]] = True
        h[~near] = 0
        yield seed, offsets, h
    for size in short:
        yield len(PATTERNS) + size, tuple(range(size)), window_hashes(plain, tuple(range(size)), len(PATTERNS) + size, same)


def canonical_words(text: str) -> list[str]:
    """The canonical words of a text by themselves, placeholders as control characters: what sentences are compared by."""
    known: dict[str, int] = {}
    pieces = _PIECE.findall(text)
    for piece in pieces:
        known.setdefault(piece.lower(), len(known) + FIRST_WORD)
    word, plain, _ = read_words(pieces, Codes(known)) if pieces else ((), (), ())
    names = {i: w for w, i in known.items()} | {NUMBER: "\x01", NAME: "\x02", UNIT: "\x03"}
    return [names[i] for i in np.asarray(plain).tolist()]


class ItemWindows:
    """The own wording of a block of items, ready for look-up."""

    def __init__(self, items: list[tuple[int, str]], stock: dict[int, set[str]] | None = None):
        """``stock``: the keys of each item's sentences that are not its own, if ``items`` are not all there are."""
        texts = {item: [(canonical_words(s), s) for s in _SENTENCE.split(text)] for item, text in items if text and text.strip()}
        seen = Counter(key for sentences in texts.values() for key in {tuple(c) for c, _ in sentences})
        alike = defaultdict(list)
        for item, sentences in texts.items():
            alike[tuple(tuple(c) for c, _ in sentences)].append(item)
        copies = {item: len(group) for group in alike.values() for item in group}
        own: dict[int, list[str]] = {}
        known: dict[str, int] = {}
        for item, sentences in texts.items():
            said = [s for c, s in sentences if c and (seen[tuple(c)] <= copies[item] if stock is None else sentence_key(c) not in stock[item])]
            if said:
                own[item] = _PIECE.findall("\n".join(said))
                for piece in own[item]:
                    known.setdefault(piece.lower(), len(known) + FIRST_WORD)
        self.codes = Codes(known)
        #: Item to (words as written in lower case, whether each is a slot).
        self.words: dict[int, tuple[list[str], np.ndarray]] = {}
        read = {}
        for item, pieces in own.items():
            word, plain, named = read_words(pieces, self.codes)
            self.words[item] = [pieces[k].lower() for k in word], (named == NUMBER) | (named == NAME)
            read[item] = plain, named
        self.short = sorted({len(p) for p, _ in read.values() if len(p) < WINDOW})
        hashes, where = [np.empty(0, np.uint64)], [np.empty((0, 3), np.int64)]
        for item, (plain, named) in read.items():
            for seed, _, h in _readings(plain, named, [len(plain)] if len(plain) < WINDOW else []):
                at = np.flatnonzero(h)
                hashes.append(h[at])
                where.append(np.stack([np.full(len(at), item), at, np.full(len(at), seed)], axis=1))
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.where = flat[order], np.concatenate(where)[order]


def sentence_key(canon: list[str]) -> str:
    return hashlib.sha256(" ".join(canon).encode("utf-8", "surrogatepass")).hexdigest()


def _item_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text.strip():
                keys = [sentence_key(c) for c in map(canonical_words, _SENTENCE.split(text)) if c]
                whole = hashlib.sha256(" ".join(keys).encode()).hexdigest()
                rows += [(item, whole, key) for key in set(keys)]
        item, whole, key = zip(*rows) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(whole, pa.string()), pa.array(key, pa.string())], names=["item_id", "whole", "key"])


def stock_sentences(items: DataFrame) -> DataFrame:
    """(item_id, stock): the keys of an item's sentences that more items hold than there are of its equals."""
    held = cut(items.select("item_id", "text").mapInArrow(_item_sentences, "item_id bigint, whole string, key string"))
    seen = held.groupBy("key").agg(F.count("*").alias("seen")).filter("seen > 1")
    copies = held.select("item_id", "whole").distinct().groupBy("whole").agg(F.count("*").alias("copies"))
    return held.join(seen, "key").join(copies, "whole").filter("seen > copies").groupBy("item_id").agg(F.collect_set("key").alias("stock"))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def covered_share(words: list[str], slot: np.ndarray, document: list[str], item_at: np.ndarray, diagonal: np.ndarray) -> float:
    """Share of the item's words covered by the document, of which ``item_at`` are matched at ``item_at + diagonal``; sorted by diagonal and place."""
    begins = np.flatnonzero(_changes(diagonal, item_at - np.arange(len(item_at))))
    at_slot = np.flatnonzero(slot[item_at])
    values: dict[str, Counter] = defaultdict(Counter)
    for k in at_slot.tolist():
        values[words[item_at[k]]][document[item_at[k] + diagonal[k]]] += 1
    filled = {word: min(seen.items(), key=lambda x: (-x[1], x[0]))[0] for word, seen in values.items()}
    good = np.ones(len(item_at), dtype=bool)
    for k in at_slot.tolist():
        good[k] = document[item_at[k] + diagonal[k]] == filled[words[item_at[k]]]
    hit = np.zeros(len(words), dtype=bool)
    hit[item_at[good]] = True
    ends = np.r_[begins[1:], len(item_at)] - 1
    runs = sorted(zip(item_at[begins].tolist(), (item_at[ends] + 1).tolist(), (item_at[begins] + diagonal[begins]).tolist()))
    for k, (begin, end, at) in enumerate(runs):
        for begin2, _, at2 in runs[k + 1 :]:
            gap, there = begin2 - end, at2 - (at + end - begin)
            if gap > EDIT:
                break
            if 0 < gap and 0 <= there <= EDIT + 1:
                hit[end:begin2] = True
                break
    return float(hit.mean())


def matches(texts: Sequence[str], items: ItemWindows, at_least: float) -> list[tuple[int, int, float]]:
    """(number of the text, item, covered share) of the items that the texts hold."""
    out: list[tuple[int, int, float]] = []
    pieces, sizes = [], []
    for text in texts:
        found = _PIECE.findall(text)
        pieces += found
        pieces.append("\n")
        sizes.append(len(found) + 1)
    if not len(items.hashes) or not pieces:
        return out
    word, plain, named = read_words(pieces, items.codes)
    text_of = np.repeat(np.arange(len(sizes)), sizes)[word]
    hits = []
    for seed, offsets, h in _readings(plain, named, items.short, text_of):
        at = np.flatnonzero(h)
        lo = np.searchsorted(items.hashes, h[at], "left")
        ok = lo < len(items.hashes)
        ok[ok] = items.hashes[lo[ok]] == h[at[ok]]
        if not ok.any():
            continue
        at, lo = at[ok], lo[ok]
        count = np.searchsorted(items.hashes, h[at], "right") - lo
        place = np.repeat(at, count)
        slot = np.repeat(lo, count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        item, pos, kind = items.where[slot].T
        right = kind == seed
        for k in offsets:
            hits.append(np.stack([text_of[place[right]], item[right], pos[right] + k, place[right] - pos[right], np.full(int(right.sum()), 0 < seed < len(PATTERNS))]))
    if not hits:
        return out
    number, item, item_at, diagonal, gapped = np.concatenate(hits, axis=1)
    if not len(number):
        return out
    order = np.lexsort((gapped, item_at, diagonal, item, number))
    number, item, item_at, diagonal, gapped = number[order], item[order], item_at[order], diagonal[order], gapped[order] > 0
    keep = _changes(number, item, diagonal, item_at)
    number, item, item_at, diagonal, gapped = number[keep], item[keep], item_at[keep], diagonal[keep], gapped[keep]
    # Gapped windows count in chains only, in which no two words running are missing.
    links = _changes(number, item, diagonal)
    links[1:] |= item_at[1:] > item_at[:-1] + 2
    chain = np.cumsum(links) - 1
    keep = ~gapped | (np.bincount(chain)[chain] >= CHAIN)
    number, item, item_at, diagonal = number[keep], item[keep], item_at[keep], diagonal[keep]
    if not len(number):
        return out
    bounds = np.flatnonzero(np.append(_changes(number, item), True))
    # Runs can be lengthened by EDIT words each at most; what can not reach the share is not looked at.
    runs = np.add.reduceat(_changes(number, item, diagonal, item_at - np.arange(len(item_at))), bounds[:-1])
    length = np.array([len(items.words[i][0]) for i in item[bounds[:-1]].tolist()])
    may = np.diff(bounds) + EDIT * runs >= at_least * length
    lower: dict[int, list[str]] = {}
    first = np.searchsorted(text_of, np.arange(len(sizes)))
    for b, e in zip(bounds[:-1][may].tolist(), bounds[1:][may].tolist()):
        of = int(number[b])
        if of not in lower:
            last = first[of + 1] if of + 1 < len(sizes) else len(word)
            lower.clear()  # texts come in order
            lower[of] = [pieces[k].lower() for k in word[first[of] : last]]
        words, slots = items.words[int(item[b])]
        share = covered_share(words, slots, lower[of], item_at[b:e], diagonal[b:e] - first[of])
        if share >= at_least and share > 0:
            out.append((of, int(item[b]), share))
    return out


def document_matches(text: str, items: ItemWindows, at_least: float) -> list[tuple[int, float]]:
    """(item, covered share) of the items that the text holds."""
    return [(item, share) for _, item, share in matches([text], items, at_least)]


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", at_least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least ``at_least`` of an item's own wording."""
    spark: SparkSession = documents.sparkSession
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    stated = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-(stated.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    if blocks > 1:
        # Shared sentences are counted over all items, before the blocks are cut.
        stated = stated.groupBy("item_id").agg(F.max("text").alias("text"))
        stated = cut(stated.join(stock_sentences(stated), "item_id", "left"))
    out = None
    for block in range(blocks):
        own = stated.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else stated
        held = own.orderBy("item_id").collect()
        stock = {r.item_id: set(r.stock or ()) for r in held} if blocks > 1 else None
        shared = spark.sparkContext.broadcast(ItemWindows([(r.item_id, r.text) for r in held], stock))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                found: list[tuple[int, int, float]] = []
                for begin in range(0, batch.num_rows, STROKE):
                    part = batch.slice(begin, STROKE)
                    ids = part.column(0).to_pylist()
                    found += [(ids[k], item, share) for k, item, share in matches(part.column(1).to_pylist(), windows, at_least)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], names=["doc_id", "item_id", "share"]
                )

        part = source.mapInArrow(run, "doc_id bigint, item_id bigint, share double")
        out = part if out is None else out.unionByName(part)
    return out
