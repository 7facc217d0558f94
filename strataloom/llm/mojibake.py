"""Text garbled by a wrong character decoding: which documents, and what they said.

Noisy channel. A garbled token is a clean one whose bytes went through a wrong
decoder. The channel is turned round: the token's characters are put back into
bytes by every decoder that can have made them, and these bytes are read by every
encoding they can have been in; characters that were lost are wildcards of the
byte lattice. What comes out is judged by the frequencies of the words of the
whole corpus, and a symbol by those of its neighbours:

* bytes that are valid UTF-8 again and again beside letters, lost characters
  inside words, and letters no word has in that place need no further evidence;
* readings in another one-byte or two-byte encoding count if the corpus knows the
  word they give, and better than the word that stands there;
* a single symbol (``see`` + garbled section sign) counts if the corpus has the
  restored symbol beside the same neighbour. Garbled characters that a text quotes
  on purpose fail here: nobody writes the clean symbol in that place.

Finding and restoring both run a Viterbi search over the tokens of each suspect
document: the states are the channels, a token's score is the log frequency of its
reading, and changing the channel between tokens costs. A document is found if its
best path, which begins and ends in text as it is, goes through another channel.
A token with lost characters is a lattice of known bytes and of arcs for any high
bytes; the corpus words whose bytes in the meant encoding run through it are its
readings. Words meet lattices by encoding, length, and the known bytes at both ends.
A lattice without two known bytes has no word, but as a symbol it has those that run
through it, judged by both neighbours.

Scale. One narrow pass reads every text and writes word counts (combined in the
task), open tokens with their places, and questions, all small beside the texts;
counts, lattices and questions are joined by word, and only documents with a reading
likelier than what stands there are searched. No dictionary is broadcast or collected.

Defined results: null, empty and pure ASCII texts without entities are no case;
entities of characters beyond ASCII are read as these, and what is not restored stays
as it was written; repeated documents are reported each; a null id is
ignored; other columns are not read; empty input gives no rows.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import cut

LOST = "�"
#: Decoders that turn bytes into these characters, by the script they leave.
ONE_BYTE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1254", "cp1258")
TWO_BYTE = ("gbk", "cp932", "big5", "euc_kr", "euc_jp")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
#: Encodings a text may really have been in, by the decoder that misread it.
MEANT = {
    "cp1252": ("cp932", "euc_jp", "gbk", "big5", "euc_kr", "cp1251", "koi8_r", "cp1250", "iso8859_2", "cp1254", "cp1258", "mac_roman"),
    "mac_roman": ("cp1252", "cp1251", "cp932"),
    "cp437": ("cp1252", "cp1251", "cp866", "cp1250"),
    "cp850": ("cp1252", "cp1250"),
    "cp1250": ("cp1252", "cp1254", "cp1251"),
    "iso8859_2": ("cp1252", "cp1250", "cp1251"),
    "cp1254": ("cp1252", "cp1250"),
    "cp1258": ("cp1252",),
    **{c: tuple(x for x in (*CYRILLIC, "cp1252", "cp1250", "cp932", "gbk", "cp1254") if x != c) for c in ("cp1251", "koi8_r", "cp866", "iso8859_5")},
    "gbk": ("cp932", "euc_kr", "big5", "euc_jp", "cp1251"), "cp932": ("gbk", "euc_kr", "euc_jp", "cp1251"), "big5": ("gbk", "cp932"), "euc_kr": ("gbk", "cp932", "euc_jp"), "euc_jp": ("gbk", "euc_kr", "cp932"),
}

_TOKEN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_WORD_BEFORE = re.compile(r"([^\s]+)[\s]*\Z")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_ODD_END = re.compile(r"[a-z][ÂÃ](?![A-Za-z\x80-\U0010ffff])")
_SLOPPY = {chr(c): bytes([c]) for c in range(0x80, 0xA0)}


def to_bytes(text: str, decoder: str) -> bytes | None:
    """The bytes the decoder made ``text`` from, or None. cp1252 keeps its undefined bytes as control characters."""
    if decoder != "cp1252":
        try:
            return text.encode(decoder)
        except (UnicodeEncodeError, LookupError):
            return None
    out = bytearray()
    for c in text:
        if c in _SLOPPY:
            out += _SLOPPY[c]
        else:
            try:
                out += c.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


#: First and last code points of the blocks that texts are likely to use.
_BLOCKS = (
    (0xA0, 0x17F), (0x18F, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DD), (0x300, 0x33F), (0x370, 0x3FF), (0x400, 0x4FF), (0x5D0, 0x5F4), (0x600, 0x6FF),
    (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2000, 0x214F), (0x2150, 0x23FF), (0x2460, 0x27BF), (0x2900, 0x29FF), (0x2B00, 0x2BFF), (0x3000, 0x30FF), (0x3400, 0x9FFF),
    (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF), (0x20000, 0x2FA1F),
)


@lru_cache(maxsize=70_000)
def _plausible(c: str) -> bool:
    """Whether texts are likely to hold the character."""
    o = ord(c)
    if o < 0x80:
        return c.isprintable() or c in "\n\t"
    return any(lo <= o <= hi for lo, hi in _BLOCKS)


def _fits(text: str) -> bool:
    """All characters plausible; beside Latin letters no letters of another script."""
    if not all(map(_plausible, text.replace(LOST, ""))):
        return False
    if any("a" <= c.lower() <= "z" for c in text):
        return all(not c.isalpha() or ord(c) < 0x250 or 0x1E00 <= ord(c) <= 0x1EFF or c in "µμΩπ" for c in text)
    return True


def _sequences(raw: bytes) -> tuple[int, int, str]:
    """(valid UTF-8 sequences, other high bytes, text with the other bytes lost)."""
    found = _SEQUENCE.findall(raw)
    high = sum(b > 0x7F for b in raw) - sum(map(len, found))
    return len(found), high, raw.decode("utf-8", "replace")


@lru_cache(maxsize=200_000)
def utf8_reading(token: str) -> tuple[str, str, int, int] | None:
    """(channel, text, sequences, bytes that fit nowhere) of the best reading as UTF-8, also twice or three times misread."""
    best = None
    for decoder in (*ONE_BYTE, *TWO_BYTE):
        raw = to_bytes(token.replace(LOST, ""), decoder)
        if raw is None or raw.isascii():
            continue
        n, bad, text = _sequences(raw)
        if not n:
            continue
        bad += token.count(LOST)
        if decoder in TWO_BYTE and bad and LOST not in token:
            continue
        if decoder != "cp1252" and n < 2 and bad:
            continue
        chain = decoder
        for _ in range(3):
            again = to_bytes(text, "cp1252")
            if again is None or again.isascii():
                break
            m, worse, more = _sequences(again)
            if not m or worse > m * 0.5 or not _fits(more):
                break
            text, chain = more, chain + "+cp1252"
        if not _fits(text):
            continue
        if best is None or (bad, -n) < (best[3], -best[2]):
            best = chain, text, n, bad
    return best


def _letters(text: str) -> int:
    return sum(c.isalpha() for c in text)


def _cased_well(text: str) -> bool:
    words = "".join(c if c.isalpha() else " " for c in text).split()
    return all(w == w.lower() or w[1:] == w[1:].lower() for w in words)


def _kana(text: str) -> int:
    return sum("぀" <= c <= "ヿ" for c in text)


@lru_cache(maxsize=200_000)
def legacy_readings(token: str) -> tuple[tuple[str, str], ...]:
    """(channel, text): readings in other encodings that look like words, for the corpus to judge; one channel a text."""
    first: dict[str, str] = {}
    for channel, text in legacy_channels(token):
        first.setdefault(text, channel)
    return tuple((channel, text) for text, channel in first.items())


def legacy_channels(token: str) -> list[tuple[str, str]]:
    """(channel, text) as in ``legacy_readings``, with every channel that gives a text."""
    if LOST in token or len(token) < 3:
        return []
    out = []
    wide = any(ord(c) > 0x2E7F for c in token)
    cyrillic = any("Ѐ" <= c <= "ӿ" for c in token)
    for decoder in TWO_BYTE if wide else CYRILLIC[:4] + (("cp866",) if cyrillic else ()) if cyrillic else ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1254", "cp1258"):
        raw = to_bytes(token, decoder)
        if raw is None or raw.isascii():
            continue
        for meant in MEANT[decoder]:
            try:
                text = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if text == token or not all(map(_plausible, text)) or _letters(text) < 0.75 * len(text) or not _cased_well(text):
                continue
            if meant not in TWO_BYTE and len({unicodedata.name(c, "X").split()[0] for c in text if c.isalpha()}) > 1:
                continue
            out.append((f"{decoder}>{meant}", text))
    return out


@lru_cache(maxsize=50_000)
def lost_symbols(token: str) -> tuple[tuple[str, str], ...]:
    """(channel, symbol): the symbols of which one byte was lost and the others were read by a one-byte decoder."""
    rest = token.replace(LOST, "")
    if token.count(LOST) != 1 or not rest or len(rest) > 3 or _letters(rest):
        return ()
    out: dict[str, str] = {}
    for decoder in ONE_BYTE:
        known = to_bytes(rest, decoder)
        if known is None or known.isascii():
            continue
        at = len(to_bytes(token[: token.index(LOST)], decoder))
        for arc in range(0x80, 0x100):
            try:
                text = (known[:at] + bytes([arc]) + known[at:]).decode()
            except UnicodeDecodeError:
                continue
            if len(text) == 1 and _plausible(text):
                out.setdefault(text, decoder)
    return tuple((decoder, text) for text, decoder in out.items())


#: Verdicts on a token by itself.
NOTHING, SURE, ASK_WORD, ASK_NEIGHBOUR, ASK_LATTICE = range(5)


@lru_cache(maxsize=400_000)
def token_verdict(token: str) -> tuple[int, str]:
    """(verdict, reading); the readings to ask for are in ``legacy_readings``."""
    lost = token.count(LOST)
    rest = token.replace(LOST, "")
    if lost:
        if lost > 1 or _letters(rest):
            return SURE, ""
        if not rest:
            return ASK_NEIGHBOUR, ""
    best = utf8_reading(token)
    if best:
        chain, text, n, bad = best
        plain = sum("a" <= c.lower() <= "z" for c in token)
        if bad <= n * 0.5 and text != token:
            if chain.startswith("cp1252") or not bad:
                double = "+" in chain
                sure = n >= 3 or double or (n >= 2 and len(set(_SEQUENCE.findall(to_bytes(rest, chain.split("+")[0]) or b""))) > 1) or (plain and n >= 1)
                if chain.split("+")[0] in TWO_BYTE and not plain:
                    sure = n >= 3 and not bad
                if sure:
                    return SURE, text
                return ASK_NEIGHBOUR, text
    if _ODD_END.search(token):
        return SURE, ""
    # Japanese in a two-byte encoding read byte by byte
    if not any(ord(c) > 0x2E7F for c in token):
        raw = to_bytes(token, "cp1252")
        if raw and sum(b > 0x7F for b in raw) >= 6:
            for meant in ("cp932", "euc_jp"):
                text = raw.decode(meant, "replace")
                if _kana(text) >= 3 and text.count(LOST) * 4 <= len(text) and _kana(text) + sum("一" <= c <= "鿿" for c in text) >= 0.6 * len(text):
                    if meant == "euc_jp" or sum(0x82 <= b <= 0x83 for b in raw) >= 3:
                        return SURE, text
    if legacy_readings(token) or not lost and best and LOST in best[1] and best[3] <= best[2] * 0.5:
        return ASK_WORD, ""
    if lost and lost_symbols(token):
        return ASK_LATTICE, ""
    return NOTHING, ""


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


class Raw:
    """A text with the entities of characters beyond ASCII read, and where everything stood; other entities are text."""

    def __init__(self, written: str):
        self.written, self.text = written, written
        self.at: list[int] = []
        self.shift: list[int] = [0]
        if "&" in written and ";" in written:
            out, done, size = [], 0, 0
            for m in _ENTITY.finditer(written):
                said = html.unescape(m.group())
                if said == m.group() or said.isascii():
                    continue
                out += [written[done : m.start()], said]
                size += m.start() - done + len(said)
                self.at.append(size)
                self.shift.append(self.shift[-1] + len(m.group()) - len(said))
                done = m.end()
            self.text = "".join(out) + written[done:]

    def place(self, at: int) -> int:
        """Where a place of the text stands as written."""
        return at + self.shift[bisect_right(self.at, at)]


def _strip(word: str) -> str:
    return html.unescape(word).strip("\"'`.,;:!?()[]{}<>*_|#-=").lower()


class Words:
    """The words around the places of one text, by blanks."""

    def __init__(self, text: str):
        self.text = text
        self.blanks: list[int] | None = None

    def beside(self, begin: int, end: int) -> tuple[str, str]:
        """The words before and after, which may be glued on; a glued mark of punctuation stands for none."""
        text = self.text
        if self.blanks is None:
            self.blanks = [-1, *(m.start() for m in re.finditer(r"[ \n]", text)), len(text)]
        k = bisect_left(self.blanks, begin)  # the first blank at or after the place
        before = text[self.blanks[k - 1] + 1 : begin]
        prev = _strip(before) or (_strip(text[self.blanks[k - 2] + 1 : self.blanks[k - 1]]) if k > 1 and not before.strip("|>*- ") else "")
        k = bisect_left(self.blanks, end)
        after = text[end : self.blanks[k]]
        nxt = _strip(after) or (_strip(text[self.blanks[k] + 1 : self.blanks[k + 1]]) if k + 1 < len(self.blanks) and not after.strip("|>*-.,;:") else "")
        return prev, nxt


#: Kinds of rows that the pass writes. Of SURE and WORD, a is a token; of SYMBOL and LATTICE, a and b are what stands before and after.
COUNT, SURE_WORD, WORD, BESIDE, SYMBOL, READING, LATTICE = range(7)
_TYPES = {"kind": pa.int32(), "doc_id": pa.int64(), "at": pa.int32(), "a": pa.string(), "b": pa.string(), "channel": pa.string(), "n": pa.int64()}
_SCHEMA = "kind int, doc_id bigint, at int, a string, b string, channel string, n bigint"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    beside: Counter = Counter()
    asks: set[str] = set()

    def drain() -> pa.RecordBatch:
        rows = [(COUNT, None, None, t, None, None, n) for t, n in counts.items()] + [(BESIDE, None, None, t, None, None, n) for t, n in beside.items()]
        asks.update(t for t in counts if LOST in t or LOST in (utf8_reading(t) or ("", ""))[1])
        rows += [(READING, None, None, t, r, None, 1) for t in asks for r in dict.fromkeys(r for _, r in channels(t))]
        asks.clear()
        counts.clear()
        beside.clear()
        return _batch(rows)

    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = Raw(text).text
            around = Words(text)
            sure = False
            # A token said again is no new evidence. Places that no row has are words that can only be as they are.
            places: dict = {}
            for m in _TOKEN.finditer(text):
                token = m.group()
                verdict, reading = token_verdict(token)
                if verdict == SURE:
                    sure = True
                else:
                    counts[token] += 1
                symbol = _letters(token) < 2 and len(token) <= 3
                if verdict == SURE or not symbol and verdict not in (ASK_NEIGHBOUR, ASK_LATTICE):
                    if token not in places:
                        places[token] = len(places)
                        if verdict != NOTHING:
                            asks.add(token)
                            rows.append((SURE_WORD if verdict == SURE else WORD, doc, places[token], token, None, None, 1))
                    continue
                prev, nxt = around.beside(m.start(), m.end())
                if verdict in (ASK_NEIGHBOUR, ASK_LATTICE):
                    at = places.setdefault((token, prev, nxt), len(places))
                    wild = verdict == ASK_LATTICE
                    for channel, want in lost_symbols(token) if wild else ((utf8_reading(token)[0] if reading else LOST, reading),):
                        left = f"L|{prev}|{want}" if want and prev else f"T|{prev}|{nxt}"
                        right = f"R|{want}|{nxt}" if want and nxt else f"T|{prev}|{nxt}"
                        rows.append((LATTICE if wild else SYMBOL, doc, at, left, right, channel, int(not sure)))
                elif prev or nxt:
                    beside[f"L|{prev}|{token}"] += 1
                    beside[f"R|{token}|{nxt}"] += 1
                    beside[f"T|{prev}|{nxt}"] += 1
        yield _batch(rows)
        if len(counts) + len(beside) > 200_000:
            yield drain()
    yield drain()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], names=list(_TYPES))


def candidate_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold anything beside ASCII, or an entity; decided in the JVM."""
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|&#?[A-Za-z0-9]+;"))


#: How many times likelier the clean reading must be than what stands there, by the counts of the corpus.
RATIO = 2
#: What leaving the text as it is and coming back cost together is the log of RATIO.
CHANGE = math.log(RATIO) / 2
#: Short words are met by chance: one is no evidence, two in one channel are, two in two channels are not.
SHORT = 0.6
#: How many times likelier a token that no clean text holds is in any channel.
EVIDENT = 1000
AS_IS = "as is"
_TOLD = "array<struct<channel:string,reading:string,gain:double>>"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents whose best path goes through another channel than the text as it is."""
    rest = [(AS_IS, AS_IS, 0.0)]
    for batch in batches:
        found = []
        for doc, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            path, due = [rest], 0
            for o in sorted(tokens, key=lambda o: o["at"]):
                if o["at"] > due:
                    path.append(rest)
                due = o["at"] + 1
                told = o["told"] or ()
                by_reading = {t["reading"]: t["gain"] for t in told if t["channel"] is None}
                # A reading that the corpus does not know is as likely as what stands there.
                gains = {channel: by_reading.get(reading, 0.0) for channel, reading in (channels(o["token"]) if o["token"] else ())}
                for t in told:
                    if t["channel"] is not None:
                        gains[t["channel"]] = max(t["gain"], gains.get(t["channel"], t["gain"]))
                path.append(rest + [(channel, channel, gain) for channel, gain in sorted(gains.items())])
            if any(channel != AS_IS for channel in viterbi([*path, rest], CHANGE)):
                found.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["doc_id"])


def evidence(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with evidence, word counts, corpus words through the lattices of tokens with lost characters).

    All evidence by counts is a ratio of two counts of the corpus, so it does not depend on its size.
    """
    scanned = cut(candidate_documents(documents).mapInArrow(_scan, _SCHEMA))
    counts = scanned.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    beside = scanned.filter(F.col("kind") == BESIDE).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))

    # What each token may say and how much likelier that is. Tokens that no clean text holds are not counted.
    kinds = scanned.filter(F.col("kind") == READING).select(F.col("a").alias("token"), F.col("b").alias("reading")).distinct()
    judged = kinds.join(counts.select(F.col("word").alias("reading"), F.col("n").alias("known")), "reading", "left").join(counts.select(F.col("word").alias("token"), F.col("n").alias("seen")), "token", "left")
    ratio = F.log(F.col("known") / F.col("seen"))
    gain = F.when(F.col("seen").isNull(), F.log(F.lit(EVIDENT) * F.coalesce("known", F.lit(1)))).when(F.length("reading") >= 4, ratio).otherwise(SHORT * F.least(ratio, F.lit(math.log(RATIO))))
    plain = judged.filter("seen IS NULL OR known IS NOT NULL").select("token", F.lit(None).cast("string").alias("channel"), "reading", gain.alias("gain"))
    lattice = cut(lattice_readings(kinds.filter(F.col("reading").contains(LOST)).select("token"), counts.filter(~F.col("word").contains(LOST))))
    times = F.when(F.col("seen").isNull(), F.lit(EVIDENT) * F.col("n")).otherwise(F.col("n") / F.col("seen"))
    filled = lattice.join(counts.select(F.col("word").alias("token"), F.col("n").alias("seen")), "token", "left").select("token", "channel", "reading", F.log(times).alias("gain"))
    told = cut(plain.unionByName(filled).groupBy("token").agg(F.collect_list(F.struct("channel", "reading", "gain")).alias("told"), F.max("gain").alias("most")))

    # A garbled symbol between two words against clean symbols there; of a lattice's symbols one must suit both words.
    symbols = scanned.filter(F.col("kind").isin(SYMBOL, LATTICE)).groupBy("kind", "doc_id", "at", "a", "b", "channel").agg(F.sum("n").alias("n"))
    sides = symbols
    for side in ("a", "b"):
        asked_here = symbols.groupBy(F.col(side).alias("key")).agg(F.greatest(F.sum("n"), F.lit(1)).alias("asked"))
        likely = beside.join(asked_here, "key").select(F.col("key").alias(side), F.log(F.col("n") / F.col("asked")).alias(f"gain_{side}"))
        sides = sides.join(likely, side, "left")
    both = F.when(F.col("gain_a").isNotNull() & F.col("gain_b").isNotNull(), F.least("gain_a", "gain_b"))
    sides = sides.withColumn("gain", F.when(F.col("kind") == SYMBOL, F.greatest("gain_a", "gain_b")).otherwise(both)).filter("gain IS NOT NULL")
    marks = cut(sides.groupBy("doc_id", "at").agg(F.collect_list(F.struct("channel", F.lit("").alias("reading"), "gain")).cast(_TOLD).alias("told"), F.max("gain").alias("most")))

    # Without a reading that is likelier than what stands there no path leaves the text as it is.
    words = scanned.filter(F.col("kind").isin(SURE_WORD, WORD)).select("doc_id", "at", F.col("a").alias("token"))
    suspects = words.join(told.filter("most > 0").select("token"), "token", "left_semi").select("doc_id").unionByName(marks.filter("most > 0").select("doc_id")).distinct()
    tokens = words.join(suspects, "doc_id", "left_semi").join(told.select("token", "told"), "token", "left").select("doc_id", "at", "token", F.col("told").cast(_TOLD).alias("told"))
    tokens = tokens.unionByName(marks.join(suspects, "doc_id", "left_semi").select("doc_id", "at", F.lit(None).cast("string").alias("token"), "told"))
    paths = tokens.groupBy("doc_id").agg(F.collect_list(F.struct("at", "token", "told")).alias("tokens"))
    return paths.mapInArrow(_leaves, "doc_id bigint"), counts, lattice


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents with at least one garbled passage."""
    return evidence(documents)[0]


#: Encodings that corpus words are put into to be held against lattices; ``+`` is UTF-8 misread once.
MEANINGS = ("utf-8", "utf-8+cp1252", *dict.fromkeys((*ONE_BYTE, "mac_cyrillic", *TWO_BYTE)))
_HIGH = r"[\x80-\xff]"


def encoded(word: str, meant: str) -> bytes | None:
    """The bytes of a clean word in one of ``MEANINGS``, or None."""
    if meant == "utf-8+cp1252":
        once = word.encode("utf-8", "ignore")
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in once).encode()
    return to_bytes(word, meant) if meant != "utf-8" else word.encode("utf-8", "ignore")


def _arcs(decoder: str, meant: str) -> int:
    """Most bytes that one lost character can stand for."""
    if decoder == "utf-8":
        return 4 if meant.startswith("utf-8") else 3
    return 2 if decoder in TWO_BYTE else 1


@lru_cache(maxsize=50_000)
def lattices(token: str) -> tuple[tuple[str, str, int, int, str, str, str], ...]:
    """(channel, encoding, least and most bytes, known bytes before and after, pattern) of a token with lost characters, bytes as Latin-1."""
    rest = token.replace(LOST, "")
    if LOST not in token or not rest:
        return ()
    out = []
    decoders = ("utf-8",) if rest.isascii() else ("utf-8", *ONE_BYTE, *TWO_BYTE)
    for decoder in decoders:
        known = [b"" if c == LOST else c.encode("utf-8", "ignore") if decoder == "utf-8" else to_bytes(c, decoder) for c in token]
        if None in known or sum(map(len, known)) < 2:
            continue
        lost, size = token.count(LOST), sum(map(len, known))
        first, last = token.index(LOST), token.rindex(LOST)
        before, after = (b"".join(x).decode("latin-1") for x in (known[:first], known[last + 1 :]))
        for meant in MEANINGS if decoder == "utf-8" else ("utf-8", "utf-8+cp1252", *MEANT.get(decoder, ())):
            most = _arcs(decoder, meant)
            channel = f"{decoder}>{meant}" if decoder == "utf-8" or not meant.startswith("utf-8") else decoder + meant[5:]
            pattern = "".join(f"{_HIGH}{{1,{most}}}" if c == LOST else "".join(f"\\x{x:02x}" for x in b) for c, b in zip(token, known))
            out.append((channel, meant, size + lost, size + lost * most, before, after, f"\\A{pattern}\\z"))
    return tuple(out)


def readings(token: str) -> list[tuple[str, str]]:
    """(channel, reading) of one token, as it stands first; the readings of lost characters are in ``lattices``."""
    out = [("as is", token)]
    best = utf8_reading(token)
    if best and best[3] <= best[2] * 0.5:
        out.append((best[0], best[1]))
    out += legacy_readings(token)
    verdict, reading = token_verdict(token)
    if verdict == SURE and reading and reading not in {r for _, r in out}:
        out.append(("two-byte", reading))
    return out


def channels(token: str) -> list[tuple[str, str]]:
    """(channel, reading) of every channel a token may have come through; a token that is sure has one at least."""
    out = [*readings(token)[1:], *legacy_channels(token)]
    if LOST in token or not out and token_verdict(token)[0] == SURE:
        out.append((LOST, token))
    return out


def _encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for meant in MEANINGS:
                raw = encoded(word, meant)
                if raw:
                    rows.append((word, n, meant, len(raw), raw.decode("latin-1")))
        word, n, meant, size, raw = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(meant, pa.string()), pa.array(size, pa.int32()), pa.array(raw, pa.string())], names=["word", "n", "meant", "size", "raw"])


def _lattice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for token in batch.column(0).to_pylist():
            held = [("", token)] if LOST in token else [(channel, text) for channel, text in readings(token) if LOST in text]
            for outer, text in held:
                for channel, meant, least, most, before, after, pattern in lattices(text):
                    rows += [(token, outer or channel, meant, size, before, after, len(before), len(after), pattern) for size in range(least, most + 1)]
        columns = zip(*rows) if rows else ((),) * 9
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["token", "channel", "meant", "size", "before", "after", "p", "s", "pattern"])


def lattice_readings(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(token, channel, reading, n): the most frequent corpus word that runs through each lattice. ``tokens`` has token, ``known`` word and n."""
    made = cut(tokens.distinct().mapInArrow(_lattice_rows, "token string, channel string, meant string, size int, before string, after string, p int, s int, pattern string"))
    words = known.mapInArrow(_encode_words, "word string, n bigint, meant string, size int, raw string")
    shapes = made.select("meant", "size", "p", "s").distinct()
    # Words are keyed by the ends that lattices of their encoding and length ask for.
    ends = words.join(shapes, ["meant", "size"]).withColumn("before", F.expr("substring(raw, 1, p)")).withColumn("after", F.expr("substring(raw, size - s + 1, s)"))
    # Lattices are small as files and large in memory, so Spark would broadcast them by the size of the files.
    hits = made.hint("merge").join(ends, ["meant", "size", "p", "s", "before", "after"]).filter(F.expr("raw RLIKE pattern"))
    best = Window.partitionBy("token", "channel").orderBy(F.col("n").desc(), "word")
    return hits.select("token", "channel", "word", "n").distinct().withColumn("r", F.row_number().over(best)).filter("r = 1").select("token", "channel", F.col("word").alias("reading"), "n")


def viterbi(lattice: list[list[tuple[str, str, float]]], change: float = 1.5) -> list[str]:
    """The best reading of each token; ``lattice`` has (channel, reading, log score) per token."""
    score: dict[str, float] = {}
    back: list[dict[str, tuple[str | None, str]]] = []
    for options in lattice:
        now: dict[str, float] = {}
        step: dict[str, tuple[str | None, str]] = {}
        top = max(score, key=score.get) if score else None
        for channel, reading, value in options:
            stay = score.get(channel, -math.inf)
            move = score[top] - change if top is not None else 0.0
            before, base = (channel, stay) if stay >= move and channel in score else (top, move)
            if channel not in now or base + value > now[channel]:
                now[channel] = base + value
                step[channel] = (before, reading)
        score = now
        back.append(step)
    out: list[str] = []
    state = max(score, key=score.get) if score else None
    for step in reversed(back):
        before, reading = step[state]
        out.append(reading)
        state = before
    return out[::-1]


def restored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, restored): the text of every garbled document, restored as far as the corpus can tell."""
    found, counts, lattice = evidence(documents)
    damaged = cut(candidate_documents(documents).join(found, "doc_id", "left_semi"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in dict.fromkeys(_TOKEN.findall(Raw(text).text)):
                    rows += [(doc, token, channel, reading) for channel, reading in readings(token)]
            doc, token, channel, reading = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(token, pa.string()), pa.array(channel, pa.string()), pa.array(reading, pa.string())], names=["doc_id", "token", "channel", "reading"])

    asked = cut(damaged.mapInArrow(ask, "doc_id bigint, token string, channel string, reading string"))
    known = counts.filter(~F.col("word").contains(LOST))
    plain = asked.join(known.select(F.col("word").alias("reading"), "n"), "reading", "left").select("doc_id", "token", "channel", "reading", F.coalesce("n", F.lit(0)).alias("n"))
    lost = asked.filter(F.col("reading").contains(LOST)).select("doc_id", "token").distinct()
    filled = lost.join(lattice, "token").select("doc_id", "token", "channel", "reading", "n")
    options = plain.unionByName(filled).groupBy("doc_id").agg(F.collect_list(F.struct("token", "channel", "reading", "n")).alias("options"))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = Raw(text)
                by = defaultdict(list)
                for o in sorted(found or (), key=lambda o: (o["token"], o["channel"], o["reading"])):
                    value = math.log(o["n"] + 0.2) - (3.0 if LOST in o["reading"] or o["channel"] == "as is" and token_verdict(o["token"])[0] == SURE else 0.0)
                    by[o["token"]].append((o["channel"], o["reading"], value))
                spans = [m for m in _TOKEN.finditer(raw.text) if m.group() in by]
                said = viterbi([by[m.group()] for m in spans])
                out, at = [], 0
                for m, reading in zip(spans, said):
                    if reading != m.group():  # what stays as it is stays as it was written
                        out += [text[at : raw.place(m.start())], reading]
                        at = raw.place(m.end())
                ids.append(doc)
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return damaged.join(options, "doc_id", "left").select("doc_id", "text", "options").mapInArrow(restore, "doc_id bigint, restored string")
