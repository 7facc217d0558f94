"""Generated, minified, vendored source files and data kept as code.

Every text is lexed once. Identifiers, numbers (with their sign) and strings are
masked, comments left out, and the tokens give five-token shingles, numbered by
occurrence so that a text of many common statements is not alike to every other.
The MinHash signature of the masked shingles is banded inside each project, that of
the unmasked ones over all projects. Pairs that share a band are held against each
other: first every file with the smallest file of its band (a star), then the pairs
that the stars leave open. A pair must be alike when masked, whatever band it shares, so
one bit of each of 128 minima of the masked signature goes with every band, and pairs whose
bits rule that out are passed over where they meet; so are then those whose signatures (a byte
of each of the 224 minima) rule it out. Only the texts of the pairs that are left are read
again, and the pairs verified on all their shingles. So what is kept on disk is the bands and
the signature of a text, not its shingles. A big band is split by salt.

What the clusters say:

* a family inside one project (masked similarity of ``MASKED`` or more) is generated;
* texts alike in names too (``NAMES`` or more), or equal, in several projects are vendored
  (patched copies too);
* texts whose shingles hold literals and punctuation only are one cluster, the data kept as code;
* blocks of one file that repeat one masked shape are a family within the file: generated.

What one file says by itself, where clusters can say nothing (a tool's output may look
like hand-written code and stand alone):

* a tool's signature in a comment of its own (not quoted by code, not about the past, not
  the description of a declaration), wherever it stands, marks the file as generated;
* so does a name that build tools reserve for their output (``REGISTERED``);
* short names in dense text are minified code.

Equal texts are one class from the start, so a hot text costs one row per file.

Defined results: null, empty and tiny texts (stubs of fewer than ``TINY`` tokens) are in
no cluster; a null project counts as a project of its own; a null path names nothing;
repeated rows are one file; whole texts are read; other columns are not read; empty input
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.components import connected_components
from strataloom.session import cut, release

SHINGLE, MASKED, NAMES = 5, 0.8, 0.5
#: A pair of similarity 0.8 shares no masked band in 1 of 1,900 cases, one of 0.5 no unmasked band in 1 of 200.
BANDS, ROWS = 32, 7
NAME_BANDS, NAME_ROWS = 40, 3
#: Shorter texts are stubs, alike by nature.
TINY = 20
#: A window spans several statements; a file most of whose windows come again is a family of blocks.
WINDOW, REPEATED = 20, 0.5
#: Share of shingles without a name, or of characters inside literals, from which a text is nothing but literals.
LITERAL_SHINGLES, LITERAL_CHARS = 0.85, 0.9
#: Bits of the masked signature, and the fewest that are equal in a pair to verify: a pair of similarity 0.8 has fewer in 1 of 3,500,000 cases.
BITS, EQUAL_BITS = 128, 96
#: The same for the bytes of the signature: fewer in 1 of 2,800,000 cases.
EQUAL_BYTES = 148
#: Rows of a band that one task compares with the whole band.
SALT_ROWS = 1000
#: Characters of literals from which even a text of few tokens is no stub.
STUB = 200

#: Words that keep their own shape when identifiers are masked.
KEYWORDS = frozenset(
    "if else elif for while do return function def class const let var try catch except finally throw throws raise new import from export async await package use namespace "
    "static private public protected void int string boolean bool in not is and or null nil None true false True False undefined this self switch case default break continue "
    "interface trait struct enum extends implements defer range with as pass lambda yield func fn type echo go select match where".split()
)
_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*|[^\w\s]", re.S)

#: How tools sign what they wrote. Matched at the start of a head comment.
_BANNER = re.compile(
    r"(?:code |file |source )?(?:auto[- ]?)?generated (?:by|from|with)\b|<auto-?generated\b|@generated\b|auto-?generated\b(?! (?:method|constructor|stub|getter))|(?:this|the) (?:file|code|source|module) (?:was|is|has been) "
    r"(?:auto[- ]?|automatically |machine[- ])?(?:generated|produced|written|created)\b|(?:machine|tool)[- ](?:written|made|generated)\b|do not edit\b|output of \S+ --",
    re.I,
)
#: The same in other languages; there the verb may stand anywhere in the line.
_BANNER_ELSEWHERE = re.compile(
    r"\bgénérée? (?:par|automatiquement)\b|\b(?:von|durch|mit) \S+ (?:automatisch )?(?:erzeugt|generiert|erstellt)\b|\bautomatisch (?:erzeugt|generiert)\b|\b(?:generado|creado automáticamente) (?:por|con)\b|\bgerado (?:por|automaticamente)\b"
    r"|\bgenerato (?:da|automaticamente)\b|\bwygenerowan\w* (?:przez|automatycznie)\b|сгенерирован|создан автоматически|自動生成|によって生成|自动生成|\bđược tạo (?:bởi|tự động)|tarafından (?:oluşturul|üretil)|\bgegenereerd door\b",
    re.I,
)
_PAST = re.compile(r"\bused to be\b|\bno longer\b|\bby hand since\b|\bonce (?:was )?generated\b|\bkept by hand\b|\bwas once\b|\bformerly\b", re.I)
_MARK = re.compile(r"^(?:<\?php)?\s*(?:/\*+!?|\*+|//+!?|#+!?|--|<!--|;+|%+)\s*")


#: Names that build tools reserve for what they write.
REGISTERED = r"(?:[._](?:pb2?|gen|generated|designer)(?:_grpc)?|\.g)\.\w+$|(?:^|/)__generated__/|(?:^|/)generated-(?:test-)?sources/|(?:^|/)cache/compiled/"


class _Kinds(dict):
    """Token that is no string or comment to its mask."""

    def __missing__(self, token: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        c = token[0]
        self[token] = kind = "N" if c.isdigit() else (token if token in KEYWORDS else "I") if c.isalpha() or c in "_$" else token
        return kind


class _Hashes(dict):
    """Token to its hash."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(token)
        return found


_kinds, _hash_of = _Kinds(), _Hashes()


def lex(text: str) -> tuple[list[str], list[str], int, int]:
    """(masked tokens, tokens, characters in strings and numbers, characters in comments)."""
    masked, raw, literal, comment = [], [], 0, 0
    kinds = _kinds
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in "#/\"'`":
            if c == "#" or t[:2] in ("//", "/*") or (len(t) > 5 and t[:3] in ('"""', "'''")):
                comment += len(t)
                continue
            if len(t) > 1 and c != "/":
                masked.append("S")
                literal += len(t)
            else:
                masked.append(t)
        else:
            kind = kinds[t]
            if kind == "N":
                literal += len(t)
                if masked and masked[-1] in "+-" and (len(masked) == 1 or masked[-2] in "([{,=:"):
                    masked[-1], raw[-1] = "N", raw[-1] + t
                    continue
            masked.append(kind)
        raw.append(t)
    return masked, raw, literal, comment


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash_of.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` tokens (one for the whole, if it is shorter)."""
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            part = h[k : k + n]
            out[: len(part)] = (out[: len(part)] ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def shingles(tokens: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-token shingles, the second and later occurrences of one as shingles of their own."""
    out = np.sort(_runs(_hashes(tokens), SHINGLE))
    occurrence = (np.arange(len(out)) - np.searchsorted(out, out)).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = (out ^ (occurrence * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return np.unique(out)


_SEEDS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(max(BANDS * ROWS, NAME_BANDS * NAME_ROWS))], dtype=np.uint64)


def _minima(found: np.ndarray, count: int) -> np.ndarray:
    """The MinHash signature."""
    with np.errstate(over="ignore"):
        mixed = found[None, :] * _SEEDS[:count, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed.min(axis=1)


def _keys(low: np.ndarray, bands: int, rows: int) -> list[int]:
    low = low.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows):
            key = (key ^ low[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64).tolist()


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One key per band of the MinHash signature."""
    return _keys(_minima(found, bands * rows), bands, rows)


def signature_bits(low: np.ndarray) -> list[int]:
    """One bit of each of the first ``BITS`` minima, 64 to a number."""
    with np.errstate(over="ignore"):
        bit = (low[:BITS] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(bit.astype(np.uint8)).view(np.int64).tolist()


def signature_bytes(low: np.ndarray) -> np.ndarray:
    """One byte of each minimum."""
    with np.errstate(over="ignore"):
        return ((low * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.uint8).view(np.int8)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


class _Names(dict):
    """Mask to whether it stands for a name or a word."""

    def __missing__(self, masked: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        self[masked] = found = masked not in ("N", "S") and (masked[0].isalpha() or masked[0] in "_$")
        return found


_name_of = _Names()


def _names_before(masked: list[str]) -> np.ndarray:
    """The number of names before each place."""
    out = np.zeros(len(masked) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(_name_of.__getitem__, masked), dtype=bool, count=len(masked)), out=out[1:])
    return out


def repeated_share(masked: list[str]) -> float:
    """Share of the file's windows of ``WINDOW`` masked tokens, names among them, that come again in the file."""
    if len(masked) < WINDOW + SHINGLE:
        return 0.0
    names = _names_before(masked)
    named = names[WINDOW:] > names[:-WINDOW]
    _, where, times = np.unique(_runs(_hashes(masked), WINDOW), return_inverse=True, return_counts=True)
    return float(((times[where] > 1) & named).mean())


def literal_only(masked: list[str], literal: int, code: int) -> bool:
    """Whether the text consists of literals: hardly a shingle holds a name, or hardly a character stands outside literals."""
    if not masked or not literal:
        return False
    names = _names_before(masked)
    if len(masked) >= TINY and float((names[SHINGLE:] == names[:-SHINGLE]).mean()) >= LITERAL_SHINGLES:
        return True
    return literal >= LITERAL_CHARS * code


def is_signed(text: str) -> bool:
    """A tool's signature in a comment of its own: at the head of the file, at its end or between declarations."""
    lines = text.lstrip("\ufeff").split("\n")
    open_block, first = False, True  # ``first``: nothing but comments so far
    waiting = False  # a signature whose comment must not belong to the line that follows
    for line in lines:
        bare = line.strip()
        mark = _MARK.match(bare) if line[:1] not in (" ", "\t") or open_block else None
        if not bare:
            if waiting and not open_block:
                return True
            continue
        if not mark and not open_block:
            first = first and (bare.startswith("#!") or bare == "<?php")
            waiting = False
            continue
        open_block = (open_block or "/*" in bare) and "*/" not in bare
        said = bare[mark.end() :] if mark else bare
        said = re.sub(r"'[^']*'|\"[^\"]*\"|“[^”]*”", "", said)  # a quoted signature is spoken of
        if (_BANNER.match(said) or _BANNER_ELSEWHERE.search(said)) and not _PAST.search(said):
            if first:
                return True
            waiting = True
    return waiting


def own_traits(text: str, path: str = "") -> tuple[list[str], list[str], list[str]]:
    """(reasons found in the file alone, masked tokens, tokens)."""
    masked, raw, literal, comment = lex(text)
    reasons: list[str] = []
    if is_signed(text) or re.search(REGISTERED, path.replace("\\", "/")):
        reasons.append("generated")
    code = max(1, len(text) - comment)
    if literal_only(masked, literal, code) and (len(masked) >= TINY or literal >= STUB):
        reasons.append("data")
    elif repeated_share(masked) >= REPEATED:
        reasons.append("generated")
    names = [t for t, m in zip(raw, masked) if m == "I"]
    short = sum(len(t.lstrip("$")) <= 2 for t in names) / len(names) if names else 0.0
    blank = sum(text.count(c) for c in " \t\n\r") / max(1, len(text))
    if short >= 0.5 and blank < 0.1 and len(names) >= TINY:
        reasons.append("minified")
    return reasons, masked, raw


def _features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The traits of each text, a few hundred texts at a time; the other columns go along."""
    for whole in parts:
        for begin in range(0, len(whole), 300):
            part = whole.iloc[begin : begin + 300]
            out = []
            for text in part["content"]:
                reasons, masked, raw = own_traits(text)
                bits, low, bands, name_bands = (None, None), np.empty(0, np.uint64), [], []
                if len(masked) >= TINY and "data" not in reasons:
                    low = _minima(shingles(masked), BANDS * ROWS)
                    bits, bands, name_bands = signature_bits(low), _keys(low, BANDS, ROWS), band_keys(shingles(raw), NAME_BANDS, NAME_ROWS)
                out.append((sorted(set(reasons)), *bits, signature_bytes(low), np.asarray(bands, np.int64), np.asarray(name_bands, np.int64)))
            traits = pd.DataFrame(out, columns=["reasons", "x", "y", "low", "bands", "name_bands"], index=part.index)
            yield pd.concat([part.drop(columns="content"), traits.astype({"x": "Int64", "y": "Int64"})], axis=1)


def _sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingles of each text, 32 bits of each."""
    for part in parts:
        out = []
        for text in part["content"]:
            masked, raw, _, _ = lex(text)
            out.append([np.unique((shingles(tokens) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for tokens in (masked, raw)])
        yield pd.DataFrame({"id": part["id"].to_numpy(), "shape": [a for a, _ in out], "names": [b for _, b in out]})


def _common(a: str, b: str) -> str:
    """Jaccard similarity of two columns of shingles."""
    both = f"size(array_intersect({a}, {b}))"
    return f"{both} / (size({a}) + size({b}) - {both})"


def _judged(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, head, alike) of the pairs that are alike: 1 when masked, 2 in names too. The shingles are made anew, of the texts in pairs only."""
    signed = pairs.join(classes.select("id", "low"), "id").join(classes.select(F.col("id").alias("head"), F.col("low").alias("low2")), "head")
    pairs = cut(signed.filter(f"size(filter(zip_with(low, low2, (p, q) -> p = q), e -> e)) >= {EQUAL_BYTES}").select("id", "head"), tidy=True)
    asked = pairs.select(F.explode(F.array("id", "head")).alias("id")).distinct()
    mine = cut(texts.join(asked, "id", "left_semi").mapInPandas(_sets, "id bigint, shape array<int>, names array<int>"), tidy=True)
    other = mine.select(F.col("id").alias("head"), F.col("shape").alias("shape2"), F.col("names").alias("names2"))
    alike = f"CASE WHEN {_common('shape', 'shape2')} < {MASKED} THEN 0 WHEN {_common('names', 'names2')} < {NAMES} THEN 1 ELSE 2 END"
    told = pairs.join(mine, "id").join(other, "head").select("id", "head", F.expr(alike).alias("alike")).filter("alike > 0")
    out = cut(told.groupBy("id", "head").agg(F.max("alike").alias("alike")), tidy=True)  # a file that is given twice is read twice
    release(mine)
    release(pairs)
    return out


def _copies(links: DataFrame) -> DataFrame:
    """(id, component) of the files with a copy."""
    return connected_components(links.filter("alike = 2"), "id", "head").select(F.col("node").alias("id"), "component")


def _relatives(links: DataFrame, place: DataFrame) -> DataFrame:
    """(id) of the members of families: alike, and of one and the same project."""
    family = links.filter("alike > 0").join(place, "id").join(place.select(F.col("id").alias("head"), F.col("project").alias("other")), "head").filter("project = other")
    return family.select(F.explode(F.array("id", "head")).alias("id")).distinct()


def _banded(classes: DataFrame, *more: str) -> DataFrame:
    """(key, id, x, y and more) of every band: a masked one within its project (odd keys), an unmasked one over all (even keys)."""
    keep = ["id", "x", "y", *more]
    shapes = classes.filter("lo = hi").select(*keep, "lo", F.explode("bands").alias("band")).select(F.expr("xxhash64(lo, band) | 1L").alias("key"), *keep)
    named = classes.select(*keep, F.explode("name_bands").alias("band")).select(F.expr("band & -2L").alias("key"), *keep)
    # Said here, since filters that only one reader of a shuffle infers would make another shuffle of it.
    return shapes.unionByName(named).filter(" AND ".join(f"{c} IS NOT NULL" for c in ("key", "id", "x", "y", *more)))


#: Whether masked likeness is left open by the bits of two texts.
_NEAR = f"bit_count(x ^ x2) + bit_count(y ^ y2) <= {BITS - EQUAL_BITS}"


def alike_files(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, head, alike): links between different texts, such that every family member has one and every copy is joined to its copies.

    ``classes``: one row per text (id, lo and hi project, bands, name_bands, x and y: bits, low: bytes); ``texts``: id and content of at least these.
    """
    place = classes.filter("lo = hi").select("id", F.col("lo").alias("project"))
    bands = _banded(classes).repartition("key")  # a key's rows are shuffled once; both sides of the join read them there
    heads = bands.groupBy("key").agg(F.min(F.struct("id", "x", "y")).alias("h"), F.count("*").alias("members")).filter("members > 1")
    heads = heads.select("key", F.col("h.id").alias("head"), F.col("h.x").alias("x2"), F.col("h.y").alias("y2"))
    stars = _judged(bands.join(heads, "key").filter("id <> head").filter(_NEAR).select("id", "head").distinct(), classes, texts)

    copies = _copies(stars)
    state = cut(classes.select("id").join(copies, "id").join(_relatives(stars, place).withColumn("placed", F.lit(True)), "id", "full").select("id", "component", F.coalesce("placed", F.lit(False)).alias("placed")), tidy=True)
    told = classes.join(state, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("placed", F.coalesce("placed", F.lit(False)))
    told = _banded(told, "component", "placed")
    hot = cut(told.groupBy("key").agg(F.count("*").alias("members")).filter(f"members > {SALT_ROWS}").select("key", F.ceil(F.col("members") / SALT_ROWS).cast("int").alias("salts")), tidy=True)
    right = [F.col("key").alias("key2"), *[F.col(c).alias(d) for c, d in (("id", "head"), ("x", "x2"), ("y", "y2"), ("component", "c2"), ("placed", "placed2"))]]
    # A pair is open if one of the two has no family yet, or if the two are not yet joined by copies.
    still = "head < id AND CASE WHEN key & 1 = 1 THEN NOT (placed AND placed2) ELSE component <> c2 END"
    pair = f"{still} AND {_NEAR}"
    cold = told.join(hot, "key", "left_anti").repartition("key")
    cold = cut(cold.join(cold.select(*right), F.expr(f"key = key2 AND {pair}")).select("id", "head").distinct(), tidy=True)
    busy = told.join(hot, "key")
    halves = busy.withColumn("salt", F.expr("pmod(hash(id), salts)")), busy.select(*right, F.explode(F.expr("sequence(0, salts - 1)")).alias("s2"))
    busy = cut(halves[0].join(halves[1], F.expr(f"key = key2 AND salt = s2 AND {pair}")).select("id", "head").distinct(), tidy=True)
    rest = _judged(cold.unionByName(busy).distinct().join(stars, ["id", "head"], "left_anti"), classes, texts)
    return stars.unionByName(rest)


def file_origins(files: DataFrame) -> DataFrame:
    """(file_id, reasons, class_id, links): files that are not hand-written source of their project.

    ``class_id`` is the smallest file of its class of equal or copied texts, ``links`` the number of
    verified links of its text; a file told by itself alone has its own id and no links.
    """
    rows = files.filter("id IS NOT NULL AND content IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.coalesce("project_id", -F.col("id")).cast("int").alias("project_id"), F.translate(F.coalesce("path", F.lit("")), "\\", "/").alias("path"), "content", F.sha2("content", 256).alias("sha"))
    # Equal texts are read once; what is left of the files are small rows.
    texts = rows.groupBy("sha").agg(F.min("id").alias("id"), F.min("project_id").alias("lo"), F.max("project_id").alias("hi"), F.count_distinct("id").alias("files"), F.first("content").alias("content"))
    schema = "sha string, id bigint, lo int, hi int, files bigint, reasons array<string>, x bigint, y bigint, low array<tinyint>, bands array<bigint>, name_bands array<bigint>"
    traits = cut(texts.mapInPandas(_features, schema), tidy=True)
    classes = traits.filter(F.size("bands") > 0)
    links = alike_files(classes, rows.select("id", "content"))

    whole = classes.select("id", "sha", "lo", "hi").join(_copies(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    wide = whole.groupBy("component").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select("component")
    vendored = whole.join(wide, "component", "left_semi").select("id", F.lit("vendored").alias("reason"))

    place = classes.filter("lo = hi").select("id", F.col("lo").alias("project"))
    family = _relatives(links, place).unionByName(classes.filter("lo = hi AND files > 1").select("id")).distinct()
    generated = family.select("id", F.lit("generated").alias("reason"))

    more = vendored.unionByName(generated).groupBy("id").agg(F.collect_set("reason").alias("more"))
    count = links.select(F.explode(F.array("id", "head")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    told = whole.select("id", "sha", "component").join(more, "id").join(count, "id", "left").drop("id")
    members = rows.select("id", "sha", F.col("path").rlike(REGISTERED).alias("registered")).groupBy("id").agg(F.min("sha").alias("sha"), F.max("registered").alias("registered"))
    none = F.array().cast("array<string>")
    both = members.join(traits.select("sha", "reasons"), "sha").join(told, "sha", "left")
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", F.coalesce("more", none), F.when(F.col("registered"), F.array(F.lit("generated"))).otherwise(none))))
    return both.select(F.col("id").cast("int").alias("file_id"), reasons.alias("reasons"), F.coalesce("component", "id").cast("int").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")).filter("size(reasons) > 0")
