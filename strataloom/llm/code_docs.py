"""Functions paired with what their documentation says about them.

Source files and bodies are parsed with generalised LL grammars that recover from
errors (``gll``, ``source_grammar``): the parse gives the functions of a file, sound ones
of broken files too, the comment that stands before each, its head over all lines and, in
Python, the string before the first statement. A documentation comment is a sequence of
paragraphs, tags with or without a description, notices, directives, code and separators.

What counts as a description is wording that is left after everything else: words
of the name, the signature and the parameters (also inflected), filler words, type
names. Descriptions of any length that are given to a large share of the differently
named functions of the corpus are templates; they are found by hash counts and dropped.

Defined results: a null, empty or blank body is no pair; null documentation and a
null signature count as empty; repeated symbols are judged each; whole texts are
read; a null id is ignored; other columns are not read; empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.gll import Parser
from strataloom.llm.source_grammar import brace_head, functions_of, head_and_docstring
from strataloom.session import cut

#: A description given to at least so large a share of the differently named functions, and to so many of them, is a template.
TEMPLATE_SHARE, TEMPLATE_NAMES = 0.001, 5

#: Runs of lines of one kind are one token, and a text ends with the token END, so that every parse has
#: one end and the work is linear in the lines.
COMMENT_GRAMMAR = {
    "Comment": [("END",), ("Item", "Comment")],
    "Item": [("Paragraph",), ("TagBlock",), ("Notice",), ("Aside",), ("Example",)],
    "Paragraph": [("TEXT",)],
    "TagBlock": [("TAG",), ("TAG", "TEXT")],
    "Notice": [("NOTICE",), ("NOTICE", "LEGAL")],
    "Aside": [("BLANK",), ("RULE",), ("MARK",), ("LEGAL",)],
    "Example": [("CODE",)],
}


def runs(tokens: list[tuple[str, str]], alone: tuple[str, ...]) -> list[tuple[str, str]]:
    """Tokens with neighbours of one kind joined, except the kinds that stand ``alone``, and END."""
    out: list[tuple[str, list[str]]] = []
    for kind, text in tokens:
        if out and out[-1][0] == kind and kind not in alone:
            out[-1][1].append(text)
        else:
            out.append((kind, [text]))
    return [(k, " ".join(t for t in texts if t)) for k, texts in out] + [("END", "")]


_comment_parser = Parser(COMMENT_GRAMMAR, "Comment")

#: Words that say nothing about a function by themselves.
FILLER = frozenset(
    "a an the this that these those it its is are was were be been being do does did done will shall would should can could may might must has have had of in on at to for from by with and or as if so then when "
    "which who whose what where into onto we you i our your their they he she there here not no none null nil void undefined true false also just some any all each every one "
    "function functions method methods procedure routine func def class object instance module file helper helpers util utils utility utilities getter getters setter setters accessor accessors constructor "
    "param params parameter parameters arg args argument arguments option options value values result results return returns returned returning throws throw raises raise error errors exception type types "
    "string strings str int integer number numeric float double long boolean bool array arrays list lists map dict any mixed unknown object promise date byte bytes self cls "
    "public private protected internal static api section region endregion end begin start block stuff things thing misc miscellaneous general common various constants fields properties property members "
    "todo fixme xxx tbd wip n na doc docs document documentation documented describe description describing desc summary short brief details detail comment comments placeholder lorem ipsum dolor sit amet add write fill me later "
    "see above below parent super inherited inherit inheritdoc javadoc non auto generated stub default given name named called main simple new used use uses using implementation implements implement".split()
)
_TAG = re.compile(r"^(?:[@\\](\w[\w:.-]*)|:(\w+)(?:\s+[^:]*)?:|(Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Note|Notes|Warning|Example|Examples)\s*:\s*$)\s*", re.I)
_BARE_TAGS = frozenset("author authors since version date created copyright license licence override inheritdoc see link api internal access package subpackage category group ignore nodoc hide test covers dataprovider codecoverageignore codecoverageignorestart codecoverageignoreend noinspection suppresswarnings todo var property type typedef template extends implements module namespace file fileoverview private public protected static final abstract readonly async generator memberof constructor class function method name alias example usage".split())
_TYPE = re.compile(r"^(?:\{[^}]*\}?\s*|(?:int|string|str|bool|boolean|float|double|long|array|object|mixed|void|null|None|self|static|callable|iterable|\w+\[\]|\w+<[^>]*>|\w+\|[\w|]+|\?\w+|list|dict|number|any)\s*(?=\$|\b|$))", re.I)
_NOTICE = re.compile(
    r"^(?:copyright\b|\(c\)|©|spdx-|licen[cs]ed? (?:under|by)\b|all rights reserved|created (?:on|by|at|with)\b|created \w+ \d|(?:last )?(?:change|changed|modified|updated|edited|revision|reviewed)\b[^a-z]*\d|(?:author|authors|date|version|revision|since|owner|maintainer|copyright|licen[cs]e|file|package|project|ticket|jira|reviewed[- ]by|signed-off-by)s?\s*[:=]|"
    r"permission is hereby|redistribution and use|the above copyright|this (?:file|program|software|source|code) is (?:part of|free|licensed|provided|distributed|subject|proprietary|confidential)|\$(?:id|revision|date)\b|-\*-)",
    re.I,
)
_LEGAL = re.compile(r"\b(?:rights reserved|without (?:any )?warrant\w+|warranties|hereby granted|licen[cs]e(?:d)? (?:under|agreement|terms)|merchantability|redistribut\w+|liab(?:le|ility)|as is\b|see (?:the )?licen[cs]e)\b", re.I)
_DIRECTIVE = re.compile(
    r"^(?:eslint|tslint|jshint|jslint|jscs|prettier|stylelint|istanbul|c8|v8|noqa|nolint|pylint|flake8|mypy|pyright|type:\s*ignore|fmt:|isort:|yapf:|pragma\b|go:|\+build|lint:|nosonar|nosec|checkstyle|noinspection|suppress|phpcs|phpstan|psalm|phan|codecoverage|"
    r"@?ts-|@ts-|@formatter|@noinspection|@codecoverage|@suppress|@phpstan|@psalm|sonar|cspell|spell-?checker|webpack|jsx|@jsx|#?region\b|#?endregion\b|<editor-fold|</editor-fold|vim?:|emacs|coding[:=]|!?/usr/bin|global\s|exported\s|jshint|rubocop|shellcheck|clang-format|cppcheck|coverity|fallthrough|line \d)",
    re.I,
)
_POINTER = re.compile(
    r"^(?:@?see\b|cf\.?\s|c\.f\.|ref(?:er)?(?:ence)?(?: to|:)|for (?:more |further )?(?:details|information|docs|documentation|an explanation)\b.*\bsee\b|(?:documented|described|explained|specified|defined) (?:in|at|under|by|elsewhere)\b|more (?:info|details|information) (?:in|at|on)\b|docs? (?:in|at|under|:)|(?:same|as) (?:as )?(?:above|below|parent|the parent|super)\b|https?://|www\.|"
    r"siehe\b|voir\b|véase\b|ver (?:el|la|o|a|em|en)\b|zob\.|zobacz\b|см\.|xem\b|bkz\b|参照)",
    re.I,
)
_PLACEHOLDER = re.compile(r"^(?:\W*(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|none|empty|lorem ipsum|lorem|placeholder|undocumented|not documented|no description|missing (?:doc|description)|(?:add|write|insert|needs?|missing|fill in)(?: a| the| some)? (?:doc\w*|description|comment)\w*|description(?: here)?|document me|auto-?generated .*stub)\b[^a-z]*)", re.I)
_CODE = re.compile(
    r"^(?:return\b(?:\s+[\w.$\[\]()'\"]+)?\s*;?$|(?:if|for|while|switch|catch|elif|foreach)\s*\(.*|(?:if|for|while|elif|with|except|else|try)\b[^.?!]*:\s*$|(?:const|let|var|import|from|use|using|defer|go|await|yield|throw|raise|del|echo|print)\s+[\w$.*{(\"'][^ ]*(?:\s*(?:=|:=|import|as|;|\().*)?;?$|"
    r"[\w$.\[\]>-]+\s*(?:[+\-*/|&.]?=|:=|<-|=>)\s*\S.*|[\w$.>:-]+\([^)]*\)?\s*[;{]?$|[\w$.>:-]+\(.*\)\s*;?$|.*[;{}]\s*$|[})\]]+;?$|(?:def|function|func|fn|class|public|private|protected|static|async)\s+[\w$ ]+\(.*)"
)
#: What makes a statement of a text that shares all but one word with the name.
_CONDITION = re.compile(r"\bO\([^)]*\)|\b(?:not|never|once|when|if|unless|until|without|only|null|idempotent|safe|deprecated)\b", re.I)
_SEPARATOR = re.compile(r"^[\W_]*$")
_FENCE = re.compile(r"^(\W{2,})\s*(.*?)\s*\1?\W*$")
_STRIP_OPEN = re.compile(r"^\s*(?:/\*+!?|//+[!/]?|#+(?![A-Za-z])|#(?=[A-Za-z])|--+(?!-)|;+|<!--|\"\"\"|'''|%+)\s?")
_STRIP_STAR = re.compile(r"^\s*\*+(?!/)\s?")
_STRIP_CLOSE = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")


def words_of(text: str) -> list[str]:
    """Lower-case words; camelCase and snake_case are taken apart."""
    return [w.lower() for w in _WORD.findall(re.sub(r"([a-z\d])([A-Z])", r"\1 \2", text))]


def comment_lines(comment: str) -> list[str]:
    """Lines without comment marks and indentation."""
    out = []
    for line in comment.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = _STRIP_CLOSE.sub("", line)
        bare = _STRIP_OPEN.sub("", line)
        if bare == line:
            bare = _STRIP_STAR.sub("", line)
        elif bare.lstrip().startswith("*") and not bare.lstrip().startswith("**"):
            bare = bare.lstrip().lstrip("*")
        out.append(re.sub(r"</?[A-Za-z][^<>]*>", " ", bare).strip())
    return out


def line_kind(line: str) -> tuple[str, str]:
    """(kind of token, what the line may say)."""
    if not line:
        return "BLANK", ""
    if _SEPARATOR.match(line):
        return "RULE", ""
    fence = re.match(r"^([=\-*~#+_/]{2,})\s*(.*?)\s*[=\-*~#+_/]{2,}$", line)
    if fence:
        return "MARK", ""
    if _DIRECTIVE.match(line):
        return "MARK", ""
    if _NOTICE.match(line):
        return "NOTICE", ""
    tag = _TAG.match(line)
    if tag:
        name = (tag[1] or tag[2] or tag[3] or "").lower()
        rest = line[tag.end() :]
        base = re.sub(r"[^a-z]", "", name)
        if base in ("param", "parameter", "arg", "argument", "key", "keyword", "tparam", "property", "raises", "throws", "exception") or base.startswith("param"):
            if tag[1]:
                rest = _TYPE.sub("", rest)
                if base in ("param", "arg", "argument", "tparam", "property", "parameter"):
                    rest = re.sub(r"^[\[&.]*\$?[\w.\[\]=]+\]?\s*(?:-|–|:)?\s*", "", rest)
        elif base in ("return", "returns", "yield", "yields", "type", "rtype", "var"):
            rest = re.sub(r"^(?:Promise|[A-Z]\w*)(?:<[^>]*>)?\s*$", "", _TYPE.sub("", rest))
            if base in ("type", "rtype", "var"):
                rest = ""
        elif base in _BARE_TAGS:
            return ("CODE" if base in ("example", "usage") else "NOTICE"), ""
        if _POINTER.match(rest.strip()) or _PLACEHOLDER.match(rest.strip()):
            rest = ""
        return "TAG", rest
    if _PLACEHOLDER.match(line) and len(_WORD.findall(line)) <= 6:
        return "MARK", ""
    if _POINTER.match(line):
        return "MARK", ""
    if _LEGAL.search(line) and not re.search(r"\b(?:strip|strips|add|adds|remove|removes|insert|inserts|check|checks|parse|parses)\b", line, re.I):
        return "LEGAL", ""
    if _CODE.match(line) and not re.search(r"[a-z]{2,}[.?!]$", line) and len(_WIDE.findall(line)) < 2:
        return "CODE", ""
    return "TEXT", line


def _alike(word: str, known: set[str], stems: set[str]) -> bool:
    if word in known or word in FILLER:
        return True
    if len(word) >= 3:
        for cut in ("", "s", "es", "ed", "d", "ing", "er", "or", "r", "ter", "ies", "ied", "ting", "ning", "ping", "ter", "ler", "ger", "ment", "ion"):
            if cut and not word.endswith(cut):
                continue
            root = word[: len(word) - len(cut)] if cut else word
            if len(root) >= 2 and (root in known or root + "e" in known or root + "y" in known or root in stems):
                return True
            if len(root) > 3 and root[-1] == root[-2] and root[:-1] in known:
                return True
    return False


def informative_words(text: str, known: set[str], stems: set[str]) -> list[str]:
    """Words left when the name's, the signature's and filler words are taken away; wide scripts count by characters."""
    out = [w for w in words_of(_WIDE.sub(" ", text)) if len(w) > 1 and not _alike(w, known, stems)]
    wide = _WIDE.findall(text)
    return out + ["".join(wide[k : k + 2]) for k in range(0, len(wide) - 1, 2)]


def described(comment: str, known: set[str], stems: set[str]) -> list[str]:
    """The passages of a comment that say something."""
    lines = comment_lines(comment)
    tokens = runs([line_kind(line) for line in lines], ("TAG",))
    out = []
    for name, begin, end in _comment_parser.pieces([k for k, _ in tokens], ("TagBlock", "Paragraph", "Notice", "Example")):
        if name in ("TagBlock", "Paragraph"):
            said = " ".join(t for _, t in tokens[begin:end] if t)
            left = len(informative_words(said, known, stems))
            if left >= 2 or (left and _CONDITION.search(said)):
                out.append(said)
    return out


_QUOTES = re.compile(r"^[rRuUbBfF]{0,2}(\"\"\"|'''|[\"'])(.*?)(?:\1|\Z)", re.S)


def docstring(body: str) -> str:
    """The string that documents the function, also of a broken body; empty if there is none."""
    if "def" not in body or ('"' not in body and "'" not in body):
        return ""
    quoted = _QUOTES.match(head_and_docstring(body)[1])
    return quoted[2] if quoted else ""


def head_of(body: str) -> str:
    """The head of a function, over all its lines; the first line if the parse finds none."""
    return head_and_docstring(body)[0] or brace_head(body) or body.lstrip().split("\n", 1)[0]


def describe(name: str | None, signature: str | None, doc: str | None, body: str | None) -> tuple[str, bool] | None:
    """(description, whether it stands inside the body), or None."""
    if not body or not body.strip():
        return None
    known = set(words_of((name or "") + " " + (signature or "")))
    if not signature:
        known |= set(words_of(head_of(body)))
    joined = re.sub(r"[^A-Za-z]", "", (name or "").rpartition("::")[2]).lower()
    known.add(joined)
    stems = {w[:-1] for w in known if len(w) > 3 and w[-1] in "ey"}
    if doc and doc.strip():
        said = described(doc, known, stems)
        if said:
            return " ".join(said), False
    inner = docstring(body)
    if inner.strip():
        said = described(inner, known, stems)
        if said:
            return " ".join(said), True
    return None


def _judged(rows: Iterator[tuple]) -> list[tuple]:
    """(key, name, description, inside, template, body, what else a row has) of the rows with a description."""
    out = []
    for key, name, signature, doc, body, *rest in rows:
        found = describe(name, signature, doc, body)
        if found:
            known = set(words_of((name or "") + " " + (signature or "")))
            masked = " ".join("\x00" if w in known else w for w in words_of(found[0]))
            out.append((key, name, found[0], found[1], xxhash.xxh64_intdigest(masked) - (1 << 63), body, *rest))
    return out


def _without_templates(found: DataFrame) -> DataFrame:
    """Pairs whose description, the name's words masked, is not given to ``TEMPLATE_SHARE`` of all differently named functions (``TEMPLATE_NAMES`` at least)."""
    given = found.select("template", "name").distinct().groupBy("template").agg(F.count("*").alias("names")).filter(F.col("names") >= TEMPLATE_NAMES)
    total = found.agg(F.approx_count_distinct("name", 0.01).alias("total"))
    # The total is one row.
    templates = given.join(F.broadcast(total), F.col("names") >= TEMPLATE_SHARE * F.col("total")).select("template")
    return found.join(templates, "template", "left_anti").drop("template")


_FOUND = "name string, description string, inside boolean, template bigint, body string"
_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]


def _batch(out: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cells = list(zip(*out)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)


def pairs_with_documentation(symbols: DataFrame, kinds: tuple[str, ...] = ("function", "method"), columns: tuple[str, ...] = ("symbol_id", "description", "inside", "body")) -> DataFrame:
    """(symbol_id, description, inside, body): code and description of every function that has one.

    What is asked for by ``columns`` is written once between the parse and the two counts of the templates.
    """
    source = symbols.filter(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & (F.trim("body") != "")).select(F.col("id").cast("bigint").alias("id"), "name", "signature", "doc", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(_judged(zip(*(c.to_pylist() for c in batch.columns))), [pa.int64(), *_TYPES], ["symbol_id", "name", "description", "inside", "template", "body"])

    found = cut(source.mapInArrow(run, f"symbol_id bigint, {_FOUND}").select(*columns, *[c for c in ("name", "template") if c not in columns]))
    return _without_templates(found).select(*columns)


def pairs_in_files(files: DataFrame) -> DataFrame:
    """(file_id, name, start_line, end_line, description, inside, repairs, body): functions that a parse of the whole
    file finds, with the comment before them or the string inside; ``repairs`` is 0 for those that are sound, also of broken files.

    Null ids and contents are ignored, a text without functions gives no rows, a file that stands twice is read twice.
    """
    source = files.filter(F.col("id").isNotNull() & F.col("content").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "content")
    more = ["start_line", "end_line", "repairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((k, f.name, f.signature, f.doc, f.body, f.start_line, f.end_line, f.repairs) for k, text in zip(*(c.to_pylist() for c in batch.columns)) for f in functions_of(text))
            yield _batch(_judged(rows), [pa.int64(), *_TYPES, *[pa.int32()] * 3], ["file_id", "name", "description", "inside", "template", "body", *more])

    found = cut(source.mapInArrow(run, f"file_id bigint, {_FOUND}, start_line int, end_line int, repairs int"))
    return _without_templates(found).select("file_id", "name", "start_line", "end_line", "description", "inside", "repairs", "body")
