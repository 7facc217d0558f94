"""Source texts to symbols and relations.

Python is read with its own grammar; JSON, HTML, XML and CSS with scanners of their
structure; JavaScript, TypeScript, PHP and Go with a lexical scanner (declarations by
pattern, extents by brackets outside strings and comments), which is an approximation:
no types, no scopes beyond parameters, no macros. A text that cannot be read gives an
error row and no symbols, so its hash is not recorded and the next scan tries again.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths at which parts of a symbol are cut, and the mark of a cut body.
MAX_SIGNATURE, MAX_DOC, MAX_BODY = 300, 1000, 6000
CUT_MARK = "\n/* …truncated */"
FILE_SCOPE = "@file"
HOOKS_FIRED = frozenset("do_action apply_filters do_action_ref_array apply_filters_ref_array".split())
HOOKS_REGISTERED = frozenset("add_action add_filter".split())
NOT_CALLS = frozenset("if for while switch catch return function typeof new throw await async super foreach elseif list array isset empty unset echo print include require match defer go range select func import case else do with sizeof declare exit die".split())

Symbol = tuple[str, str, str, str | None, int, int, str]  # name, kind, signature, doc, start, end, body
Relation = tuple[str, str, str, int]  # source symbol or @file, relation, target name, line


def _cut(body: str) -> str:
    return body if len(body) <= MAX_BODY else body[:MAX_BODY] + CUT_MARK


def _symbol(name: str, kind: str, body: str, doc: str | None, start: int, end: int) -> Symbol:
    return name, kind, body.split("\n", 1)[0].strip()[:MAX_SIGNATURE], doc[:MAX_DOC] if doc else None, start, end, _cut(body)


def parse_python(text: str) -> tuple[list[Symbol], list[Relation]]:
    tree = ast.parse(text)
    lines = text.split("\n")
    symbols: list[Symbol] = []
    relations: list[Relation] = []

    def comment_above(line: int) -> str | None:
        out = []
        k = line - 2
        while k >= 0 and lines[k].strip().startswith("#"):
            out.append(lines[k].strip())
            k -= 1
        return "\n".join(reversed(out)) or None

    def calls(node: ast.AST, owner: str, hidden: set[str]) -> None:
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call):
                target = inner.func
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                if name and not (isinstance(target, ast.Name) and name in hidden):
                    relations.append((owner, "CALLS", name, inner.lineno))

    def visit(node: ast.AST, inside: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{inside}::{child.name}" if inside else child.name
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                symbols.append(_symbol(name, "method" if inside else "function", body, ast.get_docstring(child) or comment_above(child.lineno), child.lineno, child.end_lineno or child.lineno))
                a = child.args
                calls(child, name, {x.arg for x in (*a.args, *a.kwonlyargs, *a.posonlyargs)})
            elif isinstance(child, ast.ClassDef):
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                symbols.append(_symbol(child.name, "class", body, ast.get_docstring(child) or comment_above(child.lineno), child.lineno, child.end_lineno or child.lineno))
                for base in child.bases:
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        relations.append((child.name, "EXTENDS", base.id if isinstance(base, ast.Name) else base.attr, child.lineno))
                visit(child, child.name)
            elif isinstance(child, ast.Import):
                relations.extend((FILE_SCOPE, "IMPORTS", n.name, child.lineno) for n in child.names)
            elif isinstance(child, ast.ImportFrom):
                relations.append((FILE_SCOPE, "IMPORTS", "." * child.level + (child.module or ""), child.lineno))
            elif isinstance(child, ast.Expr) and inside is None and isinstance(child.value, ast.Call):
                calls(child, FILE_SCOPE, set())

    visit(tree, None)
    return symbols, relations


_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_PHP_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|(?://|#(?!\[))[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)


def _blank(text: str, noise: re.Pattern) -> str:
    """The text with strings and comments as blanks of the same length, so places stay."""
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class _Places:
    """Lines, bracket pairs and round brackets of a text, found in one pass each and looked up by bisection."""

    def __init__(self, text: str, plain: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.round = [m.start() for m in re.finditer(r"\(", plain)]
        self.last = len(plain) - 1
        self.closed: dict[int, int] = {}
        opened: list[int] = []
        for m in re.finditer(r"[{}]", plain):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                self.closed[opened.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def close(self, opened: int) -> int:
        """Where the bracket opened at ``opened`` is closed; the end of the text if it is not."""
        return self.closed.get(opened, self.last)

    def bracket_between(self, begin: int, end: int) -> bool:
        k = bisect_left(self.round, begin)
        return k < len(self.round) and self.round[k] < end


class _Spans:
    """Spans with a value, for the outermost or innermost one around a place."""

    def __init__(self, spans: list[tuple[int, int, Any]]):
        self.spans = sorted(spans, key=lambda s: (s[0], -s[1]))
        self.begins = [b for b, _, _ in self.spans]
        self.around: list[int] = []  # the span that the span begins in
        open_: list[int] = []
        for k, (begin, _, _) in enumerate(self.spans):
            while open_ and self.spans[open_[-1]][1] < begin:
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(k)

    def inner(self, at: int) -> Any | None:
        k = bisect_right(self.begins, at) - 1
        while k >= 0 and self.spans[k][1] < at:
            k = self.around[k]
        return self.spans[k][2] if k >= 0 else None

    def outer(self, at: int) -> Any | None:
        """Of the spans that hold the place inside, the one that begins first."""
        k, found = bisect_left(self.begins, at) - 1, None
        while k >= 0:
            if at < self.spans[k][1]:
                found = self.spans[k][2]
            k = self.around[k]
        return found


def _doc_above(text: str, start: int) -> str | None:
    """The block comment or the run of line comments that ends where the declaration begins; only these lines are looked at."""
    line = text.rfind("\n", 0, start) + 1
    tail = re.sub(r"(?:export|default|abstract|final|public|private|protected|static|async)\s*\Z", "", text[line:start].rstrip(" \t"))
    end = line + len(tail.rstrip()) if tail.strip() else len(text[:line].rstrip())
    if text.endswith("*/", 0, end):
        opened = text.rfind("/*", 0, end - 2)
        return text[opened:end] if opened >= 0 and "*/" not in text[opened + 2 : end - 2] else None
    lines = []
    while end > 0:
        begin = text.rfind("\n", 0, end) + 1
        said = text[begin:end]
        if not re.match(r"\s*(//|#)", said):
            break
        lines.append(said.strip())
        end = begin - 1
    return "\n".join(reversed(lines)) or None


_DECLARATIONS = {
    "script": (
        re.compile(r"\b(class|interface|trait)\s+([A-Za-z_$][\w$]*)[^{;]*\{"),
        re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(([^)]*)\)[^{;]*\{"),
        re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|abstract|readonly|override)\s+)*\*?([A-Za-z_$#][\w$]*)\s*\(([^)]*)\)\s*(?::[^{;=]+)?\{", re.M),
    ),
    "php": (
        re.compile(r"\b(class|interface|trait)\s+([A-Za-z_]\w*)[^{;]*\{"),
        re.compile(r"\bfunction\s*&?\s*([A-Za-z_]\w*)\s*\(([^)]*)\)[^{;]*\{"),
        re.compile(r"\bfunction\s*&?\s*([A-Za-z_]\w*)\s*\(([^)]*)\)[^{;]*\{"),
    ),
}
_GO_FUNC = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?\s*([A-Za-z_]\w*)[^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(([^)]*)\)[^{\n]*\{", re.M)
_GO_TYPE = re.compile(r"^type\s+([A-Za-z_]\w*)\s+(struct|interface)\s*\{", re.M)
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(([^)]*)\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>\s*\{")


def parse_brackets(text: str, lang: str) -> tuple[list[Symbol], list[Relation]]:
    php, go = lang == "php", lang == "go"
    plain = _blank(text, _PHP_NOISE if php else _NOISE)
    places = _Places(text, plain)
    line_of = places.line
    found: list[tuple[int, int, str, str, str]] = []  # begin, end, name, kind, parameters
    space = re.search(r"\bnamespace\s+([\w\\]+)\s*[;{]", plain) if php else None
    prefix = space[1] + "\\" if space else ""
    if go:
        found += [(m.start(), places.close(m.end() - 1), f"{m[1]}::{m[2]}" if m[1] else m[2], "method" if m[1] else "function", m[3]) for m in _GO_FUNC.finditer(plain)]
        found += [(m.start(), places.close(m.end() - 1), m[1], "interface" if m[2] == "interface" else "class", "") for m in _GO_TYPE.finditer(plain)]
    else:
        types, functions, members = _DECLARATIONS["php" if php else "script"]
        classes = [(m.start(), places.close(m.end() - 1), prefix + m[2], m[1]) for m in types.finditer(plain)]
        found += [(b, e, n, k, "") for b, e, n, k in classes]
        within = _Spans([(b, e, n) for b, e, n, _ in classes]).outer
        for m in functions.finditer(plain):
            if not within(m.start()):
                found.append((m.start(), places.close(m.end() - 1), prefix + m[1], "function", m[2]))
        for m in members.finditer(plain):
            owner = within(m.start())
            if owner and m[1] not in NOT_CALLS:
                found.append((m.start() + len(m[0]) - len(m[0].lstrip()), places.close(m.end() - 1), f"{owner}::{m[1]}", "method", m[2]))
        if not php:
            found += [(m.start(), places.close(m.end() - 1), m[1], "function", m[2] or "") for m in _ARROW.finditer(plain) if not within(m.start())]
    found = sorted(set(found))
    symbols = [_symbol(n, k, text[b : e + 1], _doc_above(text, b), line_of(b), line_of(e)) for b, e, n, k, _ in found]
    relations: list[Relation] = []

    bodies = _Spans([(b, e, (n, frozenset(re.findall(r"[A-Za-z_]\w*", p)))) for b, e, n, kind, p in found if kind in ("function", "method")])

    def owner_of(k: int) -> tuple[str, frozenset[str]]:
        return bodies.inner(k) or (FILE_SCOPE, frozenset())

    heads = sorted({b for b, _, _, kind, _ in found if kind in ("function", "method")})
    for m in re.finditer(r"(\bnew\s+)?(?<![\w$])\$?([A-Za-z_][\w$\\]*)\s*\(", plain):
        name = m[2]
        head = bisect_right(heads, m.start()) - 1
        # The first bracket after the beginning of a declaration is that of its own parameters.
        if name in NOT_CALLS or (head >= 0 and not places.bracket_between(heads[head], m.start())):
            continue
        owner, hidden = owner_of(m.start())
        if name in hidden:
            continue
        line = line_of(m.start())
        if php and name in HOOKS_FIRED | HOOKS_REGISTERED:
            hook = re.match(r"\s*['\"]([^'\"]+)['\"]", text[m.end() :])
            if hook:
                relations.append((owner, "FIRES_HOOK" if name in HOOKS_FIRED else "REGISTERS_HOOK", "hook:" + hook[1], line))
                callback = re.match(r"\s*['\"][^'\"]+['\"]\s*,\s*['\"]([A-Za-z_][\w\\:]*)['\"]", text[m.end() :])
                if callback:
                    relations.append((owner, "CALLS", callback[1], line))
            continue
        relations.append((owner, "INSTANTIATES" if m[1] else "CALLS", name, line))
    if go:
        relations += [(owner_of(m.start())[0], "INSTANTIATES", m[1], line_of(m.start())) for m in re.finditer(r"&?\b([A-Z]\w*)\{", plain)]
        relations += [(FILE_SCOPE, "IMPORTS", m[1], line_of(m.start())) for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|(?:\w+\s+)?\"[^\"]+\")", text, re.M) for m in re.finditer(r"\"([^\"]+)\"", block[0])]
    elif php:
        relations += [(FILE_SCOPE, "IMPORTS", m[1], line_of(m.start())) for m in re.finditer(r"^\s*use\s+(?:function\s+)?([\w\\]+)", plain, re.M)]
    else:
        relations += [(FILE_SCOPE, "IMPORTS", m[1] or m[2], line_of(m.start())) for m in re.finditer(r"\bimport\s+(?:[^'\";]*?\s+from\s+)?['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]", text)]
    if not go:
        for m in re.finditer(r"\b(?:class|interface)\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$\\., ]+?))?(?:\s+implements\s+([\w$\\, ]+?))?\s*\{", plain):
            relations += [(prefix + m[1], "EXTENDS", x.strip(), line_of(m.start())) for x in (m[2] or "").split(",") if x.strip()]
            relations += [(prefix + m[1], "IMPLEMENTS", x.strip(), line_of(m.start())) for x in (m[3] or "").split(",") if x.strip()]
    return symbols, sorted(set(relations), key=lambda r: (r[3], r))


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[Symbol] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        mark = f"#{a['id']}" if a.get("id") else "." + a["class"].split()[0] if (a.get("class") or "").split() else None
        if mark:
            line = self.getpos()[0]
            self.found.append(_symbol(tag + mark, "element", self.get_starttag_text() or "", None, line, line))


def parse_markup(text: str) -> list[Symbol]:
    reader = _Elements()
    reader.feed(text)
    return reader.found


def parse_xml(text: str) -> list[Symbol]:
    line_of = _Places(text, "").line
    return [_symbol(m[1], "element", m[0], None, line_of(m.start()), line_of(m.start())) for m in re.finditer(r"<([A-Za-z_][\w:.-]*)\b[^<>]*>", re.sub(r"<!--.*?-->", lambda c: re.sub(r"[^\n]", " ", c[0]), text, flags=re.S))]


def parse_css(text: str) -> list[Symbol]:
    plain = re.sub(r"/\*.*?\*/", lambda c: re.sub(r"[^\n]", " ", c[0]), text, flags=re.S)
    out, places = [], _Places(text, plain)
    for m in re.finditer(r"([^{};]+)\{", plain):
        name = " ".join(m[1].split())
        if name:
            begin, end = m.start() + len(m[1]) - len(m[1].lstrip()), places.close(m.end() - 1)
            out.append(_symbol(name, "rule", text[begin : end + 1], None, places.line(begin), places.line(end)))
    return out


def parse_json(text: str) -> list[Symbol]:
    data = json.loads(text)
    out = []
    for key, value in (data.items() if isinstance(data, dict) else []):
        at = re.search(re.escape(json.dumps(key, ensure_ascii=False)) + r"\s*:", text)
        line = text.count("\n", 0, at.start()) + 1 if at else 1
        out.append(_symbol(key, "key", json.dumps(value, ensure_ascii=False), None, line, line))
    return out


def parse_source(lang: str, text: str) -> tuple[list[Symbol], list[Relation]]:
    if lang == "python":
        return parse_python(text)
    if lang in ("js", "jsx", "ts", "tsx", "php", "go"):
        return parse_brackets(text, lang)
    if lang == "html":
        return parse_markup(text), []
    if lang == "xml":
        return parse_xml(text), []
    if lang in ("css", "scss"):
        return parse_css(text), []
    if lang == "json":
        return parse_json(text), []
    return [], []


SCHEMA = "file_id bigint, row_kind string, name string, kind string, signature string, doc string, start_line int, end_line int, body string, source string, relation string, target string, line int, error string"


def parse_files(files: DataFrame, key: str = "id", lang: str = "language", text: str = "content") -> DataFrame:
    """Symbol, relation and error rows of every file; ``symbol_rows``, ``relation_rows`` and ``failed`` take them apart."""
    source = files.select(F.col(key).cast("bigint").alias("file_id"), lang, text).filter(F.col(text).isNotNull())
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    types = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file, language, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    symbols, relations = parse_source(language or "", content.replace("\x00", ""))
                except (SyntaxError, ValueError, RecursionError) as failed:
                    rows.append((file, "error", *[None] * 11, f"{type(failed).__name__}: {failed}"[:300]))
                    continue
                rows += [(file, "symbol", *s, None, None, None, None, None) for s in symbols]
                rows += [(file, "relation", *[None] * 7, *r, None) for r in relations]
            cells = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    return source.mapInArrow(run, SCHEMA)


def symbol_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row_kind = 'symbol'").select("file_id", "name", "kind", "signature", "doc", "start_line", "end_line", "body")


def relation_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row_kind = 'relation'").select("file_id", "source", "relation", "target", "line")


def failed(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row_kind = 'error'").select("file_id", "error")
