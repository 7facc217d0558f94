"""Grammars of source files, and the functions that a parse of a file gives.

Two families of languages are read, those with braces (JavaScript, TypeScript, PHP, Go, Java and
their kin) and those with indentation (Python); the text decides, not a language label. Tokens are
coarse (a comment, a string, a word, a bracket, a line end, a change of indentation); all nesting, the
heads of functions and the place of a documenting string are left to the grammar. Broken files go through
error recovery (``gll``): a missing bracket is taken as given where the parses got furthest, a superfluous
one is passed over, and sound functions before, after and inside the broken part are found as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from strataloom.llm.gll import Parser

#: Words of the two families that the grammars tell apart.
FUNCTION_WORDS = frozenset("function func fn fun".split())
MODIFIERS = frozenset("public private protected internal static final abstract async export default override virtual synchronized readonly declare pub inline const suspend open sealed get set".split())
CONTROL = frozenset("if else for foreach while do switch case match try catch finally return throw new await yield defer go with using unless until elseif elif select lock when in of typeof delete print echo assert raise import package use from".split())

_WORD_KINDS = dict.fromkeys(FUNCTION_WORDS, "FUN") | dict.fromkeys(MODIFIERS, "MOD") | dict.fromkeys(CONTROL, "CTRL")
_BRACE_TOKEN = re.compile(
    r"(?P<DOC>/\*.*?(?:\*/|\Z)|(?://|\#(?=[ !\#/@]))[^\n]*(?:\n[ \t]*(?://|\#(?=[ !\#/@]))[^\n]*)*)|(?P<STR>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<WORD>[$@]?[^\W\d][\w$]*(?:(?:\\|::|\.)[^\W\d][\w$]*)*(?:<[\w\s,<>\[\]?.|&:]*>)?)|(?P<NUM>\d[\w.]*)|(?P<GAP>\n(?:[ \t\r]*\n)+)|(?P<NL>\n)|(?P<ARROW>[=-]>)|(?P<MARK>[(){}\[\];,:])|(?P<OP>[^\s\w(){}\[\];,:\"'`]+?(?=[\s\w(){}\[\];,:\"'`]|\Z)|[\"'`])",
    re.S,
)
_LINE_TOKEN = re.compile(
    r"(?P<STR>[rRuUbBfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))|(?P<DOC>\#[^\n]*(?:\n[ \t]*\#[^\n]*)*)"
    r"|(?P<WORD>[^\W\d]\w*(?:\.[^\W\d]\w*)*)|(?P<NUM>\d[\w.]*)|(?P<GAP>\n(?:[ \t\r]*\n)+)|(?P<NL>\n)|(?P<DECO>@)|(?P<ARROW>->)|(?P<MARK>[(){}\[\];,:])|(?P<OP>[^\s\w(){}\[\];,:\"'@\#]+|[\"'])",
    re.S,
)


_CODE_LINE = re.compile(r"\n[^\S\n]*[^\s#]")


class Token(NamedTuple):
    kind: str
    begin: int
    end: int


def brace_tokens(text: str) -> list[Token]:
    out = []
    for m in _BRACE_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "WORD":
            kind = "NOTE" if m.group()[0] == "@" else _WORD_KINDS.get(m.group(), "NAME")
        elif kind == "MARK":
            kind = m.group()
        out.append(Token(kind, m.start(), m.end()))
    return out + [Token("END", len(text), len(text))]


def line_tokens(text: str) -> list[Token]:
    """Tokens with IN and DE where a line with code is indented more or less than the one before; brackets play no part in it."""
    out, levels, fresh = [], [0], True
    for m in _LINE_TOKEN.finditer(text):
        kind, at = m.lastgroup, m.start()
        if kind in ("NL", "GAP"):
            fresh = True
        elif fresh:
            # A comment stands where the next line of code stands, so that it goes with a function below it.
            code = at if kind != "DOC" else _CODE_LINE.search(text, m.end())
            if code is not None:
                code = code if isinstance(code, int) else code.end() - 1
                width = len(text[text.rfind("\n", 0, code) + 1 : code].expandtabs(8))
                while width < levels[-1]:
                    levels.pop()
                    out.append(Token("DE", at, at))
                if width > levels[-1]:
                    levels.append(width)
                    out.append(Token("IN", at, at))
                fresh = kind == "DOC"
        if kind == "WORD":
            kind = "DEF" if m.group() == "def" else "MOD" if m.group() == "async" else "NAME"
        elif kind == "MARK":
            kind = m.group()
        out.append(Token(kind, at, m.end()))
    return out + [Token("DE", len(text), len(text))] * (len(levels) - 1) + [Token("END", len(text), len(text))]


_ATOMS = ("NAME", "STR", "NUM", "OP", "ARROW", ":", ",", "DOC", "MOD")
_ONE = lambda *kinds: [(k,) for k in kinds]
#: A statement ends at a line end or a semicolon; a function may begin only where a statement does.
BRACE_GRAMMAR = {
    "File": [("END",), ("Sep", "File"), ("Function", "File"), ("Piece", "FileMid")],
    "FileMid": [("END",), ("Sep", "File"), ("Piece", "FileMid")],
    "Sep": _ONE("NL", "GAP", ";"),
    "Function": [("Doc", "Declared"), ("Declared",)],
    "Doc": [("DOC",), ("DOC", "NL")],
    "Declared": [("Lead", "FUN", "Named", "Tail", "Block"), ("Lead", "FUN", "Group", "Named", "Tail", "Block"), ("Lead", "Named", "Tail", "Block")],
    "Lead": [(), ("LeadWord", "Lead")],
    "LeadWord": [("MOD",), ("NAME",), ("Square",), ("OP",), ("Note",), ("Note", "NL")],
    "Note": [("NOTE",), ("NOTE", "Group")],
    "Named": [("NAME", "Group"), ("MOD", "Group")],
    "Tail": [(), ("TailWord", "Tail")],
    "TailWord": [("NAME",), ("MOD",), (":",), (",",), ("OP",), ("Square",), ("Group",), ("NL",)],
    "Block": [("{", "Body")],
    "Body": [("}",), ("Sep", "Body"), ("Function", "Body"), ("Piece", "Mid")],
    "Mid": [("}",), ("Sep", "Body"), ("Piece", "Mid")],
    "Group": [("(", "Inner")],
    # A function may stand on a line of its own inside brackets, also where they were never closed.
    "Inner": [(")",), ("Piece", "Inner"), ("Sep", "Inner"), ("Sep", "Function", "Inner")],
    "Square": [("[", "Items")],
    "Items": [("]",), ("Piece", "Items"), ("Sep", "Items"), ("Sep", "Function", "Items")],
    "Piece": [("Group",), ("Square",), ("Block",), *_ONE(*_ATOMS, "CTRL", "FUN", "NOTE")],
}
LINE_GRAMMAR = {
    "File": [("END",), ("Sep", "File"), ("Function", "File"), ("Indented", "File"), ("Piece", "FileMid")],
    "FileMid": [("END",), ("Sep", "File"), ("Piece", "FileMid")],
    "Sep": _ONE("NL", "GAP", ";"),
    "Function": [("Doc", "Declared"), ("Declared",)],
    "Doc": [("DOC",), ("DOC", "NL")],
    "Declared": [("Decorator", "Declared"), ("DEF", "Named", "Result", ":", "Opening", "Described"), ("MOD", "DEF", "Named", "Result", ":", "Opening", "Described"), ("DEF", "Named", "Result", ":", "Piece"), ("MOD", "DEF", "Named", "Result", ":", "Piece")],
    "Decorator": [("DECO", "NAME", "NL"), ("DECO", "NAME", "Group", "NL")],
    "Named": [("NAME", "Group")],
    "Result": [(), ("ARROW", "Type")],
    "Type": [("TypePart",), ("TypePart", "Type")],
    "TypePart": [("NAME",), ("STR",), ("OP",), ("Square",)],
    # A head over several lines may end in a dedent of its own.
    "Opening": [("Sep", "Opening"), ("Remark", "Opening"), ("IN",), ("DE", "Opening")],
    "Remark": [("DOC",)],
    "Described": [("Docstring", "Sep", "Suite"), ("Docstring", "DE"), ("Remark", "Sep", "Described"), ("Suite",)],
    "Docstring": [("STR",)],
    "Suite": [("DE",), ("Sep", "Suite"), ("Function", "Suite"), ("Indented", "Suite"), ("Piece", "SuiteMid")],
    "SuiteMid": [("DE",), ("Sep", "Suite"), ("Piece", "SuiteMid")],
    "Group": [("(", "Inner")],
    "Inner": [(")",), ("Piece", "Inner"), ("Line", "Inner")],
    "Square": [("[", "Items")],
    "Items": [("]",), ("Piece", "Items"), ("Line", "Items")],
    "Curly": [("{", "Pairs")],
    "Pairs": [("}",), ("Piece", "Pairs"), ("Line", "Pairs")],
    "Line": _ONE("NL", "GAP", "DE", ";"),
    "Indented": [("IN", "Suite")],
    "Piece": [("Group",), ("Square",), ("Curly",), *_ONE(*_ATOMS, "DECO")],
}
#: Inside brackets an indent opens nothing; a function on a line of its own shows that they were never closed.
for _open in ("Inner", "Items", "Pairs"):
    LINE_GRAMMAR[_open] = [LINE_GRAMMAR[_open][0], *((*k, _open) for k in [("IN",), ("IN", "Function"), ("Line",), ("Line", "Function"), ("Group",), ("Square",), ("Curly",), *_ONE(*_ATOMS)])]
#: The head of one function and the string after it; what follows is not read.
HEAD_GRAMMAR = LINE_GRAMMAR | {
    "Unit": [("Head",), ("Head", "Opening", "Documented"), ("Head", "Docstring")],
    "Head": [("Lead", "DEF", "Named", "Result", ":")],
    "Lead": [(), ("DOC", "Lead"), ("MOD", "Lead"), ("Sep", "Lead"), ("IN", "Lead"), ("DECO", "NAME", "Lead"), ("DECO", "NAME", "Group", "Lead")],
    "Documented": [("Docstring", "After"), ("Remark", "Sep", "Documented"), ("Sep", "Documented")],
    "After": _ONE("NL", "GAP", "DE", "END", ";"),
}

#: The head of one function with braces.
BRACE_HEAD_GRAMMAR = BRACE_GRAMMAR | {
    "Unit": [("Before", "Lead", "FUN", "Named", "Tail", "{"), ("Before", "Lead", "FUN", "Group", "Named", "Tail", "{"), ("Before", "Lead", "Named", "Tail", "{")],
    "Before": [(), ("DOC", "Before"), ("Sep", "Before")],
}

_brace = Parser(BRACE_GRAMMAR, "File", (")", "]", "}"))
_lines = Parser(LINE_GRAMMAR, "File", (")", "]", "}", ":", "IN", "DE"))
_head = Parser(HEAD_GRAMMAR, "Unit", (")", "]", "}", ":"), skips=False)
_brace_head = Parser(BRACE_HEAD_GRAMMAR, "Unit", (")", "]", "}"), skips=False)
_DEF_LINE = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+[^\W\d]\w*[ \t]*\(", re.M)


class FoundFunction(NamedTuple):
    name: str
    start_line: int
    end_line: int
    signature: str
    doc: str
    body: str
    repairs: int


def functions_of(text: str) -> list[FoundFunction]:
    """Every function and method of a source text, nested ones too, in order; ``repairs`` counts what recovery did inside it."""
    by_lines = bool(_DEF_LINE.search(text))
    tokens, parser = (line_tokens(text), _lines) if by_lines else (brace_tokens(text), _brace)
    kinds = [t.kind for t in tokens]
    if not by_lines and "{" not in kinds:
        return []
    spans = parser.spans(kinds)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    out, taken = [], set()
    for (name, begin), ends in sorted((k, v) for k, v in spans.items() if k[0] == "Function" and v):
        repairs, end = min((cost, -end) for end, cost in ends.items())
        end = -end
        first = begin
        while kinds[first] in ("DOC", "NL"):
            first += 1
        named = min((b for (n, b), e in spans.items() if n == "Named" and first <= b < end and any(x <= end for x in e)), default=None)
        if named is None or named in taken:
            continue  # the same function without the comment or a part of the head before it
        taken.add(named)
        last = end - 1
        while last > first and kinds[last] in ("NL", "GAP", "DE", "END"):
            last -= 1
        opening = next((k for k in range(min(spans["Named", named]), end) if kinds[k] == ("{" if not by_lines else ":")), last)
        doc = "\n".join(text[tokens[k].begin : tokens[k].end] for k in range(begin, first) if kinds[k] == "DOC")
        body = text[tokens[first].begin : tokens[last].end]
        line_of = lambda at: bisect_right(starts, at)
        out.append(FoundFunction(text[tokens[named].begin : tokens[named].end], line_of(tokens[first].begin), line_of(tokens[last].end), text[tokens[first].begin : tokens[opening].begin].strip(), doc, body, repairs))
    return sorted(out, key=lambda f: (f.start_line, -f.end_line))


def brace_head(body: str) -> str:
    """The head of a function written with braces, over as many lines as it takes; empty where there is none."""
    tokens = brace_tokens(body)
    kinds = [t.kind for t in tokens]
    if "{" not in kinds or "(" not in kinds:
        return ""
    ends = _brace_head.spans(kinds, whole=False)["Unit", 0]
    if not ends:
        return ""
    return body[: tokens[min(ends.items(), key=lambda x: (x[1], x[0]))[0] - 1].begin]


def head_and_docstring(body: str) -> tuple[str, str]:
    """(head, documenting string with its quotes) of a function written with indentation; empty where there is none."""
    tokens = line_tokens(body)
    kinds = [t.kind for t in tokens]
    if "DEF" not in kinds:
        return "", ""
    spans = _head.spans(kinds, whole=False)
    heads = spans.get(("Head", 0))
    if not heads:
        return "", ""
    head = min(heads.items(), key=lambda x: (x[1], x[0]))[0]
    told = {end for end, cost in spans["Unit", 0].items() if cost == min(spans["Unit", 0].values())}
    strings = [b for (n, b), ends in spans.items() if n == "Docstring" and any(e <= max(told) for e in ends)]
    at = max(strings, default=None)
    return body[: tokens[head - 1].begin], body[tokens[at].begin : tokens[at].end] if at is not None else ""
