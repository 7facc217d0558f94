"""Functions with their documentation: truth tables, broken files, the parser itself."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import code_docs, gll
from tests.conftest import rows

SCHEMA = "id bigint, name string, kind string, signature string, doc string, body string, symbol_id int, description string"
NO = [
    "", "  ", "/** */", "// ====", "# TODO", "/** FIXME */", "// @todo", "/**\n * Load cache.\n */", "# load_cache()", "/** loadCache function */", "// This function will load cache.", "/** @param key */", "/**\n * @param key the key\n * @return void\n */",
    "// eslint-disable-next-line no-unused-vars", "# type: ignore", "// Copyright (c) Firm. All rights reserved.\n// Licensed under the Open Licence 2.0.", "/** {@inheritdoc} */", "/** @see parent */", "// See parent.", "// Created on 2021-03-13", "# Last change: 03/2022", "// --- Getters ---",
    "// load(cache, 4)\n// return cache", "// if (cache > 3) { load(); }", "# region helpers", "/** Description here. */", "// Loads the cache.", "/** Cache loadter */", "// @author web team", "# noqa", "/** N/A */", "// https://x.example/docs", "This file is part of the X distribution.\nIt comes WITHOUT ANY WARRANTY; see COPYING.",
]
YES = [
    "/** Evicts stale entries once the budget is spent. */", "// Returns the entry or nothing when the disk is slow.", "/**\n * @param key\n * @return the oldest entry that survives a restart\n */", "# Strips the licence header before hashing.", "// Collects TODO notes of the tree and orders them by age.", "/**\n * @deprecated Prefer the bulk reader for large trees.\n */",
    "# Der Index prüft die älteren Einträge über Nacht.", "// 規則は静かに次の処理を並べ替える。", "/**\n * TODO\n *\n * Waits for the writer to finish first.\n */", "/** O(n) in the number of stale rows. */", "<p>Rejects keys from foreign shards.</p>",
]


@pytest.mark.parametrize("doc", NO)
def test_says_nothing(doc):
    assert code_docs.describe("loadCache", "function loadCache(key)", doc, "function loadCache(key) {}") is None


@pytest.mark.parametrize("doc", YES)
def test_says_something(doc):
    assert code_docs.describe("loadCache", "function loadCache(key)", doc, "function loadCache(key) {}") is not None


@pytest.mark.parametrize(
    ("body", "inside"),
    [
        ('def f(a):\n    """Waits for the slow writer first."""\n    return a', True), ("def f(\n    a,\n    b=(1, 2),\n):\n    r'''\n    Waits for the slow writer first.\n    '''\n", True), ('def f(a):\n    """TODO"""\n    x = 1', False), ('def f(a):\n    x = 1\n    """Waits for the slow writer first."""', False),
        ('def f(a):\n    """Waits for the slow writer first.', True), ('@wraps\ndef f(a):\n\n    # note\n    """Waits for the slow writer first."""', True), ("function f() { return 'Waits for the slow writer first.' }", False), ('def f(a: "Waits for the slow writer"):\n    return 1', False), ("def f(a:\n    'Waits for the slow writer first.'\n", False),
        ("def f(a):\n    'Waits for the slow writer first.'\n    return 1", True),
    ],
)
def test_descriptions_inside_bodies_also_of_broken_files(body, inside):
    found = code_docs.describe("f", None, None, body)
    assert (found is not None and found[1]) is inside


def test_nulls_repeats_and_clashing_columns(spark):
    said = "// Waits for the slow writer first."
    df = spark.createDataFrame(
        [(1, "f", "function", None, said, "f() {}", 1, "x"), (1, "f", "function", None, said, "f() {}", 1, "x"), (2, None, "method", None, said, "g() {}", 1, None), (3, "f", "class", None, said, "x", 1, None), (4, "f", "function", "s", said, " \n", 1, None), (5, "f", "function", None, None, None, 1, None), (None, "f", "function", None, said, "f() {}", 1, None), (6, "f", None, None, said, "f()", 1, None)],
        SCHEMA,
    )
    assert rows(code_docs.pairs_with_documentation(df).select("symbol_id")) == [(1,), (1,), (2,)]
    assert code_docs.pairs_with_documentation(df.limit(0)).count() == 0


def test_templates_of_the_corpus_are_dropped(spark):
    n = code_docs.TEMPLATE_NAMES
    # A template of any length goes where its share of the names is large, not where its count is.
    long = "Legacy glue layer kept for the printers of the old harbour office"
    letters = "abcdefghijklmnopqrst"
    unlike = lambda i: "".join(letters[i // 20**k % 20] * 3 for k in range(4))
    many = spark.createDataFrame([(i, f"q{i}", "function", None, f"// {long}" if i < 6 else f"// Moors boat {unlike(i)} here", "x() {}", 0, "") for i in range(7000)], SCHEMA)
    assert code_docs.pairs_with_documentation(many).count() == 7000 and code_docs.pairs_with_documentation(many.filter("id < 3000")).count() == 2994
    df = spark.createDataFrame([(i, f"fn{chr(97 + i // 26)}{chr(97 + i % 26)}", "function", None, "// Legacy glue layer", "x() {}", 0, "") for i in range(n)] + [(900, "other", "function", None, "// Legacy glue for printers", "x() {}", 0, "")], SCHEMA)
    assert rows(code_docs.pairs_with_documentation(df).select("symbol_id")) == [(900,)]
    assert code_docs.pairs_with_documentation(df.filter(df.id < n - 1)).count() == n - 1


def test_very_long_texts():
    long = "/**\n" + " * \n" * 3000 + " * Waits for the slow writer first.\n */"
    assert code_docs.describe("f", None, long, "x") is not None
    assert code_docs.describe("f", None, "(" * 20000, "def f(:\n" + "    x(\n" * 3000) is None


def test_gll_handles_ambiguity_left_recursion_and_cycles():
    p = gll.Parser({"S": [("S", "S"), ("a",), ()]}, "S")
    assert 4 in p.spans(["a"] * 4)["S", 0]
    p = gll.Parser({"E": [("E", "+", "E"), ("n",)]}, "E")
    assert set(p.spans(["n", "+", "n", "+", "n"])["E", 0]) == {1, 3, 5}
    p = gll.Parser({"A": [("B",)], "B": [("A",), ("x",)]}, "A")
    assert 1 in p.spans(["x"])["A", 0]


def _matches(grammar, symbol, text, depth=0):
    """All ends of ``symbol`` from 0 by exhaustive expansion (for grammars without left recursion)."""
    if symbol not in grammar:
        return {1} if text[:1] == [symbol] else set()
    out = set()
    for body in grammar[symbol]:
        ends = {0}
        for s in body:
            ends = {e + k for e in ends for k in _matches(grammar, s, text[e:], depth + 1)}
        out |= ends
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6))
def test_gll_against_exhaustive_expansion(text):
    grammar = {"S": [("a", "S", "b"), ("X", "X"), ()], "X": [("c",), ("a", "X"), ()]}
    got = {end for end, cost in gll.Parser(grammar, "S").spans(text)["S", 0].items() if not cost}
    want = _matches(grammar, "S", text)
    assert got <= want and (len(text) in got) is (len(text) in want)


def test_gll_recovers_where_the_parses_got_furthest():
    p = gll.Parser({"S": [("$",), ("E", "S")], "E": [("(", "I")], "I": [(")",), ("x", "I"), ("E", "I")]}, "S", (")",))
    cost = lambda text: p.spans([*text, "$"])["S", 0][len(text) + 1]
    assert [cost(x) for x in ("", "(x)", "((x)(x))", "(x", "((x", "(x))", "(y)", "(x)y(x)")] == [0, 0, 0, 1, 2, 1, 1, 1]
    assert ("E", 2) in p.spans(list("(x(x)"))


SOUND = {
    "js": ("/** Adds tides to the shore. */\nfunction add(a, b = {k: [1, (2)]}) {\n  return a;\n}\n", "class K {\n  // Weighs the load twice.\n  async weigh(q) {\n    for (const x of q) { go(x); }\n  }\n}\n"),
    "go": ("// Mixes the paints by hand.\nfunc (s *Box[T]) mix(a []int, b map[string]int) (int, error) {\n\tgo func() { x() }()\n\treturn nil\n}\n",),
    "java": ("class A {\n  /** Says the words aloud. */\n  @Override\n  public static Map<String, List<Integer>> say(List<String> a) throws X, Y {\n    if (check(a)) { return null; }\n  }\n}\n",),
    "php": ("/**\n * Puts a lid on the pot.\n */\npublic function put($a, array $b = [])\n{\n  return foo($a);\n}\n",),
    "py": ("@deco(1)\nasync def f(a: Dict[str, int] = {'x': (1, 2)},\n            *b, c=':') -> List[str]:\n    # remark\n    '''Waits for the slow writer.'''\n    return [a]\n", "class A:\n    # Holds the older door open.\n    def h(self,\n          x\n    ):\n        return 1\n"),
}
NAMES = {"add": "Adds tides", "weigh": "Weighs the load", "mix": "Mixes the paints", "say": "Says the words", "put": "Puts a lid", "f": "Waits for", "h": "Holds the older"}
BROKEN = {
    "js": ["function lost(x {\n  if (x) { y(;\n}\n", "function lost(x) {\n  if (x) {\n}\n", "}\n}\n", "foo(a]) ;\n", "lost([1, 2;\n"],
    "go": ["func lost(a int\n", "}\n", "func lost() {\n\tif x {\n}\n"],
    "java": ["class B { void lost( { }\n", "}\n"],
    "php": ["function lost($a {\n}\n"],
    "py": ["def lost(a, b:\n    return a\n\n", "x = [1, (2\n", "class L:\n        y = 1\n    z = 2\n", "def lost(a)\n    return a\n\n"],
}


@pytest.mark.parametrize("language", list(SOUND))
def test_sound_functions_of_broken_files(spark, language):
    """A planted defect before, after and between: every sound function is found with its comment and no repair."""
    parts = SOUND[language]
    want = [n for n in NAMES if any(f" {n}(" in p for p in parts)]
    texts = ["\n".join(parts)]
    for bad in BROKEN[language]:
        texts += [bad + "\n" + "\n".join(parts), "\n".join(parts) + "\n" + bad] + ["\n".join([parts[0], bad, *parts[1:]])] * (len(parts) > 1)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in code_docs.pairs_in_files(df).collect():
        if not r.repairs:
            got.setdefault(r.file_id, {})[r.name] = r.description
    for k, text in enumerate(texts):
        assert {n: got.get(k, {}).get(n, "")[: len(NAMES[n])] for n in want} == {n: NAMES[n] for n in want}, text


def test_pairs_in_files_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (None, SOUND["js"][0]), (4, SOUND["js"][0]), (4, SOUND["js"][0]), (5, "{" * 3000 + "\n" + SOUND["js"][0]), (6, "x(1);\n" * 4000)], "id int, content string")
    assert rows(code_docs.pairs_in_files(df).select("file_id", "name")) == [(4, "add"), (4, "add"), (5, "add")]
    assert code_docs.pairs_in_files(df.limit(0)).count() == 0
