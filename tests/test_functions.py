"""Truth tables of the scalar functions and folds."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import documents as docs
from strataloom.functions import messages, ranking, text, vectors
from tests.conftest import rows

FIXES = [
    ("fix: a null", True), ("Fix a crash", True), ("fixes the login", True), ("Name Other - fix: text", True), ("[web] fixed it", True), ("ABC-12 hotfix for it", True), ("bugfix(api): retry", True),
    ("feat: join past fixes", False), ("refactor: fix naming", False), ("prefix the key", False), ("", False), (None, False), ("regression in search", True), ("docs: mention the fix", False),
]


def test_fix_classifier(spark):
    df = spark.createDataFrame(FIXES, "s string, want boolean")
    assert [r for r in df.select("s", "want", messages.is_fix(F.col("s")).alias("got")).collect() if r.want != r.got] == []


def test_revert_classifier(spark):
    df = spark.createDataFrame([("Revert \"x\"", None, True), ("add", "text\nThis reverts commit abc.", True), ("irreverent", None, False), (None, None, False)], "s string, b string, want boolean")
    assert all(r.want == r.got for r in df.select("want", messages.is_revert(F.col("s"), F.col("b")).alias("got")).collect())


def test_issue_refs_prefer_closing_and_keep_urls(spark):
    df = spark.createDataFrame([(1, "see #5 then fixes #5, closes: AB-7, UTF-8, SHA-256, https://x.example/browse/CD-9 and a#6 b/#7"), (2, None), (3, "https://github.com/o/r/pull/44 resolves #44")], "id int, m string")
    got = {(r.id, r.tracker, r.issue): (r.relation, r.url) for r in messages.issue_refs(df, "id", "m").collect()}
    assert got[1, "github", "5"] == ("FIXES", None)
    assert got[1, "jira", "AB-7"][0] == "FIXES"
    assert got[1, "jira", "CD-9"] == ("REFERENCES", "https://x.example/browse/CD-9")
    assert got[3, "github", "44"] == ("FIXES", "https://github.com/o/r/pull/44")
    assert len(got) == 4


def test_person_key(spark):
    df = spark.createDataFrame([("A", " A@X.example "), ("Bo", ""), (None, None)], "n string, e string")
    assert [r[0] for r in df.select(messages.person_key(F.col("n"), F.col("e"))).collect()] == ["a@x.example", "name:bo", "name:unknown"]


def test_tokens_and_slug(spark):
    df = spark.createDataFrame([("The fix_it of 12 ÄÖ caches, 345",)], "t string")
    r = df.select(text.tokens(F.col("t")).alias("a"), text.cluster_tokens(F.col("t")).alias("b"), text.slug(F.col("t")).alias("c")).first()
    assert r.a == ["the", "fix_it", "of", "12", "caches", "345"]
    assert r.b == ["fix_it", "caches"]
    assert r.c == "the-fix-it-of-12-caches-345"


@pytest.mark.parametrize(
    ("paths", "scope"),
    [(["a/b/c.py", "a/b/d/e.py"], "a/b/**"), (["a/x.py"], "a/x.py"), (["a/x.py", "b/y.py"], None), ([], None), (["x.py", "y.py"], None), (["a/b/c.py", None, "a/q.py"], "a/**")],
)
def test_common_scope(spark, paths, scope):
    df = spark.createDataFrame([(paths,)], "p array<string>")
    assert df.select(text.common_scope(F.col("p"))).first()[0] == scope


@pytest.mark.parametrize(("path", "depth", "module"), [("a/b/c/d.py", 2, "a/b"), ("a/x.py", 2, "a"), ("x.py", 2, "."), ("a/b/c.py", 0, "a"), ("a/b/c.py", 5, "a/b")])
def test_module_path(spark, path, depth, module):
    assert spark.range(1).select(text.module_path(F.lit(path), depth)).first()[0] == module


@pytest.mark.parametrize(("glob", "path", "hit"), [("src/**", "src/a/b.py", True), ("src/*.py", "src/a/b.py", False), ("**/x.py", "x.py", True), ("a?.py", "ab.py", True), ("*.{js,ts}", "m.ts", True), ("a.py", "axpy", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(text.path_in_scope(F.lit(path), glob)).first()[0] is hit


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0]


def test_usable_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0],), ([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, None],), (None,), ([0.0, 2.0],)], "a array<float>")
    assert [r[0] is not None for r in df.select(vectors.usable(F.col("a"), 2)).collect()] == [False] * 6 + [True]


def test_fusion_and_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "x")], "source string, rank int, id string")
    got = ranking.with_rank(ranking.reciprocal_ranks(df, []), [], F.col("score").desc(), F.col("id")).orderBy("rank").collect()
    assert [(r.id, r.sources) for r in got] == [("x", ["a", "b"]), ("y", ["a", "b"])]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_pack_skips_what_is_too_large_and_keeps_pinned(spark):
    df = spark.createDataFrame([(1, "p", 80, 1, True), (1, "a", 30, 1, False), (1, "b", 15, 2, False), (1, "c", 5, 3, False)], "q int, key string, cost int, rank int, pinned boolean")
    got = {r.key: (r.taken, r.tokens_after) for r in ranking.pack(df, ["q"], 100).collect()}
    assert got == {"p": (True, 80), "a": (False, 80), "b": (True, 95), "c": (True, 100)}


MD = "# One\n\nintro\n\n## Two\n\n```\n# no heading\n```\n\n### Three\nshort\n"


def test_sections_are_fence_aware():
    assert [(a, b, c) for a, b, c, _ in docs.sections(MD)] == [(1, "One", "One"), (2, "Two", "One > Two"), (3, "Three", "One > Two > Three")]


def test_chunks_merge_small_and_carry_bare_headings():
    got = docs.chunks("# Title\n\n## Context\n\nwords here\n\n### Sub\n\nmore\n")
    assert len(got) == 1 and got[0][1] == "Title > Context" and got[0][2].startswith("# Title")
    assert [c[1] for c in docs.chunks("## A\ntext\n## B\ntext")] == ["A", "B"]
    assert docs.chunks("") == [] and docs.chunks("# only") [0][2] == "# only"


def test_chunks_lose_nothing_and_respect_the_cap():
    long = "## Big\n\n" + "\n\n".join("w" * 900 for _ in range(40)) + "\n\n" + "z" * 20000
    got = docs.chunks(long)
    assert all(len(c[2]) <= docs.HARD_CAP for c in got)
    assert sum(c[2].count("w") for c in got) == 36000 and sum(c[2].count("z") for c in got) == 20000


SENTENCES = [
    ("Never edit an applied migration.", [("Never edit an applied migration", 0.65)]), ("The ids are never reused by anyone.", []), ("You must run the tests before pushing.", [("You must run the tests before pushing", 0.6)]), ("Should we never do this thing?", []),
    ("Prefer small commits over large ones.", [("Prefer small commits over large ones", 0.5)]), ("Add a new file — never edit the old one.", [("Add a new file — never edit the old one", 0.65)]), ("must be short", []), ("```\nNever do this in code here.\n```", []), ("We should always test with the", []),
    ("# Never in a heading line\n| never in a table row |", []), ("- always sort the keys first\n- and then", [("always sort the keys first", 0.6)]),
]


def test_normative_sentences(spark):
    df = spark.createDataFrame(list(enumerate(s for s, _ in SENTENCES)), "doc_id bigint, text string")
    got = [(r.doc_id, (r.sentence, r.confidence)) for r in docs.rule_sentences(df).collect()]
    assert got == [(k, w) for k, (_, want) in enumerate(SENTENCES) for w in want]
    long = spark.createDataFrame([(1, "```\n" + "Never run this here.\n" * 50000), (2, "Word " * 100000 + "must stop now here. You must end it now.")], "doc_id bigint, text string")
    assert [r.sentence for r in docs.rule_sentences(long).collect()] == ["You must end it now"]


def test_front_matter_and_records():
    meta, body = docs.front_matter("---\ntags: [a, 'b']\nlist:\n  - x\n  - y\nstatus: accepted\n---\n## Context\nwhy\n## Decision\nwhat\n")
    assert meta == {"tags": ["a", "b"], "list": ["x", "y"], "status": ["accepted"]}
    assert body.startswith("## Context")
    assert docs.record_parts("## Context\nwhy\n## Decision\nwhat") == {"status": None, "context": "why", "decision": "what", "consequences": None}
    assert docs.record_parts("nothing") is None


def test_mentions():
    assert docs.mentions("see `src/a.py`, src/b.js. and `Foo::bar` or `two words`\n```\nlib/c.py\n```\nhttps://x.example/d/e.md") == (["src/a.py", "src/b.js"], ["Foo::bar"]) or docs.mentions("see `src/a.py` `Foo::bar`") == (["src/a.py"], ["Foo::bar"])


@pytest.mark.parametrize(("path", "kind"), [("docs/adr/x.md", "adr"), ("0001-use.md", "adr"), ("README.md", "readme"), ("CHANGELOG", "changelog"), ("contributing.md", "contributing"), ("docs/a.md", "guide"), ("notes/a.md", "note")])
def test_doc_type(spark, path, kind):
    assert spark.range(1).select(docs.doc_type(F.lit(path))).first()[0] == kind


def test_document_rows_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Never skip the tests here.")], "doc_id bigint, text string")
    assert rows(docs.rule_sentences(df)) == [(3, "Never skip the tests here", 0.65, "never")]
    assert docs.chunk_rows(df).count() == 1
