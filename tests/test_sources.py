"""Sources, streaming and the registry."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom import api
from strataloom.sources import code_parser, commit_log, config, decisions, embeddings, files, knowledge_files
from strataloom.streaming import ingest, ledger
from tests.conftest import rows


def test_python_parser():
    s, r = code_parser.parse_python("import os\nfrom a.b import c\n# says\ndef f(g):\n    g()\n    return h(1)\nclass K(Base):\n    def m(self):\n        f(2)\nrun()\n")
    assert [(x[0], x[1]) for x in s] == [("f", "function"), ("K", "class"), ("K::m", "method")]
    assert s[0][3] == "# says"
    found = {x[:3] for x in r}
    assert {("@file", "IMPORTS", "os"), ("@file", "IMPORTS", "a.b"), ("f", "CALLS", "h"), ("K", "EXTENDS", "Base"), ("K::m", "CALLS", "f"), ("@file", "CALLS", "run")} <= found
    assert ("f", "CALLS", "g") not in found


def test_script_parser():
    s, r = code_parser.parse_brackets("import x from './y.js';\n/** doc */\nfunction a(cb) { cb(); b('}'); new Box(); }\nclass K extends B implements I, J {\n  m(x) { this.n(x); }\n}\nconst g = (q) => { h(q); };\n", "ts")
    assert {(x[0], x[1]) for x in s} == {("a", "function"), ("K", "class"), ("K::m", "method"), ("g", "function")}
    found = {x[:3] for x in r}
    assert {("@file", "IMPORTS", "./y.js"), ("a", "CALLS", "b"), ("a", "INSTANTIATES", "Box"), ("K", "EXTENDS", "B"), ("K", "IMPLEMENTS", "I"), ("K::m", "CALLS", "n"), ("g", "CALLS", "h")} <= found
    assert ("a", "CALLS", "cb") not in found


def test_php_and_go_parsers():
    s, r = code_parser.parse_brackets("<?php\nnamespace App\\X;\nuse App\\Y;\nclass K extends B { public function m() { add_action('init', 'boot'); do_action('done'); } }\n", "php")
    assert {x[0] for x in s} == {"App\\X\\K", "App\\X\\K::m"}
    assert {("@file", "IMPORTS", "App\\Y"), ("App\\X\\K::m", "REGISTERS_HOOK", "hook:init"), ("App\\X\\K::m", "CALLS", "boot"), ("App\\X\\K::m", "FIRES_HOOK", "hook:done")} <= {x[:3] for x in r}
    s, r = code_parser.parse_brackets('import (\n "fmt"\n)\ntype T struct {\n a int\n}\nfunc (t *T) M(x int) {\n fmt.Println(x)\n y := T{}\n}\nfunc F() { g() }\n', "go")
    assert {x[0] for x in s} == {"T", "T::M", "F"} and {("@file", "IMPORTS", "fmt"), ("T::M", "INSTANTIATES", "T"), ("F", "CALLS", "g")} <= {x[:3] for x in r}


def test_data_and_markup_parsers():
    assert [x[0] for x in code_parser.parse_json('{"a": 1, "b": {"c": 2}}')] == ["a", "b"]
    assert [x[0] for x in code_parser.parse_markup('<div id="x"><p class="y z">t</p><b></b></div>')] == ["div#x", "p.y"]
    assert [x[0] for x in code_parser.parse_css("/* c */ .a, b { x: y }\n@media q { .c { d: e } }")] == [".a, b", "@media q", ".c"]
    assert [x[0] for x in code_parser.parse_xml("<a><!-- <no/> --><b:c d='e'/></a>")] == ["a", "b:c"]


def test_broken_files_are_quarantined(spark):
    f = spark.createDataFrame([(1, "python", "def ("), (2, "python", "def f(): pass"), (3, "json", "{"), (4, "none", "x"), (5, "js", None), (6, "js", "function f() {")], "id int, language string, content string")
    parsed = code_parser.parse_files(f)
    assert {r.file_id for r in code_parser.failed(parsed).collect()} == {1, 3}
    assert {r.file_id for r in code_parser.symbol_rows(parsed).collect()} == {2, 6}


LOG = "\x1e" + "\x1f".join(["a" * 40, "a" * 8, "Ann", "a@x.example", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00Z", "p1 p2", "fix: it\n\nbody\n1\t2\tnot a change\n"]) + "\x1d\n1\t2\tsrc/a\tb.py\n-\t-\timg.png\n" + "\x1e" + "broken" + "\x1e" + "\x1f".join(["b" * 40, "b" * 8, "Bo", "", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z", "", "add"]) + "\x1d"


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    got = {r.short_sha: r for r in commit_log.read_log(spark, f"file://{tmp_path}/log.txt").collect()}
    a, b = got["a" * 8], got["b" * 8]
    assert len(got) == 2 and a.is_merge and a.is_fix and a.subject == "fix: it" and (a.files_changed, a.insertions, a.deletions) == (2, 1, 2) and not b.is_merge and b.files == []
    assert [(x.path, x.is_binary) for x in a.files] == [("src/a\tb.py", False), ("img.png", True)]
    assert str(a.authored_at) == "2024-01-01 08:00:00"


def test_tree_scan(spark, tmp_path):
    for name, text in {"a/x.py": "one\ntwo", "a/y.txt": "no", "node_modules/z.js": "no", "b/skip.js": "no", "b/keep.js": "q\x00r", "README.md": "# t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in files.scan_tree(spark, str(tmp_path), "b/*.js\n!b/keep.js\n").collect()}
    assert set(got) == {"a/x.py", "b/keep.js", "README.md"} and got["a/x.py"].loc == 2 and got["b/keep.js"].content == "qr" and got["a/x.py"].language == "python"
    present = files.scan_tree(spark, str(tmp_path))
    known = present.filter("path <> 'a/x.py'").select("path", "hash")
    assert [r.path for r in files.to_process(present, known).collect()] == ["a/x.py"]


def test_version_changes_without_history_ask_for_a_full_scan(spark, tmp_path):
    assert files.version_changes(spark, str(tmp_path), None) is None


def test_config_precedence(tmp_path):
    (tmp_path / "strataloom.json").write_text(json.dumps({"module_depth": 3, "embedding_dim": 8}))
    (tmp_path / ".env").write_text("STRATALOOM_MODULE_DEPTH=4\n")
    c = config.load(str(tmp_path), {"STRATALOOM_COCHANGE_MIN_PAIR": "5"})
    assert (c.module_depth, c.embedding_dim, c.cochange_min_pair, c.cochange_max_files) == (4, 8, 5, 50)


def test_embeddings_heal_and_cache(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, None), (3, "x", [1.0])], "id int, t string, embedding array<float>")
    got = {r.id: r.embedding for r in embeddings.fill_missing(df, F.col("t"), embeddings.hashing_embedder).collect()}
    assert len(got[1]) == 64 and got[2] is None and got[3] == [1.0]
    calls = []
    cache = embeddings.QueryCache(lambda ts: calls.append(ts) or [[1.0]] if ts[0] != "bad" else 1 / 0, 2)
    assert cache("q") == cache("q") == [1.0] and len(calls) == 1
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            cache("bad")


def test_decision_patches_are_atomic(tmp_path, spark):
    g = decisions.new_graph("My Feature")
    assert g["slug"] == "my-feature"
    g = decisions.apply(g, [{"op": "add_node", "id": "a", "title": "A"}, {"op": "add_node", "id": "b", "title": "B", "parent": "a"}])
    for bad in ({"op": "reparent", "id": "a", "parent": "b"}, {"op": "remove_node", "id": "root"}, {"op": "select_answer", "id": "a", "value": "q"}, {"op": "set_risk", "id": "a", "value": "huge"}, {"op": "nope"}):
        with pytest.raises(decisions.PatchError):
            decisions.apply(g, [{"op": "set_title", "id": "a", "value": "changed"}, bad])
    assert g["nodes"]["a"]["title"] == "A"
    decisions.save(str(tmp_path), g)
    assert set(decisions.patch_file(str(tmp_path), "my-feature", [{"op": "remove_node", "id": "a"}])["nodes"]) == {"root"}
    assert decisions.read_nodes(spark, str(tmp_path)).count() == 1


def test_knowledge_files_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("k1", 'say "x": y', None, "high", "doc", 0.5, "active"), ("k2", "z", "a/**", "low", "doc", 0.4, "candidate"), ("k3", "r", None, "low", "doc", 0.4, "rejected")], knowledge_files.RULE_SCHEMA)
    memories = spark.createDataFrame([("m1", "c", "note", None, True, 1, None), ("m2", "d", "note", None, False, 2, 1)], knowledge_files.MEMORY_SCHEMA + ", memory_id bigint, supersedes bigint")
    knowledge_files.export(str(tmp_path), rules, memories)
    assert rows(knowledge_files.read_rules(spark, str(tmp_path))) == rows(rules.filter("state <> 'rejected'"))
    assert [r.memory_key for r in knowledge_files.read_memories(spark, str(tmp_path)).collect()] == ["m2"]


FEED = "run_id bigint, key string, version string, observed_at int, is_deleted boolean, value string"


def test_ledger_survives_a_crash_and_rereads_open_runs(spark, tmp_path):
    feed = spark.createDataFrame([(1, "a", "1", 1, False, "x"), (1, "b", "1", 1, False, "y"), (2, "a", "2", 2, False, "z"), (2, "c", "1", 2, False, "w"), (3, "b", "2", 3, True, None), (3, "a", "2", 3, False, "z")], FEED)
    runs = ledger.IncrementalRuns(spark, f"file://{tmp_path}/l")
    seen = []

    def work(df):
        out = df.select("key", "value")
        seen.append(sorted(r.key for r in out.collect()))
        return out

    assert runs.run(feed, 1, None, work)
    with pytest.raises(ZeroDivisionError):
        runs.run(feed, 2, None, lambda df: 1 / 0)
    assert runs.run(feed, 2, 2, work) and not runs.run(feed, 2, None, work)
    assert runs.run(feed, 3, None, work)
    assert seen == [["a", "b"], ["a", "c"], []]
    assert rows(runs.store.read("output")) == [("a", "x"), ("a", "z"), ("b", "y"), ("c", "w")]
    assert rows(runs.current().select("key", "version")) == [("a", "2"), ("c", "1")]
    assert len(runs.store.manifest()["output"]["parts"]) == 3


def test_ledger_counts_a_version_that_comes_back_and_orders_by_time(spark, tmp_path):
    """aaa, bbb, aaa ends at aaa; of two waiting versions the one observed last counts; a late older one does not."""
    feed = spark.createDataFrame([(1, "f", "aaa", 1, False, ""), (2, "f", "bbb", 2, False, ""), (3, "f", "aaa", 3, False, ""), (4, "g", "zzz", 4, None, ""), (4, "g", "abc", 5, False, ""), (5, "g", "old", 3, False, ""), (5, None, "x", 5, False, ""), (5, "h", "x", None, False, "")], FEED)
    runs = ledger.IncrementalRuns(spark, f"file://{tmp_path}/l", fold_after=2)
    got = []
    for k in range(1, 6):
        runs.run(feed, k, None, lambda df: (got.append(sorted(tuple(r) for r in df.select("key", "version").collect())), df)[1])
    assert got == [[("f", "aaa")], [("f", "bbb")], [("f", "aaa")], [("g", "abc")], []]
    assert rows(runs.current().select("key", "version")) == [("f", "aaa"), ("g", "abc")]
    assert len(runs.store.manifest()["state"]["parts"]) <= 2 and runs.store.read("ledger").count() == 0


def test_ledger_removes_the_overlap_of_an_open_run_and_reads_nothing_older(spark, tmp_path):
    a, b = [(1, "a", "1", 1, False, ""), (3, "b", "1", 3, False, "")], [(2, "c", "1", 2, False, "")]
    runs = ledger.IncrementalRuns(spark, f"file://{tmp_path}/l")
    seen = []
    work = lambda df: (seen.append(sorted(r.key for r in df.collect())), df)[1]
    assert runs.run(spark.createDataFrame(a, FEED), 3, 2, work)  # run 2 is still open
    later = spark.createDataFrame([(1, "q", "1", 1, False, ""), *a, *b, (4, "b", "1", 3, False, "")], FEED)
    assert runs.run(later, 4, None, work)
    assert seen == [["a", "b"], ["c"]]  # b is not repeated, c not skipped, run 1 not read again
    plan = runs._rows(later, 9, runs.marks()[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "run_id" in plan and ">= 5" in plan


def test_two_writers_of_one_manifest(spark, tmp_path):
    from strataloom.operators.store import Snapshots

    s = Snapshots(spark, f"file://{tmp_path}/s")
    s.commit("t", spark.range(2))
    read, state = s._load()
    s.append("t", spark.range(3))
    with pytest.raises(RuntimeError):
        s._move(read, state)
    assert s.read("t").count() == 5 and s.manifest()["t"]["rows"] == 5
    s.commit("t", spark.range(1))
    Snapshots.KEEP, kept = 1, Snapshots.KEEP
    try:
        s.commit("u", spark.range(1))
        assert s.vacuum() == 2 and s.read("t").count() == 1
    finally:
        Snapshots.KEEP = kept


def test_stream_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    for _ in range(2):
        df.write.mode("append").parquet(f"file://{tmp_path}/feed")
        stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/feed")
        ingest.ingest(stream, spark, f"file://{tmp_path}/state", "t", ["k"], "n", f"file://{tmp_path}/cp").awaitTermination()
    from strataloom.operators.store import Snapshots

    assert rows(Snapshots(spark, f"file://{tmp_path}/state").read("t").select("k", "v")) == [("a", "y"), ("b", "z")]


def test_registry_validates_arguments():
    op = api.find("search")
    assert op.name == "search_code" and op.required == ["query"]
    assert op.validate({"query": "x", "limit": "5"}) == {"query": "x", "limit": 5}
    for bad in ({}, {"query": "x", "limit": 99}, {"query": "x", "nope": 1}, {"query": "x", "limit": "z"}):
        with pytest.raises(api.ArgumentError):
            op.validate(bad)
    assert api.parse_argv("history", ["src/a", "--limit", "7"]) == {"target": "src/a", "limit": 7}
    assert len(api.OPERATIONS) == 24


def test_core_imports_nothing_of_the_optional_subpackage():
    import pathlib

    root = pathlib.Path(api.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "strataloom.llm" not in p.read_text()


def test_queries_run_on_the_smallest_tables(spark, small_data):
    from strataloom.plans import registry

    for name in ("list_projects", "p3_found", "hybrid_search_rrf", "module_metrics_risk", "compose_context"):
        assert registry.queries()[name](spark, small_data).count() > 0, name
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_operations_answer_over_the_tables(spark, small_data):
    for name, args in (("list_projects", {}), ("search_code", {"query": "cache"}), ("get_modules", {}), ("who_owns", {}), ("get_history", {"target": "src"}), ("get_cochange", {"target": "src"}), ("get_bug_clusters", {}), ("project_overview", {}), ("get_file_outline", {"path": "src"})):
        api.call(spark, small_data, name, args).count()
    with pytest.raises(api.UnknownTarget):
        api.call(spark, small_data, "get_callers", {"name": "no_such_symbol_at_all"})


def test_vectors_are_used_only_with_their_embedder(spark, small_data):
    asked = {"query": "cache", "limit": 5}
    plain = {s for r in api.call(spark, small_data, "search_code", asked).collect() for s in r.sources}
    assert plain == {"fts"}
    vector = {s for r in api.call(spark, small_data, "search_code", asked, embedder=lambda texts: [[1.0] * 64 for _ in texts]).collect() for s in r.sources}
    assert "vector" in vector


def test_what_is_written_outlives_the_catalog(spark, small_data, tmp_path):
    store = f"file://{tmp_path}/kept"
    with pytest.raises(api.ArgumentError):
        api.call(spark, small_data, "remember", {"content": "x"})
    api.call(spark, small_data, "remember", {"content": "keep the cache small"}, store=store)
    assert [r.content for r in api.call(spark, small_data, "recall", {"query": "cache"}, store=store).collect()] == ["keep the cache small"]
    assert {r.item[:4] for r in api.call(spark, small_data, "search_knowledge", {"query": "keep small"}, store=store).collect()} == {"mem:"}
    rules = api.mine_rules(spark, small_data, store)
    some = rules.orderBy("rule_key").limit(2).collect()
    assert rules.count() == api.mine_rules(spark, small_data, store).count() > 2
    decided = spark.createDataFrame([(some[0].rule_key, "active", "ann", None), (some[1].rule_key, "rejected", "ann", None)], "rule_key string, state string, verified_by string, verified_at timestamp")
    api.decide_rules(spark, store, decided)
    assert [r.statement for r in api.call(spark, small_data, "get_rules", {}, store=store).collect()] == [some[0].statement]
    got = api.call(spark, small_data, "compose_context", {"task": "keep the cache", "budget": 500, "deadline": 120.0}, store=store).collect()
    assert {"rule", "commit"} <= {r.type for r in got} and all(r.tokens_after <= 500 or r.type == "rule" for r in got if r.taken)
    assert api.call(spark, small_data, "compose_context", {"task": "keep the cache", "format": "markdown"}, store=store).first().markdown.startswith("# Context: keep the cache")


def test_index_follows_the_tree(spark, small_data, tmp_path):
    tree, store = tmp_path / "tree", f"file://{tmp_path}/index"
    (tree / "src").mkdir(parents=True)
    (tree / "src" / "a.py").write_text("def f(x):\n    return g(x)\n")
    (tree / "src" / "b.py").write_text("def g(x):\n    return x\n")
    (tree / "readme.md").write_text("# Tree\n\nWords about it.\n")
    run = lambda: api.call(spark, small_data, "index_project", {"path": str(tree), "store": store}).first().asDict()
    first = run()
    assert (first["files"], first["symbols"], first["chunks"]) == (3, 2, 1) and first["relations"] >= 1 and run() == first
    (tree / "src" / "a.py").write_text("def f(x):\n    return 1\n\ndef h():\n    return f(2)\n")
    (tree / "src" / "b.py").unlink()
    second = run()
    assert (second["files"], second["symbols"], second["chunks"]) == (2, 2, 1)


def test_state_of_a_project(spark, tmp_path):
    from strataloom.operators import lifecycle
    from strataloom.operators.store import Snapshots

    s = Snapshots(spark, f"file://{tmp_path}/s")
    s.commit("files", spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, path string"))
    lifecycle.append_usage(s, spark.createDataFrame([(1, "p", "m", 5), (2, "p", "m", 0), (2, "p", "m", 7)], "project_id int, provider string, model string, tokens int"))
    assert lifecycle.delete_project(s, 1) == {"files": 1, "usage": 0}
    assert rows(s.read("files")) == [(2, "b")] and sorted(r.project_id or 0 for r in s.read("usage").collect()) == [0, 2]
    steps = [("one", lambda st: st.commit("t", spark.range(1))), ("two", lambda st: st.append("t", spark.range(2)))]
    assert lifecycle.migrate(s, steps[:1]) == ["one"] and lifecycle.migrate(s, steps) == ["two"] and lifecycle.migrate(s, steps) == [] and s.read("t").count() == 3
    kinds = [("m", lambda: spark.range(3)), ("bad", lambda: 1 / 0), ("n", lambda: spark.range(1))]
    assert lifecycle.derive_all(s, kinds, "w1") == {"m": "derived", "bad": "failed: ZeroDivisionError", "n": "derived"}
    assert lifecycle.derive_all(s, kinds, "w1") == {"m": "unchanged", "bad": "failed: ZeroDivisionError", "n": "unchanged"} and "bad" not in s.manifest()
