"""Core operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import compose, derive, graph, history, identity, incremental, knowledge, search, store
from strataloom.operators.components import connected_components
from strataloom.session import clear_cuts, cut, release
from strataloom.streaming.ledger import IncrementalRuns
from tests.conftest import rows

T = lambda d, h=0: dt.datetime(2024, 1, d, h)
RUNS = "run_id bigint, project_id int, started_at timestamp_ntz, status string"
SCANS = "row_id bigint, run_id bigint, project_id int, path string, hash string, observed_at timestamp_ntz, is_deleted boolean, error string"
FILES = "project_id int, path string, hash string, updated_at timestamp_ntz"


def test_components(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "y"), ("a", "b"), (None, "q"), ("z", "z")], "src string, dst string")
    assert rows(connected_components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(399)] + [(1000 + i, 1001 + i) for i in range(150)], "src bigint, dst bigint")
    assert {(r.component, r.n) for r in connected_components(edges).groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 400), (1000, 151)}


def test_cut_tables_are_deleted_when_told(spark):
    a, b = cut(spark.range(3)), cut(spark.range(4))
    release(a)
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a._cut_path).count()
    clear_cuts(spark)
    with pytest.raises(Exception):
        spark.read.parquet(b._cut_path).count()


def brute_increment(runs, scans, files):
    """The definition, run by run."""
    out = []
    norm = lambda p: p.replace("\\", "/").removeprefix("./")
    for project in {r[1] for r in runs}:
        known = {norm(p): (h.lower() if h else None, at) for pr, p, h, at in files if pr == project}
        open_rows = []
        for run, _, _, status in sorted((r for r in runs if r[1] == project), key=lambda r: (r[2], r[0])):
            open_rows += [s for s in scans if s[1] == run]
            if status != "ok":
                continue
            last = {}
            for s in open_rows:
                if s[7] is None and s[3] is not None:
                    key = norm(s[3])
                    if key not in last or (s[5], s[0]) > (last[key][5], last[key][0]):
                        last[key] = s
            for path, s in last.items():
                h, at = known.get(path, (None, None))
                if at is not None and s[5] <= at:
                    continue
                new = None if s[6] else s[4].lower()
                if new is not None and new != h:
                    out.append((run, project, path))
                known[path] = (new, s[5])
            open_rows = []
    return sorted(out)


def test_increment_survives_failures_and_repeats(spark):
    runs = [(1, 1, T(1), "ok"), (2, 1, T(2), "failed"), (3, 1, T(3), "aborted"), (4, 1, T(4), "ok"), (5, 1, T(5), "failed"), (6, 2, T(1), "ok")]
    scans = [
        (1, 1, 1, "./a", "H1", T(1, 1), False, None), (2, 1, 1, "b", "h2", T(1, 1), False, None), (3, 2, 1, "a", "h3", T(2, 1), False, None), (4, 2, 1, "c", "h4", T(2, 1), False, None), (5, 3, 1, "c", None, T(3, 1), True, None),
        (6, 4, 1, "a", "h1", T(1, 1), False, None), (7, 4, 1, "d\\e", "h5", T(4, 1), False, None), (8, 4, 1, "b", None, T(4, 1), False, "timeout"), (9, 5, 1, "z", "h9", T(5, 1), False, None), (10, 6, 2, "q", "h1", T(1, 1), False, None), (11, 6, 2, "q", "h1", T(1, 1), None, None),
        (12, 1, 1, None, "h", T(1, 1), False, None),
    ]
    files = [(1, "a", "h1", None), (1, "b", "h2", T(1)), (2, "q", None, T(2))]
    got = rows(incremental.files_to_process(spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)))
    assert got == brute_increment(runs, scans, files) == [(4, 1, "a"), (4, 1, "d/e")]


def test_increment_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    runs = [(p * 10 + k, p, T(1 + k), rnd.choice(["ok", "ok", "failed", "aborted"])) for p in (1, 2, 3) for k in range(7)]
    scans = []
    for n in range(400):
        run = rnd.choice(runs)
        gone = rnd.random() < 0.15
        scans.append((n, run[0], run[1], rnd.choice(["", "./"]) + rnd.choice("abcdefgh"), None if gone else rnd.choice(["h1", "H1", "h2", "h3"]), T(rnd.randint(1, 8), rnd.randint(0, 20)), gone, "x" if rnd.random() < 0.1 and not gone else None))
    files = [(p, c, rnd.choice(["h1", "h2", None]), rnd.choice([T(1, 5), None, T(3)])) for p in (1, 2, 3) for c in "abcde"]
    got = rows(incremental.files_to_process(spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)))
    assert got == brute_increment(runs, scans, files)


def test_increment_run_by_run_equals_one_plan(spark, tmp_path):
    """The feed advanced by recorded runs, with failures between, gives what the one plan gives."""
    rnd = random.Random(9)
    runs = [(k, 1, T(k), status) for k, status in enumerate(["ok", "failed", "aborted", "ok", "ok", "failed", "ok"], 1)]
    drawn = {}  # within a run the larger row id wins at one instant, so ties are left out here
    for n in range(120):
        r = rnd.randint(1, 7)
        s = (n, r, 1, rnd.choice("abcdef"), rnd.choice(["h1", "h2", "h3"]), T(r, rnd.randint(0, 20)), rnd.random() < 0.15, None)
        drawn.setdefault((s[3], s[5]), s)
    scans = list(drawn.values())
    want = rows(incremental.files_to_process(spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS), spark.createDataFrame([], FILES)))
    runner, got, feed = IncrementalRuns(spark, f"file://{tmp_path}/l", ("path",), fold_after=2), [], [(s[1], s[3], s[4], s[5], s[6]) for s in scans]
    source = spark.createDataFrame(feed, "run_id bigint, path string, version string, observed_at timestamp_ntz, is_deleted boolean")
    for run, _, _, status in runs:
        if status == "ok":
            runner.run(source, run, None, lambda df, run=run: (got.extend((run, 1, r.path) for r in df.collect()), df)[1])
    assert sorted(got) == want


def test_increment_of_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s + ", extra string")
    assert incremental.files_to_process(empty(SCANS), empty(RUNS), empty(FILES)).count() == 0


SYMBOLS = "id bigint, project_id int, file_id int, name string, kind string, signature string, doc string, start_line int, end_line int, body string"


def test_call_edges_and_resolution(spark):
    s = spark.createDataFrame(
        [(1, 1, 1, "run", "function", None, None, 1, 2, "function run() { new Box(); help(x); if (a) {} run(); help(y) }"), (2, 1, 1, "Box", "class", None, None, 3, 4, None), (3, 1, 2, "Tool::help", "method", None, None, 1, 2, "x"), (4, 1, 2, "App\\far", "function", None, None, 5, 6, "far2(); far()")], SYMBOLS
    )
    edges = graph.call_edges(s)
    assert rows(edges.select("src", "dst_name", "relation")) == [(1, "Box", "INSTANTIATES"), (1, "help", "CALLS"), (4, "far", "CALLS"), (4, "far2", "CALLS")]
    assert rows(graph.resolve_edges(edges, s).select("src", "dst_name", "dst")) == [(1, "Box", 2), (1, "help", 3), (4, "far", 4), (4, "far2", None)]


def test_subgraph_caps_and_depth(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 6)] + [(9, 1)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "seed bigint")
    assert rows(graph.subgraph(e, seeds, 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 9, 1)]
    assert graph.subgraph(e, seeds, 4, cap=3).count() == 3


def test_unknown_target_raises(spark):
    with pytest.raises(graph.UnknownTarget):
        graph.require(spark.createDataFrame([], "a int"), "nothing")


def test_decay_and_risk(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(history.decay(F.lit(180.0))) == pytest.approx(0.5)
    assert value(history.decay(F.lit(-5.0))) == 1.0 and value(history.decay(F.lit(50.0), 0)) == 1.0
    risk = lambda c, d, m, f: value(derive.risk_score(F.lit(c), F.lit(d), F.lit(m), F.lit(f)))
    assert risk(10.0, 1.0, 10.0, True) == 100 and risk(10.0, 0.25, 40.0, True) == pytest.approx(25) and risk(10.0, 0.0, 40.0, False) == 25 and risk(0.0, 0.0, 0.0, True) == 0 and risk(10.0, 3.0, 10.0, True) == 100


COMMITS = "entity_id bigint, project_id int, sha string, author_name string, author_email string, authored_at timestamp_ntz, subject string, is_merge boolean, is_fix boolean, is_revert boolean, insertions int, deletions int"
TOUCH = "id bigint, project_id int, commit_entity_id bigint, path string, additions int, deletions int"


def test_cochange_counts_repeats_once_and_leaves_large_commits_out_of_pairs(spark):
    c = spark.createDataFrame([(i, 1, f"s{i if i != 9 else 1}", "A", "a@x.example", T(i), "s", i == 4, False, False, 1, 1) for i in range(1, 10)], COMMITS)
    touches = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (4, "b"), (9, "a"), (9, "b"), (5, None), (5, ""), (99, "a")] + [(6, p) for p in "abcdef"]
    f = spark.createDataFrame([(k, 1, e, p, 1, 1) for k, (e, p) in enumerate(touches)], TOUCH)
    got = rows(derive.cochange(c, f, 2, 5).select("path_a", "path_b", "pair_commits", "a_commits", "b_commits", "confidence", "lift"))
    assert got == [("a", "b", 2, 4, 3, pytest.approx(2 / 3), pytest.approx(2 * 7 / 12))]
    assert derive.cochange(c, f, 2, 0).first().pair_commits == 3


def test_leader_clusters_follow_the_order(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.99, 0.1]), (1, 4, None), (2, 5, [1.0, 0.0])], "g int, k int, v array<double>")
    got = {r.k: r.cluster for r in derive.leader_clusters(v, "g", "k", "v").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 5: 0}


KEYS = "project_id int, symbol_key string, kind string, name string, fingerprint string"


def test_renames_need_uniqueness_on_both_sides(spark):
    old = spark.createDataFrame([(1, "a#f:x", "f", "x", "F1"), (1, "a#f:y", "f", "y", None), (1, "a#f:z", "f", "z", "F3"), (1, "b#f:z", "f", "z", "F3")], KEYS)
    new = spark.createDataFrame([(1, "b#f:x2", "f", "x2", "F1"), (1, "c#f:y", "f", "y", "F9"), (1, "c#f:z", "f", "z", "F3")], KEYS)
    assert rows(identity.match_renames(old, new)) == [(1, "a#f:x", "b#f:x2", "fingerprint"), (1, "a#f:y", "c#f:y", "name")]


def test_reconcile_keeps_ids_and_tombstones(spark):
    e = spark.createDataFrame([(1, "a", 7, "A", None), (1, "b", 8, "B", None), (1, "c", 9, "C", T(1))], "project_id int, natural_key string, entity_id bigint, title string, deleted_at timestamp_ntz")
    p = spark.createDataFrame([(1, "a", "A2"), (1, "c", "C"), (1, "d", "D")], "project_id int, natural_key string, title string")
    got = {r.natural_key: (r.state, r.deleted_at is None, r.entity_id) for r in identity.reconcile(e, p, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert got["a"] == ("kept", True, 7) and got["b"][:2] == ("retired", False) and got["c"] == ("returned", True, 9) and got["d"][0] == "new"


def test_merge_rules_are_idempotent(spark):
    old = spark.createDataFrame([(1, "t", ["a"], {"x": "1"}), (2, "u", None, None)], "k int, title string, mails array<string>, data map<string,string>")
    new = spark.createDataFrame([(1, None, ["b", "a"], {"x": "2", "y": "3"}), (3, "v", ["c"], None)], "k int, title string, mails array<string>, data map<string,string>")
    rules = {"mails": store.array_union, "data": store.map_merge}
    once = store.merge(old, new, ["k"], rules)
    first = next(r for r in once.collect() if r.k == 1)
    assert (first.title, first.mails, first.data) == ("t", ["a", "b"], {"x": "2", "y": "3"})
    assert sorted(map(repr, store.merge(once, new, ["k"], rules).collect())) == sorted(map(repr, once.collect()))


def test_chunk_refresh_drops_stale_vectors(spark):
    old = spark.createDataFrame([(1, 0, "h", [1.0]), (1, 1, "g", [2.0]), (1, 2, "x", [3.0])], "entity_id int, ord int, content_hash string, embedding array<double>")
    new = spark.createDataFrame([(1, 0, "h", None), (1, 1, "new", None)], "entity_id int, ord int, content_hash string, embedding array<double>")
    assert rows(store.refresh_chunks(old, new, ["entity_id", "ord"]).select("ord", "embedding")) == [(0, [1.0]), (1, None)]


def test_snapshots_commit_and_skip(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/s")
    df = spark.range(3)
    assert s.read("t") is None
    assert s.commit_if_changed("t", lambda: df, "w1") and not s.commit_if_changed("t", lambda: df, "w1")
    with pytest.raises(ZeroDivisionError):
        s.commit_if_changed("t", lambda: 1 / 0, "w2")
    assert s.manifest()["t"]["watermark"] == "w1" and s.read("t").count() == 3
    assert s.drop("t") == 3 and s.read("t") is None


def test_lexical_needs_every_word_and_prefers_names(spark):
    s = spark.createDataFrame([(1, 1, "cache store", None, "x"), (2, 1, "other", None, "cache store"), (3, 1, "cache", None, None)], "symbol_id int, project_id int, name string, doc string, body string")
    q = spark.createDataFrame([(1, 1, "Cache store")], "query_id int, project_id int, query_text string")
    got = search.lexical(search.inverted_index(s, "symbol_id", search.FIELD_WEIGHTS, "project_id"), q, "symbol_id", ["project_id"], 10).orderBy("rank").collect()
    assert [r.symbol_id for r in got] == [1, 2] and got[0].score > got[1].score


def test_recall_pins_first_and_drops_superseded(spark):
    m = spark.createDataFrame([(1, False, None), (2, True, None), (3, False, 1), (4, False, None)], "memory_id int, pinned boolean, supersedes int")
    r = spark.createDataFrame([(1, 9.0), (3, 1.0), (3, 5.0), (4, 2.0)], "memory_id int, score double")
    assert [(x.memory_id, x.score) for x in search.recall(m, r, 3).orderBy("rank").collect()] == [(2, None), (3, 5.0), (4, 2.0)]


def test_parse_task():
    t = compose.parse_task("Fix the \"stale cache\" in src/core and/or `charge`, see api.js and fooBar in Foo::run")
    assert t.paths == ["src/core", "api.js"] and t.phrases == ["stale cache"]
    assert "charge" in t.identifiers and "fooBar" in t.identifiers and "stale" in t.terms and "core" not in t.terms
    assert compose.parse_task(None).terms == []


def test_rules_by_scope(spark):
    r = spark.createDataFrame([(1, "a", "src/**", "low", "active", 0.5), (2, "b", None, "critical", "active", 0.5), (3, "c", "lib/**", "high", "active", 0.5), (4, "d", None, "high", "candidate", 0.9)], "rule_id int, statement string, scope string, severity string, state string, confidence double")
    ids = lambda paths: [x.rule_id for x in compose.rules_for(r, spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("rank").collect()]
    assert ids(["src/a.py"]) == [2, 1] and ids([]) == [2, 3, 1] and ids(["x"]) == [2]


RULES = "rule_key string, statement string, confidence double, state string, verified_by string, verified_at timestamp_ntz"


def test_rule_lifecycle_is_one_way(spark):
    r = spark.createDataFrame([("a", "A", 0.5, "candidate", None, None), ("b", "B", 0.6, "rejected", None, None), ("c", "C", 0.7, "active", "me", None)], RULES)
    d = spark.createDataFrame([("a", "active", "you", None), ("b", "active", "you", None), ("c", "rejected", "you", None)], "rule_key string, state string, verified_by string, verified_at timestamp_ntz")
    assert {x.rule_key: x.state for x in knowledge.decide(r, d).collect()} == {"a": "active", "b": "rejected", "c": "active"}
    new = spark.createDataFrame([("b", "B2", 0.9, "doc", 1), ("z", "Z", 0.4, "doc", 2)], "rule_key string, statement string, confidence double, origin string, origin_ref bigint")
    merged = {x.rule_key: (x.state, x.confidence) for x in knowledge.merge_candidates(r, new).collect()}
    assert merged["b"] == ("rejected", 0.6) and merged["z"] == ("candidate", 0.4)


def test_channels_run_and_degrade(spark):
    rows_, late = compose.run_channels(spark, {"a": spark.range(2), "b": spark.range(1).select(F.raise_error(F.lit("x")))})
    assert len(rows_["a"]) == 2 and late == ["b"]
