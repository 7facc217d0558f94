"""The declared operations: names, aliases, validated arguments and handlers that return DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.catalog import TABLES, table
from strataloom.functions.documents import chunk_rows
from strataloom.functions.ranking import with_rank
from strataloom.operators import compose, derive, graph, history, identity, knowledge, search
from strataloom.operators.graph import UnknownTarget
from strataloom.operators.store import Snapshots
from strataloom.plans import graph_queries
from strataloom.session import cut
from strataloom.sources import code_parser, decisions
from strataloom.sources.files import scan_tree, to_process

__all__ = ["OPERATIONS", "ArgumentError", "UnknownTarget", "call", "find", "parse_argv"]


#: Texts to their vectors.
Embedder = Callable[[list[str]], list[list[float]]]


class ArgumentError(ValueError):
    """An argument that is missing, unknown or out of range."""


@dataclass(frozen=True)
class Arg:
    kind: type = str
    required: bool = False
    default: Any = None
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()

    def coerce(self, name: str, value: Any) -> Any:
        try:
            if self.kind is bool:
                value = value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
            else:
                value = self.kind(value)
        except (TypeError, ValueError):
            raise ArgumentError(f"{name} must be {self.kind.__name__}") from None
        if self.least is not None and not self.least <= value <= self.most:
            raise ArgumentError(f"{name} must be within {self.least:g}..{self.most:g}")
        if self.choices and value not in self.choices:
            raise ArgumentError(f"{name} must be one of {', '.join(self.choices)}")
        return value


@dataclass(frozen=True)
class Operation:
    name: str
    handler: Callable[..., DataFrame]
    args: dict[str, Arg] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    writes: bool = False

    @property
    def required(self) -> list[str]:
        return [n for n, a in self.args.items() if a.required]

    def validate(self, given: dict[str, Any]) -> dict[str, Any]:
        unknown = set(given) - set(self.args)
        if unknown:
            raise ArgumentError(f"{self.name} has no argument {sorted(unknown)[0]}")
        missing = [n for n in self.required if given.get(n) in (None, "")]
        if missing:
            raise ArgumentError(f"{self.name} needs {', '.join(missing)}")
        out = {n: a.coerce(n, given[n]) if given.get(n) is not None else a.default for n, a in self.args.items()}
        return {n: v for n, v in out.items() if v is not None}

    def usage(self) -> str:
        return " ".join([self.name, *(f"<{n}>" if a.required else f"[--{n} {a.kind.__name__}]" for n, a in self.args.items())])


LIMIT = lambda most, default: Arg(int, default=default, least=1, most=most)
PROJECT = Arg(int)


class Catalog:
    """The tables of one folder, restricted to a project if one is asked for."""

    def __init__(self, spark: SparkSession, folder: str, project: int | None = None, store: str | None = None, embedder: Embedder | None = None):
        """``store``: the folder of what operations write, shared and kept; ``embedder``: the one that made the tables' vectors, if it is at hand."""
        self.spark, self.folder, self.project, self.embedder = spark, folder, project, embedder
        self._store = store
        if project is not None:
            graph.require(self("projects"), f"no project {project}")

    def __call__(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        if self.project is None:
            return df
        return df.filter(F.col("id" if name == "projects" else "project_id") == self.project)

    def store(self) -> Snapshots:
        if not self._store:
            raise ArgumentError("this operation needs a store: a folder that outlives the session")
        return Snapshots(self.spark, self._store)

    def kept(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty if there is no store or no such table yet."""
        found = Snapshots(self.spark, self._store).read(name) if self._store else None
        return found if found is not None else self.spark.createDataFrame([], schema)

    def resolved(self) -> DataFrame:
        return graph.resolve_edges(graph.call_edges(self("symbols")), self("symbols"))

    def named(self, name: str) -> DataFrame:
        return graph.require(self("symbols").filter(graph.names_match(F.col("name"), name)), f"no symbol {name!r}")

    def as_of(self):
        at = self("commits").agg(F.max("authored_at").cast("string")).first()[0]
        return F.lit(at or "1970-01-01").cast("timestamp_ntz")


def _query(c: Catalog, text: str) -> DataFrame:
    """A query for every project; with a vector only if the embedder of the tables is at hand."""
    rows = c("projects").select(F.col("id").cast("bigint").alias("query_id"), F.col("id").alias("project_id"), F.lit(text).alias("query_text"))
    if c.embedder is None:
        return rows
    return rows.withColumn("embedding", F.array(*[F.lit(float(x)) for x in c.embedder([text])[0]]))


def _index(c: Catalog, path: str, store: str | None = None) -> DataFrame:
    """Scans a tree and brings a store up to it in one move: files, symbols, relations between them and chunks of documents.

    Only what changed is parsed; what belongs to unchanged files stays as it is, what belongs to removed ones goes.
    A file that can not be read keeps its old rows and hash, so the next scan tries it again.
    """
    snap = Snapshots(c.spark, store) if store else c.store()
    present, old = scan_tree(c.spark, path), snap.read("files")
    manifest = old if old is not None else present.select("path", "language", "hash", "loc").limit(0)
    todo = cut(to_process(present, manifest).withColumn("id", F.xxhash64("path")))
    sources, prose = todo.filter("language IS NOT NULL"), todo.filter("language IS NULL")
    parsed = cut(code_parser.parse_files(sources))
    bad = code_parser.failed(parsed).select(F.col("file_id").alias("id"))
    good = todo.join(bad, "id", "left_anti")
    kept = manifest.join(present.select("path"), "path", "left_semi").join(good.select("path"), "path", "left_anti")
    files = cut(kept.unionByName(good.select("path", "language", "hash", "loc")))
    alive = kept.select(F.xxhash64("path").alias("file_id"))
    new = {"symbols": code_parser.symbol_rows(parsed), "relations": code_parser.relation_rows(parsed), "chunks": chunk_rows(prose, "id", "content").withColumnRenamed("id", "file_id")}
    tables = {"files": files}
    for name, rows in new.items():
        before = snap.read(name)
        tables[name] = rows if before is None else before.join(alive, "file_id", "left_semi").unionByName(rows)
    state = snap.commit_all(tables)
    return c.spark.createDataFrame([tuple(state[n]["rows"] for n in ("files", *new))], "files bigint, " + ", ".join(f"{n} bigint" for n in new))


def _search(c: Catalog, query: str, limit: int) -> DataFrame:
    found = search.search_code(c("symbols"), _query(c, query), limit, c.embedder is not None)
    s = c("symbols").select(F.col("id").alias("symbol_id"), "name", "kind", "signature", "file_id", "start_line")
    return found.join(s, "symbol_id").join(c("files").select(F.col("id").alias("file_id"), "path"), "file_id").drop("file_id")


def _knowledge(c: Catalog, query: str, limit: int) -> DataFrame:
    return search.search_knowledge(c("symbols"), c("chunks"), _query(c, query), limit, c.kept("memories", _MEMORIES), c.embedder is not None)


def _symbol(c: Catalog, name: str, limit: int) -> DataFrame:
    rows = c.named(name).join(c("files").select(F.col("id").alias("file_id"), "path"), "file_id")
    top = with_rank(rows, [], (F.col("name") == name).desc(), F.col("id"), keep=limit)
    return top.select("rank", "id", "name", "kind", "path", "signature", "doc", "start_line", "end_line", F.when(F.col("rank") == 1, F.col("body")).alias("body"))


def _neighbours(c: Catalog, name: str, limit: int, inbound: bool) -> DataFrame:
    ours = c.named(name).select(F.col("id").alias("symbol_id"))
    rows = graph.neighbours(c.resolved(), c("symbols"), c("files"), inbound).join(ours, "symbol_id", "left_semi")
    return with_rank(rows, [], F.col("other"), F.col("other_path").asc_nulls_last(), F.col("symbol_id"), F.col("relation"), keep=limit)


def _related(c: Catalog, name: str, limit: int) -> DataFrame:
    seeds = c.named(name).orderBy((F.col("name") == name).desc(), "id").limit(1).select("id", "project_id", "embedding")
    near = search.related(c("symbols"), seeds, "id", "project_id", limit)
    return near.join(c("symbols").select("id", "name", "kind"), "id")


def _history(c: Catalog, target: str | None = None, limit: int = 20) -> DataFrame:
    ours = history.unique_commits(c("commits")).select("entity_id", "project_id", "sha", "subject", "author_name", "authored_at", "is_fix")
    if target:
        paths = graph.require(history.resolve_target(target, c("files"), c("symbols"), c("commit_files")), f"nothing is called {target!r}")
        touched = c("commit_files").join(paths.select("project_id", "path"), ["project_id", "path"], "left_semi").select(F.col("commit_entity_id").alias("entity_id"))
        ours = ours.join(touched, "entity_id", "left_semi")
    return with_rank(ours, ["project_id"], F.col("authored_at").desc_nulls_last(), F.col("sha"), keep=limit)


def _owners(c: Catalog, target: str | None = None, limit: int = 10) -> DataFrame:
    commits = c("commits")
    if target:
        paths = graph.require(history.resolve_target(target, c("files"), c("symbols"), c("commit_files")), f"nothing is called {target!r}")
        touched = c("commit_files").join(paths.select("project_id", "path"), ["project_id", "path"], "left_semi").select(F.col("commit_entity_id").alias("entity_id"))
        commits = commits.join(touched, "entity_id", "left_semi")
    return history.owners(commits, c.as_of(), limit)


_RULES = "rule_id int, statement string, scope string, severity string, state string, confidence double"
_STORED_RULES = "rule_id int, rule_key string, statement string, scope string, severity string, state string, confidence double, origin string, origin_ref string, verified_by string, verified_at timestamp"
_MEMORIES = "memory_id bigint, memory_key string, content string, kind string, scope string, supersedes bigint, pinned boolean"


def _target_paths(c: Catalog, target: str | None) -> DataFrame:
    if not target:
        return c.spark.createDataFrame([], "path string")
    return history.resolve_target(target, c("files"), c("symbols"), c("commit_files")).select("path").distinct()


def _remember(c: Catalog, content: str, kind: str = "note", scope: str | None = None, supersedes: int | None = None, pinned: bool = False) -> DataFrame:
    out = knowledge.remember(c.kept("memories", _MEMORIES), c.spark, content, kind, scope, supersedes, pinned)
    store = c.store()
    store.commit("memories", out)
    return store.read("memories")


def _recall(c: Catalog, query: str, limit: int) -> DataFrame:
    m = c.kept("memories", _MEMORIES)
    rows = m.withColumn("one", F.lit(1))
    q = c.spark.createDataFrame([(1, 1, query)], "query_id int, one int, query_text string")
    ranked = search.lexical_search(rows, q, "memory_id", search.MEMORY_WEIGHTS, ["one"]).select("memory_id", "score")
    return search.recall(m, ranked, limit).join(m.select("memory_id", "content", "kind"), "memory_id")


def _review(c: Catalog, paths: str = "") -> DataFrame:
    given = c.spark.createDataFrame([(p.strip(),) for p in paths.split(",") if p.strip()], "path string")
    fixes = history.path_touches(history.unique_commits(c("commits")).filter("is_fix").select("entity_id", "sha", "subject", "authored_at"), c("commit_files"))
    return compose.review_context(c.kept("rules", _RULES), c.kept("memories", _MEMORIES), fixes.select("sha", "subject", "authored_at", "path"), given)


def _modules(c: Catalog, sort: str, limit: int) -> DataFrame:
    metrics = derive.module_metrics(c("commits"), c("commit_files"), c("files"), c.as_of()).select("project_id", "module", "commits", "churn", "risk")
    rows = derive.modules(c("files"), c("symbols")).join(metrics, ["project_id", "module"], "left")
    order = F.col("module") if sort == "path" else F.col(sort).desc_nulls_last()
    return with_rank(rows, ["project_id"], order, F.col("module"), keep=limit)


def _module(c: Catalog, module: str) -> DataFrame:
    """One module: (section, name, value), five rows a section."""
    rows = graph.require(derive.modules(c("files"), c("symbols")).filter(F.col("module") == module), f"no module {module!r}")
    metrics = derive.module_metrics(c("commits"), c("commit_files"), c("files"), c.as_of()).filter(F.col("module") == module)
    owners = derive.module_owners(c("commits"), c("commit_files"), c("files"), c.as_of()).filter(F.col("module") == module)
    deps = derive.module_dependencies(c.resolved(), c("symbols"), c("files"))
    together = derive.cochange_of(derive.cochange(c("commits"), c("commit_files")), module)
    part = lambda df, section, name, value: df.select("project_id", F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    out = (
        part(rows, "size", "module", "files").unionByName(part(metrics, "risk", "module", "risk")).unionByName(part(owners, "owner", "person", "share"))
        .unionByName(part(deps.filter(F.col("from_module") == module), "depends on", "to_module", "edges")).unionByName(part(deps.filter(F.col("to_module") == module), "used by", "from_module", "edges")).unionByName(part(together, "changes with", "other", "confidence"))
    )
    return with_rank(out, ["project_id", "section"], F.col("value").desc_nulls_last(), F.col("name"), keep=5)


def _clusters(c: Catalog, limit: int) -> DataFrame:
    """The largest clusters with the newest fixes of each."""
    rows = with_rank(derive.fix_clusters(c("commits"), c("commit_files")), ["project_id"], F.col("size").desc(), F.col("module"), F.col("term"), keep=limit)
    shown = derive.cluster_examples(c("commits"), c("commit_files")).groupBy("project_id", "module", "term").agg(F.array_sort(F.collect_list(F.struct("n", "sha", "subject"))).alias("examples"))
    return rows.join(shown, ["project_id", "module", "term"])


def _overview(c: Catalog) -> DataFrame:
    """(section, project_id, name, value, rank): folders, languages and hubs."""
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), "project_id", F.col(name).alias("name"), F.col(value).cast("bigint").alias("value"))
    f = c("files").filter("path IS NOT NULL")
    dirs = f.groupBy("project_id", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("files"))
    langs = f.groupBy("project_id", "language").agg(F.count("*").alias("files"))
    rows = part(dirs, "directory", "dir", "files").unionByName(part(langs, "language", "language", "files")).unionByName(part(graph.hubs(c.resolved(), c("symbols")), "hub", "name", "inbound"))
    return with_rank(rows, ["project_id", "section"], F.col("value").desc(), F.col("name").asc_nulls_last(), keep=20)


def _outline(c: Catalog, path: str, limit: int) -> DataFrame:
    rows = graph.outline(c("symbols"), c("files"))
    return graph.require(rows.filter((F.col("path") == path) | F.startswith("path", F.lit(path.rstrip("/") + "/"))), f"no file {path!r}").filter(F.col("ord") <= limit)


def _subgraph(c: Catalog, name: str, depth: int) -> DataFrame:
    seed = c.named(name).agg(F.min("id").alias("seed"))
    return graph.subgraph(c.resolved(), seed, depth).join(c("symbols").select("id", "name", "kind"), "id")


def _compose(c: Catalog, task: str, budget: int, format: str = "json", deadline: float | None = None) -> DataFrame:
    """The context of a task from five channels; with a ``deadline`` in seconds a channel that is late or fails is left out."""
    parsed = compose.parse_task(task)
    fixes = history.unique_commits(c("commits")).filter("is_fix").select("project_id", "sha", "short_sha", "subject", "authored_at")
    channels = compose.channel_items(_query(c, " ".join(parsed.terms) or task), c("symbols"), c("chunks"), c.kept("memories", _MEMORIES), fixes, c.resolved(), c.embedder is not None)
    if deadline is not None:
        rows, _ = compose.run_channels(c.spark, channels, deadline)
        channels = {name: c.spark.createDataFrame(rows.get(name, []), df.schema) for name, df in channels.items()}
    rules = compose.rules_for(c.kept("rules", _RULES), c.spark.createDataFrame([(p,) for p in parsed.paths], "path string"))
    # People's rules are few; every project gets them as literals.
    fields = ("rule_id", "statement", "rank")
    said = [F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rules.select(*fields).collect()]
    each = c("projects").select(F.col("id").alias("project_id"), F.explode(F.array(*said)).alias("r")).select("project_id", "r.*") if said else rules.select(F.lit(0).alias("project_id"), *fields).limit(0)
    out = compose.compose(compose.union_channels(channels), each, budget, ["project_id"])
    if format == "markdown":
        text = compose.to_markdown(parsed, [r.asDict() for r in out.orderBy("project_id", "tokens_after", "key").collect()])
        return c.spark.createDataFrame([(text,)], "markdown string")
    return out


def mine_rules(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """Adds rule candidates mined from the documents to the store; known rules stay as they are."""
    snap = Snapshots(spark, store)
    found = knowledge.propose(table(spark, folder, "documents"), "doc")
    fresh = found.select("rule_key", "statement", "confidence", "origin", F.col("origin_ref").cast("string").alias("origin_ref"))
    old = snap.read("rules")
    known = old if old is not None else spark.createDataFrame([], _STORED_RULES)
    new = fresh.join(known.select("rule_key"), "rule_key", "left_anti")
    rows = new.select(F.abs(F.hash("rule_key")).alias("rule_id"), "rule_key", "statement", F.lit(None).cast("string").alias("scope"), F.lit("medium").alias("severity"), F.lit("candidate").alias("state"), "confidence", "origin", "origin_ref", F.lit(None).cast("string").alias("verified_by"), F.lit(None).cast("timestamp").alias("verified_at"))
    snap.append("rules", rows)
    return snap.read("rules")


def decide_rules(spark: SparkSession, store: str, decisions_: DataFrame) -> DataFrame:
    """People's decisions (rule_key, state, verified_by, verified_at) on candidates, written to the store that ``get_rules`` reads."""
    snap = Snapshots(spark, store)
    snap.commit("rules", knowledge.decide(snap.read("rules"), decisions_))
    return snap.read("rules")


def _new_decision(c: Catalog, feature: str, slug: str | None = None, folder: str = ".") -> DataFrame:
    g = decisions.new_graph(feature, slug)
    decisions.save(folder, g)
    return decisions.node_rows(c.spark, [g])


def _patch_decision(c: Catalog, slug: str, patch: str, folder: str = ".") -> DataFrame:
    ops = json.loads(patch)
    return decisions.node_rows(c.spark, [decisions.patch_file(folder, slug, ops if isinstance(ops, list) else [ops])])


def _per_project(handler: Callable[[SparkSession, str], DataFrame]) -> Callable[[Catalog], DataFrame]:
    def run(c: Catalog) -> DataFrame:
        rows = handler(c.spark, c.folder)
        return rows if c.project is None else rows.filter(F.col("project_id") == c.project)

    return run


_S = Arg(str, required=True)
OPERATIONS = [
    Operation("index_project", _index, {"path": _S, "store": Arg()}, ("index", "reindex"), writes=True),
    Operation("list_projects", _per_project(graph_queries.list_projects)),
    Operation("project_overview", _overview),
    Operation("search_code", _search, {"query": _S, "limit": LIMIT(30, 10)}, ("search",)),
    Operation("search_knowledge", _knowledge, {"query": _S, "limit": LIMIT(30, 10)}, ("knowledge",)),
    Operation("get_symbol", _symbol, {"name": _S, "limit": LIMIT(10, 5)}),
    Operation("get_callers", lambda c, name, limit: _neighbours(c, name, limit, True), {"name": _S, "limit": LIMIT(30, 10)}),
    Operation("get_callees", lambda c, name, limit: _neighbours(c, name, limit, False), {"name": _S, "limit": LIMIT(30, 10)}),
    Operation("get_graph", _subgraph, {"name": _S, "depth": Arg(int, default=2, least=1, most=4)}),
    Operation("get_file_outline", _outline, {"path": _S, "limit": LIMIT(30, 10)}),
    Operation("find_related", _related, {"name": _S, "limit": LIMIT(30, 10)}),
    Operation("get_history", _history, {"target": Arg(), "limit": LIMIT(100, 20)}, ("history",)),
    Operation("who_owns", _owners, {"target": Arg(), "limit": LIMIT(50, 10)}, ("owners",)),
    Operation("get_rules", lambda c, target=None: compose.rules_for(c.kept("rules", _RULES), _target_paths(c, target)), {"target": Arg()}, ("rules",)),
    Operation("remember", _remember, {"content": _S, "kind": Arg(default="note", choices=("note", "decision", "preference", "fact")), "scope": Arg(), "supersedes": Arg(int), "pinned": Arg(bool, default=False)}, writes=True),
    Operation("recall", _recall, {"query": _S, "limit": LIMIT(30, 10)}),
    Operation("review_context", _review, {"paths": Arg(default="")}, ("review",)),
    Operation("get_modules", _modules, {"sort": Arg(default="risk", choices=("risk", "churn", "loc", "path")), "limit": LIMIT(200, 30)}, ("modules",)),
    Operation("get_module", _module, {"module": _S}, ("module",)),
    Operation("get_cochange", lambda c, target, limit: derive.cochange_of(derive.cochange(c("commits"), c("commit_files")), target, limit), {"target": _S, "limit": LIMIT(50, 15)}, ("cochange",)),
    Operation("get_bug_clusters", _clusters, {"limit": LIMIT(50, 10)}, ("bugs",)),
    Operation("compose_context", _compose, {"task": _S, "budget": Arg(int, default=6000, least=200, most=60000), "format": Arg(default="json", choices=("json", "markdown")), "deadline": Arg(float, least=0.01, most=3600)}, ("context",)),
    Operation("create_reasoning_graph", _new_decision, {"feature": _S, "slug": Arg(), "folder": Arg(default=".")}, ("reasoning-init",), writes=True),
    Operation("update_reasoning_graph", _patch_decision, {"slug": _S, "patch": _S, "folder": Arg(default=".")}, ("reasoning-update",), writes=True),
]
_BY_NAME = {n: op for op in OPERATIONS for n in (op.name, *op.aliases)}


def find(name: str) -> Operation:
    if name not in _BY_NAME:
        raise ArgumentError(f"no operation {name!r}")
    return _BY_NAME[name]


def parse_argv(name: str, argv: list[str]) -> dict[str, Any]:
    """Typed arguments from words: positional ones fill the arguments in order, ``--name value`` names them."""
    op, given, rest = find(name), {}, []
    k = 0
    while k < len(argv):
        if argv[k].startswith("--"):
            key, _, value = argv[k][2:].partition("=")
            if not value and op.args.get(key) and op.args[key].kind is bool:
                value = "true"
            elif not value:
                k += 1
                value = argv[k] if k < len(argv) else ""
            given[key] = value
        else:
            rest.append(argv[k])
        k += 1
    for key in op.args:
        if rest and key not in given:
            given[key] = rest.pop(0)
    if rest:
        raise ArgumentError(f"{op.name} takes no {rest[0]!r}")
    return op.validate(given)


def call(spark: SparkSession, folder: str, name: str, args: dict[str, Any] | None = None, project: int | None = None, store: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Runs one operation over the tables of ``folder``, for one project or all; see ``Catalog`` for ``store`` and ``embedder``."""
    op = find(name)
    return op.handler(Catalog(spark, folder, project, store, embedder), **op.validate(args or {}))


def browse(spark: SparkSession, folder: str, name: str, limit: int = 20) -> DataFrame:
    """The newest rows of one of the known tables."""
    if name not in TABLES:
        raise ArgumentError(f"no table {name!r}")
    df = table(spark, folder, name)
    return df.orderBy(F.col(df.columns[0]).desc()).limit(limit)


def delete_preview(spark: SparkSession, folder: str, project: int) -> dict[str, int]:
    """How many rows a project has in each table, to be shown before it is dropped."""
    return {name: table(spark, folder, name).filter(F.col("project_id") == project).count() for name in ("files", "symbols", "commits", "chunks", "documents")}


def symbol_identity(c: Catalog) -> DataFrame:
    return identity.symbol_keys(c("symbols"), c("files"))

