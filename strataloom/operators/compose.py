"""Task parsing, hint resolution, channels and the composed context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.ranking import CHANNEL_WEIGHTS, item_cost, pack, reciprocal_ranks, with_rank
from strataloom.functions.text import path_in_scope
from strataloom.operators import search
from strataloom.session import cut

#: Words without retrieval signal in a task, and the extensions that make a word a path.
TASK_STOPWORDS = frozenset(
    "the a an and or but if then than that this these those there here it its is are was were be been being to of in on at for with from by as into onto about when where while how why what which who do does did doing done "
    "can could should would will shall may might must not no i we you they me us them my our your their please need want make let get have has had".split()
)
TASK_EXTENSIONS = "js|jsx|mjs|cjs|ts|tsx|py|php|go|rb|java|rs|sql|md|mdx|json|ya?ml"
SECTION_ORDER = ("rule", "code", "graph", "doc", "memory", "commit")
SEVERITIES = ("critical", "high", "medium")
#: The forms of a path and of a compound name in a task.
PATH_FORM = rf"\b[\w.-]+(?:/[\w.-]+)+(?:\.\w{{1,6}})?\b|\b[\w-]{{2,}}\.(?:{TASK_EXTENSIONS})\b"
NAME_FORM = r"\b(?:[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+_\w+|[A-Z]{2,}_[A-Z_]+|\w+::\w+)\b"
_MARKED = re.compile(rf"\"(?P<phrase>[^\"]{{2,80}})\"|'(?P<quote>[^']{{2,80}})'|`(?P<tick>[^`]{{1,80}})`|(?P<path>{PATH_FORM})|(?P<name>{NAME_FORM})|(?P<word>\w+)", re.A)


@dataclass(frozen=True)
class Task:
    """What a free-form task says: exact hints and the words left for search."""

    text: str
    paths: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)


def _read(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of what a task holds, left to right; what stands in quotes or ticks is read inside as well."""
    for m in _MARKED.finditer(text):
        kind, said = m.lastgroup, m[m.lastgroup].strip()
        yield "phrase" if kind == "quote" else kind, said
        if kind in ("phrase", "quote", "tick"):
            yield from _read(said)


def _means_a_path(said: str) -> bool:
    """``and/or`` is no path: without a dot some part must carry meaning."""
    return "." in said or not TASK_STOPWORDS.issuperset(filter(None, said.lower().split("/")))


def parse_task(task: str | None) -> Task:
    """The hints of a task by kind, each once in order; a word is a term unless it is short, without signal or part of a hint."""
    said: dict[str, dict[str, None]] = {k: {} for k in ("phrase", "tick", "path", "name", "word")}
    for kind, part in _read((task or "").strip()):
        if kind == "path" and not _means_a_path(part):
            said["word"].update(dict.fromkeys(part.lower().split("/")))
        elif part:
            said[kind][part] = None
    # A ticked text that is one word or one qualified name is meant as a name.
    names = said["name"] | {t: None for t in said["tick"] if t not in said["path"] and re.fullmatch(r"[\w:.]+", t, re.A)}
    spent = set(re.findall(r"\w+", " ".join([*said["path"], *names]).lower(), re.A))
    words = dict.fromkeys(w.lower() for w in said["word"])
    terms = [w for w in words if len(w) >= 3 and w not in TASK_STOPWORDS and w not in spent]
    return Task((task or "").strip(), list(said["path"]), list(names), list(said["phrase"]), terms)


def resolve_hints(spark: SparkSession, task: Task, files: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """(kind, hint, project_id, match, rank): files by exact path or folder, symbols by exact name or ``::`` suffix; unresolved hints have a null match."""
    hints = spark.createDataFrame([("path", p) for p in task.paths] + [("symbol", s) for s in task.identifiers], "kind string, hint string")
    folders = files.select("project_id", F.col("path").alias("match"), F.explode(_prefixes(F.col("path"))).alias("hint"))
    by_path = hints.filter("kind = 'path'").select("kind", F.rtrim("hint", F.lit("/")).alias("hint")).join(folders, "hint").select("kind", "hint", "project_id", "match")
    keyed = symbols.filter("name IS NOT NULL").select("project_id", F.col("name").alias("match"), F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"^.*::", "")))).alias("hint"))
    by_name = hints.filter("kind = 'symbol'").join(keyed, "hint").select("kind", "hint", "project_id", "match").distinct()
    found = with_rank(by_path.unionByName(by_name), ["kind", "hint", "project_id"], F.length("match"), F.col("match"), keep=limit)
    missing = hints.select("kind", F.rtrim("hint", F.lit("/")).alias("hint")).join(found.select("kind", "hint").distinct(), ["kind", "hint"], "left_anti")
    return found.unionByName(missing.select("kind", "hint", F.lit(None).cast("int").alias("project_id"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("int").alias("rank")))


def _prefixes(path):
    """The path and every folder above it: keys that turn a prefix match into an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def rules_for(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Active rules that apply to the paths: unscoped always, all if there are no paths, else by glob; most severe first.

    ``rules``: rule_id, statement, scope, severity, state, confidence. The globs are compiled on the driver:
    rules are written by people and are few.
    """
    active = rules.filter("state = 'active'")
    scopes = [r.scope for r in active.select("scope").distinct().collect()]
    any_path = not paths.limit(1).isEmpty()
    hit = None
    for scope in sorted({s for s in scopes if s}):
        one = paths.filter(path_in_scope(F.col("path"), scope)).limit(1).select(F.lit(scope).alias("scope"))
        hit = one if hit is None else hit.unionByName(one)
    if any_path and hit is not None:
        active = active.join(hit.distinct().withColumn("hit", F.lit(True)), "scope", "left").filter("scope IS NULL OR scope = '' OR hit").drop("hit")
    elif any_path:
        active = active.filter("scope IS NULL OR scope = ''")
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return with_rank(active, [], severity, F.col("confidence").desc_nulls_last(), F.col("rule_id"))


def fuse_channels(items: DataFrame, by: list[str] = [], weights: dict[str, float] = CHANNEL_WEIGHTS) -> DataFrame:  # noqa: B006
    """Weighted fusion of channel items (channel, rank, key, type, title, ref, snippet): one row per key with its score and channels, keeping a snippet where any copy has one."""
    fused = reciprocal_ranks(items, by, "key", "channel", "rank", weights)
    copy = F.struct("type", "title", "ref", "snippet")
    best = items.groupBy(*by, "key").agg(F.min_by(copy, F.struct(F.col("snippet").isNull().cast("int"), "channel", "rank")).alias("c"))
    rows = fused.join(best, [*by, "key"]).select(*by, "key", F.round("score", 5).alias("score"), F.col("sources").alias("channels"), "c.type", "c.title", "c.ref", "c.snippet")
    return with_rank(rows, by, F.col("score").desc(), F.col("key"))


def compose(items: DataFrame, rules: DataFrame, budget: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The packed context of each ``by``: rules pinned first, then fused items that fit. Columns: by, key, type, title, ref, snippet, score, channels, taken, tokens_after, over_budget."""
    fused = fuse_channels(items, by).withColumn("pinned", F.lit(False))
    null = F.lit(None).cast("string")
    pinned = rules.select(*by, F.concat(F.lit("rule:"), F.col("rule_id").cast("string")).alias("key"), F.lit("rule").alias("type"), F.col("statement").alias("title"), null.alias("ref"), null.alias("snippet"), F.lit(None).cast("double").alias("score"), F.array(F.lit("rules")).alias("channels"), "rank", F.lit(True).alias("pinned"))
    both = fused.select(*pinned.columns).unionByName(pinned).withColumn("cost", item_cost(F.col("title"), F.col("snippet"), F.col("ref")))
    packed = pack(both.withColumn("one", F.lit(1)), ["one", *by], budget).drop("one")
    return both.join(packed, [*by, "key"]).select(*by, "key", "type", "title", "ref", "snippet", "score", "channels", "taken", "tokens_after", (F.col("tokens_after") > budget).alias("over_budget"))


#: Items that each channel gives, and the code hits whose neighbours the graph channel takes.
CHANNEL_ITEMS, GRAPH_SEEDS = 20, 3


def channel_items(tasks: DataFrame, symbols: DataFrame, chunks: DataFrame, memories: DataFrame, fixes: DataFrame, resolved: DataFrame, with_vectors: bool = False) -> dict[str, DataFrame]:
    """The five channels of a context, each (project_id, channel, rank, key, type, title, ref, snippet).

    ``tasks``: query_id (the project's id), project_id, query_text and, ``with_vectors``, embedding; ``memories``:
    memory_id, content, supersedes and maybe project_id; ``fixes``: project_id, sha, short_sha, subject, authored_at of
    commits that fix something; ``resolved``: edges with src and dst. Every channel gives ``CHANNEL_ITEMS``.
    """
    null = F.lit(None).cast("string")
    shape = lambda df, channel, kind, title, ref, text: df.select("project_id", F.lit(channel).alias("channel"), "rank", "key", F.lit(kind).alias("type"), title.alias("title"), ref.alias("ref"), text.alias("snippet"))
    keyed = lambda df, kind, key: df.filter(F.col(key).isNotNull()).withColumn("key", F.concat(F.lit(kind + ":"), F.col(key).cast("string")))

    def found(rows: DataFrame, fields: dict[str, float]) -> DataFrame:
        # Rows without a project are everybody's: they meet the tasks by word alone.
        on = ["project_id"] if "project_id" in rows.columns else []
        lists = {"fts": search.lexical_search(rows, tasks, "key", fields, on, search.pool_size(CHANNEL_ITEMS))}
        if with_vectors and "embedding" in rows.columns:
            lists["vector"] = search.nearest(rows, tasks, "key", on, search.pool_size(CHANNEL_ITEMS))
        return search.fuse(lists, "key", CHANNEL_ITEMS).select(F.col("query_id").cast("int").alias("project_id"), "key", "rank")

    sym, chunk = keyed(symbols, "code", "id"), keyed(chunks, "doc", "id")
    hits = cut(found(sym, search.FIELD_WEIGHTS).join(sym.select("key", "id", "name", "signature", F.substring("body", 1, 600).alias("text")), "key"))
    alive = memories.join(memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id")), "memory_id", "left_anti")
    memory = keyed(alive, "memory", "memory_id")
    # One hop from the best code hits, in either direction.
    links = resolved.filter("dst IS NOT NULL AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seeds = hits.filter(F.col("rank") <= GRAPH_SEEDS).select(F.col("id").alias("a"), "rank")
    near = links.join(seeds, "a").groupBy(F.col("b").alias("id")).agg(F.min("rank").alias("from_rank")).join(seeds.select(F.col("a").alias("id")), "id", "left_anti")
    near = keyed(near.join(symbols.select("id", "project_id", "name", "signature"), "id"), "code", "id")
    near = with_rank(near, ["project_id"], F.col("from_rank"), F.col("key"), keep=CHANNEL_ITEMS)
    last = with_rank(fixes.filter("sha IS NOT NULL").withColumn("key", F.concat(F.lit("commit:"), "sha")), ["project_id"], F.col("authored_at").desc_nulls_last(), F.col("sha"), keep=CHANNEL_ITEMS)
    doc = found(chunk, search.CHUNK_WEIGHTS).join(chunk.select("key", "heading_path", F.substring("content", 1, 600).alias("text")), "key")
    kept = found(memory, search.MEMORY_WEIGHTS).join(memory.select("key", F.substring("content", 1, 400).alias("text")), "key")
    return {
        "code": shape(hits, "code", "code", F.col("name"), F.col("signature"), F.col("text")),
        "doc": shape(doc, "doc", "doc", F.col("heading_path"), null, F.col("text")),
        "memory": shape(kept, "memory", "memory", F.substring("text", 1, 80), null, F.col("text")),
        "history": shape(last, "history", "commit", F.col("subject"), F.col("short_sha"), null),
        "graph": shape(near, "graph", "graph", F.col("name"), F.col("signature"), null),
    }


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    parts = list(channels.values())
    return reduce(DataFrame.unionByName, parts[1:], parts[0])


def run_channels(spark: SparkSession, channels: dict[str, DataFrame], deadline_s: float | None = None) -> tuple[dict[str, list], list[str]]:
    """(rows by channel, degraded channels). With a deadline each channel runs under its own tag and is cancelled when late; without one nothing is lost."""

    def run(name: str) -> list:
        spark.addTag(f"channel-{name}")
        try:
            return channels[name].collect()
        finally:
            spark.removeTag(f"channel-{name}")

    rows, late = {}, []
    with ThreadPoolExecutor(max(1, len(channels))) as pool:
        jobs = {name: pool.submit(run, name) for name in channels}
        for name, job in jobs.items():
            try:
                rows[name] = job.result(deadline_s)
            except TimeoutError:
                spark.interruptTag(f"channel-{name}")
                late.append(name)
            except Exception:  # noqa: BLE001 - a channel that fails degrades the answer, it does not end it
                late.append(name)
    return rows, late


def to_markdown(task: Task, rows: list) -> str:
    """The composed context as Markdown, by section in a fixed order, with references as citations."""
    out = [f"# Context: {task.text}"]
    for kind in SECTION_ORDER:
        mine = [r for r in rows if r["type"] == kind and r["taken"]]
        if mine:
            out.append(f"\n## {kind}")
            for r in mine:
                out.append(f"- {r['title']}" + (f" ({r['ref']})" if r["ref"] else ""))
                if r["snippet"]:
                    out.append("  " + r["snippet"].replace("\n", "\n  "))
    return "\n".join(out)


def review_context(rules: DataFrame, memories: DataFrame, fixes: DataFrame, paths: DataFrame, last_fixes: int = 5) -> DataFrame:
    """(kind, ref, text, rank) for a set of changed paths: rules in scope, scoped or pinned memories, the last fixes that touched them."""
    ruled = rules_for(rules, paths).select(F.lit("rule").alias("kind"), F.col("rule_id").cast("string").alias("ref"), F.col("statement").alias("text"), "rank")
    superseded = memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id"))
    alive = memories.join(superseded, "memory_id", "left_anti")
    scopes = {r.scope for r in alive.filter("scope IS NOT NULL").select("scope").distinct().collect()}
    inside = F.lit(False)
    for scope in sorted(scopes):
        touched = not paths.filter(path_in_scope(F.col("path"), scope)).limit(1).isEmpty()
        inside = inside | ((F.col("scope") == scope) & F.lit(touched))
    kept = with_rank(alive.filter(F.col("pinned") | inside), [], F.col("pinned").desc(), F.col("memory_id")).select(F.lit("memory").alias("kind"), F.col("memory_id").cast("string").alias("ref"), F.col("content").alias("text"), "rank")
    hit = fixes.join(paths.select("path").distinct(), "path", "left_semi").select("sha", "subject", "authored_at").distinct()
    past = with_rank(hit, [], F.col("authored_at").desc_nulls_last(), F.col("sha"), keep=last_fixes).select(F.lit("fix").alias("kind"), F.col("sha").alias("ref"), F.col("subject").alias("text"), "rank")
    return ruled.unionByName(kept).unionByName(past)
