"""Decision graphs: small JSON documents with nodes, changed by atomic patches, summarised as DataFrames."""

from __future__ import annotations

import copy
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a field may hold.
STATUSES = ("open", "decided", "rejected", "deferred")
REVIEWS = ("pending", "approved", "concern")
RISKS = ("low", "medium", "high")


class PatchError(ValueError):
    """A patch that cannot be applied; the graph is unchanged."""


def slugify(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", (text or "").lower()).strip("-") or "untitled"


def new_node(title: str, parent: str | None) -> dict:
    return {"title": title, "parent": parent, "status": "open", "review": "pending", "confidence": 0.5, "evidence": [], "risk": "low", "files": [], "notes": "", "alternatives": [], "answer": None}


def new_graph(feature: str, slug: str | None = None) -> dict:
    return {"slug": slug or slugify(feature), "feature": feature, "root": "root", "nodes": {"root": new_node(feature, None)}}


def validate(graph: dict) -> None:
    nodes = graph["nodes"]
    if graph["root"] not in nodes:
        raise PatchError("the root is missing")
    for key, node in nodes.items():
        if key != graph["root"] and node["parent"] not in nodes:
            raise PatchError(f"{key} has no parent")
        if node["status"] not in STATUSES or node["review"] not in REVIEWS or node["risk"] not in RISKS:
            raise PatchError(f"{key} has an unknown status, review or risk")
        if not 0 <= node["confidence"] <= 1:
            raise PatchError(f"{key} has a confidence outside 0..1")


def descendants(graph: dict, key: str) -> set[str]:
    out: set[str] = set()
    todo = [key]
    while todo:
        at = todo.pop()
        below = [k for k, n in graph["nodes"].items() if n["parent"] == at and k not in out]
        out |= set(below)
        todo += below
    return out


_SETTERS = {"set_status": "status", "set_review": "review", "set_confidence": "confidence", "set_evidence": "evidence", "set_risk": "risk", "set_affected_files": "files", "set_notes": "notes", "set_title": "title"}


def apply(graph: dict, patches: list[dict]) -> dict:
    """The graph after all patches, or PatchError and no change at all."""
    out = copy.deepcopy(graph)
    nodes = out["nodes"]

    def node(key: str) -> dict:
        if key not in nodes:
            raise PatchError(f"no node {key!r}")
        return nodes[key]

    for p in patches:
        op = p.get("op")
        if op == "add_node":
            node(p.get("parent", out["root"]))
            key = p.get("id") or slugify(p["title"])
            if key in nodes:
                raise PatchError(f"node {key!r} exists")
            nodes[key] = new_node(p["title"], p.get("parent", out["root"]))
        elif op == "add_alternative":
            node(p["id"])["alternatives"].append(p["value"])
        elif op == "select_answer":
            n = node(p["id"])
            if p["value"] not in n["alternatives"]:
                raise PatchError(f"{p['value']!r} is no alternative of {p['id']!r}")
            n["answer"], n["status"] = p["value"], "decided"
        elif op in _SETTERS:
            node(p["id"])[_SETTERS[op]] = p["value"]
        elif op == "reparent":
            n = node(p["id"])
            node(p["parent"])
            if p["id"] == out["root"] or p["parent"] == p["id"] or p["parent"] in descendants(out, p["id"]):
                raise PatchError("this would make a cycle")
            n["parent"] = p["parent"]
        elif op == "remove_node":
            node(p["id"])
            if p["id"] == out["root"]:
                raise PatchError("the root stays")
            for key in descendants(out, p["id"]) | {p["id"]}:
                del nodes[key]
        else:
            raise PatchError(f"unknown operation {op!r}")
    validate(out)
    return out


def save(folder: str, graph: dict) -> str:
    """Writes the graph beside its old version and renames it into place."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder, graph["slug"] + ".json")
    draft = path.with_suffix(".draft")
    draft.write_text(json.dumps(graph, ensure_ascii=False, indent=1))
    os.replace(draft, path)
    return str(path)


def patch_file(folder: str, slug: str, patches: list[dict]) -> dict:
    graph = apply(json.loads(Path(folder, slug + ".json").read_text()), patches)
    save(folder, graph)
    return graph


def node_rows(spark: SparkSession, graphs: list[dict]) -> DataFrame:
    """One row per node of each graph."""
    rows = [(g["slug"], k, n["title"], n["parent"], n["status"], n["review"], float(n["confidence"]), n["risk"], list(n["files"]), len(n["alternatives"]), n["answer"]) for g in graphs for k, n in g["nodes"].items()]
    return spark.createDataFrame(rows, "slug string, node string, title string, parent string, status string, review string, confidence double, risk string, files array<string>, alternatives int, answer string")


def read_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return node_rows(spark, [json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))])


def summary(nodes: DataFrame) -> DataFrame:
    """Per graph: nodes, decided, reviews, concerns and confidence weighted by alternatives + 1."""
    weight = F.col("alternatives") + 1
    return nodes.groupBy("slug").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "decided").alias("decided"), F.count_if(F.col("review") == "approved").alias("approved"), F.count_if(F.col("review") == "concern").alias("concerns"),
        F.round(F.sum(F.col("confidence") * weight) / F.sum(weight), 6).alias("confidence"),
    )


def file_impact(nodes: DataFrame) -> DataFrame:
    """(slug, file, nodes, risk): the highest risk of the nodes that affect each file."""
    level = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    rows = nodes.select("slug", "node", level.alias("level"), F.explode("files").alias("file")).groupBy("slug", "file").agg(F.count("*").alias("nodes"), F.max("level").alias("level"))
    return rows.select("slug", "file", "nodes", F.when(F.col("level") == 3, "high").when(F.col("level") == 2, "medium").otherwise("low").alias("risk"))
