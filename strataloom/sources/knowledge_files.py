"""Rules, candidates and memories as YAML files in a repository.

The files hold a list of flat mappings of scalars; that subset of YAML is read and written here.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "rule_key string, statement string, scope string, severity string, origin string, confidence double, state string"
MEMORY_SCHEMA = "memory_key string, content string, kind string, scope string, pinned boolean"


def dump(rows: list[dict]) -> str:
    cell = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, str) else "null" if v is None else json.dumps(v)
    return "".join("".join(f"{'- ' if k == 0 else '  '}{name}: {cell(value)}\n" for k, (name, value) in enumerate(row.items())) for row in rows)


def load(text: str) -> list[dict]:
    rows: list[dict] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"\s*(-\s+)?([A-Za-z_]\w*)\s*:\s*(.*)$", line)
        if not m:
            raise ValueError(f"cannot read line {line!r}")
        if m[1] or not rows:
            rows.append({})
        value = m[3].strip()
        if value in ("", "null", "~"):
            rows[-1][m[2]] = None
        elif value in ("true", "false"):
            rows[-1][m[2]] = value == "true"
        elif value[0] == '"':
            rows[-1][m[2]] = json.loads(value)
        elif re.fullmatch(r"-?\d+(\.\d+)?", value):
            rows[-1][m[2]] = float(value) if "." in value else int(value)
        else:
            rows[-1][m[2]] = value.strip("'")
    return rows


def export(folder: str, rules: DataFrame, memories: DataFrame) -> None:
    """Writes rules.yaml (active), candidates.yaml and memories.yaml (not superseded); these tables are people's and small."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    names = [c.split(" ")[0] for c in RULE_SCHEMA.split(", ")]
    for file, state in (("rules.yaml", "active"), ("candidates.yaml", "candidate")):
        rows = rules.filter(rules["state"] == state).select(*names).orderBy("rule_key").collect()
        (out / file).write_text(dump([r.asDict() for r in rows]))
    gone = memories.filter("supersedes IS NOT NULL").select(memories["supersedes"].alias("memory_id"))
    kept = memories.join(gone, "memory_id", "left_anti").select(*[c.split(" ")[0] for c in MEMORY_SCHEMA.split(", ")]).orderBy("memory_key").collect()
    (out / "memories.yaml").write_text(dump([r.asDict() for r in kept]))


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows: list[dict] = []
    for file, state in (("rules.yaml", "active"), ("candidates.yaml", "candidate")):
        path = Path(folder, file)
        rows += [r | {"state": r.get("state") or state} for r in (load(path.read_text()) if path.exists() else [])]
    names = [c.split(" ")[0] for c in RULE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(float(r[c]) if c == "confidence" and r.get(c) is not None else r.get(c) for c in names) for r in rows], RULE_SCHEMA)


def read_memories(spark: SparkSession, folder: str) -> DataFrame:
    path = Path(folder, "memories.yaml")
    names = [c.split(" ")[0] for c in MEMORY_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in (load(path.read_text()) if path.exists() else [])], MEMORY_SCHEMA)
