"""Scanning a source tree and version-control changes into DataFrames."""

from __future__ import annotations

import subprocess
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import glob_pattern

#: Languages by extension, what is never read, and the largest file.
LANGUAGES = {"js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx", "php": "php", "py": "python", "pyi": "python", "go": "go", "json": "json", "html": "html", "htm": "html", "css": "css", "scss": "scss", "xml": "xml"}
DOC_EXTENSIONS = ("md", "mdx")
IGNORED = ("node_modules", ".git", "vendor", "dist", "build", "coverage", ".next", "__pycache__", ".venv", "venv", "target", ".cache")
MAX_BYTES = 1 << 20


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def ignore_patterns(gitignore: str) -> list[tuple[str, bool]]:
    """(anchored regular expression, whether it takes back) of the lines of an ignore file, in order."""
    out = []
    for raw in gitignore.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        anchored = "/" in line.rstrip("/")
        folder = line.endswith("/")
        body = glob_pattern(line.strip("/"))[1:-1]
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", back))
    return out


def ignored(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Whether a path is ignored by default folders or an ignore file; the last line that matches decides."""
    default = path.rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")
    verdict = F.lit(False)
    for pattern, back in patterns:
        verdict = F.when(path.rlike(pattern), F.lit(not back)).otherwise(verdict)
    return default | verdict


def scan_tree(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(path, language, content, hash, loc, error) of every readable source and Markdown file below a folder.

    Files over the size limit are skipped; NUL characters are taken out before hashing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quote(base) + "/", "")
    rows = raw.filter(F.col("length") <= MAX_BYTES).select(path.alias("path"), "content")
    rows = rows.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() | F.lower("path").rlike(r"\.(" + "|".join(DOC_EXTENSIONS) + ")$"))
    rows = rows.filter(~ignored(F.col("path"), ignore_patterns(gitignore)))
    text = F.translate(F.decode("content", "UTF-8"), "\x00", "")
    return rows.select("path", "language", text.alias("content")).select("path", "language", "content", F.sha2("content", 256).alias("hash"), (F.length("content") - F.length(F.translate("content", "\n", "")) + 1).alias("loc"))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def to_process(present: DataFrame, manifest: DataFrame) -> DataFrame:
    """Present files whose hash is not the recorded one: what a scan has to parse again."""
    old = manifest.select("path", F.col("hash").alias("known"))
    return present.join(old, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("known"))).drop("known")


def version_changes(spark: SparkSession, root: str, since: str | None) -> DataFrame | None:
    """(path, change) between a recorded commit and the working tree, or None when only a full scan is sound.

    A full scan is needed without a recorded commit or when it is no ancestor of the present one. Paths are
    relative to ``root`` also when it is a folder inside the work tree; renames are a removal and an addition.
    """
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    if not since or git("merge-base", "--is-ancestor", since, "HEAD").returncode:
        return None
    prefix = git("rev-parse", "--show-prefix").stdout.strip()
    rows = []
    for line in git("diff", "--name-status", "--no-renames", since, "--").stdout.splitlines():
        status, _, name = line.partition("\t")
        if name.startswith(prefix):
            rows.append((name[len(prefix) :], {"A": "added", "D": "removed"}.get(status, "changed")))
    rows += [(name, "added") for name in git("ls-files", "--others", "--exclude-standard").stdout.splitlines()]
    return spark.createDataFrame([(str(PurePosixPath(p)), c) for p, c in rows], "path string, change string")
