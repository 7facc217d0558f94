"""Scalar text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that label nothing.
STOPWORDS = (
    "fix fixes fixed fixing bug bugs issue issues feat chore refactor docs test tests revert merge the a an and or but not for with without from into onto when where while that this these those then than there here "
    "was were been being are is be it its in on at to of by as so if we our you your they their no do does did doesn don didn should would could can will add adds added make makes made use uses used now still only "
    "just also instead rather after before again one two all any some more most"
).split()


def tokens(text: Column) -> Column:
    """Every [a-z0-9_]+ run in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != "")


def cluster_tokens(text: Column) -> Column:
    """Tokens worth clustering on: three letters or more, no stop-word, no plain number."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS) & ~t.rlike("^[0-9]+$"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def search_subject(subject: Column) -> Column:
    """A commit subject without its conventional prefix and issue numbers, as a query."""
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*(?:\w+\s*(?:\([^)]*\))?!?:)\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\(?#\d+\)?", " "), r"\s+", " "))


def statement_norm(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), r"[.!?;:,]+$", "")


def content_key(prefix: str, *parts: Column) -> Column:
    """``prefix`` and twelve hex digits of the parts joined by ``|``; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 12))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def module_path(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` directories of a path; the root is ``.``."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.least(F.size(parts) - 1, F.lit(max(1, depth))), F.lit(0)))
    return F.when(F.size(folders) == 0, ".").otherwise(F.array_join(folders, "/"))


def common_scope(paths: Column) -> Column:
    """The narrowest glob over all paths: the path itself, ``dir/**``, or null for everywhere."""
    clean = F.filter(paths, lambda p: p.isNotNull() & (p != ""))
    folders = F.transform(clean, lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1))
    same = lambda acc, x: F.aggregate(  # noqa: E731 - how many leading folders agree
        F.sequence(F.lit(0), F.size(acc)), F.lit(0), lambda n, i: F.when((n == i) & (i < F.size(acc)) & (i < F.size(x)) & F.get(acc, i).eqNullSafe(F.get(x, i)), n + 1).otherwise(n)
    )
    shared = F.aggregate(F.slice(folders, F.lit(2), F.greatest(F.size(folders) - 1, F.lit(0))), F.get(folders, F.lit(0)), lambda acc, x: F.slice(acc, F.lit(1), same(acc, x)))
    return F.when(F.size(clean) == 1, F.element_at(clean, 1)).when((F.size(clean) > 1) & (F.size(shared) > 0), F.concat(F.array_join(shared, "/"), F.lit("/**")))


def path_in_scope(path: Column, glob: str | None) -> Column:
    """Whether a rule of this scope applies to the path; no scope applies everywhere."""
    if not glob:
        return F.lit(True)
    return (path == glob) | path.rlike(glob_pattern(glob))


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    import re

    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out, k = out + "(?:" + "|".join(map(re.escape, glob[k + 1 : end].split(","))) + ")", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"
