"""What commit messages say: fixes, reverts, issue references, co-authors. Native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and words that decide the results.
FIX_TYPE = r"(?i)(^|[-–—:|/\\\]\s])\s*(fix|fixes|fixed|bugfix|hotfix)(\([^)]*\))?\s*:"
FIX_NOISE = r"^\s*(\[[^\]]*\]|\([^)]*\)|[A-Z][A-Z0-9]{1,9}-\d{1,7}|[^:]{1,40}\s[-–—]\s)\s*"
FIX_FIRST = r"(?i)^\s*(fix|fixes|fixed|fixing|bugfix|hotfix|regression)\b"
REVERT_SUBJECT = r"(?i)\brevert(s|ed|ing)?\b"
REVERT_BODY = r"(?im)^This reverts commit\b"
CLOSING = r"(?i)\b(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\s*:?\s+(?:https?://\S*?/(?:issues|pull)/\d+|#\d{1,7}|[A-Z][A-Z0-9]{1,9}-\d{1,7})\b"
ISSUE_URL = r"(?i)https?://github\.com/[\w.-]+/[\w.-]+/(?:issues|pull)/\d+"
TRACKER_URL = r"(?i)https?://[\w.-]+/browse/[A-Z][A-Z0-9]{1,9}-\d{1,7}"
HASH_REF = r"(?:^|[^\w#/&])#(\d{1,7})(?![\w-])"
TRACKER_KEY = r"\b[A-Z][A-Z0-9]{1,9}-\d{1,7}\b"
NOT_TRACKERS = "UTF ISO SHA RFC AES RSA HTTP HTTPS IPV CVE MD5 UTC GMT API JSON HTML CSS SQL TLS SSL OAUTH BASE WIN MAC LATIN ES EC X PHP NODE PG V".split()
COAUTHOR = r"(?im)^\s*co-authored-by:\s*.*?\s*<[^>]+>\s*$"


def is_fix(subject: Column) -> Column:
    """The fix word in type position, or first once a ticket or a name is taken off."""
    s = F.coalesce(subject, F.lit(""))
    return s.rlike(FIX_TYPE) | F.regexp_replace(s, FIX_NOISE, "").rlike(FIX_FIRST)


def is_revert(subject: Column, body: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(REVERT_SUBJECT) | F.coalesce(body, F.lit("")).rlike(REVERT_BODY)


def person_key(name: Column, email: Column) -> Column:
    """The address in lower case, else ``name:`` and the name."""
    address = F.nullif(F.lower(F.trim(F.coalesce(email, F.lit("")))), F.lit(""))
    return F.coalesce(address, F.concat(F.lit("name:"), F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))))))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def issue_refs(messages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tracker, issue, relation, url): one row per issue; a closing word wins, any address is kept."""
    m = F.coalesce(F.col(text), F.lit(""))
    null = F.lit(None).cast("string")
    one = lambda tracker, issue, url, relation: F.struct(F.lit(tracker).alias("tracker"), issue.alias("issue"), url.alias("url"), F.lit(relation).alias("relation"))
    number = lambda x: F.regexp_extract(x, r"(\d+)$", 1)
    ticket = lambda x: F.regexp_extract(x, r"([A-Za-z][A-Za-z0-9]{1,9}-\d{1,7})$", 1)
    closing = _found(m, CLOSING)
    is_ticket = lambda x: (ticket(x) != "") & ~x.rlike(r"#\d+$|/(issues|pull)/\d+$")
    refs = F.concat(
        F.transform(F.filter(closing, lambda x: ~is_ticket(x)), lambda x: one("github", number(x), null, "FIXES")),
        F.transform(F.filter(closing, is_ticket), lambda x: one("jira", ticket(x), null, "FIXES")),
        F.transform(_found(m, ISSUE_URL), lambda x: one("github", number(x), x, "REFERENCES")),
        F.transform(_found(m, TRACKER_URL), lambda x: one("jira", ticket(x), x, "REFERENCES")),
        F.transform(_found(m, HASH_REF, 1), lambda x: one("github", x, null, "REFERENCES")),
        F.transform(F.filter(_found(m, TRACKER_KEY), lambda x: ~F.split(x, "-")[0].isin(*NOT_TRACKERS)), lambda x: one("jira", x, null, "REFERENCES")),
    )
    rows = messages.filter(m.rlike(r"#\d|[A-Za-z]-\d|/(issues|pull)/")).select(key, F.posexplode(refs).alias("at", "r"))
    first_url = F.min_by("r.url", F.when(F.col("r.url").isNotNull(), F.col("at")))
    return rows.groupBy(key, F.col("r.tracker").alias("tracker"), F.col("r.issue").alias("issue")).agg(
        F.when(F.bool_or(F.col("r.relation") == "FIXES"), "FIXES").otherwise("REFERENCES").alias("relation"), first_url.alias("url")
    )


def co_authors(messages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, email): trailers, the first of each address."""
    trailers = _found(F.coalesce(F.col(text), F.lit("")), COAUTHOR)
    rows = messages.filter(F.col(text).rlike(r"(?i)co-authored-by:")).select(key, F.posexplode(trailers).alias("at", "line"))
    email = F.lower(F.trim(F.regexp_extract("line", r"<([^>]+)>", 1)))
    name = F.trim(F.regexp_extract("line", r"(?i)co-authored-by:\s*(.*?)\s*<", 1))
    return rows.select(key, "at", email.alias("email"), name.alias("name")).filter("email <> ''").groupBy(key, "email").agg(F.coalesce(F.nullif(F.min_by("name", "at"), F.lit("")), F.col("email")).alias("name"))
