"""Variant spellings of names typed by people, linked when they mean one person, team or bot.

1. Every distinct author gets keys: the mailbox (case, tag, trailing dot and a misspelt domain put
   right, a rare domain being one slip away from a frequent one), the account name of a mailbox, the full
   name as folded, sorted tokens (initials, titles and remarks dropped), and the name a mailbox spells.
   Equal keys inside an org link to the smallest author of the key (a star, not all pairs).
2. All spellings (full names, names with initials, account names) are joined with the full names of the org
   by a prefix-filtered set-similarity join on token q-grams: grams weigh more the rarer they are, a spelling
   must share ``SHARE`` of its weight, and only the heaviest grams that this leaves no way around are looked up,
   so the grams of common names join nothing.
3. A pair is verified by a soft weighted token similarity, in which rare tokens count more and a token may be
   slipped, abbreviated to an initial, a nickname, or run together with the next. Slips link if not both
   mailboxes spell the token as it stands there; initials, nicknames and account names link where exactly one
   person of the org is meant.
4. The links' connected components are the persons; their authors are paired.

Mailboxes of roles, and mailboxes under which unlike names write, link nobody by themselves;
neither do placeholder names.

Defined results: null name or mailbox counts as empty; an author with neither has no pair;
repeated rows count once; a null org is ignored; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.components import connected_components
from strataloom.session import cut

#: Words that name a role or nobody.
ROLES = frozenset("dev developer developers root admin administrator user users test tester info mail email office contact support help team build builder builds ci bot git noreply no-reply unknown none null nobody anonymous anon guest system service ubuntu localhost me author default your name example ops deploy release releases webmaster postmaster hello staff".split())
TITLES = frozenset("phd dr prof mr mrs ms mx sir jr sr ii iii iv msc bsc ma mba md eng dipl ing via contractor ext external intern extern".split())
#: Given names and the short forms in use for them.
NICKNAMES = {
    "alexander": "alex xander sandy sasha lex al", "alexandra": "alex sandra sasha lexi", "aleksandra": "ola sasha alex", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "beatriz": "bea bia", "benjamin": "ben benny benji",
    "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothea": "thea dora dolly", "dorothy": "dot dottie dolly",
    "edward": "ed eddie ted ned", "ekaterina": "katya kate katia", "elizabeth": "liz beth lizzie betty eliza lisa bess", "francesca": "fran cesca franca", "frederick": "fred freddie rick", "gabriella": "gabi gabby ella", "giovanni": "gianni vanni",
    "gregory": "greg", "guadalupe": "lupe lupita", "henry": "harry hank", "ignacio": "nacho iggy", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie", "johannes": "hannes jan hans", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey",
    "josephine": "jo josie", "jose": "pepe", "katherine": "kate kathy kat katie kit", "lawrence": "larry", "margaret": "meg peggy maggie greta marge daisy", "matthew": "matt", "maximilian": "max maxi", "michael": "mike mick mickey mikey", "mohamed": "mo", "mohammed": "mo",
    "nicholas": "nick nico", "nikolai": "kolya nick niko", "patricia": "pat patty tricia", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob rob bobby", "samantha": "sam sammy", "samuel": "sam sammy",
    "stephen": "steve", "susannah": "sue susie anna", "theodora": "thea teddy dora", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori", "vladimir": "vova volodya", "william": "bill will billy willy liam", "zachary": "zach",
}
SHORT_FORMS = {short: tuple(sorted(full for full, forms in NICKNAMES.items() if short in forms.split())) for forms in NICKNAMES.values() for short in forms.split()}
#: Share of a spelling's gram weight that it must have in common with a full name.
SHARE = 0.5
_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "ı": "i"})
PARTICLES = frozenset("de la van von der den di da del du le al el bin ibn ter ten".split())


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS)


def name_parts(name: str) -> tuple[list[str], bool]:
    """Folded tokens of a name in order given name first, and whether it is a team or bot."""
    text = fold(name).replace("’", "'")
    text = re.sub(r"'+", "", text)
    inner = re.fullmatch(r"\s*([a-z]{2,5})\s*\((.+)\)\s*", text)
    if inner and "".join(w[0] for w in re.findall(r"[a-z]+", inner[2])) == inner[1]:
        text = inner[2]  # an abbreviation with what it stands for
    robot = "[bot]" in text
    text = re.sub(r"\[[^\]]*\]|\([^)]*\)|\bvia\b.*$", " ", text)
    head, comma, tail = text.partition(",")
    if comma and not set(re.findall(r"[a-z]+", tail)) <= TITLES:
        text = tail + " " + head
    tokens = [t for t in re.findall(r"[a-z]+|\d+", text) if t not in TITLES]
    return tokens, robot or "team" in tokens or "bot" in tokens or "ci" in tokens


def mailbox(address: str) -> tuple[str, str]:
    """(account without tag, domain); empty if there is none."""
    address = re.sub(r"\s+", "", address.lower()).strip("<>.,;")
    account, at, domain = address.rpartition("@")
    if not at:
        return "", ""
    if "noreply" in domain:
        account = account.split("+")[-1]
    else:
        account = account.split("+")[0]
    return account, domain


def split_person(tokens: list[str]) -> tuple[str, str] | None:
    """(given name, family name with particles joined); None without both."""
    full = [t for t in tokens if len(t) > 1 and not t.isdigit()]
    if len(full) < 2 or full[0] in PARTICLES:
        # family name first: particles before it belong to it
        k = 0
        while k < len(full) - 1 and full[k] in PARTICLES:
            k += 1
        if len(full) - k < 2:
            return None
        return full[k + 1], "".join(full[: k + 1])
    return full[0], "".join(full[1:])


def author_keys(name: str, address: str) -> dict:
    """Everything the joins need to know about one author."""
    tokens, group = name_parts(name)
    account, domain = mailbox(address)
    words = re.findall(r"[a-z]+", fold(account))
    role = bool(words) and (all(w in ROLES for w in words) or group and words[-1] == "team")
    if role and len(tokens) > 1 and any(w in tokens for w in words):
        group = True  # a name that goes with the role of its mailbox: a team, however it is spelt
    full = [t for t in tokens if len(t) > 1 and not t.isdigit() and t not in PARTICLES]
    joined = "".join(tokens)
    placeholder = not tokens or all(t in ROLES for t in tokens)
    out = {"mail": None, "account": None, "full": None, "spelt": None, "given": None, "family": None, "initial": None, "handle": None, "group": group, "letters": "".join(words)}
    if group:
        rest = sorted(t for t in tokens if not t.isdigit() and t not in ("bot",))
        out["full"] = "group:" + " ".join(rest) if len(rest) > 1 else None
        out["mail"] = f"{account}@{domain}" if account and domain else None
        return out
    if account and not role and not domain.endswith(".invalid"):
        out["mail"] = f"{account}@{domain}"
        if re.search(r"\d", account) or "noreply" in domain:
            out["account"] = account
        if len(words) >= 2 and all(len(w) > 1 for w in words):
            out["spelt"] = " ".join(sorted(words))
        out["handle"] = "".join(words)
    if placeholder:
        return out
    single = len(tokens) == 1 or (len(tokens) == 2 and tokens[1].isdigit())
    if not single and len(full) >= 2:
        person = split_person(tokens)
        if person:
            out["given"], out["family"] = person
            out["full"] = " ".join(sorted((person[0], person[1])))
            # A name without a blank may be an account name.
            out["handle"] = None if re.search(r"\s", name.strip()) else "".join(t for t in tokens if not t.isdigit())
    elif any(len(t) == 1 for t in tokens) and full:
        out["initial"] = next(t for t in tokens if len(t) == 1) + " " + "".join(t for t in tokens if len(t) > 1 and not t.isdigit())
    elif single and joined and not account:
        out["handle"] = re.sub(r"\d+", "", joined)
    return out


def person_forms(given: str, family: str) -> set[str]:
    """Account names that a full name can take."""
    forms = {given + family, family + given, given[0] + family, family + given[0], given + family[0], family + given[:2]}
    for short in NICKNAMES.get(given, "").split():
        forms |= {short + family, family + short, short + family[0]}
    return forms


def typing_distance(a: str, b: str, most: int = 2) -> int:
    """Edits with neighbouring letters swapped counting one, given up beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def token_grams(text: str, q: int = 3) -> list[str]:
    return sorted({t[k : k + q] for w in text.split() for t in (f"#{w}#",) for k in range(max(1, len(t) - q + 1))})


#: Likeness of a nickname and of an initial to the name they stand for.
NICKNAME, INITIAL = 0.95, 0.9


def token_likeness(a: str, b: str) -> float:
    """1 for equal tokens, less for a slip in a longer one, a nickname or an initial, 0 for others."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return INITIAL if long[0] == short else 0.0
    if b in NICKNAMES.get(a, "").split() or a in NICKNAMES.get(b, "").split():
        return NICKNAME
    slips = typing_distance(a, b)
    return 1 - slips / len(long) if slips <= (1 if len(short) < 8 else 2) and len(short) >= 4 else 0.0


def soft_similarity(a: str, b: str, weight: dict[str, float] | None = None) -> float:
    """Share of the token weight that finds a like token on the other side; rare tokens weigh more."""
    one, two = a.split(), b.split()
    total = got = 0.0
    for mine, theirs in ((one, two), (two, one)):
        for t in mine:
            w = (weight or {}).get(t, 1.0)
            total += w
            got += w * max((token_likeness(t, u) for u in theirs), default=0.0)
    return got / total if total else 0.0


def verdict(spelling: str, full: str, kind: str, spelt: Sequence[bool] = (False, False), other_spelt: Sequence[bool] = (False, False), weight: dict[str, float] | None = None, least: float = 0.85) -> str | None:
    """How a spelling means a full name (given and family): "slip", "short" (to be unique in the org), or None.

    ``spelt`` and ``other_spelt`` say whether a mailbox of the one or the other spells its given and its family name.
    """
    given, family = full.split()
    if kind == "handle":
        return "short" if spelling in person_forms(given, family) else None
    if spelling == full or soft_similarity(spelling, full, weight) < least:
        return None
    one, two = spelling.split(), full.split()
    if sorted(one) == sorted(two):
        return None  # the same tokens are one key
    pairs = min(([(one[0], two[i]), (one[1], two[1 - i])] for i in (0, 1)), key=lambda ps: -sum(token_likeness(x, y) for x, y in ps)) if len(one) == 2 else []
    unlike = [(x, y) for x, y in pairs if x != y]
    if not unlike or any(token_likeness(x, y) == 0 for x, y in unlike):
        return None
    if any(min(len(x), len(y)) == 1 or token_likeness(x, y) == NICKNAME for x, y in unlike):
        return "short" if len(unlike) == 1 else None
    # Two mailboxes that each spell the token as it stands there belong to two persons.
    return None if any(spelt[one.index(x)] and other_spelt[two.index(y)] for x, y in unlike) else "slip"


_KEY_SCHEMA = "org_id int, author string, mail string, account string, full string, spelt string, given string, family string, initial string, handle string, `group` boolean, letters string"


def _keys(authors: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [author_keys(n, e) for n, e in zip(part["name"], part["email"])]
            keys = pd.DataFrame(rows, columns=["mail", "account", "full", "spelt", "given", "family", "initial", "handle", "group", "letters"])
            yield pd.concat([part[["org_id", "author"]].reset_index(drop=True), keys], axis=1)

    return authors.mapInPandas(run, _KEY_SCHEMA)


def _stars(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges from every author of a key to the key's smallest author, over all kinds of keys at once."""
    tag = lambda letter, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(letter + ":"), F.col(c)))
    named = F.array_distinct(F.array_compact(F.array(tag("name", "full"), tag("mail", "mail"), tag("account", "account"), tag("name", "spelt"))))
    held = keys.join(shared.withColumn("is_shared", F.lit(True)), ["org_id", "mail"], "left")
    # What comes from a shared mailbox is no key; the name is.
    usable = F.when(F.col("is_shared"), F.array_compact(F.array(tag("name", "full")))).otherwise(named)
    long = held.select("org_id", "author", F.explode(usable).alias("key"))
    head = long.groupBy("org_id", "key").agg(F.min("author").alias("head"), F.max("author").alias("last")).filter("head <> last").drop("last")
    return long.join(head, ["org_id", "key"]).filter("author <> head").select("org_id", F.col("author").alias("a"), F.col("head").alias("b"))


def _components(edges: DataFrame) -> DataFrame:
    """(org_id, author, person) for authors with an edge."""
    node = lambda c: F.concat_ws("\x1f", F.col("org_id").cast("string"), F.col(c))
    found = connected_components(edges.select(node("a").alias("src"), node("b").alias("dst")))
    cut_at = F.instr("node", "\x1f")
    return found.select(F.substring("node", F.lit(1), cut_at - 1).cast("int").alias("org_id"), F.substring("node", cut_at + 1, F.length("node")).alias("author"), F.col("component").alias("person"))


def unlike_names(x: str, y: str) -> bool:
    return not any(t == u or (min(len(t), len(u)) > 3 and typing_distance(t, u) <= 2) or t in u or u in t for t in x.split() for u in y.split())


def _any_unlike(names: pd.Series) -> pd.Series:
    """Whether two of the names are unlike; mailboxes of many people mostly tell at the first pairs."""
    return pd.Series([any(unlike_names(x, y) for x, y in combinations(held, 2)) for held in names], dtype=bool)


def link_authors(commits: DataFrame, projects: DataFrame, q: int = 3, share: float = SHARE) -> DataFrame:
    """(org_id, author, person): authors that share a person with another author."""
    source = commits.select("project_id", "author_name", "author_email").join(projects.filter("org_id IS NOT NULL").select(F.col("id").alias("project_id"), "org_id"), "project_id")
    authors = source.select("org_id", F.coalesce("author_name", F.lit("")).alias("name"), F.coalesce("author_email", F.lit("")).alias("email")).distinct()
    authors = authors.groupBy("org_id", F.concat("name", F.lit(" <"), "email", F.lit(">")).alias("author")).agg(F.min(F.struct("name", "email")).alias("x")).select("org_id", "author", "x.name", "x.email")
    keys = _keys(authors)
    fixes = _domain_fixes(keys)
    domain = F.regexp_extract("mail", "@(.*)$", 1)
    put_right = F.concat(F.regexp_extract("mail", "^(.*@)", 1), F.coalesce("better", "domain"))
    keys = cut(keys.withColumn("domain", domain).join(fixes, "domain", "left").withColumn("mail", F.when(F.col("mail").isNotNull(), put_right)).drop("domain", "better"))

    # Mailboxes under which unlike names write are shared; every two of a mailbox's names are held against each other.
    unlike = F.pandas_udf(_any_unlike, "boolean")
    held = keys.filter("mail IS NOT NULL AND full IS NOT NULL").groupBy("org_id", "mail").agg(F.sort_array(F.collect_set("full")).alias("names")).filter("size(names) > 1")
    shared = held.filter(unlike("names")).select("org_id", "mail")
    first = cut(_stars(keys, shared))
    persons = cut(_components(first))
    person = F.coalesce("person", F.concat_ws("\x1f", F.col("org_id").cast("string"), "author"))
    known = cut(keys.join(persons, ["org_id", "author"], "left").withColumn("person", person))
    return _components(first.unionByName(_spelling_links(known, q, share)))


def _domain_fixes(keys: DataFrame) -> DataFrame:
    """(domain, better): domains one slip away from a domain that is ten times as frequent, found by equal spellings with one letter left out."""
    domains = keys.filter("mail IS NOT NULL").groupBy(F.regexp_extract("mail", "@(.*)$", 1).alias("domain")).agg(F.count("*").alias("n"))
    cuts = F.expr("array_distinct(array_append(transform(sequence(1, length(domain)), k -> concat(substring(domain, 1, k - 1), substring(domain, k + 1))), domain))")
    each = domains.filter("length(domain) > 3").select("domain", "n", F.explode(cuts).alias("cut"))
    near = each.alias("a").join(each.alias("b"), F.expr("a.cut = b.cut AND a.domain <> b.domain AND b.n >= 10 * a.n"))
    one_slip = F.pandas_udf(lambda x, y: pd.Series([typing_distance(a, b, 1) <= 1 for a, b in zip(x, y)], dtype=bool), "boolean")
    pairs = near.select(F.col("a.domain").alias("domain"), F.col("b.domain").alias("to"), F.col("b.n").alias("n")).distinct().filter(one_slip("domain", "to"))
    return pairs.groupBy("domain").agg(F.max_by("to", F.struct("n", "to")).alias("better"))


def _spelling_links(known: DataFrame, q: int, share: float) -> DataFrame:
    """(org_id, a, b): links that the q-gram join of spellings with full names gives."""
    own = ["org_id", "kind", "spelling"]
    meant = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.col(c).alias("spelling"))) for c in ("named", "initial", "handle")]
    each = known.withColumn("named", F.concat_ws(" ", "given", "family")).withColumn("named", F.when(F.col("given").isNotNull(), F.col("named")))
    # What the mailboxes under a spelling spell of it, taken together.
    spelt = [F.coalesce(F.contains("letters", F.col(c)), F.lit(False)).alias(f"{c}_spelt") for c in ("given", "family")]
    each = each.select("org_id", "author", "person", *spelt, F.explode(F.array_compact(F.array(*meant))).alias("m")).select("org_id", "author", "person", "given_spelt", "family_spelt", "m.*")
    whole = cut(each.groupBy(*own, "person").agg(F.min("author").alias("author"), F.max("given_spelt").alias("given_spelt"), F.max("family_spelt").alias("family_spelt")))
    flags = [F.max(f"{c}_spelt").alias(f"{c}_spelt") for c in ("given", "family")]
    spellings = cut(whole.groupBy(*own).agg(F.min("author").alias("author"), F.min("person").alias("person"), F.max("person").alias("person_to"), *flags))

    grams = F.pandas_udf(lambda s: s.map(lambda x: token_grams(x, q)), "array<string>")
    texts = spellings.select(*own).distinct()
    long = texts.select(*own, F.explode(grams("spelling")).alias("gram"))
    names = long.filter("kind = 'named'")
    total = texts.filter("kind = 'named'").groupBy("org_id").agg(F.count("*").alias("all"))
    weight = names.groupBy("org_id", "gram").agg(F.count("*").alias("df")).join(total, "org_id").select("org_id", "gram", F.log(1 + F.col("all") / F.col("df")).alias("w"))
    # Grams of no full name weigh nothing here: no pair can share them, so the share is of what can be shared.
    weighed = long.join(weight, ["org_id", "gram"])
    heavy = Window.partitionBy(*own).orderBy(F.col("w").desc(), "gram")
    before = F.coalesce(F.sum("w").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = weighed.withColumn("before", before).withColumn("sum", F.sum("w").over(Window.partitionBy(*own)))
    # What the grams after these weigh together is less than the share asked for, so a pair shares one of these.
    prefix = ranked.filter(F.col("before") <= (1 - share) * F.col("sum")).select(*own, "gram")
    target = names.select("org_id", "gram", F.col("spelling").alias("full"))
    pairs = prefix.join(target, ["org_id", "gram"]).filter("NOT (kind = 'named' AND spelling = full)").select(*own, "full").distinct()

    tokens = texts.select("org_id", "spelling", F.explode(F.split("spelling", " ")).alias("token")).distinct()
    rare = tokens.groupBy("org_id", "token").agg(F.countDistinct("spelling").alias("c")).join(total, "org_id").select("org_id", "token", F.log(1 + F.col("all") / F.col("c")).alias("w"))
    weights = cut(tokens.join(rare, ["org_id", "token"]).groupBy("org_id", "spelling").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("weights")))
    fulls = spellings.filter("kind = 'named'").select("org_id", F.col("spelling").alias("full"), F.col("author").alias("author2"), F.col("person").alias("person2"), F.col("person_to").alias("person3"), F.array("given_spelt", "family_spelt").alias("spelt2"))
    sides = spellings.select(*own, F.array("given_spelt", "family_spelt").alias("spelt"))
    theirs = weights.select("org_id", F.col("spelling").alias("full"), F.col("weights").alias("weights2"))
    known_pairs = pairs.join(sides, own).join(weights, ["org_id", "spelling"]).join(fulls.join(theirs, ["org_id", "full"]), ["org_id", "full"])

    def judge(s: pd.Series, f: pd.Series, k: pd.Series, x: pd.Series, y: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([verdict(*row[:5], dict(row[5] or {}) | dict(row[6] or {})) for row in zip(s, f, k, x, y, wa, wb)], dtype=object)

    told = cut(known_pairs.withColumn("verdict", F.pandas_udf(judge, "string")("spelling", "full", "kind", "spelt", "spelt2", "weights", "weights2")).filter("verdict IS NOT NULL").select(*own, "verdict", "author2", "person2", "person3"))
    by = whole.select(*own, "author", "person")
    slips = told.filter("verdict = 'slip'").join(by, own).filter("person <> person2").select("org_id", F.col("author").alias("a"), F.col("author2").alias("b"))
    # Initials, nicknames and account names: one person of the org in all, and another than the one who asks.
    one = told.filter("verdict = 'short'").groupBy(*own).agg(F.min("person2").alias("p"), F.max("person3").alias("p2"), F.min("author2").alias("b")).filter("p = p2")
    return slips.unionByName(one.join(by, own).filter("person <> p").select("org_id", F.col("author").alias("a"), "b"))


def author_pairs(linked: DataFrame) -> DataFrame:
    """(org_id, author_a, author_b), a < b, of the authors of one person; their number is that of a person's spellings."""
    a, b = linked.alias("a"), linked.alias("b")
    on = F.expr("a.org_id = b.org_id AND a.person = b.person AND a.author < b.author")
    return a.join(b, on).select("a.org_id", F.col("a.author").alias("author_a"), F.col("b.author").alias("author_b"))
