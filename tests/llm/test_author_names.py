"""Linking the spellings of authors."""

import itertools

import pytest

from strataloom.llm import author_names as an
from tests.conftest import rows

PEOPLE = [
    [("Jürgen Fenland", "jfenland@firm1.example"), ("Fenland, Jürgen", "jfenland@firm1.example"), ("jurgen fenland", "jurgenf74@inbox.test"), ("jurgenf74", "204+jurgenf74@users.noreply.forge.example"), ("Jürgen L. Fenland", "JFENLAND@FIRM1.EXAMPLE"), ("j.fenland", None), ("Jürgen Fenland", "dev@firm1.example")],
    [("Jürgen Norenko", "norenko.jurgen@firm1.example"), ("Norenko Jürgen", "jurgen.norenko8@webmail.example")],
    [("Guadalupe Osenko", "gosenko@firm1.example"), ("Lupe Osenko", "lupeosenko@webmail.example"), ("Guadalupe Osnko", "guadalupeo77@mailbox.example")],
    [("William Zeldahl", "zeldahl.william@firm1.example"), ("William Zelldahl", "zeldahl.william@firm1.example"), ("Bill Zeldahl", None)],
    [("Firm Payments Team", "payments@firm1.example"), ("FPT (Firm Payments Team)", "payments@firm1.example"), ("Payments Team, Firm", ""), ("firm-payments-team", "payments-team@firm1.example")],
    [("firm-ci[bot]", "ci@firm1.example"), ("Firm CI", "ci@firm1.example")],
    [("Odile Belland", "odile.belland@firm1.example"), ("Odile Belland", "dev@firm1.example")],
    [("Odile Velland", "odile.velland@firm1.example")], [("dev", "dev@firm1.example")], [("unknown", None)], [("root", "root@build-1.invalid")], [(None, None)], [("", "rosa_thurland@firm1.example"), ("Rosa Thurland", "rosa_thurland@firm1.example")],
]


@pytest.fixture(scope="module")
def tables(spark):
    authors = [a for p in PEOPLE for a in p]
    commits = spark.createDataFrame([(1, n, e, 5, "x") for n, e in authors * 2] + [(2, "Rosa Thurland", "rosa@other.example", 5, "x"), (3, "Lost", "x@y.example", 5, "x")], "project_id int, author_name string, author_email string, org_id int, author string")
    projects = spark.createDataFrame([(1, 7, "p"), (2, 8, "q"), (3, None, "r")], "id int, org_id int, author string")
    return commits, projects


def test_persons(tables):
    text = lambda a: f"{a[0] or ''} <{a[1] or ''}>"
    want = {(7, *sorted((text(a), text(b)))) for p in PEOPLE for a, b in itertools.combinations(p, 2)}
    got = {tuple(r) for r in an.author_pairs(an.link_authors(*tables)).collect()}
    assert got - want == set() and want - got == set()


def test_empty(tables):
    commits, projects = tables
    assert an.author_pairs(an.link_authors(commits.limit(0), projects)).count() == 0
    assert rows(an.author_pairs(an.link_authors(commits.filter("author_name = 'dev'"), projects))) == []


def test_mailbox_of_several_people_with_alike_ends(spark):
    people = [("Alex Miller", "am@x.example"), ("John Smith", "js@x.example"), ("Tom Miller", "tm@x.example")]
    commits = spark.createDataFrame([(1, n, e) for n, own in people for e in (own, "crew9@firm.example")], "project_id int, author_name string, author_email string")
    projects = spark.createDataFrame([(1, 7)], "id int, org_id int")
    got = {(r.author_a.split(" <")[0], r.author_b.split(" <")[0]) for r in an.author_pairs(an.link_authors(commits, projects)).collect()}
    assert got == {(n, n) for n, _ in people}


def test_keys():
    assert an.mailbox(" Ann+git@Firm.Example. ") == ("ann", "firm.example")
    assert an.mailbox("12+ann@users.noreply.forge.example")[0] == "ann"
    assert an.split_person(["de", "la", "marski", "yuki"]) == ("yuki", "delamarski")
    assert an.author_keys("Odile O’Velbury, PhD", "")["full"] == "odile ovelbury"
    assert an.author_keys("C. Körvane", "")["initial"] == "c korvane" and an.author_keys("E de la Korvane", "")["initial"] == "e delakorvane"


def test_typing_distance_and_similarity():
    assert an.typing_distance("ulworth", "uwlorth") == 1 and an.typing_distance("abc", "abcdef") == 3 and an.typing_distance("", "a") == 1
    said = lambda a, b, kind="named", x=(0, 0), y=(0, 0): an.verdict(a, b, kind, x, y)
    assert said("rosa thuland", "rosa thurland") == "slip" and said("rosa thurland", "rosa thurborg") is None and said("ann li", "ann lo") is None
    assert said("thurlnad jhoannes", "johannes thurland") == "slip" and said("rosa velland", "rosa belland", "named", (1, 1), (1, 1)) is None and said("rosa velland", "rosa belland", "named", (1, 0), (1, 1)) == "slip"
    assert said("bill zeldahl", "william zeldahl") == "short" == said("w zeldahl", "william zeldahl", "initial") == said("wzeldahl", "william zeldahl", "handle") and said("wz", "william zeldahl", "handle") is None
    rare, common = {"rosa": 0.2, "thurland": 3.0}, {"rosa": 3.0, "thurland": 0.2}
    assert an.soft_similarity("rosa thurland", "rosa velborg", common) > an.soft_similarity("rosa thurland", "rosa velborg", rare)


def test_a_misspelt_domain_is_told_by_its_frequency(spark):
    given = "Oswin Tamsin Beatriz Quentin Farid Leena Ulrike Wanja Zeno Ximena Hye Dilnoza".split()
    family = "Holm Brack Vesper Lund Tarn Quill Moss Yarrow Fenn Dace Ruck Ilex".split()
    rows_ = [(1, f"{g} {f}", f"{chr(97 + k)}qz@firm.example") for k, (g, f) in enumerate(zip(given, family))] + [(1, "", "dqz@firm.exampel"), (1, "", "eqz@firn.example"), (1, "", "fqz@form.sample")]
    commits = spark.createDataFrame(rows_, "project_id int, author_name string, author_email string")
    got = {(r.author_a, r.author_b) for r in an.author_pairs(an.link_authors(commits, spark.createDataFrame([(1, 7)], "id int, org_id int"))).collect()}
    assert got == {(" <dqz@firm.exampel>", "Quentin Lund <dqz@firm.example>"), (" <eqz@firn.example>", "Farid Tarn <eqz@firm.example>")}


def test_a_common_given_name_joins_nobody(spark):
    """A third of all names share a given name: no pair of them comes out of the join but through the family name."""
    names = [f"Maximilian {a}{b}{c}" for a in ("Ul", "Ver", "Kor", "Hol") for b in ("ba", "di", "gro", "mu") for c in ("rens", "tigg", "pol")] + ["Maximilian Verdirens", "Maxi Ulbarens", "M. Kormupol"]
    commits = spark.createDataFrame([(1, n, None) for n in names], "project_id int, author_name string, author_email string")
    got = {(r.author_a, r.author_b) for r in an.author_pairs(an.link_authors(commits, spark.createDataFrame([(1, 7)], "id int, org_id int"))).collect()}
    assert got == {("Maxi Ulbarens <>", "Maximilian Ulbarens <>"), ("M. Kormupol <>", "Maximilian Kormupol <>")}
