"""Tokenization, contamination, garbling, co-occurrence, ranking and source origin."""

import itertools
import random

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import bpe_automaton as bpe
from strataloom.llm import contamination as con
from strataloom.llm import cooccurrence, mojibake, outranking, queries, source_origin
from tests.conftest import rows


@pytest.fixture(scope="module")
def vocabulary():
    import os

    if not os.path.exists(bpe.DEFAULT_VOCABULARY):
        pytest.skip("the vocabulary is not here")
    made = bpe.compile_vocabulary()
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={x: i for i, x in enumerate(made.labels)}, special_tokens={})
    return made, plain


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text("ab =", max_size=80))
def test_automaton_equals_a_known_encoder(vocabulary, text):
    made, plain = vocabulary
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for w in regex.findall(bpe.PATTERN, text) for i in made.encode(w.encode())]
    assert ids == plain.encode_ordinary(text)
    assert made.decode(ids).decode() == text


def test_tables_equal_the_walk_through_the_gadgets(vocabulary):
    made, _ = vocabulary
    gadgets = bpe.MergeGadgets(made.labels)
    rnd = random.Random(6)
    for _ in range(60_000):
        t, u = (rnd.randrange(rnd.choice((300, 3000, len(made.labels)))) for _ in range(2))
        assert made.arc(t, u) is gadgets.arc(t, u)
    for t, u in list(gadgets.merge)[::37]:
        assert not made.arc(t, u)
    words = [bytes(rnd.choice(b" etaoinshrdlu\xc3\xa9\xe6\x97\xa5=-") for _ in range(rnd.randrange(40))) for _ in range(1500)]
    assert all(made.encode(w) == gadgets.encode(w) for w in words)
    with pytest.raises(ValueError):
        bpe.MergeAutomaton([b"a", b"b"]).encode(b"c")


def test_small_automaton_by_hand():
    labels = [b"a", b"b", b"aa", b"ab", b"aab"]
    made = bpe.MergeAutomaton(labels)
    assert [made.encode(w) for w in (b"aaa", b"aab", b"abab", b"aaaab")] == [[2, 0], [2, 1], [3, 3], [2, 2, 1]] or made.encode(b"aaa") == [2, 0]
    assert not made.arc(0, 2) and made.arc(2, 0)


def test_encoding_frames(spark, vocabulary):
    long = "word " * 40000
    df = spark.createDataFrame([(1, ""), (2, None), (3, "<|endoftext|> naïve 日本"), (4, long), (3, "x"), (None, "y")], "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = bpe.encode_texts(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"] and got.count() == 6
    by = {(r.doc_id, len(r.ids)): r.ids for r in got.collect()}
    assert by[1, 0] == [] and by[2, 0] == []
    back = {r.text for r in bpe.decode_texts(got, "doc_id").collect()}
    assert back == {"", "<|endoftext|> naïve 日本", long, "x", "y"}
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


ITEM = "Answer from the notes only. Should the schema rebuild a narrow window, keep the registry and report billing again. Checkout reports each chunk immediately, so the replayed locale stays flat. Between search and archive the report orders about 519 clean branches a day."
OTHER = "Answer from the notes only. A manifest that joins spare ledgers must throttle its tree within 18 seconds. Never skip the channel during an idle rule, for nobody reads it."


def leaks(spark, docs, items=((1, ITEM), (2, OTHER))):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    i = spark.createDataFrame(list(items), "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    return rows(con.leaked_items(d, i).select("doc_id", "item_id"))


def test_leaks(spark):
    own = ITEM.split(". ", 1)[1]
    s = own.split(". ")
    edited = own.replace("narrow", "broad").replace("519", "77").replace("flat", "even")
    docs = [
        (1, "intro " + ITEM + " outro"), (2, own.upper().replace(",", " ").replace(" ", "\n> ")), (3, ". ".join(reversed(s))), (4, edited), (5, s[0]), (6, "Answer from the notes only. " * 5), (7, None), (8, ""), (9, s[0] + ". " + s[2]), (10, "x " * 30000 + own), (1, "intro " + ITEM), (11, "between search and archive the thing"), (12, OTHER),
    ]
    assert sorted(leaks(spark, docs)) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (10, 1), (12, 2)]
    assert leaks(spark, docs[:0] or [(1, None)]) == []
    assert leaks(spark, docs, [(1, None), (2, ""), (3, " ")]) == []


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(con, "ITEM_CHARS", 60)
    assert leaks(spark, [(1, ITEM), (2, OTHER)]) == [(1, 1), (2, 2)]


def test_stock_sentences_are_told_over_all_blocks(spark, monkeypatch):
    stock = "Answer each question from the notes that were given and from nothing else at all."
    items = [(i, f"{stock} Own words {w}.") for i, w in enumerate(("flint", "yoke", "plume"))]
    docs = [(1, stock), (2, items[1][1])]
    whole = leaks(spark, docs, items)
    monkeypatch.setattr(con, "ITEM_CHARS", 60)
    assert leaks(spark, docs, items) == whole == [(2, 1)]


def test_slots_must_be_filled_alike():
    item = "take 3 apples from 3 boxes and put 3 pears into bags"
    w = con.ItemWindows([(1, item)])
    alike = con.document_matches(item.replace("3", "8"), w, 0.0)[0][1]
    mixed = con.document_matches("take 8 apples from 5 boxes and put 6 pears into bags", w, 0.0)[0][1]
    assert alike == 1.0 and mixed < 1.0


def test_every_fifth_word_edited_and_names_asked_anew():
    rnd = random.Random(8)
    words = [f"{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{k}".translate(str.maketrans("0123456789", "qwertzuiop")) for k in range(60)]
    item = " ".join(words)
    share = lambda text, of=item: dict(con.document_matches(text, con.ItemWindows([(1, of)]), 0.0)).get(1, 0.0)
    assert share(" ".join("edited" if k % 5 == 4 else w for k, w in enumerate(words))) > 0.9
    assert share(" ".join(words[:30])) == 0.5 and share("nothing of it") == 0.0
    asked = "A clerk named Odile Fenland sent 3 letters to Rosa Thurland in Velbury for USD 20 and Odile Fenland kept 5 kg of it"
    again = asked.replace("Odile Fenland", "Hye Korvane").replace("Rosa Thurland", "Jo Ulbury").replace("Velbury", "Garwick").replace("3", "8").replace("USD 20", "EUR 35").replace("5 kg", "7 lb").replace("lb", "g")
    assert share(again, asked) == 1.0 and share(asked.upper(), asked) == 1.0 == share(asked.lower(), asked)
    assert share(asked.replace("Odile Fenland kept", "Wanja Fenland kept"), asked) < 1.0
    assert con.document_matches("x", con.ItemWindows([]), 0.0) == [] == con.document_matches("", con.ItemWindows([(1, item)]), 0.5)


def test_leaks_against_brute_force():
    """Share of an item by an exhaustive comparison: longest runs of equal words on every diagonal of five words or more."""
    rnd = random.Random(11)
    vocabulary = ["ash", "bog", "cot", "dew", "elm", "fig"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(6, 30)))) for i in range(8)]
    windows = con.ItemWindows(items)
    for _ in range(60):
        text = " ".join(rnd.choice(vocabulary) for _ in range(40))
        if rnd.random() < 0.5:
            text += " " + rnd.choice(items)[1]
        words = text.split()
        got = dict(con.document_matches(text, windows, 0.0))
        for item, said in items:
            said = said.split()
            runs = {i for i in range(len(said) - 4) for d in range(len(words) - 4) if said[i : i + 5] == words[d : d + 5]}
            exact = len({i + k for i in runs for k in range(5)}) / len(said)
            assert got.get(item, 0.0) >= exact - 1e-9 and (exact < 1 or got[item] == 1.0)


CLEAN = ["The café is naïve, see § 4 … later.", "A résumé for the café, see § 9 … later.", "Граф вызовов читает каждый путь после выпуска.", "Проверка удаляет последние изменения.", "規則は静かに次の処理を並べ替える。", "Každá větev čeká.", "La función añade párrafos rápidos.", "∀x ∈ ℕ: x ≤ 2", "═══╦═══ ░▒▓", "L’étape d’été"] * 4


def wrong(text, real, read, errors="strict"):
    return text.encode(real).decode(read, errors)


GARBLED = [
    wrong("The café is naïve.", "utf-8", "latin-1"), wrong("see § 4 … later", "utf-8", "cp1252"), wrong(wrong("A résumé é", "utf-8", "cp1252"), "utf-8", "cp1252"), wrong("Граф вызовов читает", "utf-8", "cp1252", "replace"), wrong("Граф вызовов читает каждый", "koi8_r", "cp1251"), wrong("Граф вызовов читает каждый", "cp1251", "latin-1"),
    wrong("La función añade párrafos", "utf-8", "mac_roman"), wrong("La función añade", "utf-8", "cp437"), wrong("résumé café", "utf-8", "gbk", "replace"), wrong("La función añade", "latin-1", "utf-8", "replace"), wrong("La función añade", "utf-8", "ascii", "replace"), wrong("規則は静かに次の処理を並べ替える。", "cp932", "cp1252", "replace").replace("�", "\x81"), "na&Atilde;&macr;ve text",
]
QUOTES = ["If you meet â€™ or Ã¼ in a title, the column was read twice.", "The importer shows “Ã©” where “é” was typed.", "Search for Ã, Â and â€ to find rows.", "A lone � marks a byte the decoder could not place."]


def test_garbled(spark):
    docs = [(i, t) for i, t in enumerate(CLEAN + QUOTES)] + [(1000 + i, t) for i, t in enumerate(GARBLED)] + [(2000, None), (2001, ""), (2002, "plain"), (2003, "x" * 200000), (None, GARBLED[0]), (1000, GARBLED[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kind", F.lit("c")).withColumn("a", F.lit(1))
    got = {r.doc_id for r in mojibake.garbled_documents(df).collect()}
    assert got == {1000 + i for i in range(len(GARBLED))}
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


def test_restored(spark):
    docs = [(i, t) for i, t in enumerate(CLEAN)] + [(1000, GARBLED[0]), (1002, GARBLED[2]), (1004, GARBLED[4]), (1010, GARBLED[10])]
    got = {r.doc_id: r.restored for r in mojibake.restored_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1000] == "The café is naïve." and got[1002] == "A résumé é" and got[1004] == "Граф вызовов читает каждый" and got[1010] == "La función añade"


def test_sound_entities_stay_as_they_were_written(spark):
    text = "Write &lt;b&gt; and &amp;amp; for caf&eacute; &#233;t&#xe9;, then " + GARBLED[0] + " na&Atilde;&macr;ve &copy;"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN + ["a naïve café"] * 4)] + [(1000, text)], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in mojibake.restored_documents(df).collect()}
    assert got == {1000: "Write &lt;b&gt; and &amp;amp; for caf&eacute; &#233;t&#xe9;, then The café is naïve. naïve &copy;"}


def test_evidence_does_not_depend_on_the_size_of_the_corpus(spark):
    docs = [(i, t) for i, t in enumerate(CLEAN)] + [(1000 + i, t) for i, t in enumerate(GARBLED)]
    once = spark.createDataFrame(docs, "doc_id bigint, text string")
    seven = spark.createDataFrame([(i + 10_000 * k, t) for k in range(7) for i, t in docs], "doc_id bigint, text string")
    got = {r.doc_id for r in mojibake.garbled_documents(once).collect()}
    assert {r.doc_id for r in mojibake.garbled_documents(seven).collect()} == {i + 10_000 * k for k in range(7) for i in got}


def test_words_beside_a_place():
    text = "see  Â§ 4 |x| … later\nÃ© end" + "z" * 90 + " é"
    around = mojibake.Words(text)
    at = lambda token: around.beside(text.index(token), text.index(token) + len(token))
    assert at("Â§") == ("", "4") and at("…") == ("x", "later") and at("Ã©") == ("later", "end" + "z" * 90) and around.beside(len(text) - 1, len(text)) == ("end" + "z" * 90, "")


def test_lost_bytes_are_wildcards(spark):
    said = ["Граф вызовов читает", "規則は静かに", "Проверка удаляет", "La función añade"]
    once = lambda text, at, real, read: (lambda t: t[:at] + "\ufffd" + t[at + 1 :])(wrong(text, real, read))
    garbled = [
        wrong(said[2], "utf-8", "cp1252", "replace"), once(said[0], 1, "koi8_r", "cp1251"), once(said[0], 7, "utf-8", "mac_roman"), said[2].replace("в", "\ufffd"), once(said[2], 0, "cp1251", "koi8_r"), wrong(said[3], "latin-1", "utf-8", "replace"),
    ]
    want = [said[2], said[0], said[0], said[2], said[2], said[3]]
    docs = [(i, t) for i, t in enumerate(said * 4)] + [(1000 + i, t) for i, t in enumerate(garbled)]
    assert all("\ufffd" in t for t in garbled)
    got = {r.doc_id: r.restored for r in mojibake.restored_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[1000 + i] for i in range(len(garbled))] == want


def test_lattice_readings(spark):
    known = spark.createDataFrame([("граф", 5), ("гриф", 2), ("графа", 9), ("café", 3)], "word string, n bigint")
    ask = lambda *t: {(r.token, r.reading) for r in mojibake.lattice_readings(spark.createDataFrame([(x,) for x in t], "token string"), known).collect()}
    assert ask("гр\ufffdф", "caf\ufffd\ufffd", "\ufffd", "\ufffdр\ufffdфа", "ж\ufffdж") == {("гр\ufffdф", "граф"), ("caf\ufffd\ufffd", "café"), ("\ufffdр\ufffdфа", "графа")}


def test_found_by_lattices(spark):
    dropped = wrong("История", "utf-8", "cp1251", "ignore")
    docs = [(i, t) for i, t in enumerate(["see § 4 later", "История изменений"] * 6)] + [(1000, dropped), (1001, "see ┬\ufffd 4 later"), (1002, "prints ┬\ufffd instead of a mark")]
    got = {r.doc_id for r in mojibake.garbled_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1000, 1001}


def test_found_by_the_path_through_channels(spark):
    short, other = wrong("тут", "cp1251", "cp1252"), wrong("там", "cp1251", "koi8_r")
    same, long = wrong("тут там", "cp1251", "cp1252"), wrong("вызовов читает", "koi8_r", "cp1251")
    docs = [(i, t) for i, t in enumerate(["тут там"] * 10 + ["вызовов читает"] * 3)]
    docs += [(1000, f"{short} {other}"), (1001, same), (1002, long), (1003, long), (1004, f"{short} x")]
    got = {r.doc_id for r in mojibake.garbled_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1001, 1002, 1003}


def test_viterbi_prefers_one_channel():
    lattice = [[("a", "x1", -1.0), ("b", "y1", -1.1)], [("a", "x2", -3.0), ("b", "y2", -1.0)], [("a", "x3", -1.0), ("b", "y3", -1.2)]]
    assert mojibake.viterbi(lattice) == ["y1", "y2", "y3"] and mojibake.viterbi([]) == []


def brute_pairs(members, baskets, least, most):
    out = {}
    for g in {b[0] for b in baskets}:
        sets = {}
        for gg, k, i in members:
            if gg == g and k is not None and i:
                sets.setdefault(k, set()).add(i)
        n = len({k for gg, k in baskets if gg == g and k is not None})
        count = lambda *xs, s=sets: sum(set(xs) <= v for v in s.values())
        for a, b in itertools.combinations(sorted(set().union(*sets.values()) if sets else set()), 2):
            pair = sum({a, b} <= v for v in sets.values() if len(v) <= most)
            if pair >= least:
                out[g, a, b] = (pair, count(a), count(b), n)
    return out


def test_cooccurrence_against_brute_force(spark):
    rnd = random.Random(2)
    members = [(rnd.choice([1, 2]), rnd.randint(1, 40), rnd.choice(["hot", "a", "b", "c", "d", "", None])) for _ in range(500)] + [(1, None, "a"), (None, 1, "a")]
    baskets = sorted({(g, k) for g, k, _ in members if g}, key=repr) + [(1, 99), (1, 99)]
    m = spark.createDataFrame(members, "g0 int, k0 int, i0 string").withColumn("g", F.lit(1)).withColumn("pair", F.lit(1))
    b = spark.createDataFrame(baskets, "g0 int, k0 int")
    got = {(r.g0, r.item_a, r.item_b): (r.pair, r.a, r.b, r.n) for r in cooccurrence.cooccurrence(m, b, "g0", "k0", "i0", 2, 4).collect()}
    assert got == brute_pairs(members, baskets, 2, 4)
    assert cooccurrence.cooccurrence(m.limit(0), b.limit(0), "g0", "k0", "i0").count() == 0


def prefers(d):
    return min(max((d - outranking.INDIFFERENCE) / (outranking.PREFERENCE - outranking.INDIFFERENCE), 0), 1)


def test_places_of_a_heavy_tailed_score_fill_their_buckets(spark):
    df = spark.range(2000).select(F.lit(1).alias("q"), F.col("id").alias("i"), F.exp(F.col("id") / 3.0).alias("s"))
    ties = outranking.score_places(df, ["q"], "s", 16)
    assert [r.place for r in ties.orderBy(F.desc("value")).limit(3).collect()] == [1, 2, 3] and ties.count() == 2000


def test_net_flow_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(q, i, rnd.choice([None, float("nan"), 0.0, 1.0, 2.0, 2.0]), rnd.choice([rnd.random(), 0.5, None])) for q in (1, 2) for i in range(60)] + [(3, 1, 5.0, None), (None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(data, "q int, i int, s double, t double").withColumn("place", F.lit(0))
    got = {(r.q, r.i): r for r in outranking.net_flow_ranking(df, ["q"], "i", {"s": 2.0, "t": 1.0}, buckets=4).collect()}
    assert len(got) == 121
    for q in (1, 2, 3):
        mine = [d for d in data if d[0] == q]
        n = len(mine)
        flow = dict.fromkeys((d[1] for d in mine), 0.0)
        for c, weight in ((2, 2 / 3), (3, 1 / 3)):
            value = {d[1]: d[c] if d[c] is not None and d[c] == d[c] else -1e9 for d in mine}
            place = {i: 1 + sum(w > v for w in value.values()) for i, v in value.items()}
            pct = {i: (n - p) / (n - 1) if n > 1 else 1.0 for i, p in place.items()}
            for i in flow:
                assert got[q, i][f"place_{'s' if c == 2 else 't'}"] == place[i]
                flow[i] += weight * sum(prefers(pct[i] - pct[j]) - prefers(pct[j] - pct[i]) for j in pct) / max(n - 1, 1)
        for i, f in flow.items():
            assert got[q, i].net_flow == pytest.approx(f, abs=1e-9)
    assert outranking.net_flow_ranking(df.limit(0), ["q"], "i", {"s": 1.0}).count() == 0


def test_found_symbols_come_in_the_order_of_the_ranking(spark, small_data):
    flows = {(r.query_id, r.symbol_id): -round(r.net_flow, 9) for r in queries._ranked(spark, small_data, True).collect()}
    got = [tuple(r) for r in queries.p7_found(spark, small_data).collect()]
    assert len(got) > 1 and got == sorted(got, key=lambda k: (k[0], flows[k], k[1])) != sorted(got)


def test_query_scores(spark):
    v = [1.0] + [0.0] * 63
    q = spark.createDataFrame([(1, 1, "flint  Yoke", v, 0), (2, 1, None, None, 0), (3, 9, "x", v, 0)], "query_id bigint, project_id int, query_text string, embedding array<float>, symbol_id int")
    s = spark.createDataFrame([(10, 1, "'flint':1A,7C 'yoke':2B", v), (11, 1, None, [0.0] * 64), (12, 2, "'flint':1A", v), (13, 1, "'flintyoke':1A 'xflint':2A", [2.0] * 64)], "id bigint, project_id int, fts_vector string, embedding array<float>")
    got = {(r.query_id, r.symbol_id): (r.text, r.vector) for r in outranking.query_scores(q, s).collect()}
    assert got[1, 10] == (16, 1.0) and got[1, 11] == (0, None) and got[1, 13] == (0, pytest.approx(0.125)) and got[2, 10] == (0, None) and len(got) == 6


HAND = "import a from 'b';\nfunction run(x) {\n  if (x > 3) { return go(x); }\n  const k = await load('q', x);\n  // note\n  for (const y of k) { this.put(y, 2); }\n  return k;\n}\nfunction stop(z) { try { halt(z); } catch (e) { log('e', z); } while (z < 9) { z += 1; } }\n"
LIB = "/* box */\nclass Box extends Lid {\n  open(key, hinge) {\n    while (hinge.tight) { hinge.turn(key); }\n    return this.inner || new Air();\n  }\n  shut(force) {\n    switch (force) { case 'low': return this.push(1); default: throw new Error('stuck'); }\n  }\n  weigh(scale) {\n    return scale.map((s) => s.read() * this.factor).filter((w) => w !== null);\n  }\n}\n"
OWN = "def plan(route, stops):\n    for stop in stops:\n        if stop.closed:\n            continue\n        route.append(stop)\n    with open_map(route) as chart:\n        chart.draw(route[0], width=2)\n    return [s.name for s in route if s.name]\n"
ENDE = "func mix(a []int, b map[string]int) error {\n\tfor i, v := range a {\n\t\tif v > 3 {\n\t\t\tb[\"x\"] += v\n\t\t}\n\t\ta[i] = v << 1\n\t}\n\tdefer close(b)\n\treturn nil\n}\n"
ZIP = "function zap(parts, glue) {\n  let out = '';\n  do { out += parts.shift() + glue; } while (parts.length);\n  return out.trim().split(glue).map(Number);\n}\nexport default zap;\n"
TIDE = "export const tide = (moon, shore) => {\n  const gap = shore.depth - moon.pull * 0.3;\n  return gap < 0 ? [] : shore.rocks.filter((r) => r.height > gap);\n};\nlet seen = new Set();\nwhile (seen.size < 5) seen.add(tide(luna, cove)?.[0]);\n"
MOOR = "class Moor {\n  #lines = {};\n  static tie(boat) { return new Moor().add(boat.name, boat); }\n  add(name, boat) { this.#lines[name] ??= boat; return this; }\n  async *each() { for await (const l of Object.values(this.#lines)) yield l; }\n}\n"
RAFT = "module.exports = function raft(logs) {\n  logs.sort((a, b) => b - a);\n  do { logs.pop(); } while (logs.length > 7 && !logs.at(-1));\n  label: for (let i = 0, n = logs.length; i < n; ++i) { if (i % 2) continue label; bind(logs[i]); }\n  return { logs, dry: logs.every(Boolean) };\n};\n"
FILES = [
    (1, 1, "src/a.js", HAND, False), (2, 1, "src/b.js", "// Code generated by tool. DO NOT EDIT.\n" + RAFT, True), (3, 1, "src/c.js", "// This file used to be generated by tool; it is kept by hand.\n" + TIDE, False),
    (4, 1, "src/d.js", "BANNER = '// @generated by tool'\n" + MOOR, False), (5, 1, "m.js", ";".join(f"function a{i}(b,c){{return b&&c.d||a(b,{i})}}" for i in range(60)), True), (6, 1, "t.py", "BLOB = [\n" + ",\n".join("0x%02x, 0x%02x" % (i, i + 1) for i in range(90)) + "\n]", True),
    (7, 1, "k.py", "\n".join(f"KEY_{i} = 0x{i:04x}" for i in range(40)), True), (8, 1, "lib/box.js", LIB, True), (9, 2, "util/q.js", LIB.replace("/* box */", "/* other head */").replace("'stuck'", "'jammed'"), True), (10, 3, "__init__.py", "", False), (11, 4, "__init__.py", "", False), (12, 3, "doc.go", "package main\n", False), (13, 4, "doc.go", "package main\n", False),
    (14, 3, "gen/zip_pb2.py", ZIP, True), (15, 3, "n.js", None, False), (16, None, "o.js", "# " + "long words " * 100 + "\n" + OWN, False), (17, 5, "d.js", "DATA = \"" + "QUJD" * 400 + "\"", True), (18, 6, "e.js", "// Diese Datei wurde von tool erzeugt. Nicht bearbeiten.\n" + ENDE, True),
]


def test_source_origin(spark):
    df = spark.createDataFrame([f[:4] + ("h", 1) for f in FILES], "id int, project_id int, path string, content string, sha string, tokens int")
    got = {r.file_id: r.reasons for r in source_origin.file_origins(df.union(df.filter("id = 2"))).collect()}
    assert set(got) == {f[0] for f in FILES if f[4]}, got
    assert got[8] == ["vendored"] and got[14] == ["generated"] and got[6] == ["data"] and got[17] == ["data"]
    assert source_origin.file_origins(df.limit(0)).count() == 0


def test_source_families_against_brute_force(spark):
    rnd = random.Random(7)
    lines = ["if (I > N) { I(I, S); }", "for (const I of I) { I.I(N); }", "const I = await I(S, I);", "while (I < N) { I += N; }", "return I ? I(I) : S;", "try { I(I); } catch (I) { throw I; }", "switch (I) { case S: return I; }", "let I = new I(S);"]
    word = lambda names: lambda m: {"I": names, "N": ["1", "2", "3"], "S": ["'a'", "'b'"]}[m.group()][rnd.randrange(2 if m.group() == "S" else 3)]
    texts, shapes = [], [[rnd.choice(lines) for _ in range(24)] for _ in range(4)]
    for i in range(48):
        shape = list(rnd.choice(shapes))
        for _ in range(rnd.randrange(4)):
            shape[rnd.randrange(24)] = rnd.choice(lines)
        names = [f"v{i}x{k}" for k in range(3)] if rnd.random() < 0.6 else [f"lib{rnd.randrange(3)}x{k}" for k in range(3)]
        texts.append((i, 1 + rnd.randrange(4), "\n".join(regex.sub(r"\b[INS]\b", word(names), line) for line in shape)))
    both = {i: tuple(source_origin.shingles(x) for x in source_origin.lex(t)[:2]) for i, _, t in texts}
    project = {i: p for i, p, _ in texts}
    generated, joined = set(), {i: {i} for i in project}
    for a, b in itertools.combinations(project, 2):
        if source_origin.similarity(both[a][0], both[b][0]) >= source_origin.MASKED:
            if source_origin.similarity(both[a][1], both[b][1]) >= source_origin.NAMES:
                joined[a] |= joined[b]
                for i in joined[a]:
                    joined[i] = joined[a]
            if project[a] == project[b]:
                generated |= {a, b}
    vendored = {i for i, group in joined.items() if len({project[k] for k in group}) > 1}
    df = spark.createDataFrame([(i, p, f"f{i}.js", t) for i, p, t in texts], "id int, project_id int, path string, content string")
    got = {r.file_id: set(r.reasons) for r in source_origin.file_origins(df).collect()}
    alone = {i: set(source_origin.own_traits(t, f"f{i}.js")[0]) for i, _, t in texts}
    want = {i: alone[i] | ({"generated"} if i in generated else set()) | ({"vendored"} if i in vendored else set()) for i in project}
    assert got == {i: r for i, r in want.items() if r} and len(generated) > 4


def test_families_within_one_file_and_literals():
    rnd = random.Random(3)
    block = [[rnd.choice(["if", "I", "(", ")", "=", "N", "+", "S", ";", "return", "{", "}"]) for _ in range(9)] for _ in range(17)]
    flat = lambda b: [x for line in b for x in line]
    assert source_origin.repeated_share(flat(block * 4)) == 1.0 and source_origin.repeated_share(flat(block)) < 0.1
    assert source_origin.repeated_share(["N", ","] * 200) == 0.0 and source_origin.repeated_share([]) == 0.0
    of = lambda text: source_origin.own_traits(text, "a.js")[0]
    assert of("W = [\n" + "-0.25, 0.5,\n" * 40 + "]") == ["data"] == of("ICON = '" + "M1,2 L3" * 60 + "'") and of("x = 'short'") == [] == of("")
    assert of(HAND + "const TABLE = [" + "1, " * 30 + "]; // rates") == []


@pytest.mark.parametrize("text,signed", [
    ("// Code generated by tool. DO NOT EDIT.\nimport x", True), ("#!/bin/sh\n\n# @generated by tool v1\nrun", True), ("<?php // output of tool --emit=3, hand edits vanish\nf();", True),
    ("import x\nconst L = 3;\n// The tree reads first.\n// Code generated by tool. DO NOT EDIT.\n\nfunction f() {}", True), ("f();\n\n// Fichier généré par tool, ne pas modifier\n", True), ("f();\n# Generated from tool.schema - changes get lost", True),
    ("import x\n// Generated by the nightly run, so it may be stale.\nfunction f() {}", False), ("// Looks for 'Code generated by tool' and skips such files.\n\nf();", False), ("// This file used to be generated by tool; it is kept by hand.\n\nf();", False), ("B = '// @generated by tool'\n", False), ("x();\n/** Auto-generated method stub */\n\n", False), ("f() {\n  // Generated by hand\n\n}", False),
])
def test_signatures_of_tools(text, signed):
    assert source_origin.is_signed(text) is signed


def test_names_reserved_for_build_output():
    for path, hit in (("a/x_pb2.py", 1), ("a/x.pb.go", 1), ("a\\__generated__\\x.js", 1), ("target/generated-sources/X.java", 1), ("var/cache/compiled/x.php", 1), ("x.gen.ts", 1), ("src/report/generated_x.go", 0), ("src/codegen/x.py", 0), ("app/auto_generated_coupons/x.ts", 0), ("genome.py", 0), (None, 0)):
        assert bool(source_origin.own_traits(HAND, path or "")[0]) is bool(hit), path


def test_one_generator_in_several_projects(spark):
    body = "\n".join(f"{x} function K_{k}(K_a) {{ {y} return K_{k}b(K_a, {k}); }}" for k, (x, y) in enumerate(zip("export|async|static|public|if (K) {} else|const K_z =|new K(1);|throw K;|void 0;|class K {}".split("|"), "K_q += 2;|while (K_a < 1) K_a++;|do K_p(); while (0);|for (const i of K_a) K_c(i);|try { K_d(); } catch (K_e) {}|let K_y = [1, 'a'];|K_f.K_g.K_h();|switch (K_a) { default: }|K_a = !K_a && 1;|if (K_a) K_n(K_a, 'b');".split("|"))))
    named = lambda x, more="": body.replace("K", x) + more
    files = [(1, 1, named("ab")), (2, 1, named("cd")), (3, 2, named("ef")), (4, 2, named("gh")), (5, 3, named("ij")), (6, 4, named("kl")), (7, 5, named("kl", "\nkl(3);"))]
    df = spark.createDataFrame([(i, p, f"f{i}.js", t) for i, p, t in files], "id int, project_id int, path string, content string")
    got = {r.file_id: r.reasons for r in source_origin.file_origins(df).collect()}
    assert got == {1: ["generated"], 2: ["generated"], 3: ["generated"], 4: ["generated"], 6: ["vendored"], 7: ["vendored"]}
    links = {r.file_id: (r.class_id, r.links) for r in source_origin.file_origins(df).collect()}
    assert links[6] == links[7] == (6, 1) and links[1] == (1, 1)


def test_minhash_keeps_similar_sets_together():
    rnd = random.Random(1)
    import numpy as np

    hit = 0
    for _ in range(60):
        a = {rnd.getrandbits(60) for _ in range(200)}
        b = set(sorted(a)[:185]) | {rnd.getrandbits(60) for _ in range(10)}
        ka, kb = (source_origin.band_keys(np.array(sorted(s), dtype=np.uint64)) for s in (a, b))
        hit += any(x == y for x, y in zip(ka, kb))
    assert hit == 60


def test_signature_bits_pass_over_no_alike_pair():
    import numpy as np

    rnd = random.Random(2)
    low = lambda s: source_origin._minima(np.array(sorted(s), dtype=np.uint64), source_origin.BANDS * source_origin.ROWS)
    bits = lambda s: source_origin.signature_bits(low(s))
    equal = lambda a, b: source_origin.BITS - sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))
    for _ in range(60):
        a = {rnd.getrandbits(60) for _ in range(180)}
        alike, unlike = set(sorted(a)[:160]) | {rnd.getrandbits(60) for _ in range(20)}, {rnd.getrandbits(60) for _ in range(180)}
        assert equal(bits(a), bits(alike)) >= source_origin.EQUAL_BITS > equal(bits(a), bits(unlike))
        one, other, far = (source_origin.signature_bytes(low(s)) for s in (a, alike, unlike))
        assert (one == other).sum() >= source_origin.EQUAL_BYTES > (one == far).sum()


def test_source_origin_keeps_less_on_disk_than_it_reads(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    texts = ["\n".join(f"{rnd.choice(['if', 'for', 'while'])} (w{rnd.randrange(10**6)} {rnd.choice('+-*/<>')} w{rnd.randrange(10**6)}) {{ w{rnd.randrange(10**6)}(); }}" for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame([(i, 1 + i % 4, f"f{i}.js", t) for i, t in enumerate(texts)], "id int, project_id int, path string, content string")
    monkeypatch.setattr("strataloom.session._cut_folder", lambda _: f"file://{tmp_path}")
    source_origin.file_origins(df).count()
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < sum(map(len, texts)) / 2


def test_queries_are_whole_and_registered(spark, small_data):
    made, sql = queries.queries(), queries.oracle_sql()
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(made) and set(sql) <= set(made)
    assert made["p8_ids"](spark, small_data).columns == ["doc_id", "ids"]
    for name in ("p1_found", "p6_cochange", "p9_found"):
        made[name](spark, small_data).count()
