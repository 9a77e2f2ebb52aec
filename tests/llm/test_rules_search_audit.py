"""URL rules, lexical search and the filter audit against brute force, on small tables with all odd cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations, permutations

import pytest

from cadenza.llm import filter_audit, lexical, url_rules

CLASH = ("host", "path", "rule", "verdict", "row", "items", "n", "terms", "score", "rank", "part", "mask", "good", "kept")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# ---- URL rules ----------------------------------------------------------------------------------

PAGES = [
    (1, "https://Sub.Example.ORG/es/5?a=1"),
    (2, "http://example.org/en/17"),
    (3, "http://example.org"),
    (4, "http://notexample.org/x"),
    (5, "http://a.com/fr/2#de"),
    (6, "http://a.com/de/2"),
    (7, "http://com/de/"),
    (8, "no address"),
    (9, None),
    (None, "http://spam.net/a/b"),
    (11, "ftp://u://v.com/de/x"),
    (11, "http://spam.net/a/b"),
    (12, "http://a.net:80/fr/"),
    (13, "http://" + "x." * 5000 + "net/" + "y/" * 20000),
]


def tokens_of(url):
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = re.match(r"[^?#]*\?([^#]*)", rest)
    parts = ["host:" + p for p in re.sub("[A-Z]", lambda m: m.group().lower(), host).split(".") if p]
    parts += ["path:" + p for p in path.split("/") if p]
    parts += ["query:" + p for p in re.split("[&=]", query.group(1) if query else "") if p]
    return list(dict.fromkeys(parts))


def test_listed_rules(spark):
    pages = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.page_id, r.host[:20], r.rule, r.verdict) for r in url_rules.judge(pages, none).collect()]
    assert len(got) == len(PAGES)
    assert set(got) == {
        (1, "sub.example.org", "example.org/es/", "block"),
        (2, "example.org", "example.org/en/1", "block"),
        (3, "example.org", None, "allow"),
        (4, "notexample.org", "org/", "allow"),
        (5, "a.com", "com/fr/", "allow"),
        (6, "a.com", "com/de/", "block"),
        (7, "com", "com/de/", "block"),
        (8, "", None, "allow"),
        (9, "", None, "allow"),
        (None, "spam.net", None, "allow"),
        (11, "u:", None, "allow"),
        (11, "spam.net", None, "allow"),
        (12, "a.net:80", None, "allow"),
        (13, "x.x.x.x.x.x.x.x.x.x.", None, "allow"),
    }
    assert url_rules.judge(pages.limit(0), none).count() == 0


def test_mined_rules_equal_brute_force(spark):
    chance = random.Random(5)
    urls = [
        f"http://{chance.choice(['a', 'b', 'spam'])}.{chance.choice(['m', 'n'])}.net/{chance.choice(['x', 'y'])}/{i}?k={chance.choice('12')}"
        for i in range(160)
    ]
    pages = [(i, u) for i, u in enumerate(urls)] + PAGES[8:]
    labels = [(i, 1, int("spam" in u and "/x/" in u or chance.random() < 0.2)) for i, u in enumerate(urls) if i % 4]
    labels += [(labels[0][0], 0, 0), (None, 0, 1), (9999, 0, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    marks = with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    bad = {}
    for doc, quality, toxic in labels:
        bad[doc] = bad.get(doc, False) or toxic == 1 or quality == 0
    known = [(frozenset(tokens_of(u)), bad[i]) for i, u in pages if i is not None and i in bad]
    least = max(5, math.ceil(0.01 * sum(b for _, b in known)))
    support = Counter(
        chosen for own, b in known if b for n in range(1, len(own) + 1) for chosen in combinations(sorted(own), n)
    )
    rules = {}
    for chosen, n in support.items():
        share = n / sum(own.issuperset(chosen) for own, _ in known)
        if n >= least and share >= 0.6:
            rules[chosen] = share
    useful = {r: c for r, c in rules.items() if not any(set(s) < set(r) and rules[s] >= c for s in rules)}
    mined = {tuple(r.rule_items): r.confidence for r in url_rules.mine(url_rules.labelled(df, marks)).collect()}
    assert mined == pytest.approx(useful) and useful
    by_id = {r.page_id: r for r in url_rules.judge(df, marks).collect()}
    for i, u in enumerate(urls):
        fits = [r for r in useful if set(r) <= set(tokens_of(u))]
        assert by_id[i].verdict == ("block" if fits else "allow")
        if fits:
            best = min(fits, key=lambda r: (-useful[r], -support[r], len(r), r))
            assert by_id[i].mined_tokens == " ".join(best)


def test_long_urls_are_mined_whole_and_both_ways_agree(spark):
    chance = random.Random(9)
    rows = []
    for _ in range(120):
        bad = chance.random() < 0.5
        own = [f"t{i:02d}" for i in range(9) if chance.random() < (0.7 if bad else 0.5)]
        rows.append((own, bad))
    plain = spark.createDataFrame(rows, "items array<string>, bad boolean")
    whole = {tuple(r.rule_items): (r.support, r.confidence) for r in url_rules.mine(plain).collect()}
    levels = {tuple(r.rule_items): (r.support, r.confidence) for r in url_rules.mine(plain, mined_tokens=3).collect()}
    assert whole == levels and max(map(len, whole)) > 1
    # Twelve tokens that are bad more often stand before the pair that makes the rule; forty that go together come for nothing.
    lures = [f"a{i:02d}" for i in range(12)]
    many = [f"c{i:02d}" for i in range(40)]
    rows = [([*lures, "x", "y", *many], True)] * 10 + [([*lures, *many], True)] * 10
    rows += [([*lures, *many], False)] * 15 + [(["x"], False)] * 30 + [(["y"], False)] * 30
    long = spark.createDataFrame(rows, "items array<string>, bad boolean")
    found = {tuple(r.rule_items): r.confidence for r in url_rules.mine(long).collect()}
    assert found[("x", "y")] == 1.0


# ---- lexical search -------------------------------------------------------------------------------


def search_plainly(items, docs, k=50):
    def terms(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower))

    bags = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 50 + 50 * bag.total() * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms(text) if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:k], 1)]
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def corpus():
    chance = random.Random(11)
    words = ["w%d" % i for i in range(60)] + ["Été", "naïve", "ŒUF", "x" * 3000]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + chance.choice([" ", "\n", "-", "_ "]) for w in chance.choices(words, weights, k=n))

    docs = [(i, text(chance.choice([0, 3, 20, 60]))) for i in range(400)]
    docs += [(500 + i, docs[7][1] + "w59 w58") for i in range(90)]  # more equal scores than places
    docs += [(None, "w59 w58"), (3, "w58"), (3, "w58"), (900, None), (901, ""), (902, "!? ;"), (903, text(250_000))]
    items = [(i, text(12)) for i in range(20)] + [(50, "w59 W58"), (50, "w58"), (51, "unseen"), (52, None), (None, "w0"), (53, "")]
    return items, docs


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, corpus, small, monkeypatch):
    items, docs = corpus
    if small:  # several passes, blocks of few documents, a cut inside the longest text
        monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 9)
        monkeypatch.setattr(lexical, "BLOCK", 900)
        monkeypatch.setattr(lexical, "FIRST_ROUND", 1)
        monkeypatch.setattr(lexical, "_PIECE", 1000)
    asked = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    held = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    got = lexical.search(asked, held)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == search_plainly(items, docs)


def test_search_of_nothing(spark, corpus):
    docs = spark.createDataFrame(corpus[1][:5], "doc_id long, text string")
    items = spark.createDataFrame(corpus[0], "item_id long, text string")
    assert lexical.search(items.limit(0), docs).count() == 0
    assert lexical.search(items, docs.limit(0)).count() == 0


# ---- filter audit -----------------------------------------------------------------------------------


def audit_plainly(docs, labels):
    first = {}
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = ("A" if len(words) < 100 else "") + ("B" if 100 * len(set(words)) < 80 * len(words) else "")
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        fails += "D" if re.search("[#$%&*|]", text) else ""
        fails += "E" if doc is not None and doc > first[text] else ""
        parts.setdefault(lang or "", []).append((doc, fails))
    rows = []
    for part, members in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                out = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                shapley[letter] += len(out)
                failing = sum(letter in f for _, f in members)
                alone = sum(f == letter for _, f in members)
                lines.append((part, "".join(order), step, len(left), len(out), failing - len(out), alone,
                              sum(d in good for d, _ in out), sum(d in toxic for d, _ in out), letter))
        rows += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(rows)


def test_audit_equals_brute_force(spark):
    chance = random.Random(3)
    docs = []
    for i in range(150):
        words = [chance.choice(["alpha", "Beta", "GAMMA", "x%d" % chance.randrange(400), "d$"][:: chance.choice([1, -1])]) for _ in range(chance.choice([5, 100, 130]))]
        docs.append((i, chance.choice([" ", "\t", "\x0b "]).join(words), chance.choice(["en", "de", "", None])))
    docs += [(1000 + i, docs[i % 3][1], "fr") for i in range(20)]
    docs += [(2000, None, "en"), (2001, "", None), (None, docs[0][1], "en"), (None, None, None), (1001, docs[1][1], "fr"), (1001, docs[1][1], "fr")]
    docs += [(3000, "Żółć " * 200_000, "pl"), (3001, "A\x00b \x1c c", "pl")]
    labels = [(i, chance.choice([0, 1, None]), chance.choice([0, 1])) for i in range(0, 1020, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    marks = with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(df, marks)
    assert sorted(tuple(r) for r in got.collect()) == audit_plainly(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert filter_audit.audit(df.limit(5), marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_fields_never_run_into_each_other():
    for n in (1, 7, 8, 10**15):
        width = n.bit_length()
        for mask, one in enumerate(filter_audit.packed(width)):
            counts = filter_audit.unpacked(one * n, width)
            assert all(c == n * filter_audit.removed_at(mask, *at) for at, c in counts.items())


# ---- personal data in long texts, and ids beside a null id -------------------------------------------


def shape(unit, size):
    return unit * (size // len(unit))


@pytest.mark.parametrize("size", [10_000, 1_000_000])
def test_long_texts_of_the_worst_shapes(spark, size):
    from cadenza.llm import pii

    texts = {
        "one address": ("a@b" + shape(".c", size), (1, 0, 0, 0)),
        "one name": (shape("a.", size) + "@b.c", (1, 0, 0, 0)),
        "addresses": (shape("é a@b.co ", size), (size // 9, 0, 0, 0)),
        "no address": (shape("a@", size), (0, 0, 0, 0)),
        "ips": (shape("1.2.3.4 ", size), (0, size // 8, 0, 0)),
        "dots": (shape("1.", size), (0, size // 8, 0, 0)),
        "digits": (shape("1", size), (0, 0, 0, 0)),
        "blank digits": (shape("1 ", size), (0, 0, 0, 0)),
        "cards": (shape("4111111111111111, ", size), (0, 0, size // 18, 0)),
        "phones": (shape("+49 30 1234567; ", size), (0, 0, 0, size // 16)),
        "plus": ("+1" + shape("(", size), (0, 0, 0, 0)),
        "letters": (shape("AB12", size), (0, 0, 0, 0)),
    }
    names = list(texts)
    rows = spark.createDataFrame([(i, texts[n][0]) for i, n in enumerate(names)], "doc_id long, text string").repartition(len(names))
    for row in pii.report(rows).collect():
        name = names[row.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == texts[name][1], name
        if name == "addresses":
            ends = [s.split(":") for s in row.spans.split(",")]
            assert all((int(a), int(b)) == (9 * i + 2, 9 * i + 8) for i, (_, a, b) in enumerate(ends))


def test_context_words_across_parts_of_a_text(spark):
    """Context is looked up in parts of the text: wherever a span lies, the same words count."""
    from cadenza.llm import pii

    rows = [(i, "é" * i + " call me +49 30 1234567 or not " + "x " * (600 - i)) for i in range(0, 600, 7)]
    far = [(1000 + i, "call " + "é" * (i + 60) + " +49 30 1234567") for i in range(0, 600, 7)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows + far, "doc_id long, text string")).collect()}
    assert all(found[i][0].context and found[i][0].score == 1.0 for i, _ in rows)
    assert not any(found[i][0].context for i, _ in far)


def test_mix_keeps_large_ids_beside_a_null(spark):
    from cadenza.llm import balance

    ids = [2**60 + 1, 2**60 + 3, None, 7]
    docs = spark.createDataFrame([(i, "a b c", "s") for i in ids], "doc_id long, text string, source string").coalesce(1)
    assert {r.doc_id for r in balance.mix(docs).collect()} == set(ids)
    named = spark.createDataFrame([("x", "a b", "s"), (None, "c d", "s")], "doc_id string, text string, source string")
    assert {r.doc_id for r in balance.mix(named).collect()} == {"x", None}


def test_equal_texts_lie_together_whatever_their_source(spark, monkeypatch):
    from cadenza.llm import hilbert

    rows = [(i, f"text number {i}" * (1 + i % 5), ["en", "de", None][i % 3], f"s{i % 7}") for i in range(200)]
    rows += [(1000 + i, "the same text everywhere", ["en", "fr", None][i % 3], f"s{i % 6}") for i in range(32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    found = hilbert.shard(docs, 16).collect()
    shards = {r.shard for r in found if r.doc_id >= 1000}
    assert len(shards) <= 4  # 32 rows in shards of 14 or 15
    assert len({r.curve for r in found if r.doc_id >= 1000}) == 1
    assert all(r.lang == rows[r.doc_id][2] and r.source == rows[r.doc_id][3] for r in found if r.doc_id < 200)
    monkeypatch.setattr(hilbert, "BROADCAST_KEYS", -1)
    assert {(r.doc_id, r.shard, r.slot) for r in hilbert.shard(docs, 16).collect()} == {(r.doc_id, r.shard, r.slot) for r in found}


def test_items_without_an_id_are_searched(spark):
    from cadenza.llm import decontamination

    chance = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    item = " ".join(chance.choices(words, k=40))
    docs = [(i, " ".join(chance.choices(words, k=80))) for i in range(30)] + [(50, f"one two {item} three"), (None, f"{item} four")]
    docs = spark.createDataFrame([(*d, "en", "s", 1, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    items = spark.createDataFrame([(None, item), (7, " ".join(chance.choices(words, k=40)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, items).collect()} == {(50, None), (None, None)}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(30))
