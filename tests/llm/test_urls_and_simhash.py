import random

import pytest

from convgraph.llm import queries, simhash, urlfilter

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    rules = queries.URL_RULES + [("allow", "a.b/x"), ("block", "a.b/x"), ("block", "host.only/"), ("allow", "c.d/p/q"), ("block", "c.d/p/")]
    cases = [
        (1, "https://Www.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        (3, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        (4, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"), (5, "http://x.com/de", "x.com", "/de", None, "allow"),
        (6, None, "", "", None, "allow"), (7, "nothing", "", "", None, "allow"), (8, "http://org", "org", "", None, "allow"),
        (9, "a://b://c", "b:", "//c", None, "allow"), (10, "http://a.b/xyz", "a.b", "/xyz", "a.b/x", "block"),
        (11, "http://c.d/p/qr", "c.d", "/p/qr", "c.d/p/q", "allow"), (12, "http://c.d/p/r", "c.d", "/p/r", "c.d/p/", "block"),
        (13, "http://h?q=/x", "h", "", None, "allow"), (14, "", "", "", None, "allow"), (14, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u, *_ in cases], "page_id long, url string, verdict string")
    got = urlfilter.judge_urls(df, rules).collect()
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((i, h, p, str(x), v) for i, _, h, p, x, v in cases)
    with pytest.raises(ValueError):
        urlfilter.RuleTrie([("maybe", "x/")])


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        rng = random.Random(radius)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & diff == 0 for m in masks)


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    fps = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randint(0, 6)):  # chains of one to three flips
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    comp = {r.node: r.root for r in simhash.components(simhash.links_within_two(df)).collect()}
    want = brute(fps)
    got = [comp.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    same = lambda c: {frozenset(i for i in range(len(c)) if c[i] == v) for v in c}
    assert same(got) == same(want)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(4, None), (2, ""), (9, " \t\n"), (3, "one"), (3, "ONE"), (None, "one"), (8, "a b c d"), (7, "é É"), (11, "word " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.fp == 0} == {2}
    assert sorted(str((r.doc_id, r.component_id)) for r in got if r.component_id == 3) == ["(3, 3)", "(3, 3)", "(None, 3)"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [simhash.majority(simhash.shingle_hashes(d.text, 3)) for d in docs]
    root = brute(fps)
    first = {}
    for d, r in zip(docs, root):
        first[r] = min(first.get(r, d.doc_id), d.doc_id)
    want = sorted((d.doc_id, f"{f:016x}", first[r]) for d, f, r in zip(docs, fps, root))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash"](spark, SF).collect())
    assert got == want


def test_similar_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, texts, group = [word() for _ in range(60)], [], []
    for g in range(40):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        if g % 3 == 0:
            base[5:5] = passage
        for _ in range(3):
            t = list(base)
            for _ in range(len(t) // 70):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
            group.append(g)
    texts += ["", None, "  ", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = {r.rid: r.root for r in simhash.similar_documents(df, rid="rid").collect()}
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    n = len(group)
    found = total = 0
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                total += 1
                found += got[i] == got[j]
            if group[i] != group[j]:
                assert got[i] != got[j]
    assert total > 60 and found >= 0.97 * total
    assert got[n] == got[n + 1] == got[n + 2] and got[n + 3] == n + 3


def test_similar_documents_misses_no_pair(spark):
    """Shared passages make postings of unlike texts, and one large group has many pairs close to the limit."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    edited = lambda base, n: [word() if i in at else w for at in [set(rng.sample(range(len(base)), n))] for i, w in enumerate(base)]
    passage, large = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = [edited(large, rng.randint(1, 5)) for _ in range(150)]
    for _ in range(150):
        base = [word() for _ in range(rng.choice([50, 90]))] + passage
        texts += [base, edited(base, rng.randint(1, 4)), base[:rng.randint(40, 70)] + passage]
    texts += [passage[:n] for n in (3, 5, 6, 20, 49, 55)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rid long, text string")
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in range(len(texts))}
    assert {r.rid: r.root for r in simhash.similar_documents(df, rid="rid").collect()} == want
    assert simhash.similar_documents(df.limit(0), rid="rid").count() == 0


def test_one_shingle_in_every_text(spark, monkeypatch):
    """A line that all texts share is kept out of the ranges and decides nothing."""
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "HASHES_PER_RANGE", 8)
    rng = random.Random(9)
    line = "this very line stands at the end of all texts"
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randint(3, 30))) + " " + line for _ in range(60)]
    texts += [t + " x" for t in texts[:20]] + texts[:5] + [line, line + " too", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.rid: r.root for r in simhash.similar_documents(df, rid="rid").collect()} == {i: find(i) for i in range(len(texts))}


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that resemble their source and seldom each other are chained without comparing all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, count, compared = [word() for _ in range(150)], 300, []
    texts = [" ".join(base)]
    for _ in range(count):
        at = {rng.randrange(50 * k + 5, 50 * k + 45) for k in range(3)}
        texts.append(" ".join(word() if i in at else w for i, w in enumerate(base)))
    rng.shuffle(texts)
    alike = simhash._alike

    def counted(pairs, *a):
        compared.append(pairs.count())
        return alike(pairs, *a)

    monkeypatch.setattr(simhash, "_alike", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    assert {r.root for r in simhash.similar_documents(df, rid="rid").collect()} == {0}
    assert sum(compared) < 200 * count  # a pair counts once for each posting it shares


def test_similar_documents_go_through_fingerprints(spark, monkeypatch):
    """Linked fingerprints are candidates, and those that do not resemble each other stay apart."""
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    line = "a line that says so very often".split()
    texts = [long, long[:1500] + ["other"] + long[1501:], line * 400 + long[:20], line * 400 + long[50:90]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rid long, text string")
    links, alike, seen, compared = simhash.links_within_two, simhash._alike, [], []

    def linked(prints, *a):
        seen.extend(r.fp for r in prints.collect())
        return links(prints, *a)

    def checked(pairs, *a):
        compared.append({tuple(sorted((r.x.rid, r.y.rid))) for r in pairs.collect()})
        return alike(pairs, *a)

    monkeypatch.setattr(simhash, "links_within_two", linked)
    monkeypatch.setattr(simhash, "_alike", checked)
    got = {r.rid: r.root for r in simhash.similar_documents(df, rid="rid").collect()}
    assert set(seen) == {simhash.signed(simhash.majority(simhash.shingle_hashes(" ".join(t), 5))) for t in texts}
    assert compared[0] == {(0, 1), (2, 3)} and got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_more_texts_than_a_task_holds_at_once(spark):
    """Every text has its near copy far behind it, in another part of the same batch."""
    n = 2 * simhash.ROWS + 100
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [" ".join(word() for _ in range(40)) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), "rid long, text string").coalesce(1)
    assert {r.rid: r.root for r in simhash.similar_documents(df, rid="rid").collect()} == {i: i % n for i in range(2 * n)}
