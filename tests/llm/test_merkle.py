"""Merkle manifest against a plain construction of the tree."""

import hashlib
import zlib

import pytest

from convgraph.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, part string, pos int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Last node and, per leaf, its siblings (before, after) upwards."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for j in range(len(run)):
                for o in owners[a + j]:
                    paths[o].append((run[:j], run[j + 1:]))
            up.append(h(*run))
            up_owners.append([o for group in owners[a:a + 8] for o in group])
        nodes, owners = up, up_owners
    return nodes[0], paths


def plain(rows):
    leaves = []
    for i, text, lang, source, n in rows:
        def leaf(t):
            return h(*map(encoded, (i, source, lang, n, t)))
        changed = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaves.append((lang, i, leaf(text), leaf(changed)))
    parts = sorted({x[0] for x in leaves}, key=lambda p: (p is not None, (p or "").encode()))
    members = {p: sorted((x for x in leaves if x[0] == p), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for p in parts}
    low = {p: tree([x[2] for x in members[p]]) for p in parts}
    root, high = tree([low[p][0] for p in parts])
    out = []
    for p, above in zip(parts, high):
        for x, path in zip(members[p], low[p][1]):
            folded = x[3]
            for before, after in path + above:
                folded = h(*before, folded, *after)
            out.append((x[1], x[2], low[p][0], root, "".join(s for b, a in path + above for s in b + a), folded, folded == root))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    hexed = ["leaf", "subroot", "root", "siblings", "folded_root"]
    got = merkle.verify_documents(df).select("doc_id", *[merkle.as_hex(c).alias(c) for c in hexed], "verified")
    return [tuple(r) for r in got.collect()]


def same(got, want):
    key = lambda r: tuple(str(v) for v in r)
    return sorted(got, key=key) == sorted(want, key=key)


def docs(n, lang=lambda i: "en"):
    return [(i * 7, f"Text {i} " * (i % 5), lang(i), "web", i) for i in range(n)]


CASES = {
    "one leaf": docs(1),
    "one full run": docs(8),
    "one leaf too many": docs(9),
    "run of one at two levels": docs(65),
    "lone leaves in many parts": docs(20, lambda i: f"l{i:02d}"),
    "hot part": docs(600, lambda i: "en" if i % 7 else None),
    "nulls, empty and repeated": [(None, None, None, None, None), (None, "A", None, "", 1), (3, "", "", None, 0), (3, "", "", None, 0), (3, "B", "", None, 0),
                                  (3, "ÀÉ Ab", "é", "s", 5), (-4, "Neg", "Z", "s", 3), (10**17, "X" * 100_000, "a", "s", 100_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_plain_tree(spark, name):
    assert same(run(spark, CASES[name]), plain(CASES[name]))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_every_change_of_text_is_seen(spark):
    got = run(spark, docs(300))
    changed = {i for i, t, *_ in docs(300) if zlib.crc32(str(i).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in t)}
    assert {r[0] for r in got if not r[-1]} == changed and changed


def test_recursion_setting_is_left_as_it_was(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    run(spark, docs(3))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_other_arity_and_columns(spark):
    leaves = spark.createDataFrame([("a", k, f"v{k}") for k in range(10)], "p string, o int, v string")
    leaves = leaves.select("p", "o", merkle.digest(merkle.canonical([leaves.v])).alias("leaf"), "v")
    m = merkle.build(leaves, "p", "o", arity=2, carry=("v",))
    nodes = [h(encoded(f"v{k}")) for k in range(10)]
    while len(nodes) > 1:
        nodes = [h(*nodes[a:a + 2]) for a in range(0, len(nodes), 2)]
    assert m.root.select(merkle.as_hex("root")).first()[0] == nodes[0]
