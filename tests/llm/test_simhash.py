"""Fingerprints, grid cells, components and near-duplicates against brute force."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from mnemoria.llm import simhash
from mnemoria.scale import connected

SF = "/root/testdata/sf0.01"


def fingerprint_by_hand(text, words=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def check(got, prints):
    """Rows of op1 against a comparison of all pairs of distinct fingerprints."""
    distinct = {}
    for i, f in prints.items():
        distinct[f] = min(distinct.get(f, i), i)
    values = np.array(sorted(distinct), dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    order = {int(v): at for at, v in enumerate(values)}
    by_class = components_by_hand(distinct, lambda a, b: near[order[a], order[b]]) if len(distinct) < 300 else None
    if by_class is None:
        by_class = {f: f for f in distinct}
        for x, y in zip(*np.nonzero(near)):
            a, b = int(values[x]), int(values[y])
            while by_class[a] != a:
                a = by_class[a]
            while by_class[b] != b:
                b = by_class[b]
            by_class[max(a, b)] = min(a, b)
        for f in sorted(by_class):
            by_class[f] = by_class[by_class[f]]
    least = {}
    for i, f in prints.items():
        least[by_class[f]] = min(least.get(by_class[f], i), i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{f:016x}", least[by_class[f]]) for i, f in prints.items()}
    return least


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = simhash.op1_simhash(spark, SF).collect()
    assert len(got) == len(rows)
    assert len(check(got, {r.doc_id: fingerprint_by_hand(r.text) for r in rows})) < len(rows)


def test_odd_rows(spark, table):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for i in range(150)}
    texts |= {200: None, 201: "", 202: " \n", 203: "A b C", 204: "a B c", 205: "É b", 206: "é b", 207: "word " * 50000}
    got = simhash.op1_simhash(spark, table([*texts.items(), (203, "A b C"), (None, "A b C")])).collect()
    assert len(got) == len(texts) + 2
    assert [r.component_id for r in got if r.doc_id is None] == [r.component_id for r in got if r.doc_id == 203][:1]
    check([r for r in got if r.doc_id is not None], {i: fingerprint_by_hand(t) for i, t in texts.items()})
    assert simhash.op1_simhash(spark, table([])).count() == 0


def test_every_link_shares_a_cell_and_classes_are_exact(spark):
    """Chains, dense groups and strangers, over random fingerprints with up to six flipped bits."""
    rng = random.Random(8)
    values = {0, 2**64 - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            values.add(base)
            other = base if rng.random() < 0.7 else rng.choice(sorted(values))
            for b in rng.sample(range(64), rng.randint(1, 6)):
                other ^= 1 << b
            base = base if rng.random() < 0.5 else other
            values.add(other)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(i, [v]) for i, v in enumerate(signed)], "node long, lanes array<long>")
    got = {r.node: r.root for r in simhash.classes(nodes, simhash.Settings()).collect()}
    want = components_by_hand(range(len(values)), lambda a, b: bin(values[a] ^ values[b]).count("1") <= 4)
    assert {i: got.get(i, i) for i in range(len(values))} == want
    assert len(set(want.values())) < len(values) - 50


def test_lanes_verify_over_all_bits(spark):
    a, far = [5, 9, 77], [5, ~9, ~77]
    near = [5 ^ 3, 9 ^ 7, 77 ^ (1 << 40)]
    nodes = spark.createDataFrame([(0, a), (1, far), (2, near)], "node long, lanes array<long>")
    settings = simhash.Settings(lanes=3, total_bits=10)
    assert {tuple(r) for r in simhash.classes(nodes, settings).collect()} == {(0, 0), (2, 0)}


def similarity(a, b, words=5):
    a, b = ({tuple(t[i : i + words]) for i in range(len(t) - words + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_wide_fingerprints_find_similar_texts(spark):
    """Of pairs at a similarity of 0.85 or more nearly all are linked, of those under 0.7 none, and one of each stays."""
    rng = random.Random(12)
    rows, near, far = [], [], []
    for i in range(0, 400, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        copy = list(words)
        for _ in range(rng.choice([0, 1, 2, 4, 20, 40])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        near += [i] if similarity(words, copy) >= 0.85 else []
        far += [i] if similarity(words, copy) < 0.7 else []
        rows += [(i, " ".join(words)), (i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    class_of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, settings=simhash.WIDE).collect()}
    assert len(near) > 50 and sum(class_of[i] == class_of[i + 1] for i in near) >= 0.95 * len(near)
    assert len(far) > 30 and not any(class_of[i] == class_of[i + 1] for i in far)
    assert len({class_of[i] for i, _ in rows}) >= 200
    stays = sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
    assert stays == sorted(set(class_of.values()))


def shingles_by_hand(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def test_wide_links_are_those_of_the_shingle_sets(spark):
    """Pairs about 0.8 similar are linked if, and only if, their sets say so, also where one shingle fills a text."""
    rng = random.Random(21)
    texts = []
    for _ in range(250):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(60, 250))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.randint(1, max(2, len(copy) // 35))):
            copy[at] = "other"
        texts += [" ".join(words), " ".join(copy)]
    # One shingle is most of the text; nothing else is shared.
    texts += ["na " * 300 + " ".join(f"{kind}{j}" for j in range(60)) for kind in ("x", "y")]
    sets = [shingles_by_hand(t) for t in texts]
    similar = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.75 <= x < 0.8 for x in similar) > 20 and sum(0.8 <= x < 0.85 for x in similar) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, settings=simhash.WIDE).collect()}
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert got == components_by_hand(range(len(sets)), lambda a, b: (b, a) in linked)


def test_pipeline_links_by_fingerprints_and_by_sets(spark):
    """The stage takes links of operator 1, of the shingle sets, and chains of both."""
    rng = random.Random(5)
    # One shingle fills the fingerprint of the first two, whose sets share hardly more than that.
    texts = ["na " * 300 + " ".join(f"{kind}{j}" for j in range(60)) for kind in ("x", "y")]
    words = texts[1].split()
    words[-3] = "other"
    texts.append(" ".join(words))
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    texts += [" ".join(base), " ".join(base[:280] + ["new"] * 8 + base[288:]), "a text of its own with other words in it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stays = {kind: sorted(r.doc_id for r in simhash.one_of_each(docs, settings=kind).collect()) for kind in (simhash.Settings(), simhash.WIDE)}
    assert 1 not in stays[simhash.Settings()] and 1 in stays[simhash.WIDE] and 4 not in stays[simhash.WIDE]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 3, 5]


def test_one_of_each_odd_rows(spark, table):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, ""),
            (5, "other words here"), (5, "other words here"), (None, "nameless"), (None, "nameless")]
    docs = spark.read.parquet(f"{table(rows)}/documents.parquet")
    got = sorted([(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()], key=str)
    assert got == [(1, "a b c d e f"), (3, None), (5, "other words here"), (None, "nameless")]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_connected(spark, shape):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 120)
    links = {
        "chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]],
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(90)], "empty": []}[shape]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = set(links)
    want = components_by_hand(sorted({x for p in links for x in p}), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert {k: got.get(k, k) for k in want} == want


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    want = simhash.fingerprints(simhash.shingle_hashes(text, 4, 42), 3)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprints(simhash.shingle_hashes(text, 4, 42), 3) == want
    assert want[0] % 2**64 == fingerprint_by_hand(text) and len(set(want)) == 3
