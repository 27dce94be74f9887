"""Segment join, edit distance and dropped lines against brute force."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from mnemoria.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        line = line[:at] + ("" if kind == 2 else rng.choice("abé😀 ")) + line[at + (kind > 0):]
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance_substrings_and_parity(edits):
    rng = random.Random(edits)
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(edits + 1, 14)))
        b = edited(rng, a, rng.randint(0, edits + 2)) if rng.random() < 0.8 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        near = distance(a, b) <= edits
        assert ld.within(a, b, edits) == ld.within(b, a, edits) == near, (a, b)
        if near:
            words = iter([bin((x ^ y) % 2**64).count("1") for x, y in zip(ld.parities(a), ld.parities(b))])
            assert all(sum(next(words) for _ in range(n)) <= 2 * length * edits for length, n in ld.PARITIES)
            if len(b) > edits:
                keys = [{(n, i, x[s : s + k]) for n, i, s, k in ld.substrings(len(x), edits, edits + 1)} for x in (a, b)]
                assert keys[0] & keys[1], (a, b)
    long = "x" * 30000 + "".join(rng.choice("ab") for _ in range(3000))
    assert ld.within(long, edited(rng, long, edits), edits) and not ld.within(long, long + "y" * (edits + 1), edits)


def by_hand(rows, settings=ld.Settings()):
    """{(doc_id, text): dropped line numbers}: classes over all pairs of distinct lines."""
    at = {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for no, line in enumerate((text or "").split("\n")):
            line = line.strip(ld.SPACES)
            if text and len(line) >= settings.least_chars:
                at.setdefault(line, []).append((i, text, no))
    lines = sorted(at)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in lines if len(x) >= settings.near_chars]
    for n, a in enumerate(long):
        for b in long[n + 1 :]:
            if abs(len(a) - len(b)) <= settings.edits and distance(a, b) <= settings.edits:
                root[find(b)] = find(a)
    classes = {}
    for x in lines:
        classes.setdefault(find(x), []).extend(at[x])
    dropped = {}
    for places in classes.values():
        first = min(places, key=lambda p: (p[0] is None, p[0] or 0, p[2]))
        for i, text, no in places:
            if (i, text, no) != first:
                dropped.setdefault((i, text), []).append(no)
    return {k: sorted(v) for k, v in dropped.items()}


def fixture(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(25, 60))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 9])) for _ in range(rng.randint(0, 4))]
        lines += [rng.choice(["short", "twelve chars", "", "  twelve chars \t"])]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_lines(spark, table, seed):
    rows = fixture(seed) + [(200, None), (201, ""), (202, "\n\n"), (203, "one long line that is here twice, whole\n" * 2)]
    rows += [(3, fixture(seed)[3][1]), (None, "a line without an id, of thirty and more\nshort")]
    want = by_hand(rows)
    got = ld.op4_line_dedup(spark, table(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        lines = want.get((r.doc_id, texts[r.doc_id]), [])
        assert (r.dropped_lines, r.n_dropped) == (",".join(map(str, lines)), len(lines)), r
        assert r.n_near <= r.n_dropped <= r.n_lines
    assert any(r.n_near for r in got)


def test_texts_are_cut_and_depleted_documents_go(spark, table):
    rows = fixture(5) + [(300, None), (301, "")]
    extra = [(i, text, "en", "s", 1) for i, text in rows]
    docs = spark.read.parquet(f"{table(extra)}/documents.parquet")
    got = {r.doc_id: r for r in ld.without_repeated_lines(docs).collect()}
    want = by_hand(rows)
    for i, text in rows:
        gone = want.get((i, text))
        kept = text if gone is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        part = [x for x in (text or "").split("\n") if len(x.strip(ld.SPACES)) >= ld.Settings().least_chars]
        if gone and len(gone) == len(part):
            assert i not in got
        else:
            assert got[i].text == kept and got[i].lang == "en"
    assert ld.op4_line_dedup(spark, table([])).count() == 0


def test_the_pipeline_keeps_unique_short_lines(spark, table):
    """A document goes only if no word is left of it, or all of it stays in an earlier one."""
    rows = fixture(5) + [(300, None), (301, ""), (400, "the common heading\nred rose\nblue sky"), (401, "the common heading\none\ntwo"),
                         (402, "the common heading\n \n"), (403, "the common heading\none\ntwo"), (404, "one\ntwo"), (405, "one\ntwo")]
    docs = spark.read.parquet(f"{table([(*r, 'en', 's', 1) for r in rows])}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    want, expected, texts = by_hand(rows), {}, set()
    for i, text in rows:
        gone = want.get((i, text))
        kept = text if gone is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        if gone is None or kept.split() and text not in texts:
            expected[i] = kept
        texts.add(text)
    assert got == expected
    assert got[401] == "one\ntwo" and {402, 403}.isdisjoint(got) and got[404] == got[405]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_over_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = by_hand(rows)
    for r in ld.op4_line_dedup(spark, SF).collect():
        assert r.dropped_lines == ",".join(map(str, want.get((r.doc_id, dict(rows)[r.doc_id]), [])))
