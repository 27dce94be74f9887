"""Filter audit, collocations and SetSketch near-duplicates against plain Python."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.llm import collocations, components, filter_audit, setsketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id LONG, quality INT, toxic INT"


def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 99, 100, 130]))), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, None, None), (103, "A# B", "en"), (104, "SHOUTING ALL THE WAY " * 40, "en")]
    rows += [(105, rows[3][1], "de"), (106, rows[3][1], "en"), (3, rows[3][1], rows[3][2]), (None, rows[3][1], "en")]
    rows += [(107, "x" * 300_000 + " long", "en"), (108, "あい ÄÖ Z", "de"), (109, "word " * 40_000, "")]
    return rows


def with_clashes(df):
    """The same rows with columns that operators use inside."""
    return df.selectExpr("*", "1 AS unit", "2 AS failing", "3 AS part", "4 AS shard", "'x' AS words", "5 AS node", "6 AS rank", "7 AS mark")


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    told = []
    for i, text, lang in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and firsts.get(text, i) < i else set()
        told.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {t[0] for t in told}:
        for order in itertools.permutations("ABCDE"):
            alive = [t for t in told if t[0] == part]
            for step, letter in enumerate(order, 1):
                lost = [t for t in alive if letter in t[1]]
                here = [t for t in told if t[0] == part and letter in t[1]]
                alive = [t for t in alive if letter not in t[1]]
                out[part, "".join(order), step] = [
                    len(alive), len(lost), len(here) - len(lost), sum(t[1] == {letter} for t in here), sum(t[2] for t in lost), sum(t[3] for t in lost)
                ]
    for key in out:
        part, letter = key[0], key[1][key[2] - 1]
        out[key].append(sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == letter))
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_walked(spark):
    rows = odd_rows()
    labels = [(i, i % 2, (i // 3) % 2) for i in range(0, 60, 2)] + [(4, 1, 0), (9999, 1, 1)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING"))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(got) == len(found) and found == brute_audit(rows, labels)
    assert len(found) == 600 * len({p for p, _, _ in found})


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING")
    assert filter_audit.audit(docs, spark.createDataFrame([], LABELS)).count() == 0


def test_matrix_rows_are_the_documents_words(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5)
    matrix = filter_audit.document_term_matrix(docs, shard_words=200, unit_words=30)
    word = {r["first"] + i: w for r in matrix.dictionary.collect() for i, w in enumerate(r["words"])}
    assert sorted(word) == list(range(len(word))) and len(set(word.values())) == len(word)
    got = []
    for shard in matrix.shards.collect():
        for i, doc_id in enumerate(shard["doc_id"]):
            low, high = shard["offsets"][i], shard["offsets"][i + 1]
            got.append((doc_id, Counter(dict(zip(map(word.get, shard["columns"][low:high]), shard["times"][low:high])))))
    wanted = [(i, Counter(WORDS.findall(t or ""))) for i, t in rows]
    key = lambda x: (str(x[0]), sorted(x[1].items()))
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_a_shard_is_renumbered_and_counted_in_one_worker(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id LONG, text STRING").coalesce(1)
    counted = filter_audit.row_counts(filter_audit.document_term_matrix(docs))
    assert sorted(map(tuple, counted.collect())) == [(0, 0, 2), (1, 1, 3), (3, 2, 1)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_codes_of_a_unit_come_once_however_many_shards_it_has(spark):
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(20))) for i in range(50)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1)
    matrix = filter_audit.document_term_matrix(docs, shard_words=20, unit_words=10_000)
    held = matrix.coded.collect()
    shards, pieces = [r for r in held if r["__csr"] is not None], [r for r in held if r["__csr"] is None]
    assert len(shards) > 40 and sum(r["__n"] for r in pieces) == 40
    assert all(r["__codes"] is None for r in shards) and {kind for c, kind in matrix.coded.dtypes if "array" in kind} == {"array<bigint>"}
    # No word is read to tell the rows apart.
    plan = matrix.coded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Relation" not in line and re.search(r"\bwords#", line)]
    assert sorted(map(tuple, filter_audit.row_counts(matrix).collect()), key=lambda r: r[2]) == [(20, 20, i) for i in range(50)] + [(0, 0, 50), (0, 0, 51)]


def brute_phrases(rows, least, top):
    f = {}
    for _, text, lang in rows:
        table = f.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                table.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, table in f.items():
        n = sum(c for p, c in table.items() if len(p) == 1)
        candidates = {p: c for p, c in table.items() if len(p) > 1 and c >= least}
        rows_ = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, c in candidates.items()
            )
            if not inside:
                score, _, l, r = min((2_000_000 * a // (table[p[:k]] + table[p[k:]]), k, table[p[:k]], table[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    stock = ["new york city hall", "Once upon, a time", "of the people", "É té", "a a a a a a", "x\ty z"]
    rows = []
    for i in range(250):
        parts = rng.choices(stock, k=6) + rng.choices(["la", "le", "du", "of", "the", "new"], k=8)
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", ". ", "\n"]).join(parts), rng.choice(["en", "fr", None])))
    rows += [(500, None, "en"), (501, "", None), (502, "...", "de"), (503, "hot pair " * 3000, "en"), (504, "z" * 200_000, "en"), (0, rows[0][1], "fr")]
    return rows


@pytest.mark.parametrize("shard_words, bucket_rows, most_over, top", [(500_000, 1_000_000, 2, 2000), (300, 50, 0, 25)])
def test_phrases_equal_counting_all(spark, shard_words, bucket_rows, most_over, top):
    rows = phrase_rows()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")).repartition(3)
    settings = collocations.Settings(top=top, bucket_rows=bucket_rows, most_over=most_over)
    got = collocations.collocations(docs, settings=settings, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 30, top)


def test_suffixes_of_a_bucket_are_short_rows(spark):
    """Neither codes nor suffixes lie in array columns, whose entries Spark holds several times over; a wide bucket's cuts neither."""
    docs = spark.createDataFrame([(1, "hot pair " * 20_000, "en"), (2, "cold " * 3, "en")], "doc_id LONG, text STRING, lang STRING").coalesce(1)
    shards = collocations.sequences(docs, "text", "lang", 500_000)
    assert dict(shards.dtypes)["codes"] == "binary" and sum(len(r["codes"]) for r in shards.collect()) < 20_000
    codes = shards.selectExpr("shard", "array(0, 1, 2) AS locals", "array(7, 8, 9) AS codes")
    blobs = collocations.routed(shards, codes, 3)
    assert not [kind for _, kind in blobs.dtypes if "array" in kind]
    sizes = spark.createDataFrame([(b, 2) for b in range(3)], "bucket LONG, splits INT")
    for rows, partial in ((blobs, False), (collocations.split_wide(blobs, sizes, collocations.Settings()), True)):
        got, table = Counter(), rows.toArrow()
        for i in range(table.num_rows):
            words, times = collocations._arrays(table, i)
            got.update(dict(zip(map(tuple, words.tolist()), times.tolist())))
            assert table.column("partial")[i].as_py() is partial and len(words) == len(times) == table.column("n")[i].as_py()
        assert got == {(7, 8, 7, 8): 19_999, (8, 7, 8, 7): 19_998, (7, 8, 0, 0): 1, (8, 7, 8, 0): 1, (9, 9, 9, 0): 1, (9, 9, 0, 0): 1}


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id LONG, text STRING, lang STRING")).count() == 0


@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("small", [1, 7, 4096])
def test_quicksort_counts_prefixes(partial, small):
    rng = np.random.default_rng(small)
    words = rng.integers(0, 6, (3000, 4)).astype(np.int32)
    words[:, :2] += 1
    words[words[:, 2] == 0, 3] = 0
    times = rng.integers(1, 5, 3000)
    want = Counter()
    for row, n in zip(words.tolist(), times.tolist()):
        for k in range(2, 5):
            if row[k - 1]:
                want[(*row[:k], *[0] * (4 - k))] += n
    prefixes, counts = collocations.frequent_prefixes(words, times, 40, partial, small)
    got = dict(zip(map(tuple, prefixes.tolist()), counts.tolist()))
    assert len(got) == len(prefixes)
    assert got == {p: n for p, n in want.items() if n >= 40 or partial and p[3] == 0}


def test_products_of_large_counts_stay_exact(spark):
    big = 3 * 10**17
    phrases = spark.createDataFrame([([1, 2], big)], "phrase ARRAY<INT>, a LONG")
    counts = spark.createDataFrame([([1], big + 1), ([2], big + 2), ([1, 2], big)], "phrase ARRAY<INT>, a LONG")
    row = collocations.worst_cuts(phrases, counts, collocations.Settings()).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 3) == 999_999


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=str)


def near_rows():
    rng = random.Random(3)
    rows = []
    for group in range(12):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 60, 400]))]
        for copy in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 50, len(base) // 15])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((1000 - len(rows), " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "one two three"), (5006, "x" * 200_000)]
    rows += [rows[0], (None, rows[0][1]), (None, "only here and nowhere else at all"), (5007, "same word " * 20_000), (5008, "same word " * 900)]
    return rows


def test_setsketch_components_equal_all_pairs(spark):
    rows = near_rows()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id LONG, text STRING")).repartition(3)
    got = setsketch.near_duplicates(docs)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == brute_near(rows)


def drifting_rows():
    """Groups whose links are not those with the first text: chains of small changes, own changes to a common text of all shares
    from a few to many, and changes that some of the texts have in common."""
    rng = random.Random(11)
    rows = []
    for length in (60, 150):
        words = [f"c{length}x{i}" for i in range(length)]
        for _ in range(30):
            words[rng.randrange(length)] = f"d{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    base = [f"b{i}" for i in range(150)]
    shared = {i: f"s{i}" for i in rng.sample(range(150), 12)}
    for copy in range(120):
        words = list(base)
        for i in rng.sample(range(150), rng.choice([1, 3, 6, 8, 12])):
            words[i] = f"o{rng.randrange(10**6)}"
        if copy % 4 == 0:
            for i in rng.sample(sorted(shared), 6):
                words[i] = shared[i]
        rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_setsketch_links_beside_the_hub(spark):
    rows = drifting_rows()
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3))
    want = brute_near(rows)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == want
    assert 3 < len({r[2] for r in want}) < len(rows)


def test_pairs_across_classes_lose_no_link_and_are_few(spark):
    """Sets with too many changes of their own are never tried against each other, whatever the size of their group."""
    rng = random.Random(5)
    sets = [set(range(100)) - set(rng.sample(range(100), 15)) | {1000 + 100 * i + j for j in range(15)} for i in range(80)]
    for i in range(0, 20, 2):
        sets[i + 1] = sets[i] - set(rng.sample(sorted(sets[i]), 5))
    linked = {(i, j) for i, j in itertools.combinations(range(80), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    mixed = spark.createDataFrame([(7, i, len(x), i, 0) for i, x in enumerate(sets)], "bucket LONG, node LONG, payload LONG, root LONG, main LONG")
    held = spark.createDataFrame([(i, e) for i, x in enumerate(sets) for e in x], "node LONG, element LONG")
    got = components.pairs_across(
        mixed, lambda a, b: 5 * F.least(a, b) >= 4 * F.greatest(a, b), lambda wanted: held.join(wanted, "node"),
        lambda n, a, b: 9 * n >= 4 * (a + b), 10,
    )
    pairs = {tuple(sorted(r)) for r in got.collect()}
    assert len(linked) == 10 and linked <= pairs and len(pairs) < 40


def test_setsketch_of_nothing(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


def test_registers_merge_and_tell_the_similarity():
    rng = np.random.default_rng(1)
    settings = setsketch.Settings()
    pool = rng.integers(0, 2**64, 6000, np.uint64)
    for shared, alone in [(4000, 500), (2000, 2000), (300, 2700)]:
        a = np.unique(pool[: shared + alone])
        b = np.unique(np.concatenate([pool[:shared], pool[shared + alone : shared + 2 * alone]]))
        x, y = setsketch.registers(a, settings), setsketch.registers(b, settings)
        assert (setsketch.merged(x, y) == setsketch.registers(np.union1d(a, b), settings)).all()
        true = shared / (shared + 2 * alone)
        u, v = np.array([len(a) / (len(a) + len(b))]), np.array([len(b) / (len(a) + len(b))])
        told = setsketch.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), settings.registers, u, v, settings.base)
        assert abs(told[0] - true) < 0.15
