"""Secret scan, source mixing and quality rules against brute force, on tables and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from mnemoria.llm import mixing, quality, secret_scan

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def check_spans(got, texts):
    for r in got:
        text, want = texts[r.doc_id] or "", base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("random:")] == [x for x in want.split(",") if x]
        kinds = collections.Counter(x.split(":")[0] for x in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == tuple(kinds[k] for k in secret_scan.KINDS)
        assert all(int(x.split(":")[2]) <= len(text) for x in spans)


@needs_data
def test_secrets_over_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = secret_scan.op5_secret_scan(spark, SF).collect()
    assert len(got) == len(texts)
    check_spans(got, texts)


def test_secrets_odd_rows(spark, table):
    rng, pieces = random.Random(5), [
        "password=", "PassWd ", ": ", "token", "=", "'", '"', "abcdefgh1", "short", "AKIA", "AKIAABCDEFGH0123", "0123456789abcdef",
        "deadbeef", " ", "\n", "é", "😀", "api_key", "APIKEY", "x", "secret", ".", "F"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "password: token: abcdefgh", 1003: "0123456789abcdef" * 4000 + " " + "AKIA" * 2000}
    check_spans(secret_scan.op5_secret_scan(spark, table(list(texts.items()))).collect(), texts)
    assert secret_scan.op5_secret_scan(spark, table([])).count() == 0
    again = [(7, "password=abcdefgh1"), (7, "password=abcdefgh1"), (None, "AKIAABCDEFGH0123")]
    assert sorted(r.n_assign for r in secret_scan.op5_secret_scan(spark, table(again)).collect()) == [0, 1, 1]


def test_random_tokens_are_told_from_prose(spark, table):
    rng = random.Random(9)
    alphabets = [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"]
    prose = ["internationalization_of_the_message", "getUserAccountInformationFromService", "usr/local/lib/python/site-packages",
             "donaudampfschifffahrtsgesellschaft", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "abcdefghijklmnopqrstuvwxyzabcdef",
             "123456789012345678901234567890", "MAX_CONNECTION_RETRY_INTERVAL_SECONDS", "0000000000000000000000000000ff",
             "very-long-page-title-about-the-weather-in-spring", "abababababababababababab", "xyz1xyz1xyz1xyz1xyz1xyz1"]
    rows, secrets = [], set()
    for i in range(300):
        words = [rng.choice(prose) for _ in range(3)]
        if i % 6 == 0:
            size = 31 if i % 18 == 6 else rng.randint(28, 64)  # hex of 32 and more is a base kind
            words.insert(1, "".join(rng.choice(alphabets[i // 6 % 3]) for _ in range(size)))
            secrets.add(i)
        rows.append((i, " and ".join(words)))
    got = {r.doc_id: r for r in secret_scan.op5_secret_scan(spark, table(rows)).collect()}
    flagged = {i for i, r in got.items() if r.n_random or r.n_hex}
    assert len(flagged & secrets) >= 0.9 * len(secrets) and len(flagged - secrets) <= 2


def test_random_tokens_of_each_alphabet_and_length(spark, table):
    """Nearly all of 31 characters and more are found in every alphabet, however long they are."""
    rng, rows, kind = random.Random(14), [], {}
    for number, alphabet in enumerate(secret_scan.ALPHABETS[1:]):  # plain numbers are no keys
        for size in (20, 24, 31, 40, 48, 64, 80, 96, 128, 200):
            for _ in range(8):
                kind[len(rows)] = (number, size)
                rows.append((len(rows), f"some words and {''.join(rng.choice(alphabet) for _ in range(size))} after them"))
    prose = ["internationalization_of_the_message", "getUserAccountInformationFromService", "usr/local/lib/python/site-packages"]
    rows += [(len(rows) + i, f"more words {rng.choice(prose)} here") for i in range(300)]
    got = secret_scan.op5_secret_scan(spark, table(rows)).collect()
    found, missed = collections.Counter(), collections.Counter()
    for r in got:
        if r.doc_id in kind:
            (found if r.n_random or r.n_hex else missed)[kind[r.doc_id]] += 1
    for number in range(len(secret_scan.ALPHABETS) - 1):
        sizes = (31, 40, 48, 64, 80, 96, 128, 200)
        assert sum(found[number, x] for x in sizes) >= 0.95 * 8 * len(sizes), (number, missed)
        assert all(found[number, x] >= 6 for x in sizes), (number, missed)
        assert found[number, 20] + found[number, 24] >= 5, (number, missed)  # less evidence that they are not prose
    assert sum(r.n_random for r in got if r.doc_id not in kind) <= 3


def word_sizes(rows):
    return [(r[0], len(WORD.findall(r[1] or "")), r[3]) for r in rows]


def targets_by_hand(sizes):
    sums = collections.Counter()
    for _, n, source in sizes:
        sums[source] += n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sums.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    while total:
        above = {s for s in order if target[s] > 3 * sums[s] + 1e-9}
        if not above:
            break
        excess = sum(target[s] - 3 * sums[s] for s in above)
        target.update({s: 3 * sums[s] for s in above})
        free = [s for s in order if target[s] < 3 * sums[s] - 1e-9]
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    return sums, target


def check_mix(got, rows):
    sizes = word_sizes(rows)
    sums, target = targets_by_hand(sizes)
    source = {r[0]: r[3] for r in rows}
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, n) for i, n, _ in sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sums[s] and r.target == pytest.approx(target[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sums:
        assert abs(taken[s] - target[s]) <= 0.5 * largest[s] + 1e-6


@needs_data
def test_mixing_over_the_table(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = mixing.op6_source_mixing(spark, SF).collect()
    check_mix(got, rows)
    again = mixing.op6_source_mixing(spark, SF).repartition(3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_odd_rows(spark, table):
    rng = random.Random(2)
    rows = [(i, "w " * min(900, int(rng.paretovariate(0.7) * 5)), "en", rng.choice(["a", "a", "a", "b", "é", "", "z"])) for i in range(700)]
    rows += [(1000, None, None, "a"), (1001, "", None, "empty only"), (1002, "x y z", None, None), (1003, "  \n", "en", None)]
    rows += [(1004, "one two", "en", "c")] * 7 + [(None, "some words", "en", "b")]
    check_mix(mixing.op6_source_mixing(spark, table(rows)).collect(), [r for r in rows])
    assert mixing.op6_source_mixing(spark, table([])).count() == 0
    assert mixing.op6_source_mixing(spark, table([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_mixing_repeats_whole_rows(spark, table):
    rows = [(i, f"text {i} " + "w " * (i % 40), "en", "abc"[i % 3], 5) for i in range(300)] + [(7, "same", "en", "a", 1)] * 3
    docs = spark.read.parquet(f"{table(rows)}/documents.parquet")
    clash = docs.selectExpr("*", "7 AS n", "8 AS total", "9 AS size", "text AS key", "1 AS target", "2 AS mark")
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).count() > 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    kept = collections.Counter(tuple(r) for r in out.collect())
    assert set(kept) <= set(rows) and max(kept[r] for r in set(rows) if r[0] != 7) <= 3
    sums, target = targets_by_hand(word_sizes(rows))
    for s in "abc":
        taken = sum(n * len(WORD.findall(r[1])) for r, n in kept.items() if r[3] == s)
        assert abs(taken - target[s]) <= 25


def test_expected_copies_are_fair(spark):
    sizes = spark.createDataFrame([(i, "a" if i < 60 else "b", 10 + i % 7) for i in range(120)], "doc_id long, source string, size long")
    total = collections.Counter()
    for seed in range(8):
        for r in mixing.copies(sizes, ["doc_id"], seed).where("source = 'b'").collect():
            total[r.doc_id] += r.total
    assert 0 < sum(total.values()) and len([v for v in total.values() if v in (0, 8)]) < 25


def repeated_words(words):
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})


def check_counts(got, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        text = texts[r.doc_id]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)),
                repeated_words(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * want[4] > 20 * len(words))
        assert not (r.kept and r.base_failed)


def test_quality_counts_on_odd_rows(spark, table):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a ", "b\n", "c\t", "# ", "é|", "\n", "a b c d e f\n", "x ", "😀 "]) for _ in range(rng.randint(0, 60))), "en", "s")
            for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two three four five " * 3000), (904, "a " * 5), (905, "a " * 6)]
    check_counts(quality.op7_quality_rules(spark, table(rows)).collect(), rows)
    assert quality.op7_quality_rules(spark, table([])).count() == 0


def test_frequent_lines_deplete(spark, table):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    common = "This line is On every page"
    rows = [(i, f"{own(i)}\n  {common.upper() if i % 2 else common}", "en", "a") for i in range(30)]
    rows += [(100 + i, "\n".join([common] * 5 + ["all that is here"]), "en", "a") for i in range(3)]
    rows += [(200 + i, "\n".join([common] * 5), "en", "b") for i in range(3)] + [(300, own(1), "en", None), (5, rows[5][1], "en", "a")]
    got = collections.defaultdict(list)
    for r in quality.op7_quality_rules(spark, table(rows)).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept and got[i][0].lost_words == 6 for i in range(30)) and len(got[5]) == 2
    assert all(not got[100 + i][0].kept for i in range(3))
    assert all(got[200 + i][0].lost_words == 0 for i in range(3)) and got[300][0].kept


def test_a_line_goes_at_any_size_of_its_host(spark, table):
    """The same copies, in a small host and in one of thirty thousand documents."""
    shared = "eleven documents of this host hold this line"
    body = "\n".join([shared] * 6 + ["some words"])
    rows = [(i, body, "en", "large") for i in range(11)] + [(100 + i, body, "en", "small") for i in range(11)]
    rows += [(1000 + i, f"own words of document {i} that no other has in it at all", "en", "large") for i in range(30_000)]
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, table(rows)).collect()}
    assert all(got[i].lost_words == 48 and not got[i].kept for i in [*range(11), *range(100, 111)])
    assert sum(r.kept for r in got.values()) == 30_000


def without_lines(rows, most=10, least=4):
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    holders = collections.defaultdict(set)
    for no, (i, text, _, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(WORD.findall(line)) >= least:
                holders[host, norm(line)].add(("none", no) if i is None else i)
    out = []
    for i, text, lang, host in rows:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if len(WORD.findall(x)) < least or len(holders[host, norm(x)]) <= most)
        out.append((i, text, lang, host))
    return out


def test_frequent_lines_are_removed(spark, table):
    rng = random.Random(12)
    pool = ["This line is on every page", "  THIS line is\ton every page ", "short line", "", "   ", "and a line of its own kind",
            "privacy terms contact and imprint", "a b c d", "\r"]
    rows = [(i, "\n".join(rng.choice(pool) + (f" {i}" if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 9))), "en",
             rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "\n".join([pool[0]] * 3000), "en", "a"), rows[3], rows[3]]
    rows += [(None, pool[4] + "\n" + pool[0], "en", "a") for _ in range(3)] + [(None, f"the only one of these {i}", "en", "z") for i in range(3)]
    docs = spark.read.parquet(f"{table(rows)}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS line", "2 AS words", "3 AS row", "'x' AS host", "4 AS place")
    got = quality.without_frequent_lines(extra)
    assert got.columns == extra.columns
    key = lambda r: tuple(map(str, r))
    found = [(r.doc_id, r.text, r.lang, r.source) for r in got.collect()]
    assert sorted(found, key=key) == sorted(without_lines(rows), key=key)
    assert any(r[1] == "" for r in found if r[0] == 902)
    lost = {r.doc_id: r.lost_words for r in quality.quality(extra).collect() if r.doc_id is not None}
    before = {i: len(WORD.findall(t or "")) for i, t, _, _ in rows}
    assert all(before[i] - len(WORD.findall(t or "")) == lost[i] for i, t, _, _ in found if i is not None)
    assert quality.without_frequent_lines(docs.limit(0)).count() == 0
