"""Transcripts, notes, imports, chunks and change detection."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.model import empty_table, make_store
from mnemoria.operators import changes, sessions
from mnemoria.plans.imports import import_notes, import_sessions
from mnemoria.sources.notes import parse_notes
from mnemoria.sources.transcripts import scan_transcripts
from tests.conftest import NOW


def line(role, content, at=0, **extra):
    stamp = f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}.500Z"
    return json.dumps({"type": role, "uuid": f"{role}{at}", "timestamp": stamp, "sessionId": "S1", "cwd": "/home/me/start",
                       "message": {"role": role, "content": content}, **extra})


def tool(name, at, **given):
    return {"type": "tool_use", "name": name, "input": given, "id": f"t{at}"}


def result(error, content="boom"):
    return {"type": "tool_result", "tool_use_id": "t", "is_error": error, "content": content}


GOAL = "Please build the login page schema"
SESSION = [
    json.dumps({"type": "summary", "timestamp": "2024-01-01T00:00:00Z", "gitBranch": "main"}),
    "{not json",
    line("user", "<system-reminder>be nice", 1),
    line("user", "hidden", 2, isMeta=True),
    line("user", GOAL, 10),
    line("assistant", [{"type": "text", "text": "ok"}, tool("Edit", 20, file_path="/home/me/app/src/a.py", old_string="x", new_string="yy")], 20),
    line("assistant", [tool("Edit", 25, file_path="/home/me/app/src/a.py", old_string="", new_string="z")], 25),
    line("assistant", [tool("Write", 40, file_path="/home/me/app/src/a.py", content="hello"), tool("Read", 40, file_path="/r.txt", offset=5)], 40),
    line("user", [result(True), result(True, [{"type": "text", "text": "a"}, "b"]), {"type": "text", "text": "carrier text here"}], 45),
    line("user", [result(True), result(True)], 46),
    line("user", "We decided to go with Postgres for storage, never use SQLite in tests please", 50),
    line("assistant", [tool("Bash", 60, command="cat ./src/b.py"), tool("Bash", 61, command="ls"), tool("Other", 62, x=1)], 60),
    line("assistant", "plain", 70),
    json.dumps({"type": "system", "timestamp": "2024-01-01T00:10:00Z"}),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "p").mkdir()
    (root / "p" / "s1.jsonl").write_text("\n".join(SESSION) + "\n")
    (root / "p" / "empty.jsonl").write_text(json.dumps({"type": "summary", "sessionId": "S0"}) + "\n")
    auto = [line("user", '<scheduled-task name="nightly">', 0), line("assistant", "done", 1)]
    (root / "auto.jsonl").write_text("\n".join(x.replace("S1", "S2") for x in auto) + "\n")
    (root / "ignored.txt").write_text("x")
    return root


def test_scan_transcripts(spark, folder):
    heads, turns = scan_transcripts(spark, str(folder))
    got = {r.session_id: r for r in heads.collect()}
    assert got.keys() == {"S1", "S2"}
    s = got["S1"]
    assert (s.project_cwd, s.git_branch, s.turns_user, s.turns_assistant, s.errors) == ("/home/me/start", "main", 5, 5, 4)
    assert s.ended_at - s.started_at == 600
    rows = turns.filter("session_id = 'S1'").orderBy("seq").collect()
    assert [r.uuid for r in rows][:3] == ["user1", "user10", "assistant20"] and rows[2].text == "ok"
    assert rows[5].has_tool_result and rows[5].text == "carrier text here" and rows[5].tool_results[1].output_preview == "a\nb"


def test_file_ops_intents_and_vote(spark, folder):
    heads, turns = scan_transcripts(spark, str(folder))
    ops = sessions.extract_file_ops(turns).filter("session_id = 'S1'").orderBy("seq", "call").collect()
    assert [(r.operation, r.file_path) for r in ops] == [
        ("edit", "/home/me/app/src/a.py"), ("edit", "/home/me/app/src/a.py"), ("write", "/home/me/app/src/a.py"),
        ("read", "/r.txt"), ("bash", "./src/b.py"), ("bash", "(shell)")]
    assert ops[0].preview == "OLD(1ch): x... NEW(2ch): yy..." and ops[2].preview == "WRITE(5ch): hello..."
    assert ops[3].preview == "READ /r.txt +5" and ops[5].preview == "ls"
    assert ops[0].intent == GOAL and ops[4].intent.startswith("We decided")
    votes = sessions.session_project_vote(heads, sessions.extract_file_ops(turns)).collect()
    assert {r.session_id: r.project for r in votes} == {"S1": "app", "S2": "start"}


def test_extract_memories(spark, folder):
    heads, turns = scan_transcripts(spark, str(folder))
    found = sessions.extract_memories(heads, turns, sessions.extract_file_ops(turns)).collect()
    by_kind = {(r.session_id, r.kind): r for r in found}
    assert {k for s, k in by_kind if s == "S1"} == {
        "first_intent", "clarification", "file_edit", "realize", "decision", "error_recovery", "session_summary"}
    goal = json.loads(by_kind["S1", "first_intent"].content)
    assert goal["what"] == GOAL and goal["altitude"] == "architecture" and goal["git_branch"] == "main"
    assert by_kind["S1", "first_intent"].importance == 0.8
    edit = json.loads(by_kind["S1", "file_edit"].content)
    # The second edit comes five seconds after the first and is not counted.
    assert edit["title"] == "edit+write a.py (2 ops)" and edit["op_count"] == 2 and edit["affects"] == ["/home/me/app/src/a.py"]
    assert edit["sample_change"] == "OLD(1ch): x... NEW(2ch): yy... | WRITE(5ch): hello..."
    assert json.loads(by_kind["S1", "realize"].content)["affects"][:2] == ["/home/me/app/src/a.py", "/r.txt"]
    assert json.loads(by_kind["S1", "error_recovery"].content)["title"] == "Many errors (4 in 10 turns)"
    summary = json.loads(by_kind["S1", "session_summary"].content)
    assert summary["title"] == f"Session: {GOAL} (10min, 1 files)" and summary["ended_at"] == "2024-01-01T00:10:00Z"
    assert {k for s, k in by_kind if s == "S2"} == {"automated_task", "session_summary"}
    assert json.loads(by_kind["S2", "automated_task"].content)["title"] == "Scheduled: nightly"


def test_import_is_idempotent(spark, folder, entities):
    s = make_store(spark, entities=entities({"name": "App", "normalized_name": "app"}))
    once = import_sessions(spark, str(folder), s, NOW)
    edits = once.file_edits.collect()
    assert len(edits) == 3 and len({e.memory_id for e in edits}) == 1 and edits[0].memory_id is not None
    mem = once.memories.collect()
    assert {json.loads(m.source)["session_id"] for m in mem} == {"S1", "S2"} and all(m.expires_at is None for m in mem)
    assert {e.name for e in once.entities.collect()} == {"App", "start"}
    assert once.events.count() == 2 and once.events.filter("kind = 'session_imported'").count() == 2
    stats = json.loads(once.events.filter("payload LIKE '%S1%'").first().payload)
    assert stats["file_edits"] == 3 and stats["memories"] == 7 and stats["stats"]["file_ops_raw"] == 6
    twice = import_sessions(spark, str(folder), once, NOW)
    key = ["layer", "content", "importance", "source"]
    assert twice.memories.select(key).exceptAll(once.memories.select(key)).count() == 0
    assert (twice.memories.count(), twice.file_edits.count(), twice.events.count(), twice.entities.count()) == (len(mem), 3, 2, 2)


def test_notes(spark, tmp_path):
    def put(name, raw):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(raw)

    put("p--one/memory/a.md", '---\nname: "A note"\ndescription: short\ntype: feedback\n---\nbody\ntoken=abc\n')
    put("p--one/memory/b.md", "---\nmetadata:\n  type: project\noriginSessionId: xyz\n---\njust body")
    put("p--one/memory/MEMORY.md", "index")
    put("p--one/memory/blank.md", "---\nname: x\n---\n\n")
    put("two/memory/MEMORY.md", "inline only")
    put("two/memory/c.txt", "no")
    files = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    got = {r.name: r for r in parse_notes(files).collect()}
    assert got.keys() == {"A note", "b", "MEMORY"}
    a, b = got["A note"], got["b"]
    assert (a.layer, a.importance, a.content) == ("learning", 0.7, "# A note\nshort\n\nbody\ntoken=[REDACTED]")
    assert (b.layer, b.importance, b.type, b.origin_session_id) == ("context", 0.6, "project", "xyz")
    assert got["MEMORY"].importance == 0.5 and got["MEMORY"].content == "# MEMORY\n\ninline only"
    long = spark.createDataFrame([("/x/memory/long.md", "word " * 5000 + "end")], "path STRING, raw STRING")
    assert parse_notes(long).first().content.endswith("word end")
    assert len(parse_notes(long, 8000).first().content) == 8000
    once = import_notes(spark, str(tmp_path), make_store(spark), NOW)
    assert sorted(e.name for e in once.entities.collect()) == ["one", "two"] and once.memories.count() == 3
    twice = import_notes(spark, str(tmp_path), once, NOW)
    assert twice.memories.count() == 3 and twice.events.count() == 2


def brute_debounce(times):
    kept, last = [], None
    for t in times:
        if not last or abs(t - last) >= 10:
            kept.append(t)
            last = t
    return kept


def test_debounce_compares_with_last_kept(spark):
    rng = np.random.default_rng(1)
    rows = [("k%d" % (i % 2), int(t), i) for i, t in enumerate(rng.integers(1000, 1600, 400))]
    rows += [("six", 1000 + 6 * i, 1000 + i) for i in range(7)] + [("zero", 0, 2000), ("zero", 0, 2001), ("zero", 5, 2002)]
    # File order, not time order: the last kept is what counts, and times may run back.
    rows += [("back", t, 3000 + i) for i, t in enumerate([100, 95, 106, 80, 0, 3])]
    df = spark.createDataFrame(rows, "k STRING, occurred_at BIGINT, seq BIGINT")
    got = {}
    for r in sorted(sessions.debounce_edits(df, ["k"]).collect(), key=lambda r: r.seq):
        got.setdefault(r.k, []).append(r.occurred_at)
    for k in ("k0", "k1", "six", "zero", "back"):
        assert got[k] == brute_debounce([t for kk, t, _ in rows if kk == k])
    assert got["zero"] == [0, 0, 5] and got["six"] == [1000, 1012, 1024, 1036] and got["back"] == [100, 80, 0, 3]


def test_debounce_walks_equal_places_by_time(spark):
    rows = [("k", 2000, 1), ("k", 1000, 1), ("k", 1000, 2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k STRING, occurred_at BIGINT, seq BIGINT")
        assert sorted(r.occurred_at for r in sessions.debounce_edits(df, ["k"]).collect()) == [1000, 1000, 2000]


def files(spark, *items):
    return spark.createDataFrame([(p, m, len(c.encode()), c) for p, m, c in items], "path STRING, mtime BIGINT, size_bytes BIGINT, content STRING")


MD = "intro\n\n## One\na\n### Two  \nb\nc"
PY = "import x\n\ndef f():\n  pass\nclass C:\n  def g(self): pass\nasync def h(): pass\n"


def test_chunks(spark):
    long = "\n".join(str(i) for i in range(250))
    df = files(spark, ("a.md", 1, MD), ("b.PY", 1, PY), ("c.txt", 1, long), ("d.md", 1, "no headings"), ("e.ts", 1, "x"))
    got = {}
    for r in changes.chunk_documents(df).orderBy("path", "start_line").collect():
        got.setdefault(r.path, []).append((r.id, r.kind, r.start_line, r.end_line))
    assert got["a.md"] == [("heading:_preamble", "heading", 1, 2), ("heading:One", "heading", 3, 4), ("heading:Two", "heading", 5, 7)]
    assert got["b.PY"] == [("python_preamble", "python_preamble", 1, 2), ("python_def:f", "python_def", 3, 4),
                           ("python_class:C", "python_class", 5, 6), ("python_def:h", "python_def", 7, 8)]
    assert got["c.txt"] == [("lines:1_100", "fixed", 1, 100), ("lines:101_200", "fixed", 101, 200), ("lines:201_250", "fixed", 201, 250)]
    assert got["d.md"] == [("lines:1_1", "fixed", 1, 1)] and got["e.ts"] == [("lines:1_1", "fixed", 1, 1)]


def test_change_detection(spark):
    before = files(spark, ("a.md", 1, MD), ("b.txt", 1, "same"), ("c.txt", 1, "touched"))
    snap = changes.upsert_file_snapshots(empty_table(spark, "file_snapshots"), changes.snapshot_rows(before, NOW))
    after = files(spark, ("a.md", 2, MD.replace("a\n", "A\n").replace("### Two", "### Three")), ("b.txt", 1, "same"),
                  ("c.txt", 2, "touched"), ("d.txt", 2, "new"))
    got = {r.path: r for r in changes.detect_changes(snap, after).collect()}
    assert {p: r.status for p, r in got.items()} == {"a.md": "modified", "b.txt": "unchanged", "c.txt": "unchanged_content", "d.txt": "first_read"}
    assert (got["a.md"].changed, got["a.md"].unchanged, got["a.md"].removed) == (2, 1, 1)
    forced = {r.status for r in changes.read_status(snap, after, force=True).collect()}
    assert forced == {"forced_full", "first_read"}
    diff = {r.id: r.status for r in changes.chunk_diff(changes.stored_chunks(snap.filter("path = 'a.md'")), changes.chunk_documents(after.filter("path = 'a.md'"))).collect()}
    assert diff == {"heading:_preamble": "unchanged", "heading:One": "modified", "heading:Three": "added", "heading:Two": "removed"}
    total = {r.path: r for r in changes.reread_savings(changes.detect_changes(snap, after)).collect()}
    assert total["*"].tokens_full == total["a.md"].tokens_full and total["a.md"].tokens_saved == 0
    touch = snap.select("path", F.lit(None).cast("string").alias("content_hash"), F.lit(9).cast("bigint").alias("mtime"),
                        F.lit(None).cast("bigint").alias("size_bytes"), F.col("chunks"), F.lit(NOW + 1).cast("bigint").alias("read_at"))
    touched = changes.upsert_file_snapshots(snap, touch.filter("path = 'b.txt'")).filter("path = 'b.txt'").first()
    assert (touched.mtime, touched.read_count, touched.size_bytes) == (9, 2, 4)


def test_every_removed_chunk_is_told(spark):
    ddl = "path STRING, id STRING, kind STRING, start_line INT, end_line INT, hash STRING"
    stored = spark.createDataFrame(
        [("a", "h", "s", 1, 2, "x"), ("a", "h", "s", 3, 4, "y"), ("a", "k", "s", 5, 6, "z"), ("a", "k", "s", 7, 8, "w")], ddl)
    new = spark.createDataFrame([("a", "k", "s", 1, 2, "w", "text"), ("a", "n", "s", 3, 4, "v", "more")], ddl + ", content STRING")
    got = sorted((r.id, r.status, r.start_line) for r in changes.chunk_diff(stored, new).collect())
    assert got == [("h", "removed", 1), ("h", "removed", 3), ("k", "unchanged", 1), ("n", "added", 3)]
