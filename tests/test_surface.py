import subprocess

import pytest

from plinth import Session, cli
from plinth.functions.interval import IntervalError, parse
from plinth.sources import git, sinks


def test_interval_literals():
    for t in ("1 h", "1 hour", "1 hours", "1:00:00"):
        assert parse(t)["hours"] == 1
    for t in ("2 w", "2 week", "2 weeks", "1 week 7 day", "1 w 7 d", "1 weeks 7 days"):
        assert parse(t)["days"] == 14
    assert parse("10.1 second")["seconds"] == 10.1
    a, b = parse("1 y 1 m 1 w 1 d"), parse("1 y 1 m 1 w 1 d ago")
    assert all(b[k] == -a[k] for k in a)
    for bad in ("1 h 1:00:00", "1 h 1 h", "", "5", "1 parsec", "999999999 years"):
        with pytest.raises(IntervalError):
            parse(bad)


def test_arguments():
    assert cli.parse([])[0] == "repl" and cli.parse([])[2].repos
    assert cli.parse(["--repos", "a", "b"])[2].repos == ["a", "b"]
    assert cli.parse(["-q", "SELECT 1"])[:2] == ("query", "SELECT 1")
    assert cli.parse(["-s", "f.sql"])[:2] == ("script", "f.sql")
    assert cli.parse(["--help"])[0] == "help" and cli.parse(["-v"])[0] == "version"
    assert cli.parse(["--pagesize", "7"])[2].page_size == 7
    assert cli.parse(["--output", "CSV"])[2].output == "csv" and cli.parse(["-o", "render"])[2].output == "table"
    for bad in (["--pagesize", "-"], ["--pagesize"], ["--output", "text"], ["--output"], ["-q"], ["--nope"], ["plain"]):
        assert cli.parse(bad)[0] == "error"


def test_sinks(spark, tmp_path):
    s = Session(spark).register_table("t", spark.createDataFrame([(1, "a,b"), (2, None)], "id int, name string"))
    path = tmp_path / "o.txt"
    s.sql(f"SELECT id, name FROM t ORDER BY id INTO OUTFILE '{path}' FIELDS TERMINATED BY ';' LINES TERMINATED BY '|' ENCLOSED '\"'")
    assert path.read_text() == '"id";"name"|"1";"a,b"|"2";"Null"|'
    s.sql(f"SELECT id FROM t ORDER BY id INTO DUMPFILE '{path}'")
    assert path.read_text() == "id12"
    df = s.query("SELECT id, name FROM t ORDER BY id")
    assert sinks.csv_text(df) == 'id,name\n1,"a,b"\n2,Null\n'
    assert sinks.json_text(df) == '[{"id": "1", "name": "a,b"}, {"id": "2", "name": "Null"}]'
    assert sinks.yaml_text(df) == '- id: "1"\n  name: "a,b"\n- id: "2"\n  name: "Null"\n'
    assert "│ 1  ┆ a,b  │" in sinks.table_text(df) and "a,b" not in sinks.table_text(df, None, 1, 2)
    sinks.write_distributed(df, None, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).count() == 2
    shown = []
    answers = iter(["n", "q"])
    args = cli.parse(["-p", "-ps", "1", "-q", "x"])[2]
    cli.show(s.sql("SELECT id FROM t ORDER BY id")[0], args, lambda p: shown.append(p) or next(answers))
    assert len(shown) == 2


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.name", "Ann Example")
    run("config", "user.email", "ann@example.test")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    run("add", ".")
    run("commit", "-qm", "feat: first\n\nbody")
    (tmp_path / "a.txt").write_text("one\nthree\n")
    (tmp_path / "b.txt").write_text("new\n")
    run("add", ".")
    run("commit", "-qm", "fix: second")
    run("tag", "v1")
    run("branch", "side")
    return str(tmp_path)


def test_git_tables(spark, repo):
    s = Session(spark)
    git.register(s, [repo])
    q = lambda t: [tuple(r) for r in s.query(t).collect()]
    assert q("SELECT commit_conventional(title) AS k, parents_count, author_name FROM commits ORDER BY parents_count") == [("feat", 0, "Ann Example"), ("fix", 1, "Ann Example")]
    assert q("SELECT path, mode, insertions, removals FROM diffs_changes ORDER BY path") == [("a.txt", "M", 1, 1), ("b.txt", "A", 1, 0)]
    assert q("SELECT files_changed, diff_files_count(diff_changes) AS n, diff_added_content(diff_changes) AS c, is_diff_has_file(diff_changes, 'a.txt') AS h FROM diffs ORDER BY files_changed") == [(0, 0, "", False), (2, 2, "new\n", True)]
    assert q("SELECT name FROM tags") == [("v1",)]
    assert q("SELECT name, commit_count, is_head FROM branches ORDER BY name") == [("refs/heads/main", 2, True), ("refs/heads/side", 2, False)]
    assert q("SELECT COUNT() AS n FROM refs WHERE type = 'branch'") == [(2,)]
    with pytest.raises(git.NotARepository):
        git.register(s, ["/nonexistent"])


def test_streaming(spark, tmp_path):
    from plinth.streaming import events as ev

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ev.event_stream(spark, str(tmp_path / "in"), 3)
    batch = {(r.start, r.event_type): r.n for r in ev.windowed_counts(src, "1 day").collect()}
    q = ev.windowed_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start, r.event_type): r.n for r in spark.table("w").collect()} == batch
    q = ev.running_totals(stream).writeStream.outputMode("update").format("memory").queryName("r").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("r").groupBy("user_id").max("n").collect()
    want = {r.user_id: r["count"] for r in src.groupBy("user_id").count().collect()}
    assert {r.user_id: r["max(n)"] for r in got} == want


def test_running_sum_and_spread(spark):
    from plinth.operators.ranks import running_sum
    from plinth.operators.spreading import spread

    rows = [("a", k // 3, k, k) for k in range(10)] + [(None, 0, 1, None), (None, 0, 2, 5)]
    df = spark.createDataFrame(rows, "k string, b int, o int, v int")
    got = {(r.k, r.o): r.s for r in running_sum(df, ["k"], "b", ["o"], "v", "s").collect()}
    assert all(got["a", k] == sum(range(k)) for k in range(10)) and got[None, 2] == 0
    assert spread(df.coalesce(1)).count() == 12


def test_lineage(spark):
    from plinth.operators.lineage import cut, shared_dir, written

    df = spark.range(5).selectExpr("id", "id * 2 AS w")
    assert sorted(r.w for r in written(df, "t").collect()) == [0, 2, 4, 6, 8]
    assert cut(df).count() == 5 and shared_dir(spark)


def test_entry_contract(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    assert e.entry(spark).count() >= 0


def test_git_paths_copies_and_pruning(spark, tmp_path, monkeypatch):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("config", "user.name", "Ann \x01\x02 Example")
    run("config", "user.email", "ann@example.test")
    text = "".join(f"line {k}\n" for k in range(30))
    for d in ("x", "y", "z"):
        (tmp_path / d).mkdir()
    (tmp_path / "\u00e9.txt").write_text(text)
    (tmp_path / "x" / "n.txt").write_text(text.upper())
    (tmp_path / "y" / "n.txt").write_text("other\n" * 20)
    run("add", ".")
    run("commit", "-qm", "first")
    run("mv", "x/n.txt", "z/n.txt")
    (tmp_path / "y" / "n.txt").write_text("other\n" * 19)
    (tmp_path / "c\tp.txt").write_text(text)
    (tmp_path / "\u00e9.txt").write_text(text + "more\nand more\n")
    run("add", ".")
    run("commit", "-qm", "second")
    run("commit", "-q", "--allow-empty", "-m", "third")
    s = Session(spark)
    git.register(s, [str(tmp_path)])
    rows = {tuple(r) for r in s.query("SELECT path, mode, insertions, removals FROM diffs_changes").collect()}
    assert rows == {("\u00e9.txt", "M", 2, 0), ("c\tp.txt", "C", 0, 0), ("z/n.txt", "R", 0, 0), ("y/n.txt", "M", 0, 1)}
    assert [r[0] for r in s.query("SELECT title FROM commits").collect()] == ["third", "second", "first"]
    # Small ranges of commits give the same rows.
    whole = sorted(map(str, s.query("SELECT * FROM diffs").collect()))
    monkeypatch.setattr(git, "RANGE", 1)
    reader = git._Reader("diffs", [str(tmp_path)], set(spark.createDataFrame([], git.SCHEMAS["diffs"]).columns))
    parts = reader.partitions()
    assert len(parts) == 3 and len([x for p in parts for x in reader.read(p)]) == len(whole) == 3
    # No content is read, and nothing compared, for columns that need neither.
    called = []
    monkeypatch.setattr(git._Blobs, "read", lambda self, blob: called.append(blob))
    few = list(git.diffs(git.Part(str(tmp_path), 0, 10), {"commit_id", "insertions"}))
    assert not called and [r[3] for r in few] == [0, 2, 0] and all(r[6] is None for r in few)
    assert [r[3] for r in git.diffs(git.Part(str(tmp_path), 0, 10), {"commit_id"})] == [None] * 3
    seen = []
    s.register_table("lazy", lambda columns=None: seen.append(columns) or spark.createDataFrame([(1, "a", 2.0)], "k int, t string, f double"))
    assert [tuple(r) for r in s.query("SELECT k FROM lazy WHERE t = 'a'").collect()] == [(1,)] and seen[-1] == {"k", "t"}
