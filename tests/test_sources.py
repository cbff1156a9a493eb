import json
import os

from talliq.sources import git, transcripts as t


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def cursor_after(path, cursor=None, most=None):
    at, restarted = t.resumed(str(path), cursor)
    got = list(t.lines(str(path), at.byte_offset, None, most))
    end = got[-1][1] if got else at.byte_offset
    return t.Cursor(end, at.file_id, at.head_hash), [x for _, _, x in got], restarted


def test_discovery_is_recursive_sorted_and_exact(tmp_path):
    (tmp_path / "b" / ".hidden").mkdir(parents=True)
    for name in ("z.jsonl", "b/a.jsonl", "b/.hidden/c.jsonl", "x.json", "y.jsonl.bak", ".jsonl"):
        write(tmp_path / name, "")
    os.symlink(tmp_path / "z.jsonl", tmp_path / "link.jsonl")
    assert [os.path.relpath(p, tmp_path) for p in t.discover(str(tmp_path))] == ["b/.hidden/c.jsonl", "b/a.jsonl", "z.jsonl"]
    assert t.discover(str(tmp_path / "none")) == []


def test_cursor_resumes_after_appends_and_leaves_unfinished_lines(tmp_path):
    p = tmp_path / "a.jsonl"
    write(p, "one\ntwo\nthr")
    cursor, lines, _ = cursor_after(p)
    assert lines == [b"one", b"two"] and cursor.byte_offset == 8
    assert cursor_after(p, cursor)[1] == []
    write(p, "ee\n", "a")
    cursor, lines, restarted = cursor_after(p, cursor)
    assert lines == [b"three"] and not restarted


def test_replacement_is_detected(tmp_path):
    p = tmp_path / "a.jsonl"
    write(p, "one\ntwo\n")
    cursor, _, _ = cursor_after(p)
    write(p, "one\n")  # truncated in place
    assert cursor_after(p, cursor)[1:] == ([b"one"], True)
    write(p, "eno\ntwo\nmore\n")  # another head
    assert cursor_after(p, cursor)[1:] == ([b"eno", b"two", b"more"], True)
    os.remove(p)
    write(tmp_path / "other", "x")
    write(p, "one\ntwo\nthree\n")
    assert cursor_after(p, t.Cursor(8, os.stat(p).st_ino + 1, t.head_hash(str(p))))[2]
    assert not cursor_after(p, t.Cursor(8, os.stat(p).st_ino, 0))[2]  # an unknown head is taken on trust


def test_head_hash(tmp_path):
    p = tmp_path / "a.jsonl"
    write(p, "x" * 5000)
    assert t.head_hash(str(p)) == 0
    write(p, "a\nb")
    first = t.head_hash(str(p))
    write(p, "c\n", "a")
    assert first == t.head_hash(str(p)) and first % 2 == 1


def test_long_lines_are_skipped_and_reported(tmp_path):
    p = tmp_path / "a.jsonl"
    write(p, "short\n" + "x" * 50 + "\nend\n" + "y" * 50)
    got = list(t.lines(str(p), 0, longest=16))
    assert [x for _, _, x in got] == [b"short", None, b"end"] and got[-1][1] == 61


def test_line_cap_counts_blank_lines(tmp_path):
    p = tmp_path / "a.jsonl"
    write(p, "a\n\nb\n")
    assert cursor_after(p, most=2)[1] == [b"a", b""]
    assert t.whole_end(str(p), 0, 2, 100) == 3 and t.whole_end(str(p), 0, None, 100) == 5


def test_batch_source_reads_ranges_once(spark, tmp_path):
    spark.dataSource.register(t.TranscriptSource)
    for k in range(3):
        write(tmp_path / f"{k}.jsonl", "".join(f"line {k} {i} {'x' * (i % 7)}\n" for i in range(40)) + "open")
    for size in ("7", "64", "100000"):
        got = spark.read.format("transcripts").option("rangeBytes", size).load(str(tmp_path)).collect()
        assert sorted(r["line"].split(" x")[0].strip() for r in got) == sorted(f"line {k} {i}" for k in range(3) for i in range(40))
    path = str(tmp_path / "0.jsonl")
    size, inode, head = t.identity(path)
    cursors = {path: {"byte_offset": size - 4, "file_id": inode, "head_hash": head}}
    rest = spark.read.format("transcripts").option("cursors", json.dumps(cursors)).load(str(tmp_path))
    assert rest.count() == 80
    assert spark.read.format("transcripts").load(str(tmp_path / "nothing")).count() == 0


def test_git_branch(tmp_path):
    repo = tmp_path / "r"
    (repo / ".git").mkdir(parents=True)
    (repo / "a" / "b").mkdir(parents=True)
    write(repo / ".git" / "HEAD", "ref: refs/heads/feature/x\n")
    assert git.branch(str(repo / "a" / "b")) == "feature/x"
    write(repo / ".git" / "HEAD", "0123456789abcdef\n")
    assert git.branch(str(repo)) == "0123456"
    write(repo / ".git" / "HEAD", "012")
    assert git.branch(str(repo)) is None
    tree = tmp_path / "w"
    tree.mkdir()
    write(tree / ".git", f"gitdir: {repo / '.git'}\n")
    write(repo / ".git" / "HEAD", "ref: refs/heads/main")
    assert git.branch(str(tree)) == "main"
    write(tree / ".git", "nonsense")
    assert git.branch(str(tree)) is None


def test_a_file_that_goes_away_ends_its_own_range_only(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("one\ntwo\n")
    parts = t.BatchReader({"path": str(tmp_path)}).partitions()
    os.remove(tmp_path / "0.jsonl")
    got = [row for part in parts for batch in t._read(part, t.MAX_LINE) for row in batch.column("line").to_pylist()]
    assert got == ["one", "two"]


def test_small_ranges_and_files_share_tasks(tmp_path):
    """A range is no task of its own: thousands of them would cost more than what they read."""
    lines = [f"line {i} {'x' * (i % 13)}" for i in range(20_000)]
    write(tmp_path / "a.jsonl", "".join(x + "\n" for x in lines))
    for k in range(300):
        write(tmp_path / f"b{k}.jsonl", f"{k}\n")
    tasks = t.BatchReader({"path": str(tmp_path), "rangeBytes": "50"}).partitions()
    assert len(tasks) <= 2 * t.TASKS and sum(len(x.ranges) for x in tasks) > 5000
    assert all(r.stop - r.start <= 50 for x in tasks for r in x.ranges)
    got = [row for x in tasks for batch in t._read(x, t.MAX_LINE) for row in batch.column("line").to_pylist()]
    assert sorted(got) == sorted([*lines, *map(str, range(300))])
    large = t.FileRange("p", 0, t.TASK_MOST + 1, 1, 1, True)
    assert [len(x.ranges) for x in t._tasks([large, large])] == [1, 1]


def test_ends_of_batches(tmp_path, monkeypatch):
    p = tmp_path / "a.jsonl"
    lines = [b"x" * (i * 7 % 23) for i in range(100)]
    p.write_bytes(b"".join(x + b"\n" for x in lines) + b"open")
    whole = [0]
    for x in lines:
        whole.append(whole[-1] + len(x) + 1)
    for block in (1, 10, 1 << 20):
        monkeypatch.setattr(t, "BLOCK", block)
        for most, batches, start in ((1, 5, 0), (7, 3, 0), (7, 100, 4), (100, 2, 0), (50, 2, 0), (50, 9, 1)):
            want = [whole[min(start + most * (k + 1), 100)] for k in range(batches) if start + most * k < 100]
            assert t.ends(str(p), whole[start], most, batches) == want
        assert t.ends(str(p), whole[100], 5, 2) == []
