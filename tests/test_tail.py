import os

from trialframe.sources.lines import numbered_lines
from trialframe.streaming import tail
from trialframe.streaming.journals import tail_to


def follow(spark, tmp_path, **options):
    tail_to(tail.journal_tail(spark, str(tmp_path / "j"), **options), f"{tmp_path}/out", f"{tmp_path}/state")
    return sorted((r.path.rpartition("/")[2], r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_appends_rotation_truncation_and_restarts(spark, tmp_path):
    (tmp_path / "j").mkdir()
    a, b = tmp_path / "j" / "a.jsonl", tmp_path / "j" / "b.jsonl"
    append(a, "1\n2\n\n3\r\nto")
    append(b, "x\n")
    want = [("a.jsonl", t) for t in "123"] + [("b.jsonl", "x")]
    assert follow(spark, tmp_path) == want
    assert follow(spark, tmp_path) == want  # a restart without news gives nothing twice
    append(a, "rn\n4\n")
    want = sorted([*want, ("a.jsonl", "torn"), ("a.jsonl", "4")])
    assert follow(spark, tmp_path) == want
    append(a, "before rotation\n")  # rotated between two runs: the old file goes on under its new name, the new one from 0
    os.rename(a, tmp_path / "j" / "a.jsonl.1")
    append(a, "new file\n")
    want = sorted([*want, ("a.jsonl.1", "before rotation"), ("a.jsonl", "new file")])
    assert follow(spark, tmp_path) == want
    os.truncate(b, 0)  # shorter: no growth, then what is appended counts
    append(b, "y\n")
    assert follow(spark, tmp_path) == want
    append(b, "z\n")
    assert follow(spark, tmp_path) == sorted([*want, ("b.jsonl", "z")])


def test_ranges_have_each_line_once(tmp_path):
    text = "".join(f"{'é' * (i % 13)}{i}\n" for i in range(500)) + "torn"
    (tmp_path / "a.jsonl").write_text(text)
    n = len(text.encode())
    for size in (1, 7, 64, 1000, n):
        reader = tail.TailReader({"path": str(tmp_path), "rangebytes": str(size)})
        parts = reader.partitions({"files": {}}, reader.latestOffset())
        got = [r for p in parts for r in reader.read(p)]
        assert [r[4] for r in got] == text.split("\n")[:-1]
        assert all(text.encode()[r[3] :].startswith(r[4].encode()) for r in got)


def test_a_stream_may_begin_at_the_end(spark, tmp_path):
    (tmp_path / "j").mkdir()
    append(tmp_path / "j" / "a.jsonl", "old\nto")
    assert tail.TailReader({"path": str(tmp_path / "j"), "startingat": "end"}).initialOffset()["files"].popitem()[1] == 4


def test_lines_of_a_large_file_are_numbered_by_many_tasks(spark, tmp_path):
    lines = [f"line {i}" if i % 11 else "" for i in range(60_000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "small.jsonl").write_text("\r\na\r\n\r\nb")
    (tmp_path / "empty.jsonl").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        held = numbered_lines(spark, str(tmp_path), "*.jsonl")
        assert held.rdd.getNumPartitions() > 20
        got = {}
        for r in held.collect():
            got.setdefault(r.source_file.rpartition("/")[2], {})[r.line] = (r.text, r.is_last)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got["big.jsonl"] == {i: (t, i == 59_999) for i, t in enumerate(lines) if t}
    assert got["small.jsonl"] == {1: ("a", False), 3: ("b", True)} and set(got) == {"big.jsonl", "small.jsonl"}
