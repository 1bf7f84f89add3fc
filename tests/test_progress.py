import pytest
from pyspark.sql import functions as F

from trialframe.operators import ledger
from trialframe.operators import progress as watch
from trialframe.streaming import progress

EVENTS = "/root/testdata/sf0.001/events.parquet"


def files(spark, rows, path, n, shuffled=True):
    (rows.orderBy(F.rand(n)).repartition(n) if shuffled else rows.coalesce(n)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 5).parquet(path)


@pytest.mark.parametrize(("n", "shuffled"), [(1, False), (13, True)])
def test_alarms_do_not_depend_on_files(spark, tmp_path, n, shuffled):
    events = spark.read.parquet(EVENTS)
    want = sorted((r.user_id, r.gap_s) for r in ledger.quiet_alarms(events, "user_id", "ts", 5400).collect())
    stream = files(spark, events, f"{tmp_path}/e", n, shuffled)
    out = progress.finished(spark, stream, lambda s: progress.quiet_gaps(s, "user_id", "ts", 5400, "60 days"), "ts", f"{tmp_path}/w")
    assert sorted((r.entity, r.gap_s) for r in out.collect()) == want


def test_a_key_is_forgotten_and_late_rows_are_not_taken(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-09 00:00:00"), (1, "2024-01-20 00:00:00"), (None, "2024-01-20 00:00:00")]
    df = spark.createDataFrame(rows, "u long, at string").withColumn("at", F.to_timestamp("at"))
    for name, forget, want in (("a", None, [(1, 3 * 3600), (1, 19 * 86400 - 3 * 3600)]), ("b", 2 * 86400, [(1, 3 * 3600)])):
        df.coalesce(1).sortWithinPartitions("at").write.parquet(f"{tmp_path}/{name}")
        for k, part in enumerate((df.where("at < '2024-01-05'"), df.where("at between '2024-01-05' and '2024-01-10'"), df.where("at > '2024-01-10'"))):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-{k}")
        for k in range(3):  # files are taken by their age: one folder that gets one file after the other
            spark.read.parquet(f"{tmp_path}/{name}-{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-all")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-all")
        out = progress.finished(spark, stream, lambda s: progress.quiet_gaps(s, "u", "at", 3600, "1 hour", forget), "at", f"{tmp_path}/{name}-w")  # noqa: B023
        assert sorted((r.entity, r.gap_s) for r in out.collect()) == want


SEEN = [  # run, kind, second, size, device, inode, holder
    (1, "journal", 0, 10, 1, 7, "a"), (1, "log", 0, 5, 1, 8, "a"),
    (1, "journal", 100, 10, 1, 7, "a"), (1, "log", 100, 5, 1, 8, "a"),  # quiet for 100
    (1, "journal", 200, 4, 1, 7, "a"), (1, "log", 200, 5, 1, 8, "a"),  # cut: no growth
    (1, "journal", 300, 6, 1, 7, "a"), (1, "log", 300, 5, 1, 8, "a"),  # grown from what was cut
    (1, "journal", 400, 2, 1, 9, "a"), (1, "log", 400, 5, 1, 8, "a"),  # a new file, measured from 0
    (1, "journal", 500, 0, None, None, "a"), (1, "log", 500, 5, 1, 8, "a"),  # gone
    (1, "journal", 600, 1, 1, 9, "a"), (1, "log", 600, 5, 1, 8, "a"),  # back: new against no inode
    (1, "log", 900, 5, 1, 8, "b"), (1, "log", 1000, 5, 1, 8, "b"), (1, "log", 1100, 5, 1, 8, None), (1, "log", 1200, 5, 1, 8, "b"),
]
QUIET = {0: 0, 100: 100, 200: 200, 300: 0, 400: 0, 500: 100, 600: 0, 900: 0, 1000: 100, 1100: 0, 1200: 0}


def test_growth_truncation_new_files_and_holders(spark, tmp_path):
    df = spark.createDataFrame(SEEN, "run long, kind string, s long, size long, device long, inode long, holder string").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    args = ("run", "kind", "at", "size", "device", "inode", "holder", 100)
    want = {s: (s != 1100, q, s != 1100 and q >= 100) for s, q in QUIET.items()}
    assert {int(r.at.timestamp()) - 1_700_000_000: (r.live, r.quiet_s, r.alarm) for r in watch.watched(df, *args).collect()} == want
    out = progress.finished(spark, files(spark, df, f"{tmp_path}/o", 6), lambda s: progress.watch_stream(s, *args, "1 day"), "at", f"{tmp_path}/w")
    assert {r.at_us // 1_000_000 - 1_700_000_000: (r.live, r.quiet_s, r.alarm) for r in out.collect()} == want
