import datetime as dt
import random

import pytest
from ledger_rows import by, day, money, rows
from pyspark.sql import functions as F

from tallyframe import schema as S
from tallyframe.operators import mutations
from tallyframe.streaming import batches
from tallyframe.streaming import ledger_streams as streams


def write_files(df, path, parts):
    """One file per part, in part order."""
    for n, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)


def test_micro_batches_equal_one_batch_and_replay_is_harmless(spark, small, tmp_path):
    rng = random.Random(4)
    a = small.accounts(*[(i, i % 3, 10) for i in range(6)])
    batch = small.transactions(*[(i, rng.randrange(3), rng.choice(["INCOME", "OUTCOME", "X"]), rng.randrange(1, 9), "2024-01-01", None, rng.choice([None, *range(7)])) for i in range(90)])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_files(batch, src, ["id < 30", "id BETWEEN 30 AND 59", "id >= 60"])
    source = streams.file_stream(spark, src, S.TRANSACTION, files_per_batch=1)
    streams.stream_ingest(source, a, out).awaitTermination()
    assert spark.read.parquet(f"{out}/checked").select("batch_id").distinct().count() == 3
    _, want, report = mutations.ingest_transactions(batch.filter("false"), a, batch, dt.datetime(2024, 5, 1))
    expected = {r.id: r.balance for r in want.collect()}
    assert {r.account_id: r.balance for r in streams.streamed_balances(spark, a, out).collect()} == expected
    kept = spark.read.parquet(f"{out}/checked").select("id", "reason")
    assert set(rows(kept)) == set(rows(report.select("id", "reason")))
    # Losing the last commit makes the stream replay its last batch.
    commit = max((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()
    commit.with_name(f".{commit.name}.crc").unlink()
    streams.stream_ingest(source, a, out).awaitTermination()
    assert {r.account_id: r.balance for r in streams.streamed_balances(spark, a, out).collect()} == expected


def events(spark, *rows_):
    return spark.createDataFrame(
        [(i, u, k, money(a), dt.datetime.fromisoformat(ts)) for i, u, k, a, ts in rows_],
        "id long, user_id long, type string, amount decimal(16,2), ts timestamp")


def test_daily_stats_count_rows_however_late(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    first = events(spark, (1, 1, "INCOME", 5, "2024-01-01 10:00"), (2, 1, "INCOME", 1, "2024-01-02 10:00"), (3, None, "INCOME", 9, "2024-01-02 10:00"))
    second = events(spark, (4, 1, "INCOME", 2, "2024-01-02 23:00"), (5, 1, "OUTCOME", 3, "2024-01-09 10:00"))
    third = events(spark, (6, 1, "INCOME", 100, "2024-01-01 11:00"), (7, 1, "OUTCOME", 4, "2024-01-09 12:00"))
    for df in (first, second, third):
        df.coalesce(1).write.mode("append").parquet(src)
        source = streams.file_stream(spark, src, first.schema, files_per_batch=1)
        streams.stream_daily_stats(source, out).awaitTermination()
    got = {(r.day, r.type): (r.total, r.row_count) for r in streams.streamed_daily_stats(spark, out).collect()}
    assert got == {(day("2024-01-01"), "INCOME"): (money(105), 2), (day("2024-01-02"), "INCOME"): (money(3), 2),
                   (day("2024-01-09"), "OUTCOME"): (money(7), 2)}


@pytest.mark.parametrize("compact_every", [2, 20])
def test_history_keeps_intermediate_updates_over_batches(spark, tmp_path, compact_every):
    rng = random.Random(8)
    images, changes, log = {}, [], []
    for seq in range(1, 61):
        account = rng.randrange(5)
        image = None if rng.random() < 0.2 else f'{{"v":{seq}}}'
        changes.append((seq, account, account * 10, image))
        before = images.get(account)
        if before is None and image is None:
            continue
        action = "INSERT" if before is None else "DELETE" if image is None else "UPDATE"
        log.append((account, seq, action, account * 10, before, image))
        images[account] = image
    df = spark.createDataFrame(changes, "seq long, account_id long, user_id long, image string")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    write_files(df, src, [f"seq > {n * 10} AND seq <= {n * 10 + 10}" for n in range(6)])
    source = streams.file_stream(spark, src, df.schema, files_per_batch=1)
    streams.stream_account_history(source, out, compact_every).awaitTermination()
    got = streams.streamed_history(spark, out).select("account_id", "seq", "action", "changed_by", "old_data", "new_data")
    assert sorted(rows(got), key=str) == sorted(log, key=str)
    assert by(got, "seq")[log[0][1]]["action"] == log[0][2]
    assert (tmp_path / "out" / "last_base").exists() == (compact_every == 2)
    assert got.filter(F.col("old_data").isNull() & (F.col("action") != "INSERT")).count() == 0


def test_history_of_a_busy_account_is_dealt_evenly(spark, tmp_path):
    """One account has a third of a batch and numbers are sparse; no range holds more than its share."""
    n = 6000
    seqs = random.Random(3).sample(range(10**15), n)
    changes = [(s, 7 if k % 3 == 0 else 100 + k % 500, 1, None if k % 11 == 0 else f"v{s}") for k, s in enumerate(seqs)]
    df = spark.createDataFrame(changes, "seq long, account_id long, user_id long, image string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would become one range
    try:
        dealt = streams.dealt_changes(df, str(tmp_path / "dealt"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / len(sizes)
    assert dealt.filter("account_id = 7").select("_part").distinct().count() > 1
    known = spark.createDataFrame([(7, "before"), (100, None)], "account_id long, image string")
    images, want = {7: "before"}, {}
    for s, a, _, image in sorted(changes):
        want[s] = images.get(a)
        images[a] = image
    got = {r.seq: r.old_data for r in streams.with_old_images(dealt, known).collect()}
    assert got == want


@pytest.mark.parametrize("merge_every", [1, 2, 20])
def test_edits_and_deletes_take_daily_sums_back(spark, tmp_path, merge_every):
    rng = random.Random(merge_every)
    image = "struct<user_id:long,type:string,amount:decimal(16,2),ts:timestamp>"
    kept, given = {}, []
    for _ in range(7):
        batch = []
        for _ in range(12):
            key = rng.randrange(20)
            old = kept.pop(key, None)
            new = None
            if old is None or rng.random() < 0.6:
                new = (rng.choice([1, 2, None]), rng.choice(["INCOME", "OUTCOME"]), money(rng.randrange(1, 9)),
                       dt.datetime(2024, 1, rng.randrange(1, 4), 12))
                kept[key] = new
            batch.append((old, new))
        rng.shuffle(batch)
        given.append([*batch, (None, None)])
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for n, batch in enumerate(given):
        df = spark.createDataFrame(batch, f"old {image}, new {image}")
        df.coalesce(1).write.mode("append").parquet(src)
        if n in (2, 6):  # two runs over several batches each
            source = streams.file_stream(spark, src, df.schema, files_per_batch=1)
            streams.stream_daily_changes(source, out, merge_every).awaitTermination()
    want = {}
    for user, kind, amount, ts in kept.values():
        if user is not None:
            total, count = want.get((ts.date(), user, kind), (0, 0))
            want[ts.date(), user, kind] = (total + amount, count + 1)
    got = {(r.day, r.user_id, r.type): (r.total, r.row_count) for r in streams.streamed_daily_stats(spark, out).collect()}
    assert got == want


def test_a_copy_whose_batch_is_missing_is_not_read(spark, tmp_path):
    out, schema = str(tmp_path), "k long, v long"
    for n in range(4):
        spark.createDataFrame([(1, n + 1)], schema).write.parquet(batches.batch_path(out, "t", n))
        batches.merge(spark, out, "t", schema, n, 2, lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")))
    assert batches.newest_copy(spark, out, "t", schema) == 2
    assert sorted(r.v for r in batches.parts(spark, out, "t", schema).collect()) == [3, 3, 4]
    spark.createDataFrame([(1, 999)], schema).write.parquet(batches.batch_path(out, "t_base", 4))
    assert batches.newest_copy(spark, out, "t", schema) == 2
    assert sum(r.v for r in batches.parts(spark, out, "t", schema, 3).collect()) == 6
