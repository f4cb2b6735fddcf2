"""The outbox as tables, and delivery of a stream: retries, dead letters, and batches that run again after a failure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import outbox as ob

NOW = dt.datetime(2024, 5, 1, 12)
OUTBOX = "id long, status string, created_at timestamp, retry_count int, lease_owner string, lease_expires_at timestamp, error_message string, `pay.load` string"


def table(spark):
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [
        (1, "pending", at(-9), 0, None, None, None, "a"), (2, "pending", at(-10), 0, None, None, None, "b"), (3, "pending", at(-9), 0, None, None, None, "c"),
        (4, "processing", at(-20), 2, "w1", at(-1), None, "d"), (5, "processing", at(-20), 3, "w1", at(-1), None, "e"), (6, "processing", at(-20), 0, "w1", at(1), None, "f"), (7, "processed", at(-99), 0, None, None, None, "g"),
    ]
    return spark.createDataFrame(rows, OUTBOX)


def test_claim_recover_settle(spark):
    x = table(spark)
    got = {r.id: r for r in ob.claim(x, "w2", NOW, dt.timedelta(minutes=5), 2).collect()}
    assert [i for i in got if got[i].lease_owner == "w2"] == [1, 2] or {i for i in got if got[i].lease_owner == "w2"} == {1, 2}
    assert got[2].status == "processing" and got[2].lease_expires_at == NOW + dt.timedelta(minutes=5) and got[3].status == "pending" and got[7]["pay.load"] == "g"
    back = {r.id: r for r in ob.recover(x, NOW).collect()}
    assert (back[4].status, back[4].retry_count, back[4].lease_owner, back[4].error_message) == ("pending", 3, None, ob.EXPIRED)
    assert (back[5].status, back[5].retry_count) == ("failed", 4) and back[6].status == "processing" and back[1].retry_count == 0
    done = spark.createDataFrame([(6, "w1"), (6, "w9"), (4, "w9"), (1, "w1")], "id long, worker string")
    assert {r.id: r.status for r in ob.settle(x, done).collect()} == {1: "pending", 2: "pending", 3: "pending", 4: "processing", 5: "processing", 6: "processed", 7: "processed"}


def handler(fail_until):
    """Fails a row while it has been tried fewer times than fail_until says (-1: always)."""

    def go(rows, step):
        limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in fail_until.items() for x in kv)), F.col("k")), F.lit(0))
        return rows.withColumns({"ok": (limit >= 0) & (F.col("attempts") >= limit), "error": F.lit("down")})

    return go


def source(spark, folder, parts):
    for p in parts:
        spark.createDataFrame([(k,) for k in p], "k long").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_retries_and_dead_letters(spark, tmp_path):
    stream = source(spark, f"{tmp_path}/in", [[1, 2], [3], [4, 5]])
    d = ob.Delivery(spark, f"{tmp_path}/out", stream.schema, retries=2)
    h = handler({1: 1, 3: -1, 5: 2})
    d.start(stream, h, f"{tmp_path}/check").awaitTermination()
    d.finish(h)
    delivered = {r.k: r.attempts for r in d.table("delivered").collect()}
    assert delivered == {1: 1, 2: 0, 4: 0, 5: 2}
    assert [(r.k, r.attempts, r.error) for r in d.table("dead").collect()] == [(3, 3, "down")] and d.open_rows().isEmpty()


@pytest.mark.parametrize("breaks_after", ["tried", "delivered", "waiting", "dead"])
def test_a_batch_that_failed_runs_again(spark, tmp_path, breaks_after):
    stream = source(spark, f"{tmp_path}/in", [[1, 2, 3], [4]])
    d = ob.Delivery(spark, f"{tmp_path}/out", stream.schema, retries=1)
    h, broken = handler({1: 1, 3: -1}), []

    class Broken(ob.Delivery):
        """Dies once in its second batch, when it has written one of the tables."""

        def _write(self, rows, name, step):
            super()._write(rows, name, step)
            if name == breaks_after and step.startswith("000000000001") and not broken:
                broken.append(step)
                raise RuntimeError("executor lost")

    b = Broken(spark, f"{tmp_path}/out", stream.schema, retries=1)
    with pytest.raises(Exception, match="executor lost"):
        b.start(stream, h, f"{tmp_path}/check").awaitTermination()
    d.start(stream, h, f"{tmp_path}/check").awaitTermination()
    d.finish(h)
    assert broken and sorted((r.k, r.attempts) for r in d.table("delivered").collect()) == [(1, 1), (2, 0), (4, 0)]
    assert sorted(r.k for r in d.table("dead").collect()) == [3]


def test_same_step_twice_changes_nothing(spark, tmp_path):
    d = ob.Delivery(spark, f"{tmp_path}/out", spark.createDataFrame([], "k long").schema)
    rows, h = spark.createDataFrame([(1,), (2,)], "k long"), handler({2: 1})
    for _ in range(3):
        d.run(rows, h, "000000000000-000")
    assert sorted(r.k for r in d.table("delivered").collect()) == [1] and [(r.k, r.attempts) for r in d.open_rows().collect()] == [(2, 1)]
    d.run(rows.limit(0), h, "000000000001-000")
    assert sorted(r.k for r in d.table("delivered").collect()) == [1, 2] and d.open_rows().isEmpty()
