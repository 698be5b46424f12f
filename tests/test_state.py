"""Stream state (snapshots, replays, expiry), continuous drift by state, and atomic commits of several tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.operators import drift as D
from vigil.operators import stats as S
from vigil.sources import manifest as MF
from vigil.streaming import ops as SO
from vigil.streaming.runner import StreamState, scratch_path

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, v long"


def _state(spark, out, **kw):
    return StreamState(spark, out, ["k"], SCHEMA, **kw)


def _rows(df):
    return {(r.k, r.v) for r in df.collect()}


def test_state_reads_one_snapshot_and_fewer_folders_than_that(spark):
    out, want = scratch_path(spark, "state"), {}
    for epoch in range(14):
        st = _state(spark, out, every=4)
        assert _rows(st.before(epoch)) == set(want.items())
        assert len(st.folders(epoch)) <= 4 and sum("snapshot" in p for _, p in st.folders(epoch)) == (epoch >= 4)
        now = [(None if epoch % 3 else f"k{epoch % 5}", epoch), ("all", epoch)]
        st.write(spark.createDataFrame(now, SCHEMA), epoch)
        want.update(now)
        if epoch in (3, 7, 9):  # killed before the engine's commit: the epoch comes again, with the state before it
            again = _state(spark, out, every=4)
            before = _rows(again.before(epoch))
            assert ("all", epoch - 1) in before and ("all", epoch) not in before
            again.write(spark.createDataFrame(now, SCHEMA), epoch)
    kept = MF.versions(spark, f"{out}/state")
    assert kept == [7, 11]  # the last two snapshots
    fs, p = MF._fs(spark, f"{out}/state")
    names = {s.getPath().getName() for s in fs.listStatus(p)}
    assert "snapshot=3" not in names and not {f"epoch={e}" for e in range(8)} & names


def test_state_killed_between_snapshot_and_commit(spark):
    out = scratch_path(spark, "state")
    for epoch in range(3):
        _state(spark, out, every=4).write(spark.createDataFrame([("a", epoch)], SCHEMA), epoch)
    spark.createDataFrame([("broken", 0)], SCHEMA).write.parquet(f"{out}/state/snapshot=3")  # no manifest names it
    spark.createDataFrame([("a", 3)], SCHEMA).write.parquet(f"{out}/state/epoch=3")
    assert _rows(_state(spark, out, every=4).before(4)) == {("a", 3)}
    _state(spark, out, every=4).write(spark.createDataFrame([("a", 3)], SCHEMA), 3)
    assert _rows(_state(spark, out, every=4).before(4)) == {("a", 3)}
    assert "snapshot=3" in _state(spark, out, every=4).folders(4)[0][1]


def test_dedupe_state_expires_keys_whose_ttl_is_over(spark):
    write = SO.dedupe_batch(["user_id"], lateness_us=2 * SO.DAY_US, every=3)
    out = scratch_path(spark, "dedupe-expire")
    schema = "user_id long, event_id long, ts timestamp"
    for epoch in range(6):  # one new key a day
        at = T0 + dt.timedelta(days=epoch)
        write(spark.createDataFrame([(epoch, epoch, at), (100, 1000 + epoch, at)], schema), epoch, out)
    state = StreamState(spark, out, ["user_id"], "user_id long, _last long", 3)
    assert {r.user_id for r in state.before(6).collect()} == {3, 4, 5, 100}  # 2 days of lateness, a TTL of 1 day
    # a row for an expired key is too late to be judged; one within the lateness is judged
    write(spark.createDataFrame([(0, 50, T0 + dt.timedelta(hours=1)), (3, 51, T0 + dt.timedelta(days=3, hours=5))], schema), 6, out)
    assert {r.event_id for r in spark.read.parquet(out + "/aside").collect()} == {50}
    assert {r.event_id for r in spark.read.parquet(out + "/data").collect()} == {*range(6), *range(1000, 1006)}


def test_hot_keys_chains_are_taken_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(SO, "HOT_TIMES", 10)
    hour = 3600 * 1_000_000
    times = [d * 240 * hour + i * 5 * hour for d in range(40) for i in range(8)]  # 40 chains of 35 hours, ten days apart
    df = spark.createDataFrame([(1, t) for t in times], "k long, _u long")
    got = sorted(r._u for r in SO._kept_times(df, ["k"], SO.DAY_US).collect())
    want = []
    for t in times:
        if not want or t >= want[-1] + SO.DAY_US:
            want.append(t)
    assert got == want
    chained = SO._chains(df, ["k"], SO.DAY_US)
    assert chained.select("_chain").distinct().count() == 40
    assert chained.agg(F.max((F.col("_u") - F.col("_chain")) / SO.DAY_US)).first()[0] < 2  # two steps for all of them


LOG = "model_name string, id long, created_at timestamp, value double, c string, probability double"


def _log(n, start=0):
    return [("ab"[i % 2] if i % 17 else None, i, T0 + dt.timedelta(minutes=i * 7 % 5000), float(i * i % 23), "xyz"[i % 3],
             (i * 37 % 100) / 100) for i in range(start, start + n)]


def test_ten_epochs_of_drift_equal_the_batch_check_and_do_not_grow(spark):
    ref = S.reference_stats(spark.createDataFrame(_log(400), LOG), ["model_name"], ["value"], ["c"])
    write = SO.drift_batch(ref, ["model_name"], ["value"], ["c"], n=60, every=4)
    out, sofar = scratch_path(spark, "drift-epochs"), []
    for epoch in range(10):
        rows = _log(70, 1000 + 70 * epoch)
        sofar += rows
        state = StreamState(spark, out, ["model_name"], spark.createDataFrame([], LOG).schema, 4)
        if epoch:
            cols = ["model_name", "id", "created_at", "value", "c", "probability"]
            state.schema = spark.createDataFrame([], LOG).select(*cols).schema
            assert state.before(epoch).count() <= 3 * 60 and len(state.folders(epoch)) <= 4
            assert not any("/log" in f for f in state.before(epoch).inputFiles())
        write(spark.createDataFrame(rows, LOG), epoch, out)
        if epoch in (0, 5, 9):
            want, _ = D.drift_analyze(spark.createDataFrame(sofar, LOG), ref, ["model_name"], ["value"], ["c"], window=60)
            got = spark.read.parquet(f"{out}/checks").where(F.col("epoch") == epoch)
            key = lambda r: (r.model_name, r.sample_size, r.severity, round(r.overall_score, 9))
            assert {key(r) for r in got.collect()} == {key(r) for r in want.collect() if r.model_name}
    write(spark.createDataFrame(_log(70, 1000 + 70 * 9), LOG), 9, out)  # the last epoch once more
    again = spark.read.parquet(f"{out}/checks").where("epoch = 9")
    assert {key(r) for r in again.collect()} == {key(r) for r in want.collect() if r.model_name}
    assert spark.read.parquet(f"{out}/log").count() == 700


def test_tables_change_together(spark):
    tables = MF.TableSet(spark, scratch_path(spark, "set"), {"a": "x long", "b": "y string"})
    version, now = tables.read()
    assert version == -1 and now["a"].count() == 0
    one = tables.commit(version, {"a": spark.createDataFrame([(1,)], "x long")}, {"b": spark.createDataFrame([("p",)], "y string")})
    two = tables.commit(one, {"a": spark.createDataFrame([(2,)], "x long")}, {"b": spark.createDataFrame([("q",)], "y string")})
    version, now = tables.read()
    assert version == two and {r.x for r in now["a"].collect()} == {1, 2} and [r.y for r in now["b"].collect()] == ["q"]
    assert [r.y for r in tables.read(one)[1]["b"].collect()] == ["p"]
    with pytest.raises(MF.Conflict):  # derived from a version that is no longer the newest
        tables.commit(one, {"a": spark.createDataFrame([(9,)], "x long")})
    with pytest.raises(ValueError):
        tables.read(77)


def test_failure_between_two_writes_leaves_neither_visible(spark):
    tables = MF.TableSet(spark, scratch_path(spark, "set"), {"a": "x long", "b": "y string"})
    one = tables.commit(-1, {"a": spark.createDataFrame([(1,)], "x long")}, {"b": spark.createDataFrame([("p",)], "y string")})
    bad = spark.createDataFrame([("q",)], "y string").select(F.raise_error(F.lit("lost")).cast("string").alias("y"))
    with pytest.raises(Exception, match="lost"):
        tables.commit(one, {"a": spark.createDataFrame([(2,)], "x long")}, {"b": bad})
    version, now = tables.read()
    assert version == one and [r.x for r in now["a"].collect()] == [1] and [r.y for r in now["b"].collect()] == ["p"]
    # a manifest that its writer did not finish is no version, and its number is not used again
    fs, p = MF._fs(spark, f"{tables.base}/_manifest/{one + 1}.json")
    out = fs.create(p, False)
    out.write(bytearray(b'{"tables": {"a"'))
    out.close()
    assert tables.read()[0] == one
    assert tables.commit(one, {"a": spark.createDataFrame([(3,)], "x long")}) == one + 2
    assert {r.x for r in tables.read()[1]["a"].collect()} == {1, 3}


def test_change_starts_again_after_a_conflict(spark):
    tables = MF.TableSet(spark, scratch_path(spark, "set"), {"a": "x long"})
    tries = []

    def add(now):
        tries.append(now["a"].count())
        if len(tries) == 1:  # another writer comes first
            tables.commit(-1, {"a": spark.createDataFrame([(1,)], "x long")})
        return {"a": spark.createDataFrame([(2,)], "x long")}, {}
    tables.change(add)
    assert tries == [0, 1] and {r.x for r in tables.read()[1]["a"].collect()} == {1, 2}
