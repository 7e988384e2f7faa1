"""The keyed store under replays, stopped writers, concurrent readers and writers, and many batches."""

import os

import pytest
from pyspark.sql import functions as F

from matchloom.sources.commits import CommitLog, Conflict
from matchloom.sources.store import KeyedStore

SCHEMA = "id long, v string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def told(df):
    return sorted(map(tuple, df.select("id", "v").collect()))


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "s"), ["id"], buckets=8, fan=3)


def test_replay_changes_nothing_and_other_content_is_refused(spark, store):
    store.upsert(rows(spark, (1, "a"), (2, "a"), (2, "a")), 0)
    store.upsert(rows(spark, (2, "b"), (3, None)), 1)
    before = store.log.versions()
    store.upsert(rows(spark, (3, None), (2, "b")), 1)
    assert store.log.versions() == before and told(store.read()) == [(1, "a"), (2, "b"), (3, None)]
    for batch in (0, 1):
        with pytest.raises(ValueError):
            store.upsert(rows(spark, (9, "z")), batch)
    assert told(store.read()) == [(1, "a"), (2, "b"), (3, None)] and store.has(1) and not store.has(2)


def test_a_writer_stopped_between_files_and_commit_leaves_no_trace(spark, store, monkeypatch):
    store.upsert(rows(spark, (1, "a")), 0)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.upsert(rows(spark, (1, "lost"), (2, "lost")), 1)
    assert told(store.read()) == [(1, "a")] and not store.has(1)
    store.upsert(rows(spark, (1, "b")), 1)
    assert told(store.read()) == [(1, "b")]
    assert store.vacuum(older_than=-5) == 1 and told(store.read()) == [(1, "b")]


def test_a_commit_file_cut_short_is_passed_over(spark, store):
    store.upsert(rows(spark, (1, "a")), 0)
    with open(os.path.join(store.path, "commits", "000000000002.json"), "w") as f:
        f.write('{"segments": [')
    assert told(store.read()) == [(1, "a")]
    store.upsert(rows(spark, (1, "b")), 1)
    assert told(store.read()) == [(1, "b")] and store.log.versions()[-1] == 3


def test_a_reader_keeps_its_version_while_batches_are_written_and_folded(spark, store):
    store.upsert(rows(spark, *[(i, "old") for i in range(20)]), 0)
    reader = store.read()
    for n in range(1, 6):
        store.upsert(rows(spark, *[(i, f"new{n}") for i in range(n, 20, 2)]), n)
    assert told(reader) == [(i, "old") for i in range(20)]
    want = {i: "old" for i in range(20)} | {i: f"new{n}" for n in range(1, 6) for i in range(n, 20, 2)}
    assert told(store.read()) == sorted(want.items())


def test_two_writers_of_one_version_both_end_up_in_the_store(spark, store):
    store.upsert(rows(spark, (1, "a")), 0)
    other = KeyedStore(spark, store.path, ["id"], buckets=8, fan=3)
    raced = []
    publish = store.log.publish

    def slow(version, content):
        if not raced:
            raced.append(version)
            other.upsert(rows(spark, (2, "other")), 7)  # takes the version first
        publish(version, content)
    store.log.publish = slow
    store.upsert(rows(spark, (3, "mine")), 1)
    assert raced and told(store.read()) == [(1, "a"), (2, "other"), (3, "mine")]
    with pytest.raises(Conflict):
        publish(1, {})


def test_what_a_batch_reads_does_not_grow_with_the_number_of_batches(spark, store):
    few, files = rows(spark, (1, "x"), (2, "x")), []
    for n in range(14):
        store.upsert(rows(spark, *[(i, f"v{n}") for i in range(40)]), n)
        files.append(len(store.read(few).inputFiles()))
    assert told(store.read(few)) == [(1, "v13"), (2, "v13")]
    buckets = len({r[0] for r in few.select(store._bucket(8)).collect()})
    assert max(files) <= buckets * 2 * 3 + 1  # two segments a level at most, three levels
    assert len(store.read().inputFiles()) > len(store.read(few).inputFiles())
    store.compact()
    assert len(store.state()["segments"]) == 1 and store.state()["segments"][0]["rows"] == 40
    assert told(store.read()) == [(i, "v13") for i in range(40)]


def test_unseen_keys_open_no_files_and_known_ones_are_never_missed(spark, store):
    for n in range(4):
        store.upsert(rows(spark, *[(i, f"v{n}") for i in range(n * 500, n * 500 + 700)]), n)
    every = store.read()
    unseen = spark.range(100_000, 100_040).select("id")
    maybe = store._maybe(store.state(), unseen)
    known = spark.range(0, 2200).select("id")
    assert told(store.read(known)) == told(every) and store._maybe(store.state(), known).select("id").distinct().count() == 2200
    opened, total = len(store.read(unseen).inputFiles()), len(every.inputFiles())
    print("files opened for unseen keys:", opened, "of", total)
    assert store.read(unseen).collect() == [] and maybe.count() < 40 * len(store.state()["segments"]) * 0.2 and opened < 0.7 * total
    assert store.read(spark.createDataFrame([(-1,)], "id long")).collect() == []


def test_newest_by_a_column_and_a_hot_key(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "t"), ["k"], ["at"])
    one = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 977).alias("at"), "id")
    s.upsert(one, 0)
    s.upsert(spark.createDataFrame([("hot", 5, -1), ("new", 1, -2)], "k string, at long, id long"), 1)  # older than what is stored
    got = {r.k: r.at for r in s.read().collect()}
    assert len(got) == 2002 and got["hot"] == 976 and got["new"] == 1


def test_empty_batches_and_an_empty_store(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.read_or_empty(SCHEMA).collect() == [] and store.vacuum() == 0
    store.upsert(rows(spark), 0)
    assert store.read().collect() == [] and store.has(0)
    store.upsert(rows(spark, (None, "n"), (1, "a")), 1)
    assert {tuple(r) for r in store.read().collect()} == {(None, 'n'), (1, 'a')}
