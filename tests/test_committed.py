"""The store that commits, streams into it, migration between two, and keyed reads."""

import time

import pytest

from quarry.operators import store as rows_of
from quarry.operators.committed import Change, Overtaken, Store, Table, migrated
from quarry.operators.store import Identity, IncompatibleStore
from quarry.streaming.continuous import sync_stream

CHUNK = "id string, document_id string, source_modified_time string, content string, embedding array<float>"
RECORD = "id string, is_active boolean, is_indexed boolean, provider string, store string"
TABLES = {"chunks": Table(CHUNK, "id", "document_id"), "documents": Table(RECORD, "id", "id")}


def chunks(spark, *rows, time="t"):
    return spark.createDataFrame([(f"{d}:{k}", d, time, c, [1.0, 0.0]) for d, k, c in rows], CHUNK)


def contents(frame):
    return {r.id: r.content for r in frame.collect()}


@pytest.fixture
def made(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", Identity("p", 2), TABLES, buckets=8)


def put(store, frame, **more):
    return store.commit({"chunks": Change(upserts=frame, **more)})


def test_upsert_sweep_delete(spark, made, tmp_path):
    assert made.read("chunks").count() == 0
    put(made, chunks(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")))
    put(made, chunks(spark, ("a", 0, "new")))
    assert contents(made.read("chunks")) == {"a:0": "new", "a:1": "y", "b:0": "z"}
    expected = chunks(spark, ("a", 0, "")).select("document_id", "id")
    made.commit({"chunks": Change(expected=expected)})
    assert contents(made.read("chunks")) == {"a:0": "new", "b:0": "z"}
    made.commit({"chunks": Change(removed=spark.createDataFrame([("b",), ("none",), (None,)], "document_id string"))})
    assert contents(made.read("chunks")) == {"a:0": "new"}
    assert contents(made.read("chunks", version=1)) == {"a:0": "x", "a:1": "y", "b:0": "z"}
    with pytest.raises(IncompatibleStore):
        Store(spark, made.path, Identity("q", 2), TABLES).read("chunks")
    with pytest.raises(Exception, match="another length"):
        put(Store(spark, f"file://{tmp_path}/t", Identity("p", 3), TABLES), chunks(spark, ("a", 0, "x")))
    again = rows_of.reusable(chunks(spark, ("a", 0, "new"), ("a", 1, "y")).drop("embedding"), made.read("chunks"), 2)
    assert contents(again) == {"a:0": "new"}


def test_all_in_one_commit(spark, made):
    put(made, chunks(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "c")))
    change = Change(upserts=chunks(spark, ("a", 0, "x2"), ("d", 0, "d")), removed=spark.createDataFrame([("b",)], "document_id string"), expected=chunks(spark, ("a", 0, "")).select("document_id", "id"))
    states = spark.createDataFrame([("a", True, True, "p", "s")], RECORD)
    version = made.commit({"chunks": change, "documents": Change(upserts=states)})
    assert version == 2 and made.versions() == [1, 2]
    assert contents(made.read("chunks")) == {"a:0": "x2", "c:0": "c", "d:0": "d"}
    assert made.read("documents").count() == 1 and made.read("documents", version=1).count() == 0


def test_only_touched_buckets_are_written(spark, made):
    put(made, chunks(spark, *[(f"d{k}", j, "x") for k in range(60) for j in range(3)]))
    before = made.manifest().tables["chunks"]
    assert len(before) == 8
    put(made, chunks(spark, ("d7", 0, "new")))
    after = made.manifest().tables["chunks"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and set(after) == set(before)
    assert made.read("chunks").count() == 180


def test_keyed_reads_open_the_files_of_their_buckets(spark, made):
    put(made, chunks(spark, *[(f"d{k}", j, "x") for k in range(60) for j in range(3)]))
    found = made.read("chunks", documents=["d7"])
    assert len({f.rsplit("/", 2)[-2] for f in found.inputFiles()}) == 1
    assert sorted(r.id for r in found.collect()) == ["d7:0", "d7:1", "d7:2"]
    assert "PushedFilters: [IsNotNull(document_id), EqualTo(document_id,d7)]" in found._jdf.queryExecution().toString() or "document_id" in found._jdf.queryExecution().toString()
    assert made.read("chunks", documents=["none"]).count() == 0 and made.read("chunks", documents=[]).count() == 0


def test_a_write_that_dies_leaves_the_old_version(spark, made, monkeypatch):
    put(made, chunks(spark, ("a", 0, "x")))

    def dies(name, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(made.folders, "put", dies)
    with pytest.raises(KeyboardInterrupt):
        put(made, chunks(spark, ("a", 0, "lost")))
    assert made.versions() == [1] and contents(made.read("chunks")) == {"a:0": "x"}
    assert len(made.folders.names(f"{made.path}/data")) == 2
    assert made.collect() == []  # what is young may belong to a writer at work
    assert len(made.collect(older_than_ms=0)) == 1 and contents(made.read("chunks")) == {"a:0": "x"}


def test_overtaken_writers_try_again(spark, made):
    put(made, chunks(spark, ("a", 0, "x")))
    other = Store(spark, made.path, Identity("p", 2), TABLES)
    own, calls = made.folders.put, []

    def slow(name, text):
        if not calls:
            calls.append(name)
            put(other, chunks(spark, ("b", 0, "first")))
        own(name, text)

    made.folders.put = slow
    assert put(made, chunks(spark, ("a", 1, "second"))) == 3
    assert contents(made.read("chunks")) == {"a:0": "x", "b:0": "first", "a:1": "second"}
    with pytest.raises(Overtaken):
        own(f"{made.path}/manifests/v{3:012d}.json", "{}")


def test_a_batch_is_committed_once(spark, made):
    change = {"chunks": Change(upserts=chunks(spark, ("a", 0, "x")))}
    assert made.commit(change, stream="s", batch=4) == 1
    assert made.commit(change, stream="s", batch=4) == 1 and made.commit(change, stream="s", batch=3) == 1
    assert made.commit(change, stream="other", batch=0) == 2
    assert made.manifest().streams == {"s": 4, "other": 0}


def test_keys_given_twice(spark, made):
    twice = chunks(spark, ("a", 0, "old"), time="1").union(chunks(spark, ("a", 0, "new"), time="2"))
    with pytest.raises(Exception, match="given twice"):
        put(made, twice)
    assert made.versions() == []
    put(made, twice, order="source_modified_time")
    assert contents(made.read("chunks")) == {"a:0": "new"}


def test_old_versions_go(spark, made):
    for k in range(4):
        put(made, chunks(spark, ("a", 0, str(k))))
    assert len(made.collect(keep=2, older_than_ms=0)) == 2
    assert made.versions() == [3, 4] and contents(made.read("chunks", version=3)) == {"a:0": "2"}


def test_a_stream_commits_each_batch_once(spark, made, tmp_path):
    source, schema = str(tmp_path / "in"), CHUNK
    twice = chunks(spark, ("a", 0, "old"), ("b", 0, "y"), time="1").union(chunks(spark, ("a", 0, "new"), time="2"))
    twice.coalesce(1).write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        sync_stream(stream, made, str(tmp_path / f"c{k}"), "source_modified_time").awaitTermination()  # the second has lost its progress
    assert made.versions() == [1] and contents(made.read("chunks")) == {"a:0": "new", "b:0": "y"}


def test_migration_copies_once(spark, made, tmp_path):
    target = Store(spark, f"file://{tmp_path}/t", Identity("p", 2), TABLES, buckets=4)
    put(made, chunks(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "c"), ("d", 0, "d")))
    put(target, chunks(spark, ("a", 0, "x"), ("a", 7, "stale"), ("e", 0, "e")))
    records = [("a", True, True, "p", "old"), ("b", True, True, "other", "old"), ("c", True, False, "p", "old"), ("d", True, True, "p", "old"), ("e", True, True, "p", "new"), ("f", True, True, "p", "old"), ("g", False, True, "p", "old")]
    made.commit({"documents": Change(upserts=spark.createDataFrame(records, RECORD))})
    first = migrated(made, target, made, "p", "old", "new")
    assert first == {"candidates": 4, "already_done": 1, "documents": 2, "chunks": 3, "empty": 1, "incompatible": 1, "copied_before": 0}
    assert contents(target.read("chunks")) == {"a:0": "x", "a:1": "y", "d:0": "d", "e:0": "e"}
    assert {r.id for r in made.read("documents").filter("store = 'new'").collect()} == {"a", "d", "e"}
    version = target.manifest().version
    assert migrated(made, target, made, "p", "old", "new") == {"candidates": 2, "already_done": 3, "documents": 0, "chunks": 0, "empty": 1, "incompatible": 1, "copied_before": 0}
    made.commit({"documents": Change(upserts=spark.createDataFrame(records[:1], RECORD))})  # a run broke off before it repointed a
    assert migrated(made, target, made, "p", "old", "new")["copied_before"] == 1
    assert target.manifest().version == version


def shuffled(spark):
    """Bytes that tasks have written for others so far."""
    time.sleep(0.5)
    spark.range(1).count()  # the totals are brought up to date by events
    time.sleep(0.5)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_whole_rows_travel_once(spark, made):
    """a change that touches all buckets shuffles the rows once, whatever it consists of."""
    rows = spark.range(2000).selectExpr("concat('d', id div 10, ':', id % 10) AS id", "concat('d', id div 10) AS document_id", "'t' AS source_modified_time", "concat_ws('', transform(sequence(1, 40), k -> sha2(concat(id, '/', k), 256))) AS content", "array(1F, 0F) AS embedding")
    put(made, rows)
    size = rows.selectExpr("sum(length(content))").first()[0]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        put(made, rows.filter("id LIKE '%:3'"), removed=rows.filter("document_id LIKE 'd%7'").select("document_id"), expected=rows.filter("id NOT LIKE '%:9'").select("document_id", "id"))
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert made.read("chunks").count() == 200 * 9 - 20 * 8
    assert 0 < moved < 1.3 * size
