"""Runs of a synchronisation over a store: what they do, count, and leave for the next one."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import sync
from quarry.operators.committed import Store
from quarry.operators.store import Identity
from quarry.operators.syncing import TABLES, Run, running

LISTING = "id string, ordinal long, base string, mime string, parents array<string>, modified string"
READ = "id string, reason string, chunks array<struct<content:string,section_title:string>>"


class World:
    """A folder of files, what reading each gives, and a provider that counts its inputs."""

    def __init__(self, spark, path):
        self.spark, self.store, self.files, self.read, self.asked = spark, Store(spark, f"file://{path}", Identity("p", 2), TABLES, buckets=4), [], {}, []

    def file(self, name, modified="1", chunks=("x",), reason=None, mime=sync.PDF, base=None):
        self.files = [f for f in self.files if f[0] != name] + [(name, base or name, mime, ["f"], modified)]
        self.read[name] = (reason, None if reason else [(c, None) for c in chunks])
        return self

    def run(self, provider="p", stream=None, number=0, **more):
        rows = [(f[0], k, *f[1:]) for k, f in enumerate(sorted(self.files))]
        listing = self.spark.createDataFrame(rows, LISTING)
        found = self.spark.createDataFrame([(k, *v) for k, v in self.read.items()], READ)
        self.asked = []

        def embed(texts):
            self.asked = sorted(r.text for r in texts.select("text").collect())
            return texts.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")))

        go = Run(self.store, provider, "s", lambda files: files.select("id").join(found, "id"), embed, **more)
        counters = go(listing, stream, number)
        return {k: v for k, v in counters.items() if v}

    def chunks(self):
        return {r.id: r.content for r in self.store.read("chunks").collect()}

    def states(self):
        return {r.id: (r.is_indexed, r.duplicate_of, r.is_active) for r in self.store.read("documents").collect()}


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def test_skips_updates_removes_and_goes_on_after_a_failure(world):
    world.file("same").file("edited", chunks=("a", "b")).file("gone").file("bad", chunks=("keep",)).file("logo", mime="image/png")
    assert world.run() == {"new": 4, "unsupported": 1, "embedded_chunks": 5, "embedding_batch_attempts": 4, "embedding_input_attempts": 5}
    world.file("edited", "2", ("a", "c", "d")).file("bad", "2", reason="HTTP 500").file("extra")
    world.files = [f for f in world.files if f[0] != "gone"]
    assert world.run() == {"skipped": 1, "updated": 1, "new": 1, "removed": 1, "failed": 1, "unsupported": 1, "embedded_chunks": 4, "embedding_batch_attempts": 2, "embedding_input_attempts": 4}
    assert world.chunks() == {"same:0": "x", "edited:0": "a", "edited:1": "c", "edited:2": "d", "bad:0": "keep", "extra:0": "x"}
    states = world.states()
    assert states["gone"] == (False, None, False) and states["bad"] == (False, None, True) and states["edited"] == (True, None, True) and "logo" not in states
    assert world.run() == {"skipped": 3, "failed": 1, "unsupported": 1}


def test_shorter_documents_are_swept_and_vectors_used_again(world):
    world.file("a", chunks=("1", "2", "3")).run()
    world.read["a"] = (None, [("1", None), ("2", "title")])
    world.store.commit({"documents": __import__("quarry.operators.committed", fromlist=["Change"]).Change(upserts=world.store.read("documents").withColumn("is_indexed", F.lit(False)))})
    assert world.run() == {"updated": 1, "reused_chunks": 2}
    assert set(world.chunks()) == {"a:0", "a:1"}


def test_another_provider_or_store_indexes_again(world):
    world.file("a").run()
    assert world.run() == {"skipped": 1}
    assert world.run(provider="q")["updated"] == 1


def test_known_failures_and_empty_documents_are_cleared(world):
    world.file("a").file("b").file("c").run()
    world.file("a", "2", reason="cannotDownloadAbusiveFile").file("b", "2", chunks=()).file("c", "2", reason="insufficientFilePermissions")
    assert world.run() == {"skipped_abusive_files": 1, "skipped_empty_documents": 1, "permission_errors": 1, "failed": 1}
    assert world.chunks() == {} and all(s == (False, None, True) for s in world.states().values())


def test_duplicates_lose_their_chunks(world):
    world.file("doc-a", base="doc").run()
    world.file("doc-b", base="doc", mime=sync.PPTX)
    assert world.run() == {"new": 1, "duplicates": 1, "embedded_chunks": 1, "embedding_batch_attempts": 1, "embedding_input_attempts": 1}
    assert set(world.chunks()) == {"doc-b:0"} and world.states()["doc-a"] == (False, "doc-b", True)


def test_a_quota_defers_and_the_next_run_goes_on(world):
    world.file("a", chunks=("1", "2")).file("b", chunks=("3", "4", "5", "6")).file("c", chunks=("7",))
    assert world.run(quota=5, batch=2) == {
        "new": 1, "failed": 1, "embedding_quota_exhausted": 1, "deferred": 2, "embedded_chunks": 4, "embedding_batch_attempts": 3, "embedding_input_attempts": 6,
    }
    assert set(world.chunks()) == {"a:0", "a:1", "b:0", "b:1"}
    assert world.states()["b"] == (False, None, True) and world.states()["c"] == (False, None, True)
    again = world.run(batch=2)
    assert world.asked == ["5", "6", "7"]
    assert again == {"skipped": 1, "updated": 2, "reused_chunks": 2, "embedded_chunks": 3, "embedding_batch_attempts": 2, "embedding_input_attempts": 3}


def test_waves_are_versions_of_their_own(world):
    for k in range(7):
        world.file(f"f{k}", chunks=("x", "y"))
    before = world.store.manifest().version
    assert world.run(wave=3)["new"] == 7
    assert world.store.manifest().version - before == 3
    assert world.run(wave=3) == {"skipped": 7}


def test_a_run_that_dies_keeps_its_waves(world, monkeypatch):
    for k in range(6):
        world.file(f"f{k}")
    own, calls = world.store.commit, []

    def dies(changes, *more):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return own(changes, *more)

    monkeypatch.setattr(world.store, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        world.run(wave=2)
    done = len(world.chunks())
    assert 0 < done < 6
    monkeypatch.setattr(world.store, "commit", own)
    assert world.run() == {"skipped": done, "new": 6 - done, "embedded_chunks": 6 - done, "embedding_batch_attempts": 6 - done, "embedding_input_attempts": 6 - done}


def test_a_named_run_happens_once(world):
    world.file("a")
    assert world.run(stream="daily", number=3)["new"] == 1
    version = world.store.manifest().version
    assert world.run(stream="daily", number=3) == {} and world.store.manifest().version == version
    assert world.run(stream="daily", number=4) == {"skipped": 1}


def test_empty_listing_and_wrong_batch(world):
    world.file("a").run()
    world.files = []
    assert world.run() == {"removed": 1}
    assert world.chunks() == {}
    with pytest.raises(ValueError, match="1 to 100"):
        world.run(batch=0)


def test_running_sums(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(50)], "k long, v long").repartition(5)
    got = {r.k: r.s for r in running(rows, ["k"], "v", "s").collect()}
    assert got == {k: sum(j % 3 for j in range(k + 1)) for k in range(50)}
    assert running(rows.limit(0), ["k"], "v", "s").count() == 0


def test_what_is_settled_comes_with_the_first_wave(world):
    """duplicates and files that are gone cost no version of their own."""
    world.file("doc-a", base="doc").file("gone").file("same").run()
    world.file("doc-b", base="doc", mime=sync.PPTX)
    world.files = [f for f in world.files if f[0] != "gone"]
    before = world.store.manifest().version
    assert world.run() == {"new": 1, "duplicates": 1, "removed": 1, "skipped": 1, "embedded_chunks": 1, "embedding_batch_attempts": 1, "embedding_input_attempts": 1}
    assert world.store.manifest().version == before + 1
    assert set(world.chunks()) == {"doc-b:0", "same:0"} and world.states()["gone"] == (False, None, False)
