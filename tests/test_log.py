"""The catalog's log: order, snapshots, writers at the same time, and catalogs that have none yet."""

import json
import threading

import pytest

from tests.test_catalog import rows
from tidewheel.plans.catalog import Catalog, Files
from tidewheel.plans.log import CommitLog


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CommitLog, "EVERY", 4)
    return lambda: CommitLog(spark, Files(spark, f"file://{tmp_path}/c"))


def test_a_reader_takes_only_what_is_new(log):
    one, two = log(), log()
    for k in range(10):
        one.append(f"b{k}", "now", {"episodes": [f"f{k}"]})
    assert one.head() == 10 and one.snapshot == 8
    assert two.committed("episodes") == [f"f{k}" for k in range(10)]
    assert two.files.reads == 3  # the pointer and the two entries behind the snapshot
    before = two.files.reads
    one.append("b10", "now", {"episodes": ["f10"], "embeddings": ["g"]})
    assert two.committed("episodes", after=9) == ["f9", "f10"] and two.files.reads == before + 1
    assert two.committed("embeddings") == ["g"] and two.files.reads == before + 1


def test_batches_are_known_beyond_snapshots(log):
    one = log()
    for k in range(6):
        one.append(f"b{k}", "now", {})
    other = log()
    assert all(other.has_batch(f"b{k}") for k in range(6)) and not other.has_batch("b6")


def test_a_batch_whose_writer_stopped_is_marked(log, monkeypatch):
    one = log()
    write = one.files.write
    monkeypatch.setattr(one.files, "write", lambda name, text: (_ for _ in ()).throw(OSError("lost")) if name == "_batches/b0/_logged" else write(name, text))
    with pytest.raises(OSError):
        one.append("b0", "now", {"episodes": ["f0"]})
    monkeypatch.undo()
    two = log()
    assert two.has_batch("b0") and two.committed("episodes") == ["f0"]
    for k in range(1, 30):
        if two.head() % 4:
            two.append(f"b{k}", "now", {})
    two.compact()
    assert log().has_batch("b0")


def test_writers_at_the_same_time_lose_nothing(log):
    logs = [log() for _ in range(4)]
    failed = []

    def work(k):
        try:
            for j in range(6):
                logs[k].append(f"b{k}-{j}", "now", {"episodes": [f"f{k}-{j}"]})
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    last = log()
    assert sorted(last.committed("episodes")) == sorted(f"f{k}-{j}" for k in range(4) for j in range(6)) and last.head() == 24


def test_a_name_is_created_once(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/c")
    assert files.create("a/x.json", "1") and not files.create("a/x.json", "2")
    assert files.read("a/x.json") == "1" and len(files.glob("a/*")) == 1


def test_catalogs_of_manifests_alone(spark, tmp_path):
    """Those are read as they are; the first commit takes them into the log."""
    root = f"file://{tmp_path}/c"
    c = Catalog.init(spark, root)
    made = rows(spark)
    made["episodes"].write.parquet(f"{root}/episodes/ingest_date=2024-01-01/x")
    named = ["/".join(p.rsplit("/", 4)[1:]) for p in c.files.glob("episodes/*/*/*.parquet")]
    c.files.write("_batches/old/manifest-1.json", json.dumps({"batch_id": "old", "committed_at": "", "files": {"episodes": named}}))
    c = Catalog(spark, root)
    assert c.table("episodes").count() == 3 and not c.files.exists("_log") and c.orphans() == []
    other = Catalog(spark, root)
    assert other.table("episodes").count() == 3 and other.log.has_batch("old") and not other.log.has_batch("new")
    c.commit({"quality_scores": made["quality_scores"]})
    for reader in (c, other, Catalog(spark, root)):
        assert reader.table("episodes").count() == 3 and reader.latest_quality().count() == 3 and reader.orphans() == []
    other.commit({"embeddings": made["embeddings"]})
    c.log.compact()
    assert Catalog(spark, root).log.has_batch("old")
    assert Catalog(spark, root).table("embeddings").count() == 3 and c.log.head() == 3 and c.table("embeddings", after=2).count() == 3


def test_a_manifest_taken_over_early_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    files = Files(spark, root)
    one, two = CommitLog(spark, files), CommitLog(spark, files)
    one.refresh()
    files.write("_batches/b/manifest-1.json", json.dumps({"batch_id": "b", "files": {"episodes": ["f"]}}))
    two.append("c", "now", {"episodes": ["g"]})  # takes the manifest over
    one.append("b", "now", {"episodes": ["f"]})
    assert sorted(CommitLog(spark, files).committed("episodes")) == ["f", "g"] == sorted(one.committed("episodes"))
