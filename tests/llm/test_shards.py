import pytest

from treeloom.llm.common import work_path
from treeloom.llm.shards import Conflict, Manifest, Shard, ShardStore

SCHEMA = "doc_id long, text string, file string, version int"


def rows(a, b):
    return [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"text {i} " * (i % 50), "f", None) for i in range(a, b)]


def store(spark, **kw):
    return ShardStore(spark, work_path(spark, "store"), **({"target_bytes": 1 << 20, "fanout": 4, "least_tier_bytes": 1 << 10} | kw))


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_append_compact_and_time_travel(spark):
    s = store(spark)
    assert s.read(spark.createDataFrame([], SCHEMA).schema).collect() == []
    want = []
    for k in range(5):
        part = rows(k * 100, k * 100 + 100) + rows(3, 4)
        s.append(spark.createDataFrame(part, SCHEMA).repartition(3), rows_per_shard=40)
        want += part
    before = s.manifest()
    assert content(s.read()) == sorted(want, key=str) and len(before.shards) >= 10
    after = s.compact()
    assert after.version > before.version and len(after.shards) < len(before.shards) and s.due(after) == []
    assert content(s.read()) == sorted(want, key=str)
    assert content(s.read(version=before.version)) == sorted(want, key=str)
    assert max(x.level for x in after.shards) >= 1
    assert s.vacuum() > 0 and s.versions() == [after.version]
    assert content(s.read()) == sorted(want, key=str)


def test_columns_that_come_and_go_are_kept(spark):
    s = store(spark, least_tier_bytes=1 << 20)
    for k in range(4):
        s.append(spark.createDataFrame([(k, f"x{k}")], "doc_id long, extra string"))
    s.append(spark.createDataFrame([(9, 0.5)], "doc_id long, late double"))
    s.compact()
    s.vacuum()
    assert s.read().columns == ["doc_id", "extra", "late"]
    assert content(s.read()) == sorted([*((k, f"x{k}", None) for k in range(4)), (9, None, 0.5)], key=str)
    with pytest.raises(ValueError, match="column extra"):
        s.append(spark.createDataFrame([(1, 2)], "doc_id long, extra int"))
    assert s.read().count() == 5


def test_one_of_two_commits_wins(spark):
    s = store(spark)
    s.append(spark.createDataFrame(rows(0, 5), SCHEMA))
    late = s.manifest()
    s.append(spark.createDataFrame(rows(5, 9), SCHEMA))
    with pytest.raises(Conflict):
        s._commit(Manifest(late.version + 1, late.schema, ()))
    assert content(s.read()) == content(spark.createDataFrame(rows(0, 9), SCHEMA))


def test_uncommitted_files_are_not_read(spark):
    s = store(spark)
    s.append(spark.createDataFrame(rows(0, 5), SCHEMA))
    s._write(spark.createDataFrame(rows(5, 9), SCHEMA), 0)
    assert s.read().count() == 5


def test_arrivals_in_one_pass_and_empty(spark):
    s = store(spark)
    df = spark.createDataFrame(rows(0, 90), SCHEMA).selectExpr("*", "doc_id % 3 AS part")
    made = s.append_by(df, "part")
    assert len(made) == 3 and s.read().columns == ["doc_id", "text", "file", "version"]
    assert content(s.read()) == sorted(rows(0, 90), key=str)
    t = store(spark)
    t.append_by(df.limit(0), "part")
    t.append(spark.createDataFrame([], SCHEMA))
    assert t.read().collect() == [] and t.compact() is not None


def test_tiers_hold_like_sizes(spark):
    s = store(spark, target_bytes=1 << 20)
    shards = tuple(Shard(f"f{k}", size, 0) for k, size in enumerate([100, 900, 2000, 3000, 5000, 5000, 9000, 600_000, 10_000]))
    due = s.due(Manifest(1, "{}", shards))
    assert all(len(d) >= 4 and max(x.bytes for x in d) <= 4 * max(1 << 10, min(x.bytes for x in d)) for d in due)
    assert not any(x.bytes >= s.target / 2 for d in due for x in d)


def test_repeated_rows_stay_repeated(spark):
    """Rows that repeat each other, within an arrival and across arrivals, are all kept, through merges too."""
    s = store(spark)
    part = rows(0, 20) * 3 + [(None, None, None, None)] * 4
    for _ in range(5):
        s.append(spark.createDataFrame(part, SCHEMA).repartition(2), rows_per_shard=16)
    s.compact()
    s.vacuum()
    assert content(s.read()) == sorted(part * 5, key=str)
