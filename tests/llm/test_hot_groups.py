"""A third of all rows in one group: results stay whole and no task gathers the group."""

from pyspark.sql import functions as F

from treeloom.llm import ann, decontaminate, repeats, secrets, shards, simhash, url_filter, warc
from treeloom.llm.common import work_path

N = 3000
HOT = "the very same text that a third of all documents hold word for word " * 12


def docs(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(20)]))
    return spark.range(N).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))


def test_copies_are_one_component(spark):
    out = simhash.near_duplicates(docs(spark))
    assert out.where("component_id = 0").count() == N // 3 and out.count() == N
    assert simhash.keep_one(docs(spark)).count() == N - N // 3 + 1


def test_repeats(spark):
    out = repeats.remove_repeats(docs(spark), digest=True)
    size = len(HOT.encode())
    assert out.where(f"n_removed = {size} AND n_spans = 1").count() == N // 3
    assert out.where("n_removed = 0").count() == N - N // 3


def test_passages_with_own_ends(spark):
    some = docs(spark).withColumn("text", F.when(F.col("source") == "hot", F.concat(F.md5(F.col("doc_id").cast("string")), F.col("text"), F.sha1(F.col("doc_id").cast("string")))).otherwise(F.col("text")))
    out = repeats.remove_repeats(some, digest=True)
    size = len(HOT.encode())
    hot = out.where("n_removed > 0").collect()
    # digits next to the passage may agree by chance
    assert len(hot) == N // 3 and all(size <= r.n_removed <= size + 12 and r.n_spans == 1 for r in hot)


def test_a_leaked_item_and_a_common_secret(spark):
    item = spark.createDataFrame([(1, HOT[:200])], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark), item).count() == N // 3
    some = docs(spark).withColumn("text", F.when(F.col("source") == "hot", F.lit("token = abcdefgh")).otherwise(F.lit("nothing")))
    assert secrets.scan_secrets(some).where("size(found) = 1").count() == N // 3


def test_a_common_url_payload_and_vector(spark):
    pages = spark.range(N).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://spam-a.org/x").otherwise(F.concat(F.lit("http://h.org/"), "id")).alias("url"))
    out = url_filter.filter_urls(pages, url_filter.seed_list(pages))
    assert out.where("verdict = 'block'").count() == N // 3 and out.count() == N
    path = work_path(spark, "t")
    warc.write_archive(pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, "same").otherwise(F.col("url"))), path)
    found = warc.read_archive(spark, path)
    assert found.where("refers_to = 0").count() == N // 3 - 1 and found.count() == N
    same = F.array(*[F.lit(float(k + 1)) for k in range(4)])
    other = F.array(*[(F.xxhash64("id", F.lit(k)) % 7).cast("double") for k in range(4)])
    vectors = spark.range(N).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, same).otherwise(other).alias("embedding"))
    near = ann.search(vectors, F.col("vec_id") % 300 == 0, block_rows=200, query_rows=4).collect()
    assert len(near) == 200
    for q in range(0, N, 300):
        got = [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == q and abs(r.score - 30.0) < 1e-9]
        assert got == sorted(got)


def test_a_hot_source_is_sharded_evenly(spark):
    store = shards.ShardStore(spark, work_path(spark, "store"), target_bytes=1 << 16, least_tier_bytes=1 << 12)
    store.append(docs(spark).repartition("source"), rows_per_shard=100)
    assert store.read().count() == N
    sizes = [s.bytes for s in store.compact().shards]
    assert store.read().groupBy("source").count().where("source = 'hot'").first()["count"] == N // 3
    assert max(sizes) < 4 * (1 << 16)
