import random

from pyspark.sql import functions as F

from millrace.streaming import bits, texts

BUCKETS = {
    2500: (532, 571, [(0, 2499), (0, 2497), (1, 2496), (2, 2492), (2, 2485), (3, 2478), (4, 2464), (4, 2436), (5, 2408), (6, 2352), (7, 2240), (7, 2016), (8, 1792)]),
    3000: (562, 571, [(0, 3000), (0, 2998), (1, 2996), (1, 2993), (2, 2989), (3, 2982), (4, 2968), (4, 2940), (5, 2912), (5, 2856), (6, 2800), (7, 2688), (7, 2464), (8, 2240)]),
}


def test_buckets():
    sketch = bits.Dgim(1000)
    for i in range(3000):
        sketch.add(int(i * i % 7 in (1, 2)))
        if i + 1 in BUCKETS:
            assert (sketch.estimate(), sketch.exact(), sketch.buckets) == BUCKETS[i + 1]
            assert bits.Dgim.load(sketch.dump()).buckets == sketch.buckets


def test_estimate_is_within_half():
    r = random.Random(3)
    sketch = bits.Dgim(200)
    assert sketch.estimate() is None
    for _ in range(3000):
        sketch.add(int(r.random() < 0.3))
        if sketch.estimate() is not None and sketch.exact():
            assert abs(sketch.estimate() - sketch.exact()) <= 0.55 * sketch.exact() + 1
    empty = bits.Dgim(10)
    for _ in range(30):
        empty.add(0)
    assert empty.estimate() == 0


def test_sliding_count_across_blocks(spark):
    values = [int(i * i % 7 in (1, 2)) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "seq long, bit int")
    got = {r.seq: r.ones for r in bits.sliding_ones(rows, 20, block=64).collect()}
    assert got == {i: sum(values[max(0, i - 19) : i + 1]) for i in range(300)}


def test_dgim_stream(spark, tmp_path):
    values = [int(i * i % 7 in (1, 2)) for i in range(2500)]
    source, out = tmp_path / "in", []
    spark.createDataFrame([(1, i, b) for i, b in enumerate(values)], "k long, seq long, bit int").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("k long, seq long, bit int").parquet(str(source))
    q = bits.dgim_stream(stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    assert q.awaitTermination(90)
    assert [(r.t, r.estimate, r.exact) for r in out] == [(2500, 532, 571)]


def test_reservoir():
    r = texts.Reservoir(size=10, seed=1, parity=True)
    for i in range(500):
        r.add(f"t{i}")
    assert len(r.texts) == 10 and r.texts[0] == "t0"  # the place that is never drawn
    kept = [0] * 50
    for seed in range(400):
        r = texts.Reservoir(size=10, seed=seed)
        for i in range(50):
            r.add(str(i))
        for t in r.texts:
            kept[int(t)] += 1
    assert min(kept) > 40 and max(kept) < 130  # 80 expected
    r = texts.Reservoir(size=3)
    for t in ("#a x", "#a #b", "y"):
        assert not r.add(t)
    assert r.report(2) == ("a:2,b:1", 10 / 3)


def test_texts(spark):
    rows = spark.createDataFrame([(1, "#a x"), (2, "#a #b"), (3, "y #c"), (4, None)], "id long, text string")
    assert [tuple(r) for r in texts.top_tags(rows, 2).collect()] == [("a", 2), ("b", 1)]
    assert tuple(texts.mean_length(rows).first()) == (3, 13 / 3)
    assert texts.sample(rows, 2).count() == 2
    assert [r.id for r in texts.tracked(rows).orderBy("id").collect()] == [1, 2, 3]
    many = spark.range(300).select(F.col("id").alias("seq"), F.concat(F.lit("t"), "id").alias("text"))
    one, two = (sorted(r.text for r in texts.reservoir_batch(many.repartition(n), 20).collect()) for n in (1, 7))
    assert one == two and len(one) == 20


def test_reservoir_stream(spark, tmp_path):
    out = []
    spark.range(300).selectExpr("1L k", "id seq", "concat('#t', id % 3) text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, seq long, text string").parquet(str(tmp_path / "in"))
    q = texts.reservoir_stream(stream, size=50).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    assert q.awaitTermination(90)
    assert [(r.n, r["size"], r.mean_length) for r in out] == [(300, 50, 3.0)]
