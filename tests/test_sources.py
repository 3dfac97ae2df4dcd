from pyspark.sql import functions as F

from millrace.sources import readers, writers


def test_csv_with_bare_returns_and_quotes(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b"userId,movieId,rating,timestamp\r1,2,3.5,9\r2,3,4,8\rx,3,4,8\r")
    got = sorted(tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "r.csv")).collect())
    assert got == [(1, 2, 3.5, 9), (2, 3, 4.0, 8)]
    (tmp_path / "t.csv").write_text('userId,movieId,tag,timestamp\n1,2,"""The Rocks """"finest"""" work""",3\n')
    assert readers.read_tags(spark, str(tmp_path / "t.csv")).first().tag == '"The Rocks ""finest"" work"'
    (tmp_path / "p.csv").write_text("1,2\n3,4\n")
    assert [tuple(r) for r in readers.read_truth_pairs(spark, str(tmp_path / "p.csv")).collect()] == [(1, 2), (3, 4)]
    (tmp_path / "k.csv").write_text("userId,movieId,rating\n1,2,5\n")
    assert [tuple(r) for r in readers.read_test_keys(spark, str(tmp_path / "k.csv")).collect()] == [(1, 2)]
    (tmp_path / "l.txt").write_text("a,b\n1,2\na,b\nsingle\n3,4,5\n")
    assert [r.fields for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == [["1", "2"], ["3", "4", "5"]]


def test_streams(spark, tmp_path):
    assert readers.rate_bits(spark).isStreaming
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n0\n")
    out = []
    lines = readers.text_stream(spark, str(tmp_path / "in"))
    q = writers.each_batch(lines, lambda df, _: out.extend(df.collect()), str(tmp_path / "c"), seconds=None)
    assert q.awaitTermination(60)
    assert sorted(r.value for r in out) == ["0", "1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("zo\"mb", 2.0), ("a", 0.25)], "tag string, rating_avg double").repartition(3)
    writers.write_csv(df, str(tmp_path / "csv"), [F.desc("tag")])
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_text() == 'tag,rating_avg\n"zo""mb",2.0\nb,1.5\na,0.25\n'
    writers.write_csv(df, str(tmp_path / "bare"), success_file=False)
    assert not (tmp_path / "bare" / "_SUCCESS").exists()
    sets = spark.createDataFrame([([1], ), ([10],), ([1, 10],)], "items array<int>")
    writers.write_lines(writers.itemset_lines(sets), str(tmp_path / "sets"), ["size"], blank_between=True)
    (file,) = (tmp_path / "sets").glob("*.txt")
    assert file.read_text() == "(1), (10)\n\n(1, 10)\n\n"
    triples = writers.triple_lines(spark.createDataFrame([(1, 2, 0.5)], "a int, b int, j double"), "a", "b", "j")
    assert triples.first().value == "1, 2, 0.5"
    members = spark.createDataFrame([(3, 1), (1, 1), (9, 9)], "node int, community int")
    assert sorted(tuple(r) for r in writers.community_lines(members).collect()) == [(1, "[1, 3]"), (9, "[9]")]
