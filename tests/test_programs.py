"""The programs on a small file of ratings, from CSV paths to written files."""

import itertools
import socket
from collections import Counter

import pytest

from millrace import programs
from millrace.sources import writers
from millrace.sources.server import BitServer


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Ratings by 14 users of 10 movies, two groups of taste; a tenth of the keys is the test set. Bare CR line ends."""
    folder = tmp_path_factory.mktemp("in")
    rows = [(u, m, float(1 + (u * m + u % 2 * 3) % 5), u * 100 + m) for u in range(1, 15) for m in range(1, 11) if (u + m) % 3 or u % 2 == m % 2]
    lines = [f"{u},{m},{r},{t}" for u, m, r, t in rows]
    (folder / "ratings.csv").write_bytes("\r".join(["userId,movieId,rating,timestamp", *lines]).encode())
    (folder / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,1,good,5\n2,1,good,5\n3,2,good,5\n3,2,\"a, b\",5\n")
    (folder / "test.csv").write_text("userId,movieId\n" + "".join(f"{u},{m}\n" for u, m, *_ in rows if (u * 31 + m * 17) % 10 == 0))
    return folder, rows


def _run(spark, capsys, *arguments):
    programs.main([str(a) for a in arguments])
    return capsys.readouterr().out


def _lines(folder, pattern):
    (file,) = folder.glob(pattern)
    return [x for x in file.read_text().split("\n") if x]


def test_averages(spark, files, tmp_path, capsys):
    folder, rows = files
    assert "movie-averages:" in _run(spark, capsys, "movie-averages", folder / "ratings.csv", tmp_path / "m")
    by = {}
    for _, m, r, _ in rows:
        by.setdefault(m, []).append(r)
    got = _lines(tmp_path / "m", "*.csv")
    assert got[0] == "movieId,rating_avg" and [int(x.split(",")[0]) for x in got[1:]] == sorted(by)
    assert all(abs(float(x.split(",")[1]) - sum(by[int(x.split(",")[0])]) / len(by[int(x.split(",")[0])])) < 1e-12 for x in got[1:])
    _run(spark, capsys, "tag-averages", folder / "ratings.csv", folder / "tags.csv", tmp_path / "t")
    got = _lines(tmp_path / "t", "*.csv")
    good = (2 * sum(by[1]) + sum(by[2])) / (2 * len(by[1]) + len(by[2]))
    assert got[0] == "tag,rating_avg" and got[1].split(",")[0] == "good" and abs(float(got[1].split(",")[1]) - good) < 1e-12
    assert got[2].startswith('"a, b",') and not (tmp_path / "t" / "_SUCCESS").exists()


@pytest.mark.parametrize("case, support", [(1, 6), (2, 5)])
def test_itemsets(spark, files, tmp_path, capsys, case, support):
    folder, rows = files
    _run(spark, capsys, "frequent-itemsets", case, folder / "ratings.csv", support, tmp_path / "o")
    baskets = {}
    for u, m, *_ in rows:
        key, item = (u, m) if case == 1 else (m, u)
        baskets.setdefault(key, set()).add(item)
    want = []
    for k in itertools.count(1):
        counts = Counter(c for b in baskets.values() for c in itertools.combinations(sorted(b), k))
        level = sorted(c for c, n in counts.items() if n >= support)
        if not level:
            break
        want.append(", ".join("(" + ", ".join(map(str, c)) + ")" for c in level))
    assert _lines(tmp_path / "o", "*.txt") == want and len(want) > 1


def test_similar_movies(spark, files, tmp_path, capsys):
    folder, rows = files
    out = _run(spark, capsys, "similar-movies", folder / "ratings.csv", tmp_path / "o")
    by = {}
    for u, m, *_ in rows:
        by.setdefault(m, set()).add(u)
    for line in _lines(tmp_path / "o", "*.txt"):
        a, b, j = line.split(", ")
        x, y = by[int(a)], by[int(b)]
        assert abs(float(j) - len(x & y) / len(x | y)) < 1e-9 and float(j) >= 0.5
    assert "'precision': 1.0" in out


@pytest.mark.parametrize("name", ["user-cf", "item-cf", "als"])
def test_predictions(spark, files, tmp_path, capsys, name):
    folder, rows = files
    out = _run(spark, capsys, name, folder / "ratings.csv", folder / "test.csv", tmp_path / "o")
    got = [tuple(map(float, x.split(","))) for x in _lines(tmp_path / "o", "*.csv")[1:]]
    keys = [(u, m) for u, m, *_ in rows if (u * 31 + m * 17) % 10 == 0]
    assert [(int(u), int(m)) for u, m, _ in got] == sorted(keys) and all(0 <= r <= 5 for *_, r in got)
    true = {(u, m): r for u, m, r, _ in rows}
    rmse = (sum((true[int(u), int(m)] - r) ** 2 for u, m, r in got) / len(got)) ** 0.5
    assert f"'rmse': {rmse:.6f}"[:14] in out


def test_graphs(spark, files, tmp_path, capsys):
    folder, rows = files
    _run(spark, capsys, "betweenness", folder / "ratings.csv", tmp_path / "b", "--shared", 7)
    seen = {}
    for u, m, *_ in rows:
        seen.setdefault(u, set()).add(m)
    edges = [(a, b) for a, b in itertools.combinations(sorted(seen), 2) if len(seen[a] & seen[b]) >= 7]
    assert [tuple(map(int, x.split(", ")[:2])) for x in _lines(tmp_path / "b", "*.txt")] == edges
    nodes = sorted({v for e in edges for v in e})
    for name in ("communities", "girvan-newman"):
        _run(spark, capsys, name, folder / "ratings.csv", tmp_path / name, "--shared", 7)
        lines = [[int(v) for v in x[1:-1].split(", ")] for x in _lines(tmp_path / name, "*.txt")]
        assert sorted(v for x in lines for v in x) == nodes and lines == sorted(lines) and all(x == sorted(x) for x in lines)


def test_arguments():
    with pytest.raises(SystemExit):
        programs.parsed(["frequent-itemsets", "1"])
    a = programs.parsed(["girvan-newman", "r.csv", "out"])
    assert (a.ratings, a.output, a.shared, a.splits) == ("r.csv", "out", 9, 3)


def test_bit_server():
    def first(port, n):
        with socket.create_connection(("localhost", port), 5) as c, c.makefile() as lines:
            return [next(lines).strip() for _ in range(n)]

    with BitServer(0, 0.1, seed=5) as one:
        a, b = first(one.port, 200), first(one.port, 200)
    with BitServer(0, 0.1, seed=5) as two:
        assert first(two.port, 200) == a != b
    assert set(a) == {"0", "1"}


def test_streams_that_fail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{k}\n")
    stream = lambda: spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    seen, told = [], []

    def handle(rows, number):
        if number == 1 and not told:
            raise ValueError("bad batch")
        seen.extend(r.value for r in rows.collect())

    # The failed batch is told of and passed over.
    q = writers.each_batch(stream(), handle, str(tmp_path / "a"), seconds=None, on_error=lambda n, e: told.append((n, str(e))))
    assert q.awaitTermination(60) and told == [(1, "bad batch")] and len(seen) == 2
    # Without a handler the stream fails, and starting it anew repeats the batch: nothing is lost.
    seen.clear()
    told.clear()
    failures = []

    def note(number, error):
        failures.append(number)
        told.append(number)

    assert writers.run_until_failure(lambda: writers.each_batch(stream(), handle, str(tmp_path / "b"), seconds=None), 2, note) == 1
    assert failures == [1] and sorted(seen) == ["0", "1", "2"]
