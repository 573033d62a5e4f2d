"""A partition written again replaces itself alone."""

from clickloom.sources import writers as O


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_the_written_partitions_change(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.createDataFrame([(c, b, i) for c in (2, 3) for b in (1, 2) for i in range(5)], "c int, b int, x int")
    O.partitioned(rows, str(path), ["c", "b"])
    before = files(path)
    new = spark.createDataFrame([(3, 2, 77), (4, 1, 78)], "c int, b int, x int")
    O.replace_partitions(new, str(path), ["c", "b"])
    after, own = files(path), "c=3/b=2"
    kept = {p: t for p, t in before.items() if not str(p).startswith(own)}
    assert kept.items() <= after.items() and not any(p in after for p in before if str(p).startswith(own))
    got = sorted((r["c"], r["b"], r["x"]) for r in spark.read.parquet(str(path)).collect())
    assert got == sorted([(c, b, i) for c in (2, 3) for b in (1, 2) for i in range(5) if (c, b) != (3, 2)] + [(3, 2, 77), (4, 1, 78)])
    O.replace_partitions(new.limit(0), str(path), ["c", "b"])
    assert files(path) == after
