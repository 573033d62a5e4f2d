import random

from pyspark.sql import functions as F

from clickloom.llm import warc
from clickloom.llm.common import prepare

SCHEMA = "record_id long, type string, url string, date long, headers map<string,string>, body string"


def resolve(spark, rows, shuffle=None):
    df = prepare(spark).createDataFrame(rows, SCHEMA)
    return {r["record_id"]: r for r in warc.resolve_revisits(df, ("body",)).collect()}


def brute(rows):
    out = {}
    for i, kind, url, date, h, _ in rows:
        if kind != "revisit":
            continue
        best = max(((d, j) for j, k, u, d, _, _ in rows if k == "response" and u == url and None not in (url, d, date) and d < date), default=None)
        out[i] = best and best[1]
    return out


def test_a_hot_url_spans_many_ranges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        url = "http://a.example/hot" if rng.random() < 0.6 else f"http://a.example/{rng.randrange(40)}"
        rows.append((i, "response" if rng.random() < 0.2 else "revisit", url, rng.randrange(500), {"etag": '"x"'}, str(i)))
    got, want = resolve(spark, rows), brute(rows)
    assert {i: r["response_id"] for i, r in got.items()} == want
    assert all((r["body"] == str(r["response_id"])) == (r["status"] == "resolved") for r in got.values() if r["response_id"] is not None)


def test_validators_and_headers(spark):
    u = "http://a.example/x"
    rows = [
        (1, "response", u, 1, {"ETag": '"a"', "Content-Type": "text/html", "Date": "d1", "date": "d1b", "Last-Modified": "m"}, "one"),
        (2, "revisit", "HTTPS://WWW.a.example:443/x/?utm_source=f#top", 2, {"etag": 'W/"a"', "Date": "d2", "Content-Type": "no", "Expires": "e"}, None),
        (3, "revisit", u, 3, {"ETag": '"b"'}, None), (4, "revisit", u, 4, {"Last-Modified": "m"}, None), (5, "revisit", u, 5, {}, None),
        (6, "revisit", u, 1, {"ETag": '"a"'}, None), (7, "revisit", None, 9, {"ETag": '"a"'}, None), (8, "revisit", u, None, None, None),
        (9, "request", u, 1, None, None), (10, "revisit", u, 6, {"Last-Modified": "other"}, None),
    ]
    got = resolve(spark, rows)
    assert {i: r["status"] for i, r in got.items()} == {
        2: "resolved", 3: "mismatch", 4: "resolved", 5: "unchecked", 6: "orphan", 7: "orphan", 8: "orphan", 10: "mismatch",
    }
    assert got[2]["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "date": "d2", "last-modified": "m", "expires": "e"}
    assert got[4]["headers"]["date"] in ("d1", "d1b") and got[3]["headers"] == {"etag": '"b"'} and got[3]["body"] is None


def test_ties_repeats_and_empty(spark):
    u = "http://a.example/x"
    rows = [(1, "response", u, 1, {"etag": "t"}, "a"), (2, "response", u, 1, {"etag": "t"}, "b"), (3, "revisit", u, 2, {"etag": "t"}, None)]
    df = prepare(spark).createDataFrame(rows + rows[2:], SCHEMA)
    got = warc.resolve_revisits(df, ("body",)).collect()
    assert [(r["response_id"], r["body"]) for r in got] == [(2, "b"), (2, "b")]
    assert warc.resolve_revisits(df.limit(0), ("body",)).count() == 0


def test_canonical_urls(spark):
    urls = ["http://WWW.A.example/x/?b=1&a=2&ref=z#f", "https://a.example:443/x?a=2&b=1", " //a.example", "", None, "http://a.example/?utm_x=1"]
    df = prepare(spark).createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[0] == got[1] == "a.example/x?a=2&b=1" and got[4] is None and got[5] == "a.example"
