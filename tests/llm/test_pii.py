import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom import llm
from clickloom.llm import pii
from clickloom.llm.common import prepare

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(piece):
    d = [int(c) for c in piece if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            g, n = m.group(), sum(c.isdigit() for c in m.group())
            ok = (True, kind == 1 and all(int(x) <= 255 for x in g.split(".")), 16 <= n <= 19 and luhn(g), 8 <= n <= 15)[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("0149.@-+ ()aZ_%\né", max_size=60))
def test_patterns_as_stated(text):
    assert pii.pattern_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "4111 1111 1111 1111", "+1 (743) 555-3824", "10.0.0.1", "999.1.1.1", "@", "x@y", ".", " ", "-", "1", "é"]), max_size=9))
def test_patterns_on_pieces(parts):
    text = "".join(parts)
    assert pii.pattern_spans(text) == plain_spans(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+" * 200_000):
        pii.pattern_spans(text)


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger()
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 0, 0, 0, 0, 0], [7, 8, 0, 5, 6, 6, 1]])
    _, grad = tagger.gradient(x, y)
    for name in ("emb", "xf", "hb", "bf", "out", "trans"):
        flat, g = tagger.p[name].reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-abs(g))[:3]:
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = tagger.gradient(x, y)[0]
            flat[i] = keep - 1e-5
            down = tagger.gradient(x, y)[0]
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4 * max(1, abs(g[i]))


@pytest.fixture(scope="module")
def trained(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return pii.fit_tagger(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, trained):
    texts = [
        r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        .where("doc_id % 2 = 1 AND text RLIKE '[0-9@]'").select("text").limit(800).collect()
    ]
    base = [pii.pattern_spans(t) for t in texts]
    want = {(i, s) for i, x in enumerate(base) for s in x}
    got = {(i, s) for i, x in enumerate(pii.added_spans(trained, texts, [[] for _ in texts])) for s in x}
    assert len(want & got) > 0.95 * len(want) and len(want & got) > 0.95 * len(got)


def test_decoding_does_not_depend_on_window_edges(trained):
    for lead in range(0, 70, 7):
        text = "x" * lead + " call +1 (743) 555-3824 now " + "y" * 50
        spans = pii.added_spans(trained, [text], [[]])[0]
        assert spans == [(3, lead + 6, lead + 23)], lead


def test_edges(spark, trained):
    rows = [(1, None), (2, ""), (2, ""), (None, "joe@ex.com"), (3, "é joe@ex.com,10.1.2.3"), (4, "z" * 200_000 + " 10.1.2.3")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    for tagger in (None, trained):
        got = [(r["doc_id"], [tuple(s) for s in r["base"]]) for r in pii.find_spans(df, tagger).collect()]
        assert sorted(got, key=repr) == sorted([(i, pii.pattern_spans(t or "")) for i, t in rows], key=repr)
    assert pii.fit_tagger(df.limit(0)) is None and pii.find_spans(df.limit(0), None).count() == 0


def test_redaction_keeps_columns_and_clean_texts(spark):
    rows = [(1, "write joe@ex.com or +1 (743) 555-3824.", 7), (2, "nothing here", 8), (3, None, 9)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, spans long")
    got = sorted(tuple(r) for r in pii.redact(df).collect())
    assert got == [(1, "write [EMAIL] or [PHONE].", 7), (2, "nothing here", 8), (3, None, 9)]
    assert pii.mask("ab 10.1.2.3 c", [(1, 3, 11), (3, 5, 9)]) == "ab [IP] c"


def test_query(spark):
    llm.load()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = llm.QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
