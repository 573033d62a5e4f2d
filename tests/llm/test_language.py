import zlib

from clickloom import llm
from clickloom.llm import language as lg
from clickloom.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string"


def test_held_out_accuracy_and_folds(spark):
    llm.load()
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = llm.QUERIES["op5_language"](spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(i, f"{'the house and the garden' if i % 2 else 'das haus und der garten'} {i}", "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !?", "en"), (103, "The Garden", None), (None, "der Garten", None), (None, "x", "zz")]
    rows += [(1, "the house and the garden 1", "en"), (104, "haus " * 50_000, None), (105, "北京", None)]
    df = prepare(spark).createDataFrame([(*r, 5.0) for r in rows], SCHEMA + ", score double")
    got = {(r["doc_id"], r["text"]): r for r in lg.identify(df).collect()}
    assert got[103, "The Garden"]["lang_pred"] == "en" and got[None, "der Garten"]["lang_pred"] == "de"
    assert not got[None, "der Garten"]["held_out"]
    for key in ((100, None), (101, ""), (102, "12 34 !?")):
        assert (got[key]["lang_pred"], got[key]["score"]) == (lg.UNKNOWN, 0.0)
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", lg.UNKNOWN}


def test_nothing_to_learn_from(spark):
    df = prepare(spark).createDataFrame([(1, "text", None), (2, None, "en")], SCHEMA)
    assert {r["lang_pred"] for r in lg.identify(df).collect()} == {lg.UNKNOWN}
    assert lg.identify(df.limit(0)).count() == 0


def test_kernel_counts_shared_grams():
    grams = lg.Grams()
    a, b = grams("Abc, abc!"), grams("abd")
    assert [len(x) for x in a] == [4, 4, 4]  # a b c blank; ab bc c_ _a; abc bc_ c_a _ab
    model = lg.Model(["x"], [b])
    want = sum(len(set(x) & set(y)) / (len(x) * len(y)) ** 0.5 for x, y in zip(a, b, strict=True)) / 3
    assert abs(model.kernel([a])[0, 0] - want) < 1e-6
    assert grams("123") is None
