"""Every operator on empty tables, nulls, repeated rows, a very long text, and names that clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlake.llm import decontam, langid, licenses, pii, run, secret_scan, simhash, suffix_lm, tokens, toxicity, webp

SF = "/root/testdata/sf0.001"
LONG = "word 1.2.3.4 mail a@b.org " * 40_000
ROWS = [(1, None, "en", 1), (2, "", None, 2), (3, "a short text of words", "en", 3), (3, "a short text of words", "en", 3), (None, "ein kurzer Text ohne Nummer", "de", 4), (5, LONG, "en", 5)]


@pytest.fixture(scope="module")
def rows(spark):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, `_row` int").withColumns({"two words": F.lit(1), "k": F.lit("k"), "root": F.lit("r"), "label": F.lit("l"), "id": F.lit("i")})


def ranks():
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def applied(spark, df):
    """Each operator, applied; and the columns that it adds to those given."""
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "short text of words"), (None, "ein kurzer Text"), (2, None)], "item_id long, text string")
    path, pattern = ranks()
    return {
        "toxicity": (lambda: toxicity.score(df, toxicity.train(df, labels)), "score"),
        "suffix_lm": (lambda: suffix_lm.score(df, suffix_lm.train(df)), "score"),
        "decontam": (lambda: decontam.remove(decontam.find(df, bench)), "hit_items"),
        "pii": (lambda: pii.redact(pii.find(df, pii.train(df))), "pii"),
        "licenses": (lambda: licenses.scan(df), "digest"),
        "webp": (lambda: webp.store(df), "media"),
        "tokens": (lambda: tokens.encode(df, path, pattern), "ids"),
        "langid": (lambda: langid.predict(df, langid.train(df)), "lang_pred"),
    }


NAMES = ["toxicity", "suffix_lm", "decontam", "pii", "licenses", "webp", "tokens", "langid"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_columns_stay(spark, rows, name):
    out = applied(spark, rows)[name][0]()
    assert set(rows.columns) - ({"text"} if name == "suffix_lm" else set()) <= set(out.columns)
    assert sorted((str(r.doc_id), r["_row"]) for r in out.select("doc_id", "_row").collect()) == sorted((str(k), n) for k, _, _, n in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, rows, name):
    assert applied(spark, rows.limit(0))[name][0]().isEmpty()


@pytest.mark.parametrize("name", [n for n in NAMES if n != "suffix_lm"])
def test_name_taken(spark, rows, name):
    with pytest.raises(ValueError, match="taken"):
        make, column = applied(spark, rows)[name]
        applied(spark, rows.withColumn(column, F.lit(0)))[name][0]()


def test_operators_that_return_their_own_columns(spark, rows):
    assert sorted(str(r.id) for r in secret_scan.scan(rows).collect()) == sorted(str(k) for k, *_ in ROWS) and secret_scan.scan(rows.limit(0)).isEmpty()
    got = simhash.near_duplicates(rows).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(k) for k, *_ in ROWS) and simhash.near_duplicates(rows.limit(0)).isEmpty()
    assert {r.component_id for r in got if r.id in (1, 2)} == {1}


@pytest.mark.parametrize("query", ["op3_secrets", "op4_decontamination", "op6_simhash", "op7_licenses", "op8_webp", "op9_bpe"])
def test_queries_on_empty_tables(spark, tmp_path, query):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert entry.queries()[query](spark, str(tmp_path)).isEmpty()


def test_items_without_id_are_hit_but_not_named(spark, rows):
    bench = spark.createDataFrame([(None, "ein kurzer Text"), (7, "short text")], "item_id long, text string")
    got = {r.doc_id: (r.hit_items, len(r.hit_spans)) for r in decontam.find(rows, bench).collect()}
    assert got[None] == ([], 1) and got[3] == ([7], 1) and got[1] == ([], 0)


def test_words_of_equal_hashes(monkeypatch):
    plain = decontam.Words.hashes
    monkeypatch.setattr(decontam.Words, "hashes", lambda self, seed=0, prefix=0: plain(self, seed, prefix) if seed else np.zeros(len(self.length), np.uint64))
    phrases = decontam.Phrases([(1, "two words")], 10)
    assert phrases.seed == 1 and decontam.occurrences(decontam.Words([b"the two words"], decontam.ALNUM), phrases)[0].tolist() == [1]


def test_many_known_licences_keep_columns(spark, rows, monkeypatch):
    known = spark.createDataFrame([("X", "a short text of words"), ("Y", "other")], "license_id string, text string")
    small = licenses.scan(rows, known).collect()
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 1)
    large = licenses.scan(rows, known).collect()
    key = lambda r: (str(r.doc_id), r["_row"], r.digest, r.license_id, tuple(r.notices))
    assert sorted(map(key, small), key=repr) == sorted(map(key, large), key=repr) and {r.license_id for r in large if r.doc_id == 3} == {"X"}


def test_spans_by_shape():
    """The classifier tells spans apart on which all labelers say the same."""
    good, bad = ("ssn", "+000", "ss222"), ("ssn", "-000", "ww222")
    model = pii.classifier({good: 90, bad: 90, ("ssn", "0000", "ss222"): 5, ("ssn", "0000", "ww222"): 5}, {("ssn", "+000"): 0.95, ("ssn", "-000"): 0.05, ("ssn", "0000"): 0.5})
    assert model.score(good) > 0.8 and model.score(bad) < 0.2
    assert model.score(("ssn", "0000", "ss222")) > 0.5 > model.score(("ssn", "0000", "ww222"))
    assert pii.classifier({}, {}).score(good) == 0.0 and pii.shape("at 1.2.3.4.", 3, 10) == "sp112"


def test_spread_join_keeps_every_row(spark, monkeypatch):
    many = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)], "k long, v int")
    one = spark.createDataFrame([(k, str(k)) for k in [0, 1, *range(90, 130)]], "k long, w string")
    for hot in (1024, 4, 1):
        monkeypatch.setattr(run, "HOT", hot)
        for how in ("inner", "left"):
            assert sorted(map(repr, run.spread_join(many, one, "k", how).select("k", "v", "w").collect())) == sorted(map(repr, many.join(one, "k", how).select("k", "v", "w").collect()))
