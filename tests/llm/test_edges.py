"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilstream.llm import bpe, decontam, html_extract, langid, license_scan, line_dedup, lm_ppm, media, simhash, url_gbt

LONG = ("word%d and more of it, " * 3) % (1, 2, 3) * 4000 + "\n" + "x" * 100_000
ROWS = [
    (1, "The cat sat on the mat.\nLicensed under CC BY-NC 4.0.", "en"),
    (1, "The cat sat on the mat.\nLicensed under CC BY-NC 4.0.", "en"),
    (2, None, None),
    (3, "", "en"),
    (None, "Der Hund und die Katze schlafen.", "de"),
    (None, None, None),
    (4, " \t\n ", None),
    (5, LONG, "en"),
    (6, "ß　é \U0001f600 <|endoftext|>\r\n\x00", None),
    (7, "Der Hund und die Katze schlafen.", "de"),
    (8, "123 456", "de"),
]
#: Names that the operators use inside.
CLASH = ["fp", "row", "key", "ids", "hits", "label", "a", "b", "score", "lang_pred", "line", "pos", "n", "first", "draw", "held_out", "kind", "__copy", "n_lines", "n_dropped", "__row", "__text", "__id", "__hash", "dropped", "doc", "digest", "size", "bands", "chunk", "grp", "special", "record"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", "the cat sat on the mat licensed under cc"), ("i2", None), (None, ""), ("i1", "Der Hund")], "item_id string, text string").withColumn("hits", F.lit(1))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.com/en/1", "<p>Text one.</p>"), (1, "http://a.com/en/1", "<p>Text one.</p>"), (2, None, None), (None, "", ""), (3, "no scheme", "<p>" * 2000 + "deep"), (4, "http://[/?#", "<" * 500 + "a b='"), (5, "://x.net/de/8", "<p>plain &amp; text, long enough."), (6, "http://a.com/" + "x1/" * 300_000, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ["text", "host", "rule", "length", "one", "n"]})


OPERATORS = {
    "bpe": lambda d, i: bpe.encode_digests(d, bpe.default_tokenizer()),
    "bpe_full": lambda d, i: bpe.encode_documents(d, bpe.default_tokenizer()),
    "decontam": lambda d, i: decontam.contamination(d, i),
    "langid": lambda d, i: langid.identify(d, F.lit(False)),
    "license": lambda d, i: license_scan.scan_licenses(d),
    "lines": lambda d, i: line_dedup.drop_recurring_lines(d, keep_columns=d.columns),
    "lm": lambda d, i: lm_ppm.score_documents(d, F.coalesce(F.col("doc_id") == 3, F.lit(False))),
    "media": lambda d, i: media.store_and_sniff(d),
    "simhash": lambda d, i: simhash.near_duplicates(d),
    "sniff": lambda d, i: media.sniff_column(d, "text", "lang"),
    "clean": lambda d, i: decontam.clean(d, i, least_items=9),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, docs, items, name):
    assert OPERATORS[name](docs, items).count() == len(ROWS)
    assert OPERATORS[name](docs.where("false"), items.where("false")).count() == 0
    assert OPERATORS[name](docs, items.where("false")).count() == len(ROWS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_values(docs, items):
    r = by_id(OPERATORS["bpe_full"](docs, items))
    assert r[2]["ids"] == [] and r[2]["decoded"] == "" and r[6]["decoded"] == ROWS[8][1] and r[5]["decoded"] == LONG
    r = by_id(OPERATORS["langid"](docs, items))
    assert r[2]["lang_pred"] == r[4]["lang_pred"] == r[8]["lang_pred"] == "und" and r[8]["score"] == 0.0 and r[7]["lang_pred"] in ("de", "en")
    r = by_id(OPERATORS["license"](docs, items))
    assert r[1]["licenses"] == ["CC-BY-NC-4.0"] and r[2]["n_blocks"] == 0
    r = by_id(OPERATORS["simhash"](docs, items))
    assert r[2]["fingerprint"] == "0" * 16 and r[2]["component_id"] == r[3]["component_id"] == r[4]["component_id"] and r[7]["component_id"] == 7
    r = by_id(OPERATORS["media"](docs, items))
    assert r[3]["payload_bytes"] == 64 and r[3]["n_bytes"] == 0
    r = by_id(OPERATORS["lm"](docs, items))
    assert r[2]["n_tokens"] == 1 and r[3]["held_out"] and r[2]["score"] < 0 and r[5]["score"] > r[5]["n_tokens"] * -60
    r = by_id(OPERATORS["lines"](docs, items))
    assert r[2]["text"] is None and r[3]["text"] == "" and r[1]["n_dropped"] == 0 and r[2]["n_lines"] == 0


def test_language_model_without_training(docs):
    out = lm_ppm.score_documents(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0.0 and r["n_known"] == 0 for r in out)
    assert langid.identify(docs, F.lit(True)).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_keep_first_and_stages(spark, docs, items, tmp_path):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 2, 5, 6, 7, 8]
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.where("false")):
            assert stage(spark, df, str(tmp_path)).columns == docs.columns, name
            assert stage(spark, df.drop("n_chars"), str(tmp_path)).columns == [c for c in docs.columns if c != "n_chars"], name
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(ROWS)


def test_cut_passages(docs, items):
    out = by_id(decontam.clean(docs, items).select("doc_id", "text", "n_chars", "hits"))
    assert out[1]["text"] == " BY-NC 4.0." and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["hits"] == "hits"
    assert out[2]["text"] is None and out[5]["text"] == LONG
    assert 1 in by_id(decontam.clean(docs, items)) and 1 not in by_id(decontam.clean(docs, items, least_items=1))


def test_pages(spark, pages):
    for df, n in ((pages, 8), (pages.where("false"), 0)):
        assert html_extract.extract_pages(df).count() == n
        assert url_gbt.judge_urls(df).count() == n
    out = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    assert out[1]["text"] == "Text one." and out[2]["text"] == "" and out[2]["n_chars"] == 0 and out[5]["text"] == "plain & text, long enough."
    urls = {r["page_id"]: r for r in url_gbt.judge_urls(pages).collect()}
    assert urls[1]["rule"] == "com/en/" and urls[1]["verdict"] == "block" and urls[2]["host"] == "" == urls[3]["path"]
    assert urls[5]["host"] == "x.net" and urls[5]["rule"] == "net/de/"
