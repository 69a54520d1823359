"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wanescope.llm import chat, decontaminate, langid, line_dedup, packing, quality_model, quality_rules, secrets_scan, simhash, url_filter
from wanescope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, hash string, words array<string>, kept string, n_lines string, cls int, token int"
LONG = "word%d other thing here now\n"


@pytest.fixture(scope="module")
def odd(spark):
    long = "".join(LONG % i for i in range(20_000))
    rows = [(1, "", "en", "a/x"), (2, "   \n\t ", "en", "a/x"), (None, "some words of a text that has no id at all here", "fr", None), (None, None, None, None), (5, None, "en", None), (6, long, "de", "b"), (7, "tie one two three four five six", "en", "b"), (7, "tie one two three four five six", "en", "b"), (8, "tie one two three four five six", None, "c"), (7, "another text under the same id as before it", "en", "b")]
    return spark.createDataFrame([(*r, 0, 1, "x", "y", ["z"], "k", "l", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (2, 0, 0), (5, 0, 1), (6, 1, 0), (7, 1, 0), (8, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "one two three"), (4, "one two three"), (5, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "decontaminate": lambda d: decontaminate.contamination(d, benchmark),
        "rules": quality_rules.cascade,
        "lines": line_dedup.dedup_lines,
        "language": langid.identify,
        "simhash": simhash.near_duplicates,
        "quality": lambda d: quality_model.score(d, labels),
        "secrets": secrets_scan.scan,
    }


@pytest.mark.parametrize("name", ["decontaminate", "rules", "lines", "language", "simhash", "quality", "secrets"])
def test_one_row_for_each_row(odd, labels, benchmark, name):
    f = operators(labels, benchmark)[name]
    got = f(odd).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert f(odd.where("false")).count() == 0
    narrow = odd.select("doc_id", "text", "lang", "source")
    assert f(narrow).count() == narrow.count()


def test_defined_results(odd, labels, benchmark, spark):
    hits = decontaminate.contamination(odd, benchmark).where("doc_id = 8").first()
    assert (hits.n_words, hits.n_hit, list(hits["items"])) == (7, 3, [1, 4])  # a null item id is no item
    assert {r.lang_pred for r in langid.identify(odd).where("doc_id in (1, 2, 5)").collect()} == {"und"}
    same = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(7, 7), (8, 7), (1, 1), (2, 1), (5, 1)} <= same
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(odd).where("doc_id in (5, 8)").collect()}
    assert kept[5].text is None and (kept[8].text, kept[8].n_removed) == ("", 1)
    assert quality_rules.cascade(odd).where("doc_id = 5").first().n_words == 0
    nothing = quality_model.score(odd, labels.where("false"))
    assert {r.score for r in nothing.collect()} == {0.5}
    assert langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_packing(odd):
    got = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in got) == odd.count()
    assert {r.length for r in got if r.doc_id in (1, 2, 5)} == {1}
    assert max(r.offset + r.length for r in got) <= 4096
    assert packing.pack(odd.where("false"), tokenizer_path()).count() == 0


def test_stages(spark, odd, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.where("false"), odd):
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns and out.count() <= d.count()
    assert corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).count() >= docs.count()
    rows = corpus_pipeline.near_duplicate_documents(spark, docs, str(tmp_path))
    assert rows.where("doc_id = 8").count() == 0 and rows.where("doc_id = 7").count() == 2  # two texts under one id


def test_clashing_names_pass_through(spark):
    """Columns named like any that the operators make inside come back as they were."""
    names = ["number", "id", "t1", "t2", "k_id", "k_t1", "k_t2", "d", "lines", "thash", "_key_0", "_key_1", "c", "keys", "row", "_gone", "_t"]
    docs = spark.createDataFrame([(i, "a line of six words here\nown " + f"x{i} y{i} z{i} u{i}", *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for f in (line_dedup.dedup_lines, lambda d: corpus_pipeline.near_duplicate_lines(spark, d, ""), lambda d: corpus_pipeline.near_duplicate_documents(spark, d, "")):
        got = f(docs).orderBy("doc_id").collect()
        assert [r.doc_id for r in got] == [0, 1, 2] and all(r[n] == k for r in got for k, n in enumerate(names))


def test_urls_and_chats(spark):
    pages = spark.createDataFrame([(1, "http://a.org/es/1", '<meta http-equiv="refresh" content="0; url=/fr/2">'), (2, "https://a.org/fr/2?", None), (3, "http://c.net/de/8", "<link href=http://d.io/1 rel=canonical>"), (4, "http://D.io/1", "<link href=http://e.com/en/5 rel=canonical>"), (5, None, "x"), (6, "nope", "<link rel=canonical href=/a>"), (None, "http://e.com/en/5", ""), (1, "http://a.org/es/1", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.withColumn("node", F.lit(1)).withColumn("u", F.lit(1))).collect()}
    assert got == {(1, "a.org", "/es/1", "org/es/", "block"), (2, "a.org", "/fr/2", None, "block"), (3, "c.net", "/de/8", "net/de/", "allow"), (4, "d.io", "/1", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (None, "e.com", "/en/5", "com/en/", "block")}
    assert url_filter.judge(pages).count() == 8 and url_filter.judge(pages.where("false")).count() == 0
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, None, None, "?"), (1, 1, "bob", None), (None, 0, "cat", "x"), (2, 0, None, "alone")], "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = chat.rotate(turns).collect()
    assert len(got) == 2 * 4 + 1
    bob = sorted((r.start, r.segment) for r in got if r.perspective == "bob")
    assert "".join(s for _, s in bob) == "<|user name=ann|>\nhi<|end|>\n" + "<|assistant|>\n<|end|>\n" * 2 + "<|user name=unknown|>\n?<|end|>\n"
    assert [a for a, _ in bob] == [sum(len(s) for _, s in bob[:i]) for i in range(4)]
    assert chat.rotate(turns.where("false")).count() == 0
    tied = spark.createDataFrame([(1, 0, None, "z"), (1, 0, "ann", None), (1, 0, "ann", "a")], "conv_id long, turn long, role string, text string")
    assert [(r.role, r.text_) for r in chat.rotate(tied).selectExpr("role", "segment as text_", "start").orderBy("start").collect()] == [("ann", "<|assistant|>\na<|end|>\n"), ("ann", "<|assistant|>\n<|end|>\n"), (None, "<|user name=unknown|>\nz<|end|>\n")]
