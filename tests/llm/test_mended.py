"""Languages that a sample must not lose, and links as browsers resolve them."""

import pytest
from oracle import connection, differences

from wanescope.llm import langid, queries, url_filter

LINKS = {
    "../x": "/d/x", "./y": "/d/e/y", "?v=2": "/d/e/p.html?v=2", "#f": None, "/z": "/z", "//other.net/q": None, "mailto:a@b": None, "javascript:void(0)": None, "a/../b/./c": "/d/e/b/c", "../../../../top": "/top", "..": "/d/", ".": "/d/e/", "g/..": "/d/e/",
}


def pages():
    """A page for each link, and a page at the address that it leads to."""
    rows = []
    for i, (link, path) in enumerate(LINKS.items()):
        host = f"h{i}.org"
        rows.append((2 * i, f"http://{host}/d/e/p.html", f'<link rel="canonical" href="{link}">'))
        if path:
            rows.append((2 * i + 1, f"http://{host}{path}", ""))
    return rows


def test_relative_links_make_aliases(spark):
    rules = [url_filter.Rule("block", f"h{i}.org", p.split("?")[0]) for i, p in enumerate(LINKS.values()) if p and not p.startswith(("/d/e/p.html", "/d/e/"))]
    rules = [r for r in rules if r.path != "/d/"]
    blocked = {int(r.host[1:].split(".")[0]) for r in rules}
    got = {r.page_id: (r.verdict, r.via) for r in url_filter.judge(spark.createDataFrame(pages(), "page_id long, url string, html string"), rules).collect()}
    for i in range(len(LINKS)):
        assert got[2 * i] == (("block", "alias") if i in blocked else ("allow", "default"))


def test_relative_links_as_in_sql(spark, tmp_path):
    rows = [(i, u.replace("h", "en.com/en/../../h", 1) if i % 3 == 0 else u.replace(".org/d", ".com/en"), h) for i, u, h in pages()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = connection(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert differences(queries.op9_url_filter(spark, str(tmp_path)), con, queries.ORACLES["op9_url_filter"]) == []


@pytest.mark.parametrize("path, want", [("/a/b/../c", "/a/c"), ("/./a", "/a"), ("/../a", "/a"), ("/a/..", "/"), ("/a/.", "/a/"), ("/a.b/c", "/a.b/c"), ("/...", "/..."), ("", "")])
def test_dot_segments(spark, path, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(url_filter.undotted(F.lit(path)).alias("p")).first().p == want


def test_rare_languages_are_learned(spark):
    """Twenty rows of one language beside two thousand of another, and rows that share one id."""
    rows = [(i, f"the common words of rows like number {i} are these and the others", "en") for i in range(2000)]
    rows += [(5000 + i, f"les mots rares des lignes comme celle {i} sont ici et ailleurs", "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs, fit_rows=20)).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 2000, "fr": 20}
    same = spark.createDataFrame([(3, "ein Satz der ein Satz ist und ein Satz bleibt", "de")] * 40, "doc_id long, text string, lang string")
    if same.select(~langid.held_out(same["doc_id"])).first()[0]:
        assert {r.lang_pred for r in langid.identify(same, langid.fit(same, fit_rows=4)).collect()} == {"de"}


def test_equal_scores_go_to_the_first_name(spark):
    rows = [(i, "same words here same words here same words here", lang) for i, lang in enumerate(["b", "a"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got == {("a", 0.5)}


def test_chat_turns_of_one_number(spark, monkeypatch):
    """Most turns have no number or one number, texts share long beginnings, rows repeat; blocks are smaller than all of these."""
    from wanescope.llm import chat

    monkeypatch.setattr(chat, "BLOCK", 7)
    monkeypatch.setattr(chat, "PREFIX", 3)
    rows = [(c, t, r, "same start " * 40 + str(i % 9)) for i in range(60) for c, t, r in ((1, None, "ann"), (1, 5, ("ann", "bob", None)[i % 3]), (None, i, "cat"))]
    rows += [(2, 1, "ann", "x" * 200_000), (2, 1, "bob", None), (3, 1, None, "nobody")]
    got = {}
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)
    for r in chat.rotate(turns).collect():
        got.setdefault((r.conv_id, r.perspective), []).append((r.start, r.end, r.segment, r.turn, r.role, r.trained))
    high = lambda v: (v is None, v if v is not None else 0)
    word = lambda v: (v is None, v or "")
    want = {}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (high(r[1]), word(r[2]), word(r[3])))
        for who in {r[2] for r in own} - {None}:
            at, out = 0, []
            for _, turn, role, text in own:
                head = "<|assistant|>\n" if role == who else f"<|user name={role or 'unknown'}|>\n"
                segment = f"{head}{text or ''}<|end|>\n"
                out.append((at, at + len(segment), segment, turn, role, role == who))
                at += len(segment)
            want[conv, who] = out
    assert {k: sorted(v) for k, v in got.items()} == want
