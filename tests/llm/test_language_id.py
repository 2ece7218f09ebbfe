import random

import duckdb

from wordtide.llm import language_id

from .helpers import clashing, frame, languages

DATA = "/root/testdata/sf0.01"
LETTERS = {"xx": "quick brown fox jumps over the lazy dog while rain falls", "yy": "schnelle braune füchse springen über faule hunde im regen"}


def test_matches_the_plain_version(spark):
    rows = duckdb.sql(f"SELECT text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
    rows += [("", "en", "src1"), (None, "de", "src1"), ("12345 !!", "en", None), ("zzz", None, "src2"), ("漢字 漢", "en", "src3")]
    docs = frame(spark, [(i, *r) for i, r in enumerate(rows)])
    got = {r["doc_id"]: r["lang"] for r in language_id.identify(spark, language_id.document_rows(docs), docs).collect()}
    assert got == languages(rows)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    found = language_id.identify(spark, language_id.document_rows(test), train).join(test.selectExpr("doc_id", "lang AS truth"), "doc_id").collect()
    right = sum(r["lang"] == r["truth"] for r in found)
    assert right >= 0.97 * len(found)
    assert sum(not r["accepted"] for r in found) <= 0.02 * len(found)


def test_pages_carry_evidence(spark):
    docs = frame(spark, [(i, LETTERS[k] + f" {i}", k, "s") for i, k in enumerate(("xx", "yy") * 10)])
    html = [(1, "https://a.b.yy/x", '<html lang="yy"><script>quick brown</script><p>schnelle &amp; braune hunde</p>'), (2, None, None), (3, "nonsense", "<b>quick brown fox</b>"), (4, "http://u@host.xx:80/", "")]
    rows = language_id.page_rows(spark.createDataFrame(html, "page_id long, url string, html string"))
    parts = {r["page_id"]: (r["declared"], r["suffix"], r["host"]) for r in rows.collect()}
    assert parts == {1: ("yy", "yy", "a.b.yy"), 2: (None, None, None), 3: (None, None, None), 4: (None, "xx", "host.xx")}
    got = {r["page_id"]: r["lang"] for r in language_id.identify(spark, rows, docs).collect()}
    assert got == {1: "yy", 2: "und", 3: "xx", 4: "und"}


def test_edges(spark):
    rows = [(i, LETTERS[k] + f" {i}", k, "s") for i, k in enumerate(("xx", "yy") * 10)]
    rows += [(100, None, "xx", None), (101, "", "xx", "s"), (102, LETTERS["xx"] * 5000, None, None), (103, LETTERS["yy"], "yy", "s"), (103, LETTERS["yy"], "yy", "s"), (None, LETTERS["xx"], "xx", "s")]
    df = clashing(frame(spark, rows))
    kept = language_id.accept(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(20), 102, 103, 103]
    assert language_id.accept(spark, frame(spark, [])).count() == 0
    unlabelled = frame(spark, [(1, "some text", None, "s")])
    assert language_id.accept(spark, unlabelled).count() == 0


def test_declared_language_and_suffix_match_plain_loops(spark):
    """All kinds of evidence at once, on texts that are short enough for it to matter."""
    r = random.Random(6)
    words = {"de": "der die und nicht ist ein mit für auf".split(), "en": "the and not is one with for on of".split(), "fr": "le la et est un avec pour sur des".split()}
    rows = []
    for i in range(240):
        lang = r.choice(sorted(words))
        text = " ".join(r.choice(words[lang if r.random() < 0.7 else r.choice(sorted(words))]) for _ in range(r.choice((1, 2, 3, 30))))
        other = r.choice(sorted(words))
        host = r.choice((None, f"{lang if r.random() < 0.8 else other}{r.randrange(3)}.example"))
        rows.append((text if i % 40 else None, lang if r.random() < 0.6 else None, host, r.choice((None, lang, "com")), r.choice((None, lang, lang, other))))
    want = languages(rows)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string, host string, suffix string, declared string")
    got = {x["doc_id"]: x["lang"] for x in language_id.identify(spark, df.drop("lang"), df, sample=10**9).collect()}
    assert got == want and len(set(want.values())) == 4
    assert want != languages([x[:3] for x in rows])


def test_ties_go_to_the_first_language(spark):
    text = "the same words in both of them and many of them " * 20
    df = spark.createDataFrame([(i, text, lang) for i, lang in enumerate(("zz", "aa", "zz", "aa"))], "doc_id long, text string, lang string")
    rows = df.selectExpr("doc_id", "text", "cast(null AS string) AS declared", "cast(null AS string) AS suffix", "cast(null AS string) AS host")
    assert {x["lang"] for x in language_id.identify(spark, rows, df, sample=10**9).collect()} == {"aa"}
