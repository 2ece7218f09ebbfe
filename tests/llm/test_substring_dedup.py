import random
import re

import pytest

from wordtide.llm import substring_dedup as S

SCHEMA = "doc_id long, text string"


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(5))


def texts(r, n, vocabulary=4000):
    return [" ".join(r.choice(VOCABULARY) for _ in range(r.randint(1, 160))) for _ in range(n)]


VOCABULARY = [f"w{i}" for i in range(4000)]


def brute(docs, words):
    """Word positions (doc, i) of every window of ``words`` words that has an earlier place."""
    first, covered = {}, set()
    for d, t in sorted(docs):
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+", t or "")]
        for i in range(len(w) - words + 1):
            key = tuple(w[i : i + words])
            if key in first:
                covered |= {(d, k) for k in range(i, i + words)}
            else:
                first[key] = (d, i)
    return covered


def spread(rows):
    return {(r["doc_id"], k) for r in rows for k in range(r["start"], r["start"] + r["words"])}


@pytest.mark.parametrize("batches", [1, 4])
def test_matches_brute_force(spark, batches):
    r = random.Random(batches)
    base = texts(r, 60)
    passages = [" ".join(r.choice(VOCABULARY) for _ in range(n)) for n in (49, 50, 51, 60, 75, 120)]
    docs = []
    for i, t in enumerate(base):
        if r.random() < 0.6:
            t = f"{t}, {r.choice(passages)}. {r.choice(base)}"
        docs.append((i, t))
    docs += [(100 + i, docs[3][1]) for i in range(30)] + [(200, passages[3] + " x " + passages[3]), (201, passages[4].upper())]
    got = S.repeats(spark, spark.createDataFrame(docs, SCHEMA), batches=batches).collect()
    assert spread(got) == brute(docs, 50)
    by = dict(docs)
    for g in got:
        w, v = (re.findall(r"[a-z0-9]+", by[k].lower()) for k in (g["doc_id"], g["src_id"]))
        assert w[g["start"] : g["start"] + g["words"]] == v[g["src_start"] : g["src_start"] + g["words"]]
        assert (g["src_id"], g["src_start"]) < (g["doc_id"], g["start"])
        assert re.findall(r"[a-z0-9]+", by[g["doc_id"]][g["char_start"] : g["char_end"]].lower()) == w[g["start"] : g["start"] + g["words"]]


@pytest.mark.parametrize("batches", [1, 4])
def test_hot_phrase_hides_no_repeat(spark, batches):
    """A phrase of 49 words that most documents hold, before, between and after those that repeat more around it."""
    r = random.Random(7)
    fill = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    docs = []
    for n in (30, 40, 49):
        phrase, around = fill(n), [(fill(15), fill(15)) for _ in range(4)]
        for _ in range(40):
            left, right = r.choice(around) if r.random() < 0.4 else (fill(15), fill(15))
            docs.append((len(docs), f"{fill(20)} {left} {phrase} {right} {fill(20)}"))
    got = S.repeats(spark, spark.createDataFrame(docs, SCHEMA), batches=batches).collect()
    assert spread(got) == brute(docs, 50)
    assert len(got) == len({(g["doc_id"], g["start"], g["src_id"], g["src_start"]) for g in got})


def test_phrase_in_every_document(spark, monkeypatch):
    """A hot hash in ranges of ids, a crowded text in parts; the phrase alone is too short to be reported."""
    monkeypatch.setattr(S.verify, "__defaults__", (S.WORDS, S.GRAM, 7, None))
    r = random.Random(9)
    fill = lambda n: " ".join(r.choice(VOCABULARY) for _ in range(n))
    phrase, tails = fill(40), [fill(20) for _ in range(3)]
    docs = [(i, f"{fill(12)} {phrase} {r.choice(tails) if i % 4 == 0 else fill(20)}") for i in range(240)]
    got = S.repeats(spark, spark.createDataFrame(docs, SCHEMA), batches=2, hot=50).collect()
    assert spread(got) == brute(docs, 50) != set()
    alone = [(i, f"{fill(12)} {phrase} {fill(12)}") for i in range(120)]
    assert S.repeats(spark, spark.createDataFrame(alone, SCHEMA), batches=1, hot=50).count() == 0


def test_index_is_opened_again(spark, tmp_path):
    """Batches one by one, each by an index that is opened anew, against all at once."""
    r = random.Random(3)
    passages = [" ".join(r.choice(VOCABULARY) for _ in range(n)) for n in (50, 64, 90)]
    docs = [(i, f"{t} {r.choice(passages) if r.random() < 0.5 else ''} {i}") for i, t in enumerate(texts(r, 60))]
    part = lambda a, z: spark.createDataFrame(docs[a:z], SCHEMA)
    path = f"file://{tmp_path}/index"
    got = S.repeats(spark, part(0, 20), batches=2, path=path).collect()
    for a, z in ((20, 21), (21, 45), (45, 60)):
        index = S.Index(spark, path)
        assert index.batches == 2 + [20, 21, 45].index(a)
        got += S.extend(spark, index, part(a, z), part(0, a)).collect()
        index.close()
    assert spread(got) == brute(docs, 50)
    assert all((g["src_id"], g["src_start"]) < (g["doc_id"], g["start"]) for g in got)


def test_characters_beyond_ascii(spark):
    passage = " ".join(f"é{i}ß" for i in range(60))
    docs = [(1, passage), (2, "ÄÖ ü. " + passage + " ñ")]
    (g,) = S.repeats(spark, spark.createDataFrame(docs, SCHEMA)).collect()
    assert docs[1][1][g["char_start"] : g["char_end"]] == passage and g["words"] == 60


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(VOCABULARY[i % 4000] + str(i // 4000) for i in range(40_000))
    rows = [(1, passage, 1), (1, passage, 1), (None, passage, 2), (2, None, 3), (3, "", 4), (4, "short", 5), (5, long, 6), (6, long + " " + passage, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shift int").withColumnRenamed("shift", "pos").selectExpr("*", "pos AS src_id", "pos AS wanted", "pos AS h", "pos AS batch")
    got = {(g["doc_id"], g["start"], g["words"]) for g in S.repeats(spark, df).collect()}
    assert got == {(6, 0, 40_000), (6, 40_000, 70)}
    none = spark.createDataFrame([], SCHEMA)
    assert S.repeats(spark, none).count() == 0
