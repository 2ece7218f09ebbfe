import base64
import random
from pathlib import Path

import pytest
import tiktoken

from wordtide.llm import bpe

from .helpers import clashing, frame

FOLDER = Path("/opt/tokenizers")


def reference(path, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_merging(spark, name):
    path = str(FOLDER / name)
    known, encoder = reference(path, bpe.PATTERN), bpe.Encoder(bpe.load(path))
    r = random.Random(0)
    for k in range(3000):
        text = "".join(chr(r.choice((r.randrange(32, 127), r.randrange(97, 123), r.randrange(0x400, 0x460), r.randrange(0x4E00, 0x4F00), 10, 32))) for _ in range(r.randint(0, 40)))
        import numpy as np

        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == known.encode_ordinary(text)
        piece = bytes(r.choice(b"abetionsr") for _ in range(r.randint(1, 60)))
        assert encoder.encode_piece(piece) == known._encode_single_piece(piece)


def test_documents_round_trip(spark):
    known = reference(bpe.TOKENIZER, bpe.PATTERN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = bpe.encode(spark, docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = coded.collect()
    assert all(r["exact"] and r["ids"] == known.encode_ordinary(texts[r["doc_id"]]) and r["tokens"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(spark, coded).collect()} == texts


def test_edges(spark):
    long = "the end " * 50_000 + "z" * 20_000
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "a\u0000\U0001f600"), (4, "a\u0000\U0001f600"), (None, "x"), (5, long)]
    got = bpe.encode(spark, clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["ids"] is None and by[1]["exact"] is None and by[2]["ids"] == [] and all(r["exact"] for r in got if r["doc_id"] != 1)
    assert bpe.encode(spark, frame(spark, [])).count() == 0
