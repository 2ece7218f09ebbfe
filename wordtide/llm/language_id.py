"""Language identification by Bayesian evidence fusion.

The posterior of a document's language multiplies

* the likelihood of its text under a byte-trigram model of each language,
  tempered to at most EVIDENCE trigrams, since neighbouring trigrams are not
  independent;
* the probability of the language that its markup declares, given the true one,
  estimated from all rows by a grouped aggregation;
* a prior of its host, smoothed towards the prior of its address suffix, which
  is smoothed towards that of the whole corpus; all three are grouped
  aggregations of the text posteriors, without the row's own share.

A further hypothesis, no known language, spreads evenly over the trigrams and
has the prior UNKNOWN. A row is rejected (``und``) if that hypothesis wins, if
no language reaches CONFIDENCE, or if its text has no letter.

The text models are fitted on a sample of the labelled documents, SAMPLE for each
language in expectation, drawn by a hash of the id. Everything else (confusion
of declared languages, priors, decisions) covers all rows.

Defined for every input: a null, empty or letterless text is rejected; without
any labelled document all are rejected; a null declared language, host or
suffix adds no evidence of its own (the prior is that of the level above);
long texts are scored whole; repeated rows are repeated in the result; an
empty table gives no rows; other columns are ignored. Of languages with the
same posterior the first in alphabetical order wins.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, textkit

SAMPLE = 3000
CELLS = 1 << 16
SMOOTHING = 0.1
EVIDENCE = 100
#: Weight, in rows, of the level above in a smoothed prior.
PULL = 10.0
UNKNOWN = 1e-3
CONFIDENCE = 0.5

#: Letters (and all bytes beyond ASCII) as they are, the rest as a space.
_FOLD = np.full(256, 32, np.uint32)
for _b in [*range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b


def _cells(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of the trigrams of rows lo..hi that hold a letter and no double space."""
    base = off[lo]
    x = _FOLD[data[base : off[hi]]]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    row = np.repeat(np.arange(lo, hi), np.diff(off[lo : hi + 1]))
    use = (row[:-2] == row[2:]) & (b != 32) | (row[:-2] == row[2:]) & (a != 32) & (c != 32)
    cell = ((a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)
    return cell[use], row[:-2][use]


def _counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS, np.int64)
    data, off = textkit.column(pa.array(pdf["text"], pa.string()), lower=True)
    for lo, hi in textkit.chunks(off):
        total += np.bincount(_cells(data, off, lo, hi)[0], minlength=CELLS)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [total.tobytes()]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, cell]) from a sample of ``labelled(doc_id, lang, text)``."""
    known = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, CELLS), np.float32)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    share = functools.reduce(lambda c, kv: c.when(F.col("lang") == kv[0], F.lit(sample / kv[1])), sizes.items(), F.when(F.lit(False), F.lit(0.0)))
    got = known.filter(draw < share).select("lang", "text").groupBy("lang").applyInPandas(_counts, "lang string, counts binary").collect()
    rows = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in got if len(r["counts"]))
    counts = np.array([c for _, c in rows], np.float64).reshape(-1, CELLS) + SMOOTHING
    return [lang for lang, _ in rows], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """A list column as rows of k numbers; null is a row of zeros."""
    out = np.zeros((len(column), k))
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(some):
        out[some] = np.asarray(column.drop_null().flatten()).reshape(-1, k)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _score(model: np.ndarray):
    """grams, the tempered log likelihoods of the text, and the posterior of the text alone."""
    languages = len(model)

    def run(batches):
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            n = b.num_rows
            grams, sums = np.zeros(n, np.int64), np.zeros((n, languages))
            for lo, hi in textkit.chunks(off, textkit.FINE_BYTES):
                cell, row = _cells(data, off, lo, hi)
                if not len(cell):
                    continue
                first, count = textkit.runs(row)
                at = row[first]
                grams[at] = count
                for k in range(languages):
                    sums[at, k] = np.add.reduceat(model[k][cell], first, dtype=np.float64)
            sums *= np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
            keep = [name for name in b.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(grams), _lists(sums), _lists(_softmax(sums))], [*keep, "grams", "loglik", "alone"])

    return run


def _fuse(languages: list[str], overall: np.ndarray, declared_totals: np.ndarray, declared_kinds: int, keep: list[str]):
    k = len(languages)
    names = np.array(languages, object)

    def run(batches):
        for b in batches:
            grams = b.column("grams").to_numpy()
            text, alone = _matrix(b.column("loglik"), k), _matrix(b.column("alone"), k)
            alone[grams == 0] = 0

            def level(key: str, above: np.ndarray) -> np.ndarray:
                """The prior of a row's key without the row, smoothed towards the level above."""
                known = b.column(key).is_valid().to_numpy(zero_copy_only=False)
                sums = _matrix(b.column(f"{key}_sums"), k)
                own = alone * known[:, None]
                left = np.maximum(sums - own, 0)
                return (left + PULL * above) / (left.sum(1, keepdims=True) + PULL)

            prior = level("host", level("suffix", np.tile(overall, (len(grams), 1))))
            known = b.column("declared").is_valid().to_numpy(zero_copy_only=False)
            own = alone * known[:, None]
            says = np.log((np.maximum(_matrix(b.column("declared_sums"), k) - own, 0) + 1) / (np.maximum(declared_totals - own, 0) + 1 + declared_kinds))
            scores = text + np.log(prior) + says * known[:, None]
            unknown = np.minimum(grams, EVIDENCE) * -math.log(CELLS) + math.log(UNKNOWN)
            fused = _softmax(np.c_[scores, unknown])[:, :k] if len(grams) else np.zeros((0, k))
            best = fused.argmax(1) if len(grams) else np.zeros(0, np.int64)
            top = fused[np.arange(len(best)), best]
            accepted = (grams > 0) & (top >= CONFIDENCE)
            lang = np.where(accepted, names[best], "und") if len(best) else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(grams), pa.array(lang, pa.string()), pa.array(np.round(top, 4), pa.float64()), pa.array(accepted, pa.bool_())], [*keep, "grams", "lang", "confidence", "accepted"])

    return run


def identify(spark: SparkSession, rows: DataFrame, labelled: DataFrame, sample: int = SAMPLE, base: str | None = None) -> DataFrame:
    """Languages of ``rows(…, text, declared, suffix, host)``.

    Gives the columns of ``rows`` but the text, and grams, lang, confidence, accepted.
    """
    languages, model = fit(labelled, sample)
    keep = [c for c in rows.columns if c != "text"]
    if not languages:
        return rows.select(*keep, F.lit(0).cast("long").alias("grams"), F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    base = base or runtime.shared_dir(spark)
    scored = runtime.stored(rows.mapInArrow(_score(model), f"{schema}, grams long, loglik array<double>, alone array<double>"), f"{base}/scored")

    k = len(languages)
    seen = scored.filter("grams > 0")
    sums = F.array(*(F.sum(F.element_at("alone", i + 1)) for i in range(k)))
    total = seen.agg(F.count("*").alias("n"), sums.alias("s")).first()
    overall = (np.array([x or 0.0 for x in total["s"]]) + 1) / (total["n"] + k)
    out = scored
    for key in ("suffix", "host", "declared"):
        side = runtime.stored(seen.filter(F.col(key).isNotNull()).groupBy(key).agg(sums.alias(f"{key}_sums")), f"{base}/{key}")
        out = out.join(runtime.sized(side, side.count(), 64 + 8 * k), key, "left")
        if key == "declared":
            d = side.agg(F.count("*").alias("n"), F.array(*(F.sum(F.element_at("declared_sums", i + 1)) for i in range(k))).alias("s")).first()
    fuse = _fuse(languages, overall, np.array([x or 0.0 for x in d["s"]]), d["n"], keep)
    return out.mapInArrow(fuse, f"{schema}, grams long, lang string, confidence double, accepted boolean")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the text, and the source as host; they have no markup and no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages as evidence: visible text, declared language of the markup, address suffix and host."""
    html, url = F.col("html").cast("string"), F.lower(F.col("url").cast("string"))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]{1,10};", " ")
    some = lambda c: F.when(c != "", c)
    host = some(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = some(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"), declared.alias("declared"), some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"), host.alias("host"))


def accept(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` without those whose language is rejected or whose id is null; all columns stay."""
    base = runtime.shared_dir(spark)
    found = identify(spark, document_rows(docs), docs, base=base, **how).filter("NOT accepted AND doc_id IS NOT NULL").select("doc_id").distinct()
    found = runtime.handed_over(found, base)
    return runtime.without_ids(docs.filter("doc_id IS NOT NULL"), runtime.sized(found, found.count()))
