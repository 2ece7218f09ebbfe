"""Information-theoretic sanitisation of personal data and secrets.

Protected entities (addresses, telephone and card numbers, keys, passwords, ...) are
found by patterns, card and account numbers also by their check digits, and
always generalised to their kind. What else gives an entity away is estimated
from the corpus (after Sánchez and Batet, "C-sanitized", 2016): with N the number of different
texts, n(x) the number of those that hold x, and n(e, t) of those in which term t stands within
CONTEXT words of entity e,

    PMI(e; t) = log2(p(e | t) / p(e))    IC(e) = -log2(p(e))    p(e) = n(e) / N

and PMI / IC is the share of e's information that t discloses. One meeting of two rare
words proves little, so the estimate falls back on that of any term,

    p(e | t) = (n(e, t) + BACK_OFF p(e)) / (n(t) + BACK_OFF)

which is the more so the fewer texts hold t. In texts with e, terms that disclose REMOVE of it are taken
out and those that disclose GENERALISE are replaced by ``[TERM]``, wherever they stand. An entity in a
single document counts like any other: words that stand by it alone are what names its owner.

All counts cover all documents; copies of a text are one text, each row of m copies counting
1 / m. Terms that stand near entities are counted over
the whole corpus: with their hashes sent to the tasks where those are few
enough for a broadcast, else by a join. Context is a number of words and not the document, so that the
pairs of a text grow with its length and not with the square of it.

Defined for every input: a null text stays null; an empty one stays empty; texts
without an entity are returned unchanged, byte for byte; ids play no part, so rows with a null
id or with another's are sanitised like the rest; repeated rows are one text in
all counts and stay as often as they occur; an entity that every text holds has no information
to disclose; long texts are processed whole; an empty table
gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, textkit

CONTEXT = 10
BACK_OFF = 1.0
GENERALISE = 0.75
REMOVE = 0.9

#: A text without a match holds no entity; for the JVM, so that most texts never reach Python. Digits and letters of either
#: case are those of Python's patterns: all scripts', three of which (Tangsa, Kawi, Nag Mundari) the JVM may not know yet.
SUSPECT = (
    r"[\p{Nd}@\x{16AC0}-\x{16AC9}\x{11F50}-\x{11F59}\x{1E4F0}-\x{1E4F9}]|-----BEGIN|(?iu:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[ \t]*[\"']?[ \t]*[=:]"
    r"|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10}|sk-[A-Za-z0-9_-]{20}|eyJ)"
)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_KINDS = {
    "KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
    "SECRET": r"(?i:\b(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[ \t]*[\"']?[ \t]*[=:][ \t]*)(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
    "EMAIL": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "IP": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "ACCOUNT": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "CARD": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\d)",
    "PHONE": r"(?<![\w])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _KINDS.items()))
_VALUE = re.compile(r"[=:][ \t]*([\s\S]*)\Z")


def _luhn(digits: str) -> bool:
    d = [int(x) for x in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _mod97(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every protected entity, from left to right."""
    out, at = [], 0
    while m := _FIND.search(text, at):
        kind, start, end, s = m.lastgroup, m.start(), m.end(), m.group()
        at = end
        if kind == "CARD" and not _luhn(re.sub(r"\D", "", s)) or kind == "ACCOUNT" and not _mod97(s):
            at = start + 1 if kind == "ACCOUNT" else end
            continue
        if kind == "SECRET":
            v = _VALUE.search(s)
            start += v.start(1)
            s = v.group(1).strip("\"'")
        elif kind in ("CARD", "PHONE", "SSN"):
            s = re.sub(r"\D", "", s)
        out.append((start, end, kind, s.lower()))
    return out


def _name(kind: str, value: str) -> int:
    """An entity's number; the value itself never leaves the task."""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def _terms(text: str) -> tuple[textkit.Words, textkit.Words]:
    """The words of a text as it is and in lower case: the same number, in the same order."""
    a, b = pa.array([text]), textkit.column(pa.array([text]), lower=True)
    a = textkit.column(a)
    return textkit.words(*a, 0, 1), textkit.words(*b, 0, 1)


def _is_term(w: textkit.Words) -> np.ndarray:
    """At least three bytes long."""
    return w.end - w.start >= 3


def _char_starts(data: np.ndarray) -> np.ndarray:
    """The byte at which every character begins, and the end."""
    return np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]


def _contexts(context: int):
    """(mark, entity, term) of every text's entities and the terms near them, terms by their hashes.

    Of an entity without any the term is null; with a null entity come all terms of a text that has entities.
    """

    def run(batches):
        for b in textkit.sliced(batches):
            parts = []
            for mark, text in zip(b.column("mark").to_pylist(), b.column("text").to_pylist()):
                found = entities(text)
                if not found:
                    continue
                plain, folded = _terms(text)
                at = _char_starts(plain.data)
                lo = np.searchsorted(plain.end, at[[s for s, _, _, _ in found]], "right")
                hi = np.searchsorted(plain.start, at[[e for _, e, _, _ in found]])
                free = _is_term(folded)
                for x, z in zip(lo, hi):
                    free[x:z] = False
                names = [_name(kind, value) for _, _, kind, value in found]
                hashes = folded.hash.view(np.int64)
                parts.append((mark, None, np.unique(hashes[free])))
                for x, z, e in zip(lo, hi, names):
                    near = np.r_[max(0, x - context) : x, z : min(len(free), z + context)].astype(np.int64)
                    parts.append((mark, e, np.unique(hashes[near[free[near]]])))
            if not parts:
                continue
            count = np.array([max(1, len(t)) for _, _, t in parts])
            marks = np.repeat(np.array([m for m, _, _ in parts], np.int64), count)
            names = np.repeat(np.array([e or 0 for _, e, _ in parts], np.int64), count)
            terms = np.concatenate([t if len(t) else np.zeros(1, np.int64) for _, _, t in parts])
            columns = [pa.array(marks), pa.array(names, mask=np.repeat([e is None for _, e, _ in parts], count)), pa.array(terms, mask=np.repeat([not len(t) for _, _, t in parts], count))]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "entity", "term"])

    return run


def _count_terms(wanted):
    """(term, n): in how many of a batch's texts each term stands, by the texts' weights; all terms where ``wanted`` is None."""

    def run(batches):
        only = None if wanted is None else wanted.value
        for b in textkit.sliced(batches):
            data, off = textkit.column(b.column("text"), lower=True)
            weight = b.column("weight").to_numpy()
            for lo, hi in textkit.chunks(off):
                w = textkit.words(data, off, lo, hi)
                h, row = w.hash.view(np.int64), w.row
                if only is not None:
                    at = np.searchsorted(only, h)
                    at[at == len(only)] = 0
                    hit = only[at] == h
                    h, row = h[hit], row[hit]
                if not len(h):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                h, row = h[new], row[new]
                first, _ = textkit.runs(h)
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(np.add.reduceat(weight[row], first))], ["term", "n"])

    return run


def _marked(docs: DataFrame, mark: str) -> DataFrame:
    return docs.withColumn(mark, F.xxhash64("text"))


def disclosing(spark: SparkSession, docs: DataFrame, context: int = CONTEXT, back_off: float = BACK_OFF, generalise: float = GENERALISE, remove: float = REMOVE, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(every text that has entities (mark), its disclosing terms (mark, entity, term, share, remove)) of ``docs(text)``.

    ``mark`` is xxhash64 of the text. All tables lie below ``base``.
    """
    base = base or runtime.shared_dir(spark)
    texts = _marked(docs.select("text").filter("text IS NOT NULL"), "mark")
    seen = texts.filter(F.col("text").rlike(SUSPECT)).mapInArrow(_contexts(context), "mark long, entity long, term long")
    seen = runtime.stored(seen, f"{base}/contexts")
    occurrences = runtime.stored(seen.filter("entity IS NOT NULL").select("mark", "entity").distinct(), f"{base}/occurrences")
    near = seen.filter("entity IS NOT NULL AND term IS NOT NULL").distinct()
    pairs = runtime.stored(near.groupBy("entity", "term").agg(F.count("*").alias("net")), f"{base}/pairs")
    of_entity = occurrences.groupBy("entity").agg(F.count("*").alias("ne"))

    terms = pairs.select("term").distinct()
    many = terms.count()
    copies = runtime.stored(texts.groupBy("mark").count(), f"{base}/copies")
    total = copies.count()
    copies = copies.filter("count > 1")
    weighed = texts.join(runtime.sized(copies, copies.count(), 32), "mark", "left").select("text", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("weight"))
    if not many:
        counted = spark.createDataFrame([], "term long, n double")
    elif many * 8 <= runtime.BROADCAST_BYTES:
        wanted = spark.sparkContext.broadcast(np.sort(terms.toArrow()["term"].to_numpy()))
        counted = weighed.mapInArrow(_count_terms(wanted), "term long, n double")
    else:
        counted = weighed.mapInArrow(_count_terms(None), "term long, n double").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")
    counted = counted.groupBy("term").agg(F.round(F.sum("n")).alias("nt"))
    known = pairs.join(counted, "term").join(of_entity, "entity")
    p = F.col("ne") / F.lit(float(max(1, total)))
    given = (F.col("net") + back_off * p) / (F.col("nt") + back_off)
    share = F.round(F.try_divide(F.log2(given / p), -F.log2(p)), 9)
    known = known.select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise)
    known = runtime.stored(known.select("*", (F.col("share") >= remove).alias("remove")), f"{base}/terms")
    # only terms that a text holds are joined with its entities, so that a frequent entity's terms don't go to all its texts
    present = seen.filter("entity IS NULL AND term IS NOT NULL").select("mark", "term").distinct()
    of_text = runtime.stored(present.join(runtime.sized(known, known.count(), 48), "term").join(occurrences, ["mark", "entity"], "left_semi"), f"{base}/of_text")
    marks = runtime.stored(occurrences.select("mark").distinct(), f"{base}/marks")
    for name in ("contexts", "occurrences", "pairs", "copies", "terms"):
        runtime.forget(spark, f"{base}/{name}")
    return marks, of_text


def sanitise_text(text: str, gone: np.ndarray | None = None, general: np.ndarray | None = None) -> tuple[str, int, int]:
    """(sanitised text, entities, terms); terms are given by their hashes."""
    found = entities(text)
    if not found:
        return text, 0, 0
    cuts = [(s, e, f"[{kind}]") for s, e, kind, _ in found]
    out = np.zeros(0, np.int64) if gone is None else np.asarray(gone, np.int64)
    masked = np.zeros(0, np.int64) if general is None else np.asarray(general, np.int64)
    terms = 0
    if len(out) or len(masked):
        plain, folded = _terms(text)
        hashes = folded.hash.view(np.int64)
        removed = np.isin(hashes, out)
        at = np.flatnonzero((removed | np.isin(hashes, masked)) & _is_term(folded))
        chars = _char_starts(plain.data)
        s, e = np.searchsorted(chars, plain.start[at]), np.searchsorted(chars, plain.end[at])
        # entities come in order and don't overlap: the first that ends after a word's start is the one it can touch
        starts, ends = (np.array([f[k] for f in found]) for k in (0, 1))
        next_ = np.searchsorted(ends, s, "right")
        clear = (next_ == len(ends)) | (starts[np.minimum(next_, len(ends) - 1)] >= e)
        cuts += [(int(a), int(z), "" if gone_ else "[TERM]") for a, z, gone_ in zip(s[clear], e[clear], removed[at[clear]])]
        terms = int(clear.sum())
        cuts.sort()
    parts, last = [], 0
    for s, e, new in cuts:
        parts += [text[last:s], new]
        last = e
    return "".join(parts) + text[last:], len(found), terms


def _rewrite(gone: str, general: str, keep: list[str]):
    def run(batches):
        for b in textkit.sliced(batches):
            known = zip(b.column("text").to_pylist(), b.column(gone), b.column(general))
            done = [sanitise_text(t, *(None if not k.is_valid else k.values.to_numpy() for k in terms)) for t, *terms in known]
            texts, n, m = zip(*done)
            columns = [b.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])

    return run


def sanitise(spark: SparkSession, docs: DataFrame, entities: str = "_entities", removed: str = "_removed", **how) -> DataFrame:
    """``docs`` with sanitised texts, and two more columns, whose names must be free: how many entities and terms were replaced."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    base = runtime.shared_dir(spark)
    marks, of_text = disclosing(spark, docs, base=base, **how)
    mark, own, gone, general = (runtime.fresh(docs, name) for name in ("_mark", "_own", "_gone", "_general"))
    plan = of_text.select("mark", "term", "remove").union(marks.select("mark", F.lit(None).cast("long"), F.lit(None).cast("boolean"))).groupBy(F.col("mark").alias(mark))
    plan = plan.agg(*(F.collect_set(F.when(F.col("remove") == r, F.col("term"))).alias(c) for c, r in ((gone, True), (general, False))))
    plan = runtime.handed_over(plan, base)
    size = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(gone) + F.size(general)), F.lit(0)).alias("m")).first()
    bytes_ = 96 * size["n"] + 16 * size["m"]
    keep = [f for f in docs.schema if f.name != "text"]
    zeros = [F.lit(0).cast("long").alias(c) for c in (entities, removed)]
    mine = docs
    if bytes_ > runtime.BROADCAST_BYTES:
        # the plan can't go to all tasks: only texts that may hold an entity move
        suspect = F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))
        mine = docs.filter(suspect)
    # the plan holds every text with an entity: the others go on as they are and never reach Python
    mine = _marked(mine, own).join(runtime.sized(plan, bytes_, 1), F.col(own) == F.col(mark), "left")
    types = [f.dataType.simpleString() for f in keep] + ["string", "long", "long"]
    done = mine.filter(F.col(mark).isNotNull()).mapInArrow(_rewrite(gone, general, [f.name for f in keep]), ", ".join(f"c{k} {t}" for k, t in enumerate(types)))
    done = done.toDF(*(f.name for f in keep), "text", entities, removed)
    clean = mine.filter(F.col(mark).isNull()).select(*docs.columns, *zeros)
    if bytes_ > runtime.BROADCAST_BYTES:
        clean = clean.union(docs.filter(~suspect).select(*docs.columns, *zeros))
    return clean.unionByName(done.select(clean.columns))
