"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions import lexicons

STREAM = """stream AS (
    SELECT d.doc_id AS seq, date_trunc('second', e.ts) AS ts, l.toxic AS label, d.text
    FROM documents d JOIN labels l USING (doc_id) JOIN events e ON e.event_id = d.doc_id)"""
TOKENS = STREAM + """, tokens AS (
    SELECT seq, ts, label, word, CAST(count(*) AS DOUBLE) AS x
    FROM (SELECT seq, ts, label, unnest(string_split(lower(rtrim(text, ' ')), ' ')) AS word FROM stream)
    WHERE word <> '' GROUP BY ALL)"""
DOCS = TOKENS + """, docs AS (
    SELECT s.seq, s.ts, s.label, coalesce(sum(t.x), 0.0) AS n, count(t.word) AS v, row_number() OVER (ORDER BY s.seq) AS pos
    FROM stream s LEFT JOIN tokens t USING (seq) GROUP BY s.seq, s.ts, s.label)"""

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def _of(c: int, x: str) -> str:
    return f"CASE WHEN label = {c} THEN {x} ELSE 0.0 END"


def _state() -> str:
    """Prior sums of documents and words, with the positions of the last ones of each class."""
    d = ", ".join(f"coalesce(sum({_of(c, '1.0')}) OVER w, 0.0) AS n{c}, coalesce(sum({_of(c, 'n')}) OVER w, 0.0) AS t{c}, max(CASE WHEN label = {c} THEN pos END) OVER w AS last{c}" for c in (0, 1))
    w = ", ".join(f"coalesce(sum({_of(c, 'x')}) OVER w, 0.0) AS c{c}, max(CASE WHEN label = {c} THEN pos END) OVER w AS last{c}" for c in (0, 1))
    return DOCS + f""", state AS (
        SELECT *, (SELECT CAST(arg_min(v, seq) AS DOUBLE) FROM docs) AS v1, {d} FROM docs WINDOW w AS (ORDER BY seq {PRIOR})),
    words AS (SELECT *, {w} FROM (SELECT t.*, d.pos FROM tokens t JOIN docs d USING (seq)) WINDOW w AS (PARTITION BY word ORDER BY seq {PRIOR}))"""


def _votes(scored: str, name: str = "votes") -> str:
    """CTE ``name`` from a query that gives seq, label, s0, s1, first."""
    e = "(exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1)))"
    return f"""{name} AS (SELECT seq, label, p0, p1, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS pred FROM (
        SELECT seq, label, CASE WHEN first THEN 0.0 ELSE exp(s0 - greatest(s0, s1)) / {e} END AS p0, CASE WHEN first THEN 0.0 ELSE exp(s1 - greatest(s0, s1)) / {e} END AS p1
        FROM ({scored})))"""


def _score(base: list[str], word: list[str], first: str, words: str = "words", docs: str = "state") -> str:
    sums = ", ".join(f"sum(x * {w}) AS w{c}" for c, w in enumerate(word))
    return f"""SELECT d.seq, d.label, {base[0]} + coalesce(w0, 0.0) AS s0, {base[1]} + coalesce(w1, 0.0) AS s1, {first} AS first
        FROM {docs} d LEFT JOIN (SELECT seq, {sums} FROM {words} GROUP BY seq) USING (seq)"""


def _vanilla_base(n: str = "n", t: str = "t") -> list[str]:
    return [f"ln(1 + {n}{c}) - d.n * ln(v1 + 2 + {t}{c})" for c in (0, 1)]


def _vanilla(name: str = "votes") -> str:
    return _votes(_score(_vanilla_base(), [f"ln(1 + c{c})" for c in (0, 1)], "n0 + n1 = 0"), name)


def _normalised(p: list[str], t: list[str], m: list[str], first: str, name: str, docs: str = "state", words: str = "words") -> str:
    one = lambda xs, c: f"(({xs[c]}) + 1) / (({xs[0]}) + ({xs[1]}) + 2)"
    return _votes(_score([f"ln({one(p, c)}) - d.n * ln({one(t, c)})" for c in (0, 1)], [f"ln({one(m, c)})" for c in (0, 1)], first, words, docs), name)


def _sketch(name: str = "votes") -> str:
    return _normalised([f"1 + n{c}" for c in (0, 1)], [f"v1 - 1 + t{c}" for c in (0, 1)], [f"CASE WHEN c{c} > 0 THEN 1 + c{c} ELSE 0 END" for c in (0, 1)], "n0 + n1 = 0", name)


def _fading(name: str = "votes") -> str:
    f = lambda c: f"pow(2.0, -0.1 * (pos - 1 - coalesce(last{c}, 0)) / 100.0)"
    return _normalised([f"(1 + n{c}) * {f(c)}" for c in (0, 1)], [f"(v1 - 1 + t{c}) * {f(c)}" for c in (0, 1)], [f"CASE WHEN c{c} > 0 THEN (1 + c{c}) * {f(c)} ELSE 0 END" for c in (0, 1)], "pos = 1", name)


def _select(votes: str = "votes") -> str:
    return f"SELECT seq, label, {_r('p0', 'p0')}, {_r('p1', 'p1')}, pred FROM {votes}"


def _accumulate(table: str, by: str, value: str, to: str) -> str:
    """Columns <to>0, <to>1: increments, each faded by the gap to the next one of its class, the last by that to now."""
    part = f"PARTITION BY {by} " if by else ""
    fade = lambda now, then: f"pow(2.0, -0.1 * ({now} - {then}) / 50.0)"
    mine = lambda c: f"arg_max(CASE WHEN label = {c} THEN {value} END, CASE WHEN label = {c} THEN pos END) OVER w AS {to}_x{c}, max(CASE WHEN label = {c} THEN pos END) OVER w AS {to}_l{c}"
    step = lambda c: f"coalesce(sum(CASE WHEN label = {c} AND {to}_l{c} IS NOT NULL THEN {to}_x{c} * {fade('pos', f'{to}_l{c}')} ELSE 0.0 END) OVER w, 0.0) + CASE WHEN {to}_l{c} IS NOT NULL THEN {to}_x{c} * {fade('pos - 1', f'{to}_l{c}')} ELSE 0.0 END AS {to}{c}"
    w = f"WINDOW w AS ({part}ORDER BY seq {PRIOR})"
    return f"SELECT *, {step(0)}, {step(1)} FROM (SELECT *, {mine(0)}, {mine(1)} FROM {table} {w}) {w}"


def _aggressive() -> str:
    docs = f"adocs AS (SELECT *, (SELECT CAST(arg_min(v, seq) AS DOUBLE) FROM docs) AS v1 FROM ({_accumulate(f'({_accumulate("docs", "", "1.0", "an")})', '', 'n', 'at')}))"
    words = f"awords AS ({_accumulate('(SELECT t.*, d.pos FROM tokens t JOIN docs d USING (seq))', 'word', 'x', 'ac')})"
    votes = _normalised([f"1 + an{c}" for c in (0, 1)], [f"v1 - 1 + at{c}" for c in (0, 1)], [f"CASE WHEN ac_l{c} IS NOT NULL THEN 1 + ac{c} ELSE 0 END" for c in (0, 1)], "pos = 1", "votes", "adocs", "awords")
    return f"WITH {DOCS}, {docs}, {words}, {votes} {_select()}"


def _window(seconds: int, name: str) -> str:
    """CTEs for the votes of a learner over a sliding window."""
    d = ", ".join(f"coalesce(sum({_of(c, '1.0').replace('label', 'h.label')}), 0.0) AS h{c}, coalesce(sum({_of(c, 'h.n').replace('label', 'h.label')}), 0.0) AS g{c}" for c in (0, 1))
    w = ", ".join(f"coalesce(sum({_of(c, 'h.x').replace('label', 'h.label')}), 0.0) AS c{c}" for c in (0, 1))
    inside = f"h.seq < k.seq AND h.ts >= k.before - INTERVAL {seconds} SECOND"
    return f"""{name}_docs AS (
        SELECT k.seq, k.label, k.n, k.pos, (SELECT CAST(arg_min(v, seq) AS DOUBLE) FROM docs) AS v1, {d}
        FROM (SELECT *, lag(ts) OVER (ORDER BY seq) AS before FROM docs) k LEFT JOIN docs h ON {inside} GROUP BY ALL),
    {name}_words AS (
        SELECT k.seq, k.word, k.x, {w}
        FROM (SELECT t.*, b.before FROM tokens t JOIN (SELECT seq, lag(ts) OVER (ORDER BY seq) AS before FROM docs) b USING (seq)) k
        LEFT JOIN tokens h ON h.word = k.word AND {inside} GROUP BY k.seq, k.word, k.x),
    {_votes(_score(_vanilla_base('h', 'g'), [f'ln(1 + c{c})' for c in (0, 1)], 'd.pos = 1', f'{name}_words', f'{name}_docs'), name)}"""


_ENSEMBLE = f"{DOCS}, {_window(7200, 'w1')}, {_window(43200, 'w2')}, votes AS (SELECT *, 'w1' AS learner FROM w1 UNION ALL SELECT *, 'w2' FROM w2)"
_CELLS = "count(*) FILTER (label = 0 AND pred = 0) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fp"


def _full(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 100.0 ELSE {x} END"


def _pct(top: str, below: str, undefined: str = "0.0") -> str:
    return f"coalesce(100.0 * ({top}) / nullif({below}, 0), {undefined})"


_ACC = _pct("tp + tn", "tp + tn + fp + fn")
_REC, _SPE, _PRE = _pct("tp", "tp + fn"), _pct("tn", "tn + fp"), _pct("tp", "tp + fp")
_GM = f"sqrt(({_full(_pct('tp', 'tp + fn', '100.0'))}) * ({_full(_pct('tn', 'tn + fp', '100.0'))}))"
_N = "CAST(tp + tn + fp + fn AS DOUBLE)"
_PE = f"(((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / nullif({_N} * {_N}, 0))"
_KAPPA = f"greatest(coalesce(((tp + tn) / nullif({_N}, 0) - {_PE}) / nullif(1 - {_PE}, 0), 0.0), 0.0) * 100.0"
_METRICS = f"""{_r(_ACC, 'accuracy')}, {_r(_REC, 'recall')}, {_r(_SPE, 'specificity')}, {_r(_PRE, 'precision')},
    {_r(f"coalesce(2 * ({_PRE}) * ({_REC}) / nullif(({_PRE}) + ({_REC}), 0), 1e-5)", 'f1')}, {_r(_GM, 'g_mean')}, {_r(_KAPPA, 'kappa')}"""
_CHUNK = "chunks AS (SELECT seq, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS chunk FROM stream)"


def _weighted(weights: str, final: str) -> str:
    return f"""WITH {_ENSEMBLE}, {_CHUNK}, weights AS ({weights}),
    old AS (SELECT chunk, learner, coalesce(lag(weight) OVER (PARTITION BY learner ORDER BY chunk), 1.0) AS weight FROM weights),
    joint AS (SELECT seq, label, {final} FROM votes JOIN chunks USING (seq) JOIN old USING (chunk, learner) GROUP BY seq, label)
    SELECT seq, label, {_r('p0', 'p0')}, {_r('p1', 'p1')}, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS pred FROM joint"""


_GMEAN_WEIGHTS = f"""SELECT chunk, learner, exp({_GM} / 100.0 / sqrt(
        (CASE WHEN tp + fn = 0 THEN 1.0 ELSE (tp + fn) / {_N} END) * (CASE WHEN tn + fp = 0 THEN 1.0 ELSE (tn + fp) / {_N} END))) AS weight
    FROM (SELECT chunk, learner, {_CELLS} FROM votes JOIN chunks USING (seq) GROUP BY chunk, learner)"""
_MSE_WEIGHTS = """SELECT chunk, learner, 1 / (s * (1 - s) * (1 - s) + (1 - s) * s * s + i + 1e-9) AS weight FROM (
    SELECT chunk, learner, avg(CASE WHEN p0 + p1 > 0 THEN pow(1 - CASE WHEN label = 0 THEN p0 ELSE p1 END, 2) ELSE 1.0 END) AS i,
        avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS s
    FROM votes JOIN chunks USING (seq) GROUP BY chunk, learner)"""

EVENTS = """rows AS (SELECT event_type AS word, event_id AS seq, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s,
    CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS n0, CASE WHEN user_id % 2 = 1 THEN 1.0 ELSE 0.0 END AS n1 FROM events)"""


def _periods(rows: str, seconds: int) -> str:
    """CTE periods: each anchor names the row that closes its period and anchors the next."""
    return f"""RECURSIVE {rows}, numbered AS (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY s, seq) AS r, sum(n0) OVER c AS s0, sum(n1) OVER c AS s1
        FROM rows WINDOW c AS (PARTITION BY word ORDER BY s, seq ROWS UNBOUNDED PRECEDING)),
    nexts AS (SELECT *, min(r) OVER (PARTITION BY word ORDER BY s RANGE BETWEEN {seconds + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM numbered),
    chain(word, period_id, r, nxt, t_first) AS (
        SELECT word, CAST(0 AS BIGINT), r, nxt, s FROM nexts WHERE r = 1
        UNION ALL SELECT c.word, c.period_id + 1, n.r, n.nxt, c.t_first FROM chain c JOIN nexts n ON n.word = c.word AND n.r = c.nxt),
    periods AS (
        SELECT c.word, c.period_id, c.t_first, a.s AS t_open, z.s AS t_close, z.seq AS close_seq,
            z.s0 - a.s0 + CASE WHEN c.period_id = 0 THEN a.n0 ELSE 0 END AS n0, z.s1 - a.s1 + CASE WHEN c.period_id = 0 THEN a.n1 ELSE 0 END AS n1
        FROM chain c JOIN numbered a ON a.word = c.word AND a.r = c.r JOIN numbered z ON z.word = c.word AND z.r = c.nxt)"""


_PERIODS = "WITH " + _periods(EVENTS, 3600)
_POISSON = ", ".join(f"avg(n{c}) OVER (PARTITION BY word ORDER BY period_id ROWS UNBOUNDED PRECEDING) AS poisson_{c}" for c in (0, 1))
_WEEKS = f"""weeks AS (SELECT *, (t_close - t_first) // 604800 AS wk FROM periods),
    older AS (SELECT word, wk + 1 AS wk, avg(n0) AS o0, avg(n1) AS o1 FROM weeks GROUP BY ALL)"""
_SEASONAL = ", ".join(f"(0.9 * avg(n{c}) OVER (PARTITION BY p.word, p.wk ORDER BY period_id ROWS UNBOUNDED PRECEDING) + 0.09 * coalesce(o{c}, 0.0)) / 1.71 AS seasonal_{c}" for c in (0, 1))
_EWMA = ", ".join(f"list_sum(list_transform(l{c}, lambda x, i: 0.9 * pow(0.1, len(l{c}) - i) * x)) / ((1 - pow(0.9, len(l{c}))) / 0.9) AS ewma_{c}" for c in (0, 1))
_LAST22 = ", ".join(f"list(n{c}) OVER (PARTITION BY word ORDER BY period_id ROWS 21 PRECEDING) AS l{c}" for c in (0, 1))
_KEYS = [f"{e}_{c}" for e in ("poisson", "seasonal", "ewma") for c in (0, 1)]


def _experts() -> str:
    capped = ", ".join(f"least({k}, 5.0) AS {k}" for k in _KEYS)
    loss = ", ".join(f"pow(n{k[-1]} - coalesce(lag({k}) OVER (PARTITION BY word ORDER BY period_id), 0.0), 2) AS loss_{k}" for k in _KEYS)
    total = ", ".join(f"sum(loss_{k}) OVER (PARTITION BY word ORDER BY period_id ROWS UNBOUNDED PRECEDING) AS total_{k}" for k in _KEYS)
    low = {c: "least(" + ", ".join(f"total_{k}" for k in _KEYS if k[-1] == str(c)) + ")" for c in (0, 1)}
    raw = {k: f"exp(-(total_{k} - {low[int(k[-1])]}) / 50.0)" for k in _KEYS}
    whole = {c: " + ".join(raw[k] for k in _KEYS if k[-1] == str(c)) for c in (0, 1)}
    weight = ", ".join(f"{raw[k]} / ({whole[int(k[-1])]}) AS w_{k}" for k in _KEYS)
    return f"""{_PERIODS}, {_WEEKS}, said AS (
        SELECT word, period_id, n0, n1, {capped} FROM (
            SELECT *, {_EWMA} FROM (
                SELECT p.word, period_id, n0, n1, {_POISSON.replace('PARTITION BY word', 'PARTITION BY p.word')}, {_SEASONAL}, {_LAST22.replace('PARTITION BY word', 'PARTITION BY p.word')}
                FROM weeks p LEFT JOIN older o ON o.word = p.word AND o.wk = p.wk))),
    weights AS (SELECT *, {weight} FROM (SELECT *, {total} FROM (SELECT *, {loss} FROM said)))"""


_KAPPA_CTE = f"""seen AS (SELECT seq, row_number() OVER (ORDER BY seq) AS pos, {_ACC} AS accuracy, {_KAPPA} AS kappa FROM (
    SELECT seq, {", ".join(f"sum(CASE WHEN label = {a} AND pred = {b} THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS 999 PRECEDING) AS {k}" for k, (a, b) in dict(tp=(0, 0), fn=(0, 1), tn=(1, 1), fp=(1, 0)).items())} FROM votes))"""


def _fade(of: str, factor: float, to: str, table: str) -> str:
    reach = 450 if factor > 0.5 else 40
    return f"""SELECT * EXCLUDE (l), list_sum(list_transform(l, lambda x, i: x * pow({factor}, len(l) - i))) / list_sum(list_transform(l, lambda x, i: pow({factor}, len(l) - i))) AS {to}
        FROM (SELECT *, list({of}) OVER (ORDER BY pos ROWS {reach} PRECEDING) AS l FROM {table})"""


def _fading_estimates() -> str:
    q = "seen"
    for c in ("accuracy", "kappa"):
        q = f"({_fade(c, 0.9, f'fade1_{c}', q)})"
        q = f"({_fade(f'fade1_{c}', 0.1, f'fade2_{c}', q)})"
    cols = ", ".join(_r(c, c) for c in ("accuracy", "kappa", "fade1_accuracy", "fade2_accuracy", "fade1_kappa", "fade2_kappa"))
    return f"WITH {_state()}, {_vanilla()}, {_KAPPA_CTE} SELECT seq, pos, {cols} FROM {q}"


def _words(expression: str) -> str:
    return f"SELECT doc_id, array_to_string({expression}, ' ') AS text FROM (SELECT doc_id, string_split(lower(rtrim(text, ' ')), ' ') AS w FROM documents)"


def _q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_EMOTICON = """CASE WHEN regexp_matches(t, '^[:;=][^\\n\\r]*\\)$|^\\([^\\n\\r]*[:;=]$') THEN 'positive' WHEN regexp_matches(t, '^[:;=][^\\n\\r]*\\($|^\\)[^\\n\\r]*[:;=]$') THEN 'negative'
    WHEN regexp_matches(t, '^(haha|\\*g)|^(lol|:d|;d|=d)$') THEN 'smile' WHEN regexp_matches(t, '^&lt;[^\\n\\r]*3$|^<3+$') THEN 'love' ELSE t END"""
_SQUEEZE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'aa+', 'a', 'g'), 'uu+', 'u', 'g'), 'ii+', 'i', 'g'), 'ooo+', 'o', 'g'), 'eee+', 'e', 'g')"


def _map(of: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in of.items()) + "}"


def _negated(w: str = "w") -> str:
    at = lambda k: f"(CASE WHEN i + {k} > 0 THEN {w}[i + {k}] END)"
    neg = lambda x: f"coalesce({x} LIKE '%n''t' OR {x} LIKE '%not' OR {x} IN ('nor', 'neither'), false)"
    verb, filler, other = (lambda k, l=l: f"coalesce({at(k)} IN ({_q(l)}), false)" for l in (lexicons.VERBS, lexicons.FILLERS, lexicons.ANTONYMS))  # noqa: E741
    skips = lambda k: f"({filler(k)} AND {at(k + 1)} IS NOT NULL)"
    opp, plain = _map(lexicons.ANTONYMS), f"(CASE WHEN {at(1)} IS NOT NULL THEN replace(t, 'n''t', 'not') ELSE t END)"
    return f"""list_filter(list_transform({w}, lambda t, i: CASE
        WHEN {neg('t')} THEN CASE WHEN {verb(1)} THEN 'NOT' || {at(1)} WHEN {skips(1)} THEN CASE WHEN {other(2)} THEN {opp}[{at(2)}] ELSE {plain} END
            WHEN {other(1)} THEN {opp}[{at(1)}] ELSE {plain} END
        WHEN {neg(at(-1))} AND ({verb(0)} OR {skips(0)} OR {other(0)}) THEN NULL
        WHEN {neg(at(-2))} AND NOT {verb(-1)} AND {filler(-1)} AND {other(0)} THEN NULL
        ELSE t END), lambda t: t IS NOT NULL)"""


def _colloquial(w: str) -> str:
    return f"flatten(list_transform({w}, lambda t: string_split(coalesce({_map(lexicons.COLLOQUIAL)}[t], t), ' ')))"


def _unmark(w: str) -> str:
    return f"list_transform(list_filter({w}, lambda t: NOT regexp_matches(t, '^(@|http)')), lambda t: regexp_replace(t, '^#', ''))"


_LETTERS = "regexp_replace(t, '[^a-zA-Z]', '', 'g')"


def _clean() -> str:
    one = f"list_transform(w, lambda t: {_EMOTICON})"
    return f"""SELECT doc_id, array_to_string(list_filter(list_transform({_colloquial('c')}, lambda t: {_LETTERS}), lambda t: t NOT IN ('', {_q(lexicons.STOP_WORDS)})), ' ') AS text FROM (
        SELECT doc_id, list_transform({_negated('b')}, lambda t: {_SQUEEZE.format('t')}) AS c FROM (
            SELECT doc_id, {_unmark(one)} AS b FROM (SELECT doc_id, string_split(lower(rtrim(text, ' ')), ' ') AS w FROM documents)))"""


def _chi2(n: str = "") -> str:
    a, b, c, d = "n1", "n0", "(t1 - n1)", "(t0 - n0)"
    return f"coalesce(({a} + {b} + {c} + {d}) * pow({a} * {d} - {b} * {c}, 2) / nullif(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}), 0), 0.0)"


_V = f"WITH {_state()}, {_vanilla()}"
_THREE = f"WITH {_state()}, {_vanilla('v')}, {_sketch('s')}, {_fading('f')}, votes AS (SELECT *, 'vanilla' AS learner FROM v UNION ALL SELECT *, 'sketch' FROM s UNION ALL SELECT *, 'fading' FROM f)"


def _class_counts(period: str) -> str:
    return f"""WITH {STREAM}, counted AS (SELECT CAST(date_trunc('{period}', ts) AS DATE) AS start, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM stream GROUP BY 1)
    SELECT CAST(start AS DATE) AS start, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1
    FROM (SELECT CAST(unnest(generate_series(min(start)::TIMESTAMP, max(start)::TIMESTAMP, INTERVAL 1 {period})) AS DATE) AS start FROM counted) LEFT JOIN counted USING (start)"""


def _class_periods(period: str) -> str:
    """Each anchor is the first document more than a period after the one before; gaps are filled with zeros."""
    return f"""WITH RECURSIVE {STREAM}, chain(a) AS (
        SELECT min(ts) FROM stream UNION ALL SELECT (SELECT min(ts) FROM stream WHERE ts - INTERVAL 1 {period} > a) FROM chain WHERE a IS NOT NULL),
    spans AS (SELECT a, lead(a) OVER (ORDER BY a) AS z FROM chain WHERE a IS NOT NULL),
    every AS (SELECT a AS start, a, z FROM spans UNION ALL SELECT unnest(generate_series(a + INTERVAL 1 {period}, z - INTERVAL 1 SECOND, INTERVAL 1 {period})), NULL, NULL FROM spans WHERE z IS NOT NULL)
    SELECT CAST(epoch(start) AS BIGINT) AS start, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
    FROM every LEFT JOIN stream ON ts >= a AND (z IS NULL OR ts < z) AND a IS NOT NULL GROUP BY start"""


def _values(values: str) -> str:
    """Votes of the plain learner with other values for some words."""
    words = "words2 AS (SELECT w.seq, w.word, w.x, coalesce(v0, c0) AS c0, coalesce(v1_, c1) AS c1 FROM words w LEFT JOIN vals USING (seq, word))"
    return f"WITH {_state()}, {values}, {words}, {_votes(_score(_vanilla_base(), [f'ln(1 + c{c})' for c in (0, 1)], 'n0 + n1 = 0', 'words2'))} {_select()}"


_TRACKED = ("the", "and", "of", "to", "in", "die", "und", "der", "la", "de", "le", "et", "el", "en")

ORACLE_SQL: dict[str, str] = {
    "prequential_mnb": f"{_V} {_select()}",
    "mnb_sketch_exact": f"WITH {_state()}, {_sketch()} {_select()}",
    "mnb_fading": f"WITH {_state()}, {_fading()} {_select()}",
    "mnb_aggressive": _aggressive(),
    "mnb_lexicon": _values(f"""monthly AS (SELECT word, year(ts) * 12 + month(ts) AS line, {", ".join(f"sum({_of(c, 'x')}) AS m{c}" for c in (0, 1))} FROM tokens GROUP BY 1, 2),
        asked AS (SELECT DISTINCT word, year(ts) * 12 + month(ts) AS line FROM tokens),
        vals AS (SELECT t.seq, t.word, l.v0, l.v1_ FROM tokens t JOIN (
            SELECT word, line, avg(m0) AS v0, avg(m1) AS v1_ FROM (
                SELECT a.word, a.line, m0, m1, row_number() OVER (PARTITION BY a.word, a.line ORDER BY m.line DESC) AS r FROM asked a JOIN monthly m ON m.word = a.word AND m.line < a.line)
            WHERE r <= 2 GROUP BY word, line) l ON l.word = t.word AND l.line = year(t.ts) * 12 + month(t.ts))"""),
    "mnb_predictor": _values(f"""vals AS (
        SELECT k.seq, k.word, coalesce(avg({_of(0, 'h.x').replace('label', 'h.label')}) FILTER (h.seq IS NOT NULL), 0.0) AS v0, coalesce(avg({_of(1, 'h.x').replace('label', 'h.label')}) FILTER (h.seq IS NOT NULL), 0.0) AS v1_
        FROM tokens k LEFT JOIN tokens h ON h.word = k.word AND h.seq < k.seq AND h.ts >= k.ts - INTERVAL 86400 SECOND AND h.ts <= k.ts
        WHERE k.word IN ({_q(_TRACKED)}) GROUP BY k.seq, k.word)"""),
    "model_description": f"""WITH {DOCS}, per AS (SELECT word, {", ".join(f"sum({_of(c, 'x')}) AS n{c}" for c in (0, 1))} FROM tokens GROUP BY word),
        total AS (SELECT sum(n0) AS t0, sum(n1) AS t1, (SELECT CAST(arg_min(v, seq) AS DOUBLE) FROM docs) AS v1 FROM per)
        SELECT word, n0, n1, {", ".join(_r(f'(1 + n{c}) / (v1 + 2 + t{c})', f'p_word_{c}') for c in (0, 1))} FROM per, total""",
    "holdout_split": f"""WITH {DOCS}, cut AS (SELECT floor(count(*) * 0.7) AS cut, CAST(arg_min(v, seq) AS DOUBLE) AS v1 FROM docs),
        trained AS (SELECT {", ".join(f"sum({_of(c, '1.0')}) AS n{c}, sum({_of(c, 'n')}) AS t{c}" for c in (0, 1))} FROM docs, cut WHERE pos <= cut),
        known AS (SELECT word, {", ".join(f"sum({_of(c, 'x')}) AS c{c}" for c in (0, 1))} FROM tokens WHERE seq IN (SELECT seq FROM docs, cut WHERE pos <= cut) GROUP BY word),
        words AS (SELECT t.seq, t.word, t.x, coalesce(c0, 0.0) AS c0, coalesce(c1, 0.0) AS c1 FROM tokens t LEFT JOIN known USING (word)),
        state AS (SELECT docs.*, cut.v1, trained.* FROM docs, cut, trained WHERE pos > cut),
        {_votes(_score(_vanilla_base(), [f"ln(1 + c{c})" for c in (0, 1)], "false"))} {_select()}""",
    "mnb_window_12h": f"WITH {DOCS}, {_window(43200, 'votes')} {_select()}",
    "ensemble_2": f"WITH {_ENSEMBLE} SELECT seq, label, {_r('p0', 'p0')}, {_r('p1', 'p1')}, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS pred FROM (SELECT seq, label, avg(p0) AS p0, avg(p1) AS p1 FROM votes GROUP BY seq, label)",
    "ensemble_weighted": _weighted(_GMEAN_WEIGHTS, "sum(p0 * weight) / sum(weight) AS p0, sum(p1 * weight) / sum(weight) AS p1"),
    "ensemble_mse": _weighted(_MSE_WEIGHTS, ", ".join(f"coalesce(sum(p{c} * weight) / nullif(sum(p0 * weight) + sum(p1 * weight), 0), 0.0) AS p{c}" for c in (0, 1))),
    "sliding_window_counts": f"""WITH {STREAM}, held AS (SELECT seq, count(*) OVER w AS size, min(seq) OVER w AS first_seq FROM stream WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 43200 SECOND PRECEDING AND CURRENT ROW))
        SELECT seq, size, first_seq, CASE WHEN first_seq > lag(first_seq) OVER (ORDER BY seq) THEN 1 ELSE 0 END AS slided FROM held""",
    "class_counts_day": _class_counts("day"),
    "class_counts_week": _class_counts("week"),
    "class_counts_month": _class_counts("month"),
    "class_periods_day": _class_periods("day"),
    "class_periods_week": _class_periods("week"),
    "tumbling_counts": f"WITH {STREAM} SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM stream GROUP BY 1",
    "shift_matrix": f"""WITH {EVENTS}, timed AS (SELECT *, make_timestamp(s * 1000000) AS ts FROM rows), weeks AS (
        SELECT *, date_diff('day', min(date_trunc('week', ts)) OVER (PARTITION BY word), date_trunc('week', ts)) // 7 AS week FROM timed)
        SELECT word, CAST(week AS INTEGER) AS week, CAST(isodow(ts) - 1 AS INTEGER) AS day, CAST(((hour(ts) + 22) % 24) // 4 AS INTEGER) AS shift,
            sum(n0) AS n0, sum(n1) AS n1, count(*) AS points, min(s) AS first_ts, max(s) AS last_ts FROM weeks GROUP BY 1, 2, 3, 4""",
    "tokenize_tf": f"WITH {TOKENS} SELECT seq, word, x FROM tokens",
    "running_tfidf": f"""WITH {TOKENS}, sized AS (SELECT seq, len(string_split(rtrim(text, ' '), ' ')) AS len, row_number() OVER (ORDER BY seq) AS docs FROM stream),
        seen AS (SELECT *, sum(x) OVER (PARTITION BY word ORDER BY seq ROWS UNBOUNDED PRECEDING) AS df FROM tokens)
        SELECT seq, word, x, {_r('x / len', 'tf')}, {_r('log10(docs / (df + 1))', 'idf')}, {_r('x / len * log10(docs / (df + 1))', 'tfidf')} FROM seen JOIN sized USING (seq)""",
    "bag_of_words": f"WITH {TOKENS} SELECT seq, word, x FROM tokens WHERE word IN (SELECT word FROM tokens GROUP BY word ORDER BY sum(x) DESC, word LIMIT 3000)",
    "document_lengths": f"WITH {DOCS} SELECT seq, n, v FROM docs",
    "clean_emoticons": _words(f"list_transform(w, lambda t: {_EMOTICON})"),
    "resolve_negations": _words(_negated()),
    "squeeze_repeats": f"SELECT doc_id, {_SQUEEZE.format('lower(text)')} AS text FROM documents",
    "strip_letters": _words(f"list_transform({_unmark('w')}, lambda t: {_LETTERS})"),
    "expand_colloquial": _words(_colloquial("w")),
    "stopword_antijoin": _words(f"list_filter(w, lambda t: t NOT IN ('', {_q(lexicons.STOP_WORDS)}))"),
    "cleaned_text": _clean(),
    "cleaning_counters": f"""SELECT {", ".join(f"count(*) FILTER (e <> t AND e = '{k}') AS {k}" for k in ("positive", "negative", "smile", "love"))},
        count(*) FILTER (t LIKE '%n''t' OR t LIKE '%not' OR t IN ('nor', 'neither')) AS negations, count(*) FILTER ({_SQUEEZE.format('t')} <> t) AS repetitions,
        count(*) FILTER (t IN ({_q(lexicons.COLLOQUIAL)})) AS colloquial, count(*) FILTER (t IN ({_q(lexicons.VERBS)})) AS verbs, count(*) FILTER (t IN ({_q(lexicons.ANTONYMS)})) AS opposites, count(*) FILTER (t IN ({_q(lexicons.STOP_WORDS)})) AS stop_words, count(DISTINCT nullif(t, '')) AS distinct_words
        FROM (SELECT t, {_EMOTICON} AS e FROM (SELECT unnest(string_split(lower(rtrim(text, ' ')), ' ')) AS t FROM documents))""",
    "label_encode": "SELECT doc_id, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS rating, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS mail, CAST(NULL AS INTEGER) AS unknown FROM labels",
    "date_seconds": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE CAST(epoch(o_orderdate) AS DOUBLE) END AS seconds FROM orders",
    "topk_words": f"WITH {TOKENS} SELECT word, sum(x) AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 100",
    "relative_frequency": f"""WITH {TOKENS}, total AS (SELECT seq, sum(sum(x)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM tokens GROUP BY seq)
        SELECT seq, word, {_r('sum(x) OVER (PARTITION BY word ORDER BY seq ROWS UNBOUNDED PRECEDING) / total', 'share')} FROM tokens JOIN total USING (seq)""",
    "decayed_counts": f"WITH {DOCS} SELECT word, {_r('sum(x * exp(0.01 * (pos - (SELECT max(pos) FROM docs))))', 'n')} FROM tokens JOIN docs USING (seq) GROUP BY word",
    "chi2_words": f"""WITH {TOKENS}, total AS (SELECT sum({_of(0, '1.0')}) AS t0, sum({_of(1, '1.0')}) AS t1 FROM stream), words AS (SELECT word, sum({_of(0, '1.0')}) AS n0, sum({_of(1, '1.0')}) AS n1 FROM tokens GROUP BY word)
        SELECT word, n0, n1, {_r(_chi2(), 'chi2')} FROM words, total WHERE {_chi2()} > 6.63""",
    "chi2_batches": f"""WITH {DOCS}, batched AS (SELECT seq, label, (pos - 1) // 100 AS batch FROM docs),
        total AS (SELECT batch, sum(sum({_of(0, '1.0')})) OVER w AS t0, sum(sum({_of(1, '1.0')})) OVER w AS t1 FROM batched GROUP BY batch WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)),
        words AS (SELECT batch, word, sum(sum({_of(0, '1.0').replace('label', 'b.label')})) OVER w AS n0, sum(sum({_of(1, '1.0').replace('label', 'b.label')})) OVER w AS n1 FROM tokens JOIN batched b USING (seq) GROUP BY batch, word WINDOW w AS (PARTITION BY word ORDER BY batch ROWS UNBOUNDED PRECEDING))
        SELECT batch, word, n0, n1, {_r(_chi2(), 'chi2')} FROM words JOIN total USING (batch)""",
    "anchored_periods": f"{_PERIODS} SELECT * FROM periods",
    "word_periods": f"WITH {_periods(TOKENS + f', rows AS (SELECT word, seq, CAST(epoch(ts) AS BIGINT) AS s, {_of(0, "x")} AS n0, {_of(1, "x")} AS n1 FROM tokens)', 60)} SELECT * FROM periods",
    "count_periods": f"""WITH {EVENTS} SELECT word, period_id, max(seq) AS close_seq, sum(n0) AS n0, sum(n1) AS n1
        FROM (SELECT *, (row_number() OVER (PARTITION BY word ORDER BY seq) - 1) // 26 AS period_id FROM rows) GROUP BY word, period_id HAVING count(*) > 25""",
    "cumulative_trajectory": f"WITH {EVENTS} SELECT word, seq, s, n0, n1, sum(n0) OVER w AS sum0, sum(n1) OVER w AS sum1 FROM rows WINDOW w AS (PARTITION BY word ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "time_tree": f"""WITH {TOKENS} SELECT s, documents0, documents1, coalesce(tokens0, 0.0) AS tokens0, coalesce(tokens1, 0.0) AS tokens1
        FROM (SELECT CAST(epoch(ts) AS BIGINT) AS s, sum({_of(0, '1.0')}) AS documents0, sum({_of(1, '1.0')}) AS documents1 FROM stream GROUP BY 1)
        LEFT JOIN (SELECT CAST(epoch(ts) AS BIGINT) AS s, sum({_of(0, 'x')}) AS tokens0, sum({_of(1, 'x')}) AS tokens1 FROM tokens GROUP BY 1) USING (s)""",
    "time_tree_words": f"WITH {TOKENS} SELECT CAST(epoch(ts) AS BIGINT) AS s, word, sum({_of(0, 'x')}) AS n0, sum({_of(1, 'x')}) AS n1 FROM tokens GROUP BY 1, 2",
    "inverted_index": f"WITH {TOKENS} SELECT word, array_to_string(list_sort(list_distinct(list(CAST(epoch(ts) AS BIGINT)))), ',') AS times FROM tokens GROUP BY word",
    "class_trajectory": f"""WITH {TOKENS}, lim AS (SELECT max(ts) - INTERVAL 86400 SECOND AS lo FROM stream)
        SELECT d.*, t.* FROM (SELECT 1 + coalesce(sum({_of(0, '1.0')}), 0.0) AS prior0, 1 + coalesce(sum({_of(1, '1.0')}), 0.0) AS prior1 FROM stream, lim WHERE ts >= lo) d,
        (SELECT 1 + coalesce(sum({_of(0, 'x')}), 0.0) AS total0, 1 + coalesce(sum({_of(1, 'x')}), 0.0) AS total1 FROM tokens, lim WHERE ts >= lo) t""",
    "poisson_rate": f"{_PERIODS} SELECT word, period_id, {_r('poisson_0', 'poisson_0')}, {_r('poisson_1', 'poisson_1')} FROM (SELECT *, {_POISSON} FROM periods)",
    "seasonal_rate": f"{_PERIODS}, {_WEEKS} SELECT word, period_id, {_r('seasonal_0', 'seasonal_0')}, {_r('seasonal_1', 'seasonal_1')} FROM (SELECT p.word, period_id, {_SEASONAL} FROM weeks p LEFT JOIN older o ON o.word = p.word AND o.wk = p.wk)",
    "ewma_forecast": f"{_PERIODS} SELECT word, period_id, {_r('ewma_0', 'ewma_0')}, {_r('ewma_1', 'ewma_1')} FROM (SELECT word, period_id, {_EWMA} FROM (SELECT *, {_LAST22} FROM periods))",
    "instance_rates": f"""WITH {EVENTS}, placed AS (SELECT *, (row_number() OVER (PARTITION BY word ORDER BY seq) - 1) // 25 AS bucket FROM rows),
        newest AS (SELECT *, max(bucket) OVER (PARTITION BY word) AS last FROM placed)
        SELECT word, bucket, sum(n0) AS n0, sum(n1) AS n1, count(*) AS points, {_r('sum(n0) / count(*)', 'rate0')}, {_r('sum(n1) / count(*)', 'rate1')} FROM newest WHERE bucket > last - 2 GROUP BY word, bucket""",
    "window_predictors": f"""WITH {EVENTS}, stop AS (SELECT max(s) AS stop FROM rows), hourly AS (SELECT word, s // 3600 * 3600 AS s, sum(n0) AS n0, sum(n1) AS n1 FROM rows GROUP BY 1, 2)
        SELECT word, {_r('avg(n0)', 'avg0')}, {_r('avg(n1)', 'avg1')}, sum(n0) AS sum0, sum(n1) AS sum1, {_r('regr_intercept(n0, CAST(s - stop AS DOUBLE))', 'trend0')}, {_r('regr_intercept(n1, CAST(s - stop AS DOUBLE))', 'trend1')}
        FROM hourly, stop WHERE s BETWEEN stop - 604800 AND stop GROUP BY word""",
    "expert_weights": f"{_experts()} SELECT word, period_id, {', '.join(_r(f'w_{k}', f'w_{k}') for k in _KEYS)} FROM weights",
    "expert_forecast": f"{_experts()} SELECT word, period_id, {', '.join(_r(' + '.join(f'w_{k} * {k}' for k in _KEYS if k[-1] == str(c)), f'f{c}') for c in (0, 1))} FROM weights",
    "metrics": f"{_V} SELECT tp, fn, tn, fp, {_METRICS} FROM (SELECT {_CELLS} FROM votes)",
    "running_totals": f"{_V} SELECT seq, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n0, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n1 FROM votes WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "window_kappa": f"{_V}, {_KAPPA_CTE} SELECT seq, pos, {_r('accuracy', 'accuracy')}, {_r('kappa', 'kappa')} FROM seen",
    "fading_estimates": _fading_estimates(),
    "daily_performance": f"""{_V}, {_KAPPA_CTE} SELECT CAST(ts AS DATE) AS day, count(*) AS n, {", ".join(f"{_r(f'avg({c})', f'mean_{c}')}, {_r(f'coalesce(stddev_samp({c}), 0.0)', f'std_{c}')}" for c in ("accuracy", "kappa"))}
        FROM seen JOIN stream USING (seq) GROUP BY 1""",
    "anchored_daily_performance": f"""{_V.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_KAPPA_CTE}, chain(a) AS (
            SELECT min(ts) FROM stream UNION ALL SELECT (SELECT min(ts) FROM stream WHERE ts - INTERVAL 1 DAY >= a) FROM chain WHERE a IS NOT NULL),
        spans AS (SELECT a, lead(a) OVER (ORDER BY a) AS z FROM chain WHERE a IS NOT NULL)
        SELECT CAST(epoch(a) AS BIGINT) AS start, count(*) AS n, {", ".join(f"{_r(f'avg({c})', f'mean_{c}')}, {_r(f'coalesce(stddev_samp({c}), 0.0)', f'std_{c}')}" for c in ("accuracy", "kappa"))}
        FROM seen JOIN stream USING (seq) JOIN spans ON ts >= a AND (z IS NULL OR ts < z) GROUP BY 1""",
    "count_batches": f"{_V} SELECT batch, tp, fn, tn, fp, {_METRICS} FROM (SELECT batch, {_CELLS} FROM (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 50 AS batch FROM votes) GROUP BY batch)",
    "significance_rows": f"{_V} SELECT row_number() OVER (ORDER BY seq) AS num, pred AS predicted, CASE WHEN pred = label THEN 1 ELSE 0 END AS correct FROM votes",
    "pairwise_kappa": f"""{_THREE}, placed AS (SELECT v.*, (pos - 1) // 100 AS batch FROM votes v JOIN docs USING (seq)),
        pairs AS (SELECT i.batch, i.learner AS learner_i, j.learner AS learner_j, avg(CASE WHEN (i.pred = 0) = (j.pred = 0) THEN 1.0 ELSE 0.0 END) AS theta1,
            avg(CASE WHEN i.pred = 0 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN j.pred = 0 THEN 1.0 ELSE 0.0 END) AS b
            FROM placed i JOIN placed j ON i.seq = j.seq AND i.learner < j.learner GROUP BY 1, 2, 3)
        SELECT batch, learner_i, learner_j, {_r('theta1', 'theta1')}, {_r('a * b + (1 - a) * (1 - b)', 'theta2')},
            {_r('coalesce((theta1 - (a * b + (1 - a) * (1 - b))) / nullif(1 - (a * b + (1 - a) * (1 - b)), 0), 0.0)', 'kappa')} FROM pairs""",
    "learner_daily": f"""{_THREE}, placed AS (SELECT learner, CAST(ts AS DATE) AS day, CASE WHEN pred = v.label THEN 100.0 ELSE 0.0 END AS correct FROM votes v JOIN stream USING (seq))
        SELECT day, learner, count(*) AS n, {_r('avg(CAST(correct AS DOUBLE))', 'mean_correct')}, {_r('coalesce(stddev_samp(CAST(correct AS DOUBLE)), 0.0)', 'std_correct')} FROM placed GROUP BY 1, 2""",
    "random_order": "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7')) AS position FROM documents",
    "ordered_scan": f"WITH {STREAM} SELECT seq, label, row_number() OVER (ORDER BY ts, seq) AS position FROM stream",
    "scan_page": """SELECT o_orderkey AS seq, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS s, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS label, o_orderpriority AS text
        FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 250""",
    "time_units": f"""SELECT event_id, {", ".join(f"CAST(floor((s - min(s) OVER (PARTITION BY user_id)) / {n}) AS BIGINT) AS {u}" for u, n in dict(minute=60, hour=3600, day=86400, week=604800).items())}
        FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""",
    "lexicon_keys": "SELECT DISTINCT p_type AS key FROM part WHERE p_type <> ''",
    "lexicon_key_values": "SELECT CAST(n_regionkey AS VARCHAR) AS key, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY 1",
    "lexicon_opposites": """WITH n AS (SELECT lower(n_name) AS w, row_number() OVER (ORDER BY n_nationkey) - 1 AS n FROM nation),
        p AS (SELECT arg_min(w, n) AS a, arg_max(w, n) AS b FROM n GROUP BY n // 2 HAVING count(*) = 2)
        SELECT a AS word, b AS opposite FROM p UNION ALL SELECT b, a FROM p""",
    "tracked_tail": f"""WITH {TOKENS}, lim AS (SELECT CAST(epoch(max(ts)) AS BIGINT) AS stop FROM stream),
        kept AS (SELECT word, CAST(epoch(ts) AS BIGINT) AS s, {_of(0, 'x')} AS n0, {_of(1, 'x')} AS n1 FROM tokens, lim WHERE epoch(ts) >= stop - 86400 AND word <> 'und')
        SELECT w.word, coalesce(s, stop) AS s, coalesce(n0, 0.0) AS n0, coalesce(n1, 0.0) AS n1 FROM (SELECT unnest([{_q((*_TRACKED, 'wordthatnoonesays'))}]) AS word) w LEFT JOIN kept USING (word), lim""",
    "live_slice": f"WITH {STREAM} SELECT seq, label FROM stream ORDER BY ts, seq LIMIT 1000",
}
