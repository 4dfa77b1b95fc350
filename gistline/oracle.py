"""DuckDB SQL for the queries, written apart from the Spark plans: RE2 patterns, list lambdas, recursive packing."""

from __future__ import annotations

from .functions.stopwords import ENGLISH
from .functions.text import PALETTE

_WORDY = r"\p{L}\p{N}_"
_STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"
_WS = r"\s\x{3000}"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _clean(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {_trim('x')}), lambda x: x <> '')"


def _marked(x: str) -> str:
    """Dots beside lone letters become chr(3); then chr(1) stands between sentences."""
    before = f"([^{_WORDY}]|^)([A-Za-z])\\."
    after = f"\\.([A-Za-z])([^{_WORDY}]|$)"
    for _ in range(2):
        x = f"regexp_replace({x}, '{before}', '\\1\\2' || chr(3), 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '{after}', chr(3) || '\\1\\2', 'g')"
    opener = "\\x{4e00}-\\x{9fa5}A-Za-z0-9(\\[\"''"
    x = f"regexp_replace({x}, '([。?？!！;；….])[{_WS}]*([{opener}])', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace({x}, chr(3), '.')"


def _sentences(x: str) -> str:
    return _clean(f"string_split({_marked(x)}, chr(1))")


def _commas(x: str) -> str:
    return _clean(f"string_split(regexp_replace({x}, '([，；,;])', '\\1' || chr(10), 'g'), chr(10))")


def _spaces(x: str, most: int) -> str:
    words = f"list_filter(string_split_regex({x}, '[{_WS}]+'), lambda x: x <> '')"
    now = "regexp_extract(acc, '[^\\x02]*$')"
    fold = f"list_reduce({words}, lambda acc, w: CASE WHEN length({now}) + length(w) + 1 <= {most} THEN acc || w || ' ' ELSE acc || chr(2) || w || ' ' END, '')"
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_transform(string_split({fold}, chr(2)), lambda x: rtrim(x)) END"


def _segments(x: str, most: int) -> str:
    inner = f"flatten(list_transform({_commas('s')}, lambda p: CASE WHEN length(p) <= {most} THEN [p] ELSE {_spaces('p', most)} END))"
    return f"flatten(list_transform({_sentences(x)}, lambda s: CASE WHEN length(s) <= {most} THEN [s] ELSE {inner} END))"


def _length(x: str) -> str:
    runs = f"regexp_extract_all(regexp_replace({x}, '[{_WS}]+', '', 'g'), '[a-zA-Z]+\\p{{Nd}}+|\\p{{Nd}}+[a-zA-Z]+|[a-zA-Z]+|\\p{{Nd}}+|[^a-zA-Z\\p{{Nd}}]+')"
    weight = "CASE WHEN regexp_full_match(m, '[a-zA-Z]+') THEN 0.47::DOUBLE WHEN regexp_matches(m, '^[a-zA-Z\\p{Nd}]') THEN length(m) * 0.01::DOUBLE ELSE length(m)::DOUBLE END"
    return f"floor(list_reduce(list_transform({runs}, lambda m: {weight}), lambda a, b: a + b, 0.0::DOUBLE))::INTEGER"


def _tokens(x: str, stop: bool = True) -> str:
    more = f" AND NOT list_contains({_STOP}, t)" if stop else ""
    return f"list_filter(regexp_extract_all({x}, '[{_WORDY}]+'), lambda t: length(t) > {2 if stop else 0}{more})"


def chunk_ctes(most: int, overlap: int = 10, texts: str = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL") -> str:
    """chunks(doc_id, text, idx, chunk, n): idx from 0."""
    none = "CAST([] AS STRUCT(a INTEGER, b INTEGER)[])"
    lap = f"coalesce(list_min(list_filter(range(st, i), lambda k: list_sum(l[k:i - 1]) <= {overlap})), i - 1)::INTEGER"
    flush = f"CASE WHEN st < i THEN [{{'a': st, 'b': i - 1}}] ELSE {none} END"
    return f"""
texts AS ({texts}),
segs AS (SELECT doc_id, text, {_segments('text', most)} AS s FROM texts),
lens AS (SELECT doc_id, text, s, list_transform(s, lambda x: {_length('x')}) AS l FROM segs WHERE len(s) > 0),
packs AS (
  SELECT doc_id, 1 AS i, 1 AS st, 0 AS c, {none} AS made, l FROM lens
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN l[i] > {most} THEN i + 1 WHEN st < i AND c + l[i] > {most} THEN {lap} ELSE st END,
    CASE WHEN l[i] > {most} THEN 0 WHEN st < i AND c + l[i] > {most} THEN (list_sum(l[{lap}:i - 1]) + l[i])::INTEGER ELSE c + l[i] END,
    CASE WHEN l[i] > {most} THEN list_concat({flush}, [{{'a': i, 'b': i}}]) WHEN st < i AND c + l[i] > {most} THEN {flush} ELSE {none} END,
    l
  FROM packs WHERE i <= len(l)
),
ranges AS (
  SELECT doc_id, unnest(made) AS r FROM packs
  UNION ALL SELECT doc_id, {{'a': st, 'b': len(l)::INTEGER}} FROM packs WHERE i = len(l) + 1 AND st <= len(l)
),
raw AS (SELECT doc_id, text, array_to_string(s[r.a:r.b], ' ') AS chunk, row_number() OVER (PARTITION BY doc_id ORDER BY r.b) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM ranges JOIN lens USING (doc_id)),
tails AS (SELECT doc_id, chunk AS tail, n AS at FROM raw WHERE k = n AND n >= 2 AND {_length('chunk')} < 16),
chunks AS (
  SELECT doc_id, text, (k - 1)::INTEGER AS idx, CASE WHEN tail IS NOT NULL AND k = n - 1 THEN chunk || ' ' || tail ELSE chunk END AS chunk, n - (tail IS NOT NULL)::INTEGER AS n
  FROM raw LEFT JOIN tails USING (doc_id) WHERE tail IS NULL OR k < n
)"""


def token_ctes(most: int) -> str:
    return (
        chunk_ctes(most)
        + f""",
toks AS (SELECT doc_id, text, idx, chunk, n, {_tokens('chunk')} AS ts FROM chunks),
tf AS (SELECT doc_id, idx, token, count(*) AS tf FROM (SELECT doc_id, idx, unnest(ts) AS token FROM toks) GROUP BY ALL),
df AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL),
stat AS (SELECT doc_id, count(*) AS n, avg(len(ts)) AS al FROM toks GROUP BY ALL),
asked AS (SELECT doc_id, b.text AS query, list_distinct({_tokens('b.text')}) AS qs FROM documents JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""
    )


_BM25 = "ln((s.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / al))"
_TFIDF = "tf / len(ts) * ln(s.n / (df + 1))"


def score_ctes(most: int, term: str, query: bool) -> str:
    ask = "JOIN asked USING (doc_id)" if query else ""
    when = "list_contains(qs, token) OR query = ''" if query else "true"
    return (
        token_ctes(most)
        + f""",
scored AS (
  SELECT doc_id, idx, any_value(text) AS text, any_value(chunk) AS chunk, round(coalesce(sum(CASE WHEN {when} THEN {term} ELSE 0 END), 0), 12) AS score
  FROM toks JOIN stat s USING (doc_id) {ask} LEFT JOIN tf USING (doc_id, idx) LEFT JOIN df USING (doc_id, token) GROUP BY doc_id, idx
),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rk FROM scored)"""
    )


def _skip(most: int) -> str:
    return f""",
walk AS (
  SELECT doc_id, 0::BIGINT AS rk, 0::BIGINT AS used, -1 AS idx, false AS picked FROM (SELECT DISTINCT doc_id FROM ranks)
  UNION ALL
  SELECT w.doc_id, r.rk, CASE WHEN used + length(r.chunk) <= {most} THEN used + length(r.chunk) ELSE used END, r.idx, used + length(r.chunk) <= {most}
  FROM walk w JOIN ranks r ON r.doc_id = w.doc_id AND r.rk = w.rk + 1
)"""


_STOPPED = "(SELECT *, sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY rk) AS used FROM ranks)"


def _compressed(picks: str, out: str = "compressed_text") -> str:
    return f"(SELECT doc_id, any_value(text) AS text, string_agg(chunk, '' ORDER BY idx) AS {out}, count(*)::INTEGER AS n_selected FROM {picks} GROUP BY doc_id)"


def _compress_sql(ctes: str, picks: str) -> str:
    return f"WITH RECURSIVE {ctes} SELECT d.doc_id, coalesce(compressed_text, '') AS compressed_text, round(length(coalesce(compressed_text, '')) / length(d.text), 6) AS compression_ratio, coalesce(n_selected, 0) AS n_selected FROM (SELECT DISTINCT doc_id, text FROM ranks) d LEFT JOIN {_compressed(picks)} c USING (doc_id)"


_POS = "pos AS (SELECT doc_id, idx, unnest(ts) AS token, generate_subscripts(ts, 1) AS p FROM toks)"
_EDGES = f"""{_POS},
edges AS (SELECT a.doc_id, least(a.token, b.token) AS src, greatest(a.token, b.token) AS dst, sum(1.0::DOUBLE / (b.p - a.p)) AS weight FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.idx = b.idx AND b.p IN (a.p + 1, a.p + 2, a.p + 3) AND a.token <> b.token GROUP BY ALL HAVING weight >= 0.1)"""


def _rank_rounds(rounds: int) -> str:
    out = """,
both_ AS (SELECT doc_id, src, dst, weight FROM edges UNION ALL SELECT doc_id, dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT doc_id, src, dst, weight / sum(weight) OVER (PARTITION BY doc_id, src) AS share FROM both_),
r0 AS (SELECT DISTINCT doc_id, src AS token, 1.0::DOUBLE / c.n AS rank, c.n FROM both_ JOIN (SELECT doc_id, count(DISTINCT src) AS n FROM both_ GROUP BY 1) c USING (doc_id))"""
    for k in range(rounds):
        out += f",\nr{k + 1} AS (SELECT s.doc_id, dst AS token, 0.85::DOUBLE * sum(rank * share) + 0.15::DOUBLE / any_value(n) AS rank, any_value(n) AS n FROM shares s JOIN r{k} r ON s.doc_id = r.doc_id AND s.src = r.token GROUP BY 1, 2)"
    return out


#: From edges(doc_id, src, dst, weight): ranked(doc_id, token, rank), iterated for each document until its ranks change by less than
#: 1e-6 for each of its nodes on the average, 100 rounds at most.
_CONVERGED = """,
both_ AS (SELECT doc_id, src, dst, weight FROM edges UNION ALL SELECT doc_id, dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT doc_id, src, dst, weight / sum(weight) OVER (PARTITION BY doc_id, src) AS share FROM both_),
rounds AS (
  SELECT doc_id, src AS token, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS rank, count(*) OVER (PARTITION BY doc_id) AS n, 0 AS round, false AS done FROM (SELECT DISTINCT doc_id, src FROM shares)
  UNION ALL
  SELECT doc_id, token, rank, n, round, sum(abs(rank - was)) OVER (PARTITION BY doc_id) < n * 1e-6::DOUBLE FROM (
    SELECT g.doc_id, g.token, g.rank, w.n, w.round + 1 AS round, w.rank AS was
    FROM (SELECT s.doc_id, s.dst AS token, 0.85::DOUBLE * sum(r.rank * s.share) + 0.15::DOUBLE / any_value(r.n) AS rank FROM rounds r JOIN shares s ON s.doc_id = r.doc_id AND s.src = r.token WHERE NOT r.done AND r.round < 100 GROUP BY 1, 2) g
    JOIN rounds w ON w.doc_id = g.doc_id AND w.token = g.token
  )
),
ranked AS (SELECT doc_id, token, rank FROM rounds WHERE done)"""
_FIRST = "first_ AS (SELECT doc_id, idx, token, sum(1.0::DOUBLE / p) * pow(0.95::DOUBLE, min(p) - 1) AS pw FROM pos GROUP BY 1, 2, 3)"
_EACH = "each_ AS (SELECT doc_id, idx, token, sum(1.0::DOUBLE / p * pow(0.95::DOUBLE, p - 1)) AS pw FROM pos GROUP BY 1, 2, 3)"
_MEAN = "raw_ AS (SELECT doc_id, idx, token, s.n, tf * (ln((1 + s.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, token) JOIN stat s USING (doc_id)), unit AS (SELECT doc_id, token, n, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, idx)) AS u FROM raw_), mean_ AS (SELECT doc_id, token, sum(u) / any_value(n) AS weight FROM unit GROUP BY 1, 2)"
_NEAR = "near AS (SELECT a.doc_id, a.idx, a.token AS a, b.token AS b, b.p - a.p AS d FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.idx = b.idx AND b.p IN (a.p + 1, a.p + 2, a.p + 3) AND a.token <> b.token)"


def _occurrences(weight: str, joins: str = "") -> str:
    """edges, of occurrences of which each must reach 0.1; those with a token of the query count twice."""
    return f"edges AS (SELECT doc_id, least(a, b) AS src, greatest(a, b) AS dst, sum(w) AS weight FROM (SELECT doc_id, a, b, {weight} * CASE WHEN list_contains(qs, a) OR list_contains(qs, b) THEN 2 ELSE 1 END AS w FROM near JOIN asked USING (doc_id) {joins}) WHERE w >= 0.1 GROUP BY ALL)"


def _summed(value: str, joins: str = "", whole: str = "{}") -> str:
    """The score of each chunk: the sum of a value over its distinct tokens."""
    total = f"coalesce(sum(coalesce(rank, 0) * ({value})), 0)"
    return f" SELECT t.doc_id, t.idx AS chunk_idx, round({whole.format(total)}, 6) AS score FROM toks t JOIN asked USING (doc_id) LEFT JOIN tf USING (doc_id, idx) LEFT JOIN ranked USING (doc_id, token) {joins} GROUP BY 1, 2"


_ASKED = "list_contains(qs, token)"
_ONLY = f"CASE WHEN query = '' OR {_ASKED} THEN 1 ELSE 0 END"


def _word_rankers(toks: str) -> dict[str, str]:
    """The graph rankers' scores; toks: the query's beginning, up to the tokens' tables."""
    out, twice = {}, f"CASE WHEN {_ASKED} THEN 3 ELSE 1 END"
    by_token = lambda t, name: "".join(f" LEFT JOIN {t} {name}{x} ON {name}{x}.doc_id = near.doc_id AND {name}{x}.token = {x}" + (f" AND {name}{x}.idx = near.idx" if t == "first_" else "") for x in "ab")
    occ = lambda weight, joins="": _occurrences(weight, joins).replace("SELECT doc_id, a, b", "SELECT near.doc_id, a, b")
    out["textrank"] = f"{toks}, {_EDGES}{_CONVERGED}{_summed(_ONLY)}"
    lead = "lead_ AS (SELECT doc_id, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM tf WHERE idx = 0)"
    out["singlerank"] = f"{toks}, {_POS}, {_NEAR}, {lead}, {occ('coalesce(wa.weight, 0) * coalesce(wb.weight, 0) / d', by_token('lead_', 'w'))}{_CONVERGED}{_summed(twice)}"
    out["positionrank"] = f"{toks}, {_POS}, {_NEAR}, {_FIRST}, {occ('wa.pw * wb.pw / d', by_token('first_', 'w'))}{_CONVERGED}{_summed(f'pw * {twice}', 'LEFT JOIN first_ USING (doc_id, idx, token)')}"
    for flags in ("ff", "tf", "ft", "tt"):
        tfidf, place = flags[0] == "t", flags[1] == "t"
        weight = " * ".join((["wa.weight * wb.weight"] if tfidf else []) + (["1.0::DOUBLE / d"] if place else [])) or "1.0::DOUBLE"
        value = " * ".join((["weight"] if tfidf else []) + (["pw"] if place else [])) or "1"
        more = ("LEFT JOIN mean_ USING (doc_id, token) " if tfidf else "") + ("LEFT JOIN each_ USING (doc_id, idx, token)" if place else "")
        ctes = ", ".join([_POS, _NEAR, *([_MEAN] if tfidf else []), *([_EACH] if place else [])])
        out[f"combined_{flags}"] = f"{toks}, {ctes}, {occ(weight, by_token('mean_', 'w') if tfidf else '')}{_CONVERGED}{_summed(f'{value} + CASE WHEN {_ASKED} THEN 2 ELSE 0 END', more, '{} / greatest(count(token), 1)')}"
    like = "norms AS (SELECT doc_id, token, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1, 2), edges AS (SELECT d.doc_id, src, dst, dot / (x.norm * y.norm) AS weight FROM (SELECT a.doc_id, a.token AS src, b.token AS dst, sum(a.tf * b.tf)::DOUBLE AS dot FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.token < b.token GROUP BY ALL) d JOIN norms x ON x.doc_id = d.doc_id AND x.token = src JOIN norms y ON y.doc_id = d.doc_id AND y.token = dst WHERE dot / (x.norm * y.norm) >= 0.1)"
    out["semantic_textrank"] = f"{toks}, {like}{_CONVERGED}{_summed(_ONLY)}"
    topic = f"""low AS (SELECT doc_id, idx, token, count(*) AS tf FROM (SELECT doc_id, idx, unnest({_tokens('lower(chunk)')}) AS token FROM toks) GROUP BY ALL),
lowq AS (SELECT doc_id, unnest(list_distinct({_tokens('lower(query)')})) AS token, 1 AS q FROM asked WHERE query <> ''),
sized AS (SELECT doc_id, n + CASE WHEN query = '' THEN 0 ELSE 1 END AS n FROM stat JOIN asked USING (doc_id)),
lowdf AS (SELECT doc_id, token, count(*) + coalesce(any_value(q), 0) AS df FROM low LEFT JOIN lowq USING (doc_id, token) GROUP BY 1, 2),
lowraw AS (SELECT doc_id, idx, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM low JOIN lowdf USING (doc_id, token) JOIN sized USING (doc_id)),
vec AS (SELECT doc_id, idx, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, idx)) AS u FROM lowraw),
edges AS (SELECT a.doc_id, a.idx AS src, b.idx AS dst, sum(a.u * b.u) AS weight FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.token = b.token AND a.idx < b.idx GROUP BY ALL HAVING weight >= 0.1)"""
    boost = "CASE WHEN query <> '' AND len(qs) > 0 THEN 1 + len(list_intersect(list_distinct(ts), qs)) / len(qs) ELSE 1 END"
    out["topicrank"] = f"{toks}, {topic}{_CONVERGED} SELECT t.doc_id, t.idx AS chunk_idx, round(CASE WHEN t.doc_id IN (SELECT doc_id FROM edges) THEN coalesce(rank, 0) * {boost} ELSE 1.0::DOUBLE / t.n END, 6) AS score FROM toks t JOIN asked USING (doc_id) LEFT JOIN ranked r ON r.doc_id = t.doc_id AND r.token = t.idx"
    return out


def _html() -> str:
    esc = "x"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        esc = f"replace({esc}, '{a}', '{b}')"
    esc = f"replace(replace({esc}, chr(9), '{'&nbsp;' * 4}'), chr(10), '<br>')"
    colours = "[" + ", ".join(f"'{c}'" for c in PALETTE) + "]"
    span = f"'<span style=\"background-color: ' || {colours}[idx % {len(PALETTE)} + 1] || '; border-radius: 3px\">' || {esc.replace('(x,', '(chunk,')} || '</span>'"
    return f"SELECT doc_id, '<div style=\"white-space: pre-wrap\">' || string_agg({span}, ' ' ORDER BY idx) || '</div>' AS html FROM chunks GROUP BY doc_id"


def _numbered(expr: str, name: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, (generate_subscripts(l, 1) - 1)::INTEGER AS idx, unnest(l) AS {name} FROM (SELECT {key}, {expr} AS l FROM {table})"


def _similarity(most: int) -> str:
    """Both selections for every document and each part of its query, and the dot products of letter counts."""
    letters = lambda x: "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
    ctes = score_ctes(most, _BM25, True).replace("asked AS (SELECT doc_id, b.text AS query, list_distinct(" + _tokens("b.text") + ") AS qs FROM", "asked_ AS (SELECT doc_id, unnest(" + _clean("string_split(b.text, '?')") + ") AS query FROM")
    ctes = ctes.replace("scored AS (", f"asked AS (SELECT doc_id, query, list_distinct({_tokens('query')}) AS qs FROM (SELECT DISTINCT doc_id, query FROM asked_)),\nscored AS (", 1)
    ctes = ctes.replace("SELECT doc_id, idx, any_value(text)", "SELECT doc_id, query, idx, any_value(text)").replace("GROUP BY doc_id, idx\n", "GROUP BY doc_id, query, idx\n").replace("PARTITION BY doc_id ORDER BY score", "PARTITION BY doc_id, query ORDER BY score")
    picked = lambda t: f"(SELECT doc_id, query, string_agg(chunk, '' ORDER BY idx) AS made FROM {t} GROUP BY 1, 2)"
    stopped = "(SELECT * FROM (SELECT *, sum(length(chunk)) OVER (PARTITION BY doc_id, query ORDER BY rk) AS used FROM ranks) WHERE used <= 2048)"
    like = lambda m: f"list_dot_product({letters('lower(query)')}, {letters(f'lower({m})')})"
    return f"WITH RECURSIVE {ctes} SELECT doc_id, query, {like('x')} AS by_length, {like('y')} AS by_topn, round(length(x) / length(text), 6) AS ratio_by_length, round(length(y) / length(text), 6) AS ratio_by_topn FROM (SELECT d.doc_id, d.query, d.text, coalesce(l.made, '') AS x, t.made AS y FROM (SELECT DISTINCT doc_id, query, text FROM ranks) d LEFT JOIN {picked(stopped)} l USING (doc_id, query) LEFT JOIN {picked('(SELECT * FROM ranks WHERE rk <= 5)')} t USING (doc_id, query))"


def oracle_sql() -> dict[str, str]:
    small, full = 20, 150
    toks = f"WITH RECURSIVE {token_ctes(small)} "
    bm = lambda q: score_ctes(small, _BM25, q)
    ti = lambda q: score_ctes(small, _TFIDF, q)
    rows = " SELECT doc_id, idx AS chunk_idx, round(score, 6) AS score FROM scored"
    pick = "SELECT doc_id, idx AS chunk_idx FROM "
    skipped = f"WITH RECURSIVE {bm(False)}{_skip(900)} "
    cos = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
    norm = lambda t: f"sqrt(list_sum(list_transform({t}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
    near = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
    latin = "len(regexp_extract_all(text, '{}'))"
    both = f"WITH RECURSIVE {score_ctes(full, _BM25, False)} SELECT d.doc_id, coalesce(by_length, '') AS by_length, by_topn FROM {_compressed('(SELECT * FROM ranks WHERE rk <= 5)', 'by_topn')} d LEFT JOIN {_compressed(f'(SELECT * FROM {_STOPPED} WHERE used <= 2048)', 'by_length')} l USING (doc_id)"
    return {
        "sentence_split": _numbered(_sentences("text"), "sentence"),
        "segment_split": _numbered(_segments("text", 100), "segment"),
        "comma_split": _numbered(_commas("text"), "piece"),
        "space_split": _numbered(_spaces("text", 80), "piece"),
        "custom_length": f"SELECT doc_id, {_length('text')} AS weighted_length FROM documents",
        "pdf_clean": f"SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10), 'g'), '[{_WS}]+', ' ', 'g') AS cleaned FROM documents",
        "chunk_pack": f"WITH RECURSIVE {chunk_ctes(small)} SELECT doc_id, idx AS chunk_idx, chunk FROM chunks",
        "chunk_pack_full": f"WITH RECURSIVE {chunk_ctes(full)} SELECT doc_id, idx AS chunk_idx, chunk FROM chunks",
        "chunk_counts": f"WITH RECURSIVE {chunk_ctes(small)} SELECT doc_id, n_chunks, (sum(n_chunks) OVER (ORDER BY doc_id))::BIGINT AS cumulative FROM (SELECT d.doc_id, count(c.idx) AS n_chunks FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY 1)",
        "tokenize_en": _numbered(_tokens("text"), "token").replace(" AS idx", " AS pos"),
        "stopword_anti": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text', False)}) AS token FROM documents) WHERE NOT list_contains({_STOP}, token) GROUP BY token",
        "query_split": _numbered(_clean("string_split('  ' || replace(text, '.', '? ') || '?', '?')"), "term", "benchmark", "item_id"),
        "part_files": "SELECT doc_id, p::INTEGER AS part, 'doc' || doc_id || '_part' || p || '.txt' AS part_name FROM documents, range(1, 11) t(p)",
        "detect_language": f"SELECT doc_id, CASE WHEN a > 0 AND h * 5 >= a THEN 'zh' WHEN a > 0 AND l * 2 > a THEN 'en' END AS detected FROM (SELECT doc_id, {latin.format(r'\p{Han}')} AS h, {latin.format(r'\p{Latin}')} AS l, {latin.format(r'\p{L}')} AS a FROM documents)",
        "highlight_html": f"WITH RECURSIVE {chunk_ctes(full)} {_html()}",
        "term_frequency": toks + "SELECT doc_id, idx AS chunk_idx, token, tf FROM tf",
        "document_frequency": toks + "SELECT doc_id, token, df FROM df",
        "chunk_length_mean": toks + "SELECT doc_id, n AS n_chunks, round(al, 6) AS avg_tokens FROM stat",
        "vocabulary": toks + "SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_distinct FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM df GROUP BY 1) USING (doc_id)",
        "query_overlap": toks + "SELECT doc_id, idx AS chunk_idx, len(list_intersect(list_distinct(ts), qs))::INTEGER AS shared FROM toks JOIN asked USING (doc_id)",
        "bm25_query": f"WITH RECURSIVE {bm(True)}{rows}",
        "bm25_noquery": f"WITH RECURSIVE {bm(False)}{rows}",
        "tfidf_query": f"WITH RECURSIVE {ti(True)}{rows}",
        "tfidf_noquery": f"WITH RECURSIVE {ti(False)}{rows}",
        "select_topn": f"WITH RECURSIVE {bm(False)} {pick} ranks WHERE rk <= 3",
        "select_stop": f"WITH RECURSIVE {bm(False)} {pick} {_STOPPED} WHERE used <= 900",
        "select_skip": f"{skipped} {pick} walk WHERE picked",
        "select_both": f"{skipped} {pick} walk WHERE picked OR rk BETWEEN 1 AND 3",
        "compress_bm25": _compress_sql(score_ctes(full, _BM25, True), "(SELECT * FROM ranks WHERE rk <= 5)"),
        "compress_tfidf": _compress_sql(score_ctes(full, _TFIDF, True), f"(SELECT * FROM {_STOPPED} WHERE used <= 2048)"),
        "compress_both_ways": both,
        "cooc_edges": f"WITH RECURSIVE {token_ctes(small)}, {_EDGES} SELECT doc_id, src, dst, round(weight, 9) AS weight FROM edges",
        "position_weights_first": f"WITH RECURSIVE {token_ctes(small)}, {_POS} SELECT doc_id, idx AS chunk_idx, token, round(sum(1.0::DOUBLE / p) * pow(0.95::DOUBLE, min(p) - 1), 9) AS weight FROM pos GROUP BY 1, 2, 3",
        "position_weights_each": f"WITH RECURSIVE {token_ctes(small)}, {_POS} SELECT doc_id, idx AS chunk_idx, token, round(sum(1.0::DOUBLE / p * pow(0.95::DOUBLE, p - 1)), 9) AS weight FROM pos GROUP BY 1, 2, 3",
        "tfidf_mean": toks + ", raw_ AS (SELECT doc_id, idx, token, s.n, tf * (ln((1 + s.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, token) JOIN stat s USING (doc_id)), unit AS (SELECT doc_id, token, n, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, idx)) AS u FROM raw_) SELECT doc_id, token, round(sum(u) / any_value(n), 9) AS weight FROM unit GROUP BY 1, 2",
        "pagerank_fixed": f"WITH RECURSIVE {token_ctes(small)}, {_EDGES}{_rank_rounds(10)} SELECT doc_id, token, round(rank, 8) AS rank FROM r10",
        **_word_rankers(f"WITH RECURSIVE {token_ctes(small)}"),
        "random_excerpt": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1 + (('0x' || substring(md5(doc_id || ':0'), 1, 15))::BIGINT % (length(text) - 199))::INTEGER, 200) WHEN text <> '' THEN text END AS excerpt FROM documents",
        "query_similarity": _similarity(full),
        "embedding_dot": f"SELECT a.vec_id, round({cos}, 4) AS dot {near}",
        "embedding_cosine": f"SELECT a.vec_id, round({cos} / ({norm('a')} * {norm('b')}), 4) AS cosine {near}",
        "function_usage": 'SELECT event_type AS func, count(*) AS "count", round(sum(value), 4) AS total_time, round(avg(value), 4) AS mean_time, round(max(value), 4) AS max_time, max(ts) AS last_used FROM events GROUP BY 1',
    }
