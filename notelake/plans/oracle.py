"""DuckDB SQL for the engine's queries over the same tables.

Constants are written out here a second time, on purpose: a wrong one in the engine shows.
"""

from __future__ import annotations

#: Terms of the glossary: title, aliases, status.
GLOSSARY = [("the of", ["and"], "approved"), ("in", ["que", "der"], "approved"), ("is", ["one"], "proposed"), ("The Of", [], "draft"), ("erst", ["and", "re"], "approved")]
#: Fixed values.
NOTE_WEIGHTS = {"path": 0.1, "type": 1.5, "title": 8.0, "description": 4.0, "tags": 6.0, "aliases": 6.0, "systems": 5.0, "signals": 5.0, "body": 0.2, "content": 3.0}
PASSAGE_WEIGHTS = {"type": 1.5, "title": 8.0, "tags": 6.0, "systems": 5.0, "heading": 4.0, "text": 1.0, "content": 3.0}
STOPWORDS = "a an and are as at be by com da das de do dos e em for from in into is it na nas no nos o of on or os ou para por que sem the to um uma with"
SECRETS = (
    ("private key block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("GitHub token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("token assignment", r"""token = "[0-9a-f]{40}\""""),
)

_FIELDS = r"'(?i)\b(path|type|title|description|tags|extra|body|content):'"
_WORDS = r"'[\p{L}\p{N}_]+'"
_NOTES = """notes AS (
    SELECT *, concat_ws(chr(10), nullif(type, ''), nullif(title, ''), nullif(description, ''), nullif(tags, ''), nullif(systems, '')) AS content FROM (
        SELECT 'docs/' || lpad(doc_id::VARCHAR, 8, '0') || '.md' AS path, source AS type,
            array_to_string(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:8], ' ') AS title,
            coalesce(string_split(coalesce(text, ''), chr(10))[2], '') AS description, lang AS tags, '' AS aliases,
            lang || '-' || source AS systems, '' AS signals, coalesce(text, '') AS body FROM documents))"""


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace({text}, {_FIELDS}, ' ', 'g'), {_WORDS}), lambda t: upper(t) NOT IN ('AND', 'OR', 'NOT', 'NEAR'))"


def _terms(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"


def _words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), {_WORDS}))"


_TOPICS = "topics AS (SELECT item_id AS query_id, text AS query, text FROM benchmark)"
_TITLES = "topics AS (SELECT page_id AS query_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS query FROM pages)"
_QWORDS = f"""qall AS (SELECT query_id, {_tokens("query")} AS toks FROM topics),
qpos AS (SELECT query_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS p FROM qall),
qwords AS (SELECT query_id, arg_min(token, p) AS token, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) - 1 AS pos FROM qpos GROUP BY query_id, lower(token))"""


def _occ(rows: str, key: str, weights: dict[str, float]) -> str:
    parts = " UNION ALL ".join(f"SELECT {key} AS row_id, '{c}' AS field, {w!r}::DOUBLE AS weight, {_terms(c)} AS ts FROM {rows}" for c, w in weights.items())
    return f"""fields AS ({parts}),
occ AS (SELECT row_id, field, weight, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM fields),
lens AS (SELECT row_id, sum(len(ts))::DOUBLE AS len FROM fields GROUP BY row_id),
vocab AS (SELECT DISTINCT term FROM occ)"""


_PHRASE_HITS = """pk AS (SELECT query_id, run, group_id, phrase_id, len(terms) AS m, unnest(terms) AS term, generate_subscripts(terms, 1) AS k FROM phrases WHERE NOT prefix),
placed AS (SELECT query_id, run, group_id, phrase_id, row_id, field, pos - k AS a, max(m) AS m, count(*) AS c, max(weight) AS weight FROM pk JOIN occ USING (term) GROUP BY ALL HAVING count(*) = max(m)),
grown AS (SELECT query_id, run, group_id, phrase_id, row_id, weight FROM phrases JOIN vocab ON prefix AND starts_with(vocab.term, phrases.terms[len(phrases.terms)]) JOIN occ ON occ.term = vocab.term),
hits AS (SELECT query_id, run, group_id, phrase_id, row_id, sum(weight) AS f FROM (SELECT query_id, run, group_id, phrase_id, row_id, weight FROM placed UNION ALL SELECT * FROM grown) GROUP BY ALL)"""
_BM25 = f"""{_PHRASE_HITS},
dfs AS (SELECT query_id, run, phrase_id, count(*)::DOUBLE AS df FROM hits GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM lens),
need AS (SELECT query_id, run, count(DISTINCT group_id) AS needed FROM phrases GROUP BY ALL),
raws AS (SELECT h.*, len, mean, ln((n - df + 0.5e0) / (df + 0.5e0)) AS raw FROM hits h JOIN dfs USING (query_id, run, phrase_id) JOIN lens USING (row_id) CROSS JOIN st),
scored AS (SELECT query_id, run, row_id, -sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))) AS score, count(DISTINCT group_id) AS groups FROM raws GROUP BY ALL),
scores AS (SELECT query_id, run, row_id, score FROM scored JOIN need USING (query_id, run) WHERE groups = needed)"""


def _ranked(limit: int, source: str = "scores", name: str = "ranked") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, run ORDER BY round(score, 9), row_id) AS rank FROM {source}) WHERE rank <= {limit})"


def _run(kind: str, run: int) -> str:
    """A run's phrases from qwords."""
    if kind == "strict":
        return f"SELECT query_id, {run} AS run, pos AS group_id, pos AS phrase_id, {_terms('token')} AS terms, false AS prefix FROM qwords"
    if kind == "or":
        return f"SELECT query_id, {run} AS run, 0 AS group_id, pos AS phrase_id, {_terms('token')} AS terms, false AS prefix FROM qwords"
    if kind == "prefix":
        return f"SELECT query_id, {run}, 0, min(pos), {_terms('stem')}, true FROM (SELECT query_id, pos, {_stem('token')} AS stem FROM qwords) WHERE stem IS NOT NULL GROUP BY query_id, stem"
    only = " WHERE grown" if kind == "glossary" else ""
    return f"SELECT query_id, {run}, group_id, group_id * 1000 + k, {_terms('member')}, false FROM (SELECT query_id, group_id, unnest(members) AS member, generate_subscripts(members, 1) - 1 AS k FROM groups{only})"


def _stem(token: str) -> str:
    low = f"lower({token})"
    cases = " ".join(f"WHEN ends_with({low}, '{e}') AND length({token}) - {len(e)} >= 5 THEN {low}[1:length({token}) - {len(e)}]" for e in ("ations", "ation", "ions", "ing", "ion", "ed"))
    return rf"CASE WHEN regexp_full_match({token}, '\p{{L}}{{5,}}') AND upper({token}) <> {token} THEN CASE {cases} WHEN ends_with({low}, 's') AND NOT ends_with({low}, 'es') AND length({token}) >= 6 THEN {low}[1:length({token}) - 1] END END"


_TERM_ROWS = ", ".join(f"('{t}', {al!r}::VARCHAR[], '{s}')" for t, al, s in GLOSSARY)
_TGROUPS = f"""terms0 AS (SELECT * FROM (VALUES {_TERM_ROWS}) AS g(title, aliases, status)),
tw AS (SELECT {_words("title || ' ' || array_to_string(aliases, ' ')")} AS members FROM terms0 WHERE status = 'approved'),
te AS (SELECT unnest(members) AS token_low, members FROM tw),
tgroups AS (SELECT token_low, list_sort(list_distinct(flatten(list(members)))) AS members FROM te GROUP BY token_low)"""
_MEMBERS = """gmem AS (SELECT query_id, pos, list_concat([token], list_filter(coalesce(members, []::VARCHAR[]), lambda m: strip_accents(lower(m)) <> strip_accents(lower(token)))) AS members FROM qwords LEFT JOIN tgroups ON strip_accents(lower(token)) = token_low),
ggrow0 AS (SELECT *, max((len(members) > 1)::INT) OVER (PARTITION BY query_id) = 1 AS grown FROM gmem),
ggrow AS (SELECT *, array_to_string(list_sort(list_transform(members, lambda m: CASE WHEN grown THEN strip_accents(lower(m)) ELSE lower(m) END)), chr(10)) AS gkey FROM ggrow0),
groups AS (SELECT query_id, min(pos) AS group_id, arg_min(members, pos) AS members, any_value(grown) AS grown FROM ggrow GROUP BY query_id, gkey)"""
_BASE = f"WITH {_NOTES}, {_TOPICS}, {_QWORDS}, {_TGROUPS}, {_MEMBERS}, {_occ('notes', 'path', NOTE_WEIGHTS)}"


#: The same over the notes whose number doesn't end in 7.
_LATER = _BASE.replace("FROM documents))", "FROM documents WHERE doc_id % 10 <> 7))")


def _search(runs: list[tuple[str, int]], limit: int, out: str = "SELECT query_id, row_id, round(score, 6) AS score, rank FROM ranked", base: str = "") -> str:
    phrases = " UNION ALL ".join(f"SELECT * FROM ({_run(k, r)}) WHERE len(terms) > 0" for k, r in runs)
    names = "query_id, run, group_id, phrase_id, terms, prefix"
    return f"{base or _BASE}, phrases({names}) AS ({phrases.replace('WHERE len(terms) > 0', f'AS z({names}) WHERE len(terms) > 0')}), {_BM25}, {_ranked(limit)} {out}"


_SIMILAR = f"""tx AS (SELECT path, {_words("body")} AS tw FROM notes), qx AS (SELECT query_id, {_words("text")} AS qw FROM topics),
lex AS (SELECT query_id, path, round(len(list_intersect(qw, tw))::DOUBLE / len(qw), 4) AS similarity FROM tx CROSS JOIN qx WHERE len(qw) > 0 AND len(tw) > 0)"""
_USAGE = "log AS (SELECT event_id, ts, event_type AS command, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value AS duration_ms FROM events)"
_SLUG = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-') END"


def _rate(good: str, among: str) -> str:
    return f"CASE WHEN count(*) FILTER ({among}) > 0 THEN round(count(*) FILTER (({among}) AND ({good})) / count(*) FILTER ({among})::DOUBLE, 4) ELSE 1.0 END"


def _redact(text: str) -> str:
    for kind, pattern in SECRETS:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    return text




def _secret(text: str) -> str:
    return " OR ".join(f"regexp_matches({text}, '{p}')" for _, p in SECRETS)


_TALK = r"""talk AS (SELECT 'talk/' || conv_id AS path, string_agg('# ' || coalesce(role, '') || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
ls AS (SELECT path, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM talk),
lv AS (SELECT *, length(regexp_extract(t, '^(#{1,6})\s+(.+?)\s*$', 1)) AS level, regexp_extract(t, '^(#{1,6})\s+(.+?)\s*$', 2) AS heading FROM ls)"""
_SPLIT = rf"""{_TALK}, sec AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY path ORDER BY line) AS s FROM lv),
parts0 AS (SELECT path, coalesce(max(heading) FILTER (level > 0), 'Document') AS heading, min(line) AS start_line, max(line) AS end_line, regexp_replace(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS text FROM sec GROUP BY path, s),
parts AS (SELECT *, path || ':' || start_line || ':' || end_line AS passage_id, 'talk' AS type, '' AS title, '' AS tags, '' AS systems, 'talk' || chr(10) || heading AS content FROM parts0 WHERE text <> '')"""
_PARTS = f"WITH {_SPLIT}, {_TOPICS}, {_QWORDS}, {_TGROUPS}, {_MEMBERS}, {_occ('parts', 'passage_id', PASSAGE_WEIGHTS)}"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS.split())
#: The state of each group, by the hits of run 0.
_GROUPS = f"""gdf AS (SELECT query_id, group_id, count(DISTINCT row_id) AS df FROM hits WHERE run = 0 GROUP BY ALL),
common AS (SELECT *, len(list_filter(members, lambda m: lower(m) NOT IN ({_STOP}))) = 0 AS stop FROM groups),
sg AS (SELECT query_id, group_id, members, coalesce(df, 0) AS df, CASE WHEN stop THEN 'stopword' WHEN coalesce(df, 0) = 0 THEN 'zero_hit'
    WHEN n >= 30 AND df >= 10 AND df / n >= 0.8e0 THEN 'low_signal' ELSE 'eligible' END AS status, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM common LEFT JOIN gdf USING (query_id, group_id) CROSS JOIN st WHERE NOT (grown AND stop))"""
#: What a query without hits so far keeps when it is relaxed. ``had`` lists the queries with hits.
_RELAX = """part AS (SELECT query_id, run, group_id, phrase_id, row_id, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) AS part FROM raws),
sizes AS (SELECT query_id, count(*) FILTER (status = 'eligible') AS eligible, count(*) FILTER (status <> 'eligible') AS dropped, sum(idf) FILTER (status = 'eligible') AS total FROM sg GROUP BY 1),
op AS (SELECT query_id, group_id, idf, eligible, dropped, total FROM sg JOIN sizes USING (query_id) WHERE status = 'eligible' AND eligible <= 8 AND query_id NOT IN (SELECT query_id FROM had)),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), row_id) AS rank FROM (SELECT query_id, row_id, -sum(part) AS s FROM part JOIN op USING (query_id, group_id) WHERE run = 0 AND eligible > 1 GROUP BY 1, 2)) WHERE rank <= 20),
mt AS (SELECT DISTINCT c.query_id, c.row_id, c.rank, op.group_id, idf, eligible, dropped, total FROM cand c JOIN hits h ON h.query_id = c.query_id AND h.row_id = c.row_id AND h.run = 0 JOIN op ON op.query_id = h.query_id AND op.group_id = h.group_id),
rr AS (SELECT query_id, row_id, rank, eligible, dropped, count(*) AS k, count(*) / eligible AS coverage, round(sum(idf) / any_value(total), 9) AS ratio, list(group_id) AS gs FROM mt GROUP BY query_id, row_id, rank, eligible, dropped),
pick AS (SELECT query_id, gs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, coverage DESC, k DESC, rank) AS o FROM rr WHERE k >= 2 AND coverage >= 0.6e0 AND ratio >= CASE WHEN dropped > 0 THEN 0.65e0 ELSE 0.81e0 END) WHERE o = 1),
kept AS (SELECT query_id, unnest(gs) AS group_id, true AS enough FROM pick UNION ALL SELECT query_id, group_id, dropped <= 1 FROM op WHERE eligible = 1)"""
_LADDER = f"""{_GROUPS}, sig AS (SELECT DISTINCT query_id FROM sg WHERE status = 'eligible'),
f12 AS (SELECT * FROM scores WHERE run IN (1, 2) AND query_id IN (SELECT query_id FROM sig)), had AS (SELECT DISTINCT query_id FROM f12), {_RELAX},
f3 AS (SELECT query_id, 3 AS run, row_id, -sum(part) AS score FROM part JOIN kept USING (query_id, group_id) WHERE run = 0 AND enough GROUP BY query_id, row_id HAVING count(DISTINCT group_id) = (SELECT count(*) FROM kept k2 WHERE k2.query_id = part.query_id)),
ladder AS (SELECT * FROM f12 UNION ALL SELECT * FROM f3),
stage AS (SELECT * FROM ladder JOIN (SELECT query_id, min(run) AS run FROM ladder GROUP BY 1) USING (query_id, run)),
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), row_id) AS rk FROM stage) WHERE rk <= 3)"""
_DIAGNOSE = f"""{_GROUPS}, had AS (SELECT DISTINCT query_id FROM scores WHERE run = 2), {_RELAX},
zr AS (SELECT query_id, string_agg(members[1], ' ' ORDER BY group_id) FILTER (status = 'zero_hit') AS zero, count(*) FILTER (status = 'eligible') AS eligible FROM sg GROUP BY 1),
fx AS (SELECT query_id, string_agg(CASE WHEN len(members) = 1 THEN '"' || members[1] || '"' ELSE '("' || array_to_string(members, '" OR "') || '")' END, ' AND ' ORDER BY group_id) AS relaxed, bool_and(enough) AS enough FROM sg JOIN kept USING (query_id, group_id) GROUP BY 1),
dg AS (SELECT t.query_id, coalesce(array_to_string(list_transform(toks, lambda x: '"' || x || '"'), ' '), '') AS strict_query, coalesce(zero, '') AS zero, coalesce(eligible, 0) = 0 AS silent, t.query_id IN (SELECT query_id FROM had) AND coalesce(eligible, 0) > 0 AS rows_, coalesce(relaxed, '') AS relaxed, coalesce(enough, false) AS enough FROM qall t LEFT JOIN zr USING (query_id) LEFT JOIN fx USING (query_id))
SELECT query_id, strict_query, CASE WHEN strict_query = '' OR rows_ THEN '' ELSE zero END AS zero_hit_terms, CASE WHEN rows_ OR silent THEN '' ELSE relaxed END AS relaxed_query, enough AND NOT rows_ AND NOT silent AS relaxation_applied,
    CASE WHEN strict_query = '' OR rows_ OR (enough AND NOT silent) THEN '' ELSE 'no_signal' END AS reason FROM dg"""


_BITS = r"'[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+'"
#: Snippets of (query_id, row_id) in ``shown``: twelve terms of the text as it stands, from where most different words are met.
_SNIPPETS = rf"""dw AS (SELECT s.query_id, s.row_id, unnest(['c', 'b']) AS col, unnest([n.content, n.body]) AS txt, {_terms("array_to_string(q.toks, ' ')")} AS wanted FROM shown s JOIN notes n ON n.path = s.row_id JOIN qall q USING (query_id)),
sp AS (SELECT *, regexp_extract_all(txt, {_BITS}) AS ps FROM dw),
so AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '[\p{{L}}\p{{N}}]')) AS tk FROM sp),
sh AS (SELECT *, list_transform(range(0, greatest(len(tk) - 12, 0) + 1), lambda i: len(list_intersect(list_transform(tk[i + 1:i + 12], lambda j: strip_accents(lower(ps[j]))), wanted))) AS hs FROM so),
ss AS (SELECT *, list_position(hs, list_max(hs)) - 1 AS s FROM sh),
sx AS (SELECT query_id, row_id, col, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(ps[CASE WHEN s = 0 THEN 1 ELSE tk[s + 1] END:CASE WHEN s + 12 >= len(tk) THEN len(ps) ELSE tk[s + 12] END], lambda p: CASE WHEN list_contains(wanted, strip_accents(lower(p))) THEN chr(1) || p || chr(2) ELSE p END), '') || CASE WHEN s + 12 < len(tk) THEN '...' ELSE '' END AS x FROM ss),
cb AS (SELECT query_id, row_id, coalesce(max(x) FILTER (col = 'c'), '') AS c, coalesce(max(x) FILTER (col = 'b'), '') AS b FROM sx GROUP BY 1, 2),
snip AS (SELECT query_id, row_id, replace(replace(CASE WHEN contains(c, chr(1)) THEN c WHEN contains(b, chr(1)) THEN b WHEN c <> '' THEN c ELSE b END, chr(1), '['), chr(2), ']') AS snippet FROM cb)"""


def _packets(most: int, found: str = "top3", passages: bool = False) -> str:
    """A context of each query from up to three sources (query_id, row_id, rk)."""
    steps = ["pk0 AS (SELECT query_id, '' AS ctx, false AS over, []::VARCHAR[] AS ps FROM topics)"]
    rows, key, body = ("parts", "passage_id", "text") if passages else ("notes", "path", "body")
    extra = "'heading: ' || n.heading || chr(10) || 'lines: ' || n.start_line || ':' || n.end_line || chr(10) || " if passages else ""
    prefix = f"'path: ' || n.path || chr(10) || 'title: ' || n.title || chr(10) || 'type: ' || n.type || chr(10) || 'tags: ' || array_to_string(list_filter(string_split(n.tags, ' '), lambda t: t <> ''), ', ') || chr(10) || {extra}'snippet: ' || s.snippet || chr(10) || 'content:' || chr(10)"
    for k in (1, 2, 3):
        steps.append(f"""a{k} AS (SELECT p.*, {prefix} AS prefix, n.{body} AS body, CASE WHEN ctx = '' THEN '' ELSE chr(10) || '---' || chr(10) END AS sep FROM pk{k - 1} p LEFT JOIN {found} t ON t.query_id = p.query_id AND t.rk = {k} LEFT JOIN {rows} n ON n.{key} = t.row_id LEFT JOIN snip s ON s.query_id = t.query_id AND s.row_id = t.row_id),
b{k} AS (SELECT *, {most} - length(ctx) - length(sep) - length(prefix) AS room FROM a{k}),
c{k} AS (SELECT *, CASE WHEN length(body) <= room THEN body WHEN room <= 13 THEN body[1:greatest(room, 0)] ELSE regexp_replace(body[1:room - 13], '\\s+$', '') || chr(10) || '[truncated]' || chr(10) END AS fitted, over OR prefix IS NULL OR room <= 0 AS stays FROM b{k}),
e{k} AS (SELECT *, CASE WHEN stays THEN ctx ELSE ctx || {_redact('(sep || prefix || fitted)')} END AS nctx FROM c{k}),
pk{k} AS (SELECT query_id, nctx AS ctx, stays OR length(nctx) >= {most} OR length(fitted) >= room AS over, CASE WHEN stays THEN ps ELSE list_append(ps, regexp_extract(prefix, '^path: (.*)', 1)) END AS ps FROM e{k})""")
    return ", ".join(steps)


_CONTEXTS = "contexts AS (SELECT query_id, body AS context FROM ranked JOIN notes ON row_id = path)"
_QRELS = "qrels AS (SELECT item_id AS query_id, path FROM notes JOIN benchmark ON contains(body, benchmark.text))"
_CATEGORIES = "cats AS (SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM qrels) THEN 'no_answer' WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM topics)"
_METRICS = f"""{_QRELS}, tot AS (SELECT query_id, count(*) AS total, sum(CASE WHEN r <= 3 THEN 1 / log2(r + 1.0e0) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS r FROM qrels) GROUP BY 1),
got AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0e0)) AS dcg FROM ranked JOIN qrels ON ranked.query_id = qrels.query_id AND ranked.row_id = qrels.path GROUP BY ALL),
metrics AS (SELECT t.query_id, round(CASE WHEN coalesce(total, 0) = 0 THEN 1 ELSE coalesce(hits, 0) / total::DOUBLE END, 6) AS recall, round(coalesce(1.0e0 / first, 0), 6) AS mrr, round(CASE WHEN coalesce(idcg, 0) = 0 THEN 0 ELSE coalesce(dcg, 0) / idcg END, 6) AS ndcg
    FROM topics t LEFT JOIN tot USING (query_id) LEFT JOIN got USING (query_id))""".replace("SELECT query_id, count(*) AS hits", "SELECT ranked.query_id, count(*) AS hits")

def _prints(rows: str, key: str, text: str, tag: str) -> str:
    """Four-grams of the lowered words with two spaces around them; 60 bits of each one's md5 vote."""
    return f"""ln{tag} AS (SELECT {key}, '  ' || array_to_string(ws, ' ') || '  ' AS l FROM (SELECT {key}, regexp_extract_all(lower({text}), {_WORDS}) AS ws FROM {rows}) WHERE len(ws) > 0),
gr{tag} AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, length(l) - 2), lambda i: l[i:i + 3])) AS g FROM ln{tag}) GROUP BY ALL),
hs{tag} AS (SELECT g, ('0x' || md5(g)[1:15])::BIGINT AS h FROM (SELECT DISTINCT g FROM gr{tag})),
vt{tag} AS (SELECT {key}, {", ".join(f"sum(CASE WHEN (h >> {k}) & 1 = 1 THEN n ELSE -n END) AS b{k}" for k in range(60))} FROM gr{tag} JOIN hs{tag} USING (g) GROUP BY {key}),
fp{tag} AS MATERIALIZED (SELECT {key}, ({" + ".join(f"CASE WHEN b{k} > 0 THEN {1 << k}::BIGINT ELSE 0 END" for k in range(60))})::BIGINT AS fingerprint FROM vt{tag})"""


_SIMHASH = f"WITH {_NOTES}, {_prints('notes', 'path', 'body', 'n')} SELECT path, fingerprint FROM fpn"


def _find(limit: int, tags: str = "") -> str:
    """All of a search for similar notes up to fs: whole items against all notes and the index's hits,
    with the first ``limit`` of each. Without a glossary. ``tags``: a condition on the notes."""
    base = _BASE.replace("WHERE status = 'approved'", "WHERE false")
    hits = "tops AS (SELECT query_id, row_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), row_id) AS rk FROM stage), "
    hits += f"fil AS (SELECT path FROM notes{tags}), "
    hits += f"tf AS (SELECT query_id, row_id, score FROM tops WHERE rk <= {max(20 * limit, 100) if tags else limit} AND row_id IN (SELECT path FROM fil)), "
    hits += f"shown AS (SELECT query_id, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), row_id) AS k FROM tf) WHERE k <= {limit})"
    similar = f"""mtx AS (SELECT path, concat_ws(chr(10), title, description, aliases, signals, body) AS txt FROM notes WHERE path IN (SELECT path FROM fil)),
{_prints("mtx", "path", "txt", "m")}, {_prints("topics", "query_id", "text", "q")},
tx AS (SELECT path, {_words("txt")} AS tw, fpm.fingerprint AS f FROM mtx LEFT JOIN fpm USING (path)), qx AS (SELECT query_id, {_words("text")} AS qw, fpq.fingerprint AS f FROM topics LEFT JOIN fpq USING (query_id)),
sm AS (SELECT query_id, path, greatest(CASE WHEN len(qw) = 0 OR len(tw) = 0 THEN 0 ELSE len(list_intersect(qw, tw))::DOUBLE / len(qw) END, coalesce(round_even(1 - bit_count(xor(qx.f, tx.f)) / 60.0e0, 4), 0)) AS sim FROM qx CROSS JOIN tx),
fa AS (SELECT query_id, path, sim, h.score, h.row_id IS NOT NULL AS hit FROM sm LEFT JOIN shown h ON h.query_id = sm.query_id AND h.row_id = sm.path WHERE sim >= 0.55e0 OR h.row_id IS NOT NULL),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(sim, 4) DESC, path) AS rank FROM fa) WHERE rank <= {limit})""".replace("fa AS (SELECT query_id,", "fa AS (SELECT sm.query_id,")
    return _search([("groups", 0), ("strict", 2)], 1, f", {_LADDER}, {hits}, {_SNIPPETS}, {similar}", base)


_WRITE = f"""{_find(5)}, mg AS (SELECT query_id, max(path) FILTER (rank = 1) AS path, max(round_even(sim, 4)) FILTER (rank = 1) AS sim, count(*) AS candidates, round(max(round_even(sim, 4)) FILTER (rank = 1) - coalesce(max(round_even(sim, 4)) FILTER (rank = 2), 0), 4) AS margin FROM fs GROUP BY query_id),
tg AS (SELECT t.query_id, CASE WHEN sim >= 0.7e0 THEN mg.path END AS path, coalesce(sim, 0) AS sim, coalesce(candidates, 0) AS candidates, coalesce(margin, 0) AS margin, t.text FROM topics t LEFT JOIN mg USING (query_id)),
wb AS (SELECT query_id, tg.path, sim, candidates, margin, CASE WHEN tg.path IS NULL THEN 'create' WHEN query_id % 9 = 0 THEN 'conflict' WHEN contains(n.body, trim(text)) THEN 'noop' ELSE 'update' END AS action FROM tg LEFT JOIN notes n ON n.path = tg.path)"""
_MERGE = f"""{_WRITE}, ad AS (SELECT wb.query_id, wb.path, action, regexp_replace(t.text, '^\\s+|\\s+$', '', 'g') AS addition, array_to_string(string_split(replace(t.text, chr(10), ' '), ' ')[1:5], ' ') AS title FROM wb JOIN topics t USING (query_id)),
up AS (SELECT path, list(addition ORDER BY query_id) AS adds FROM ad WHERE action = 'update' AND addition <> '' AND NOT ({_secret('addition')}) GROUP BY path),
un AS (SELECT path, body AS was, list_reduce(list_prepend(body, adds), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || CASE WHEN ends_with(a, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END || x || chr(10) END) AS body FROM up JOIN notes USING (path)),
cr AS (SELECT query_id, addition, 'knowledge/' || {_SLUG.format('title')} || '.md' AS path, CASE WHEN {_secret("title || chr(10) || addition")} THEN 'secret' WHEN trim(title) = '' OR query_id % 20 >= 15 THEN 'policy' END AS bad FROM ad WHERE action = 'create'),
ck AS (SELECT *, row_number() OVER (PARTITION BY path, bad IS NULL ORDER BY query_id) AS k FROM cr),
cc AS (SELECT *, coalesce(bad, CASE WHEN k > 1 OR path IN (SELECT path FROM notes) THEN 'exists' END) AS reason FROM ck)"""
_VARIANTS = [("strict", 0), ("or", 2), ("prefix", 3), ("glossary", 1)]
_STAGES = [("groups", 0), ("glossary", 1), ("strict", 2)]
#: Entries of a row in its runs: a later run's replaces one with a worse rank or a worse score.
_FUSED = """, es AS (SELECT query_id, row_id, list({'k': rank, 's': score} ORDER BY run) AS e, round(sum(1.0e0 / (60 + rank)), 12) AS s, min(rank) AS best_rank, min(run * 1000 + rank) AS seen FROM ranked GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, best_rank, seen, row_id) AS k, list_reduce(e, lambda o, n: CASE WHEN n.k < o.k OR n.s < o.s THEN n ELSE o END) AS w FROM es)
SELECT query_id, row_id, round(s, 6) AS rrf_score, best_rank, round(w.s, 6) AS score, k AS rank FROM fr WHERE k <= 3"""

#: Query words and what the glossary adds to them, each once, and where they are found.
_EXPLAIN = """xm AS (SELECT query_id, list_sort(list_distinct(flatten(list(members)))) AS more FROM qwords JOIN tgroups ON strip_accents(lower(token)) = token_low GROUP BY 1),
xw AS (SELECT qall.query_id, list_concat(toks, coalesce((SELECT list_concat(list(lower(token) ORDER BY pos), any_value(more)) FROM qwords JOIN xm USING (query_id) WHERE qwords.query_id = qall.query_id), []::VARCHAR[])) AS ws FROM qall),
xu AS (SELECT query_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM xw), xk AS (SELECT query_id, arg_min(term, i) AS term, strip_accents(lower(term)) AS k FROM xu GROUP BY query_id, strip_accents(lower(term)))"""
_EXPLAINED = "SELECT r.query_id, r.row_id, term, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM ranked r JOIN xk USING (query_id) JOIN hay h ON h.row_id = r.row_id AND contains(hay, k) WHERE k <> '' GROUP BY r.query_id, r.row_id, term"

_AGENTS = f""", {_LADDER}, shown AS (SELECT query_id, row_id FROM top3), {_SNIPPETS}, {_packets(3200)}, {_QRELS}, want AS (SELECT query_id, list(path) AS want FROM qrels GROUP BY 1),
tk AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, coalesce(want, []::VARCHAR[]) AS want, want IS NULL AS silent, ctx, ps, contains(lower(ctx), lower(t.text))::INT AS covered FROM topics t JOIN pk3 USING (query_id) LEFT JOIN want USING (query_id)),
ta AS (SELECT *, len(list_filter(want, lambda p: NOT list_contains(ps, p))) = 0 AS paths_found, ctx = '' AS abstained FROM tk),
td AS (SELECT query_id, slice, 1 AS facts, covered, covered::DOUBLE AS coverage, paths_found, CASE WHEN silent THEN abstained ELSE paths_found AND covered = 1 END AS sufficient, abstained, abstained = silent AS correct_abstention FROM ta)"""

SQL = {
    "token_counts": f"WITH {_NOTES} SELECT path, len({_tokens('body')}) AS query_words, len({_terms('body')}) AS terms, ceil(length(body) / 4.0e0)::BIGINT AS tokens FROM notes",
    "safe_prefix_stems": f"SELECT token, {_stem('token')} AS stem FROM (SELECT DISTINCT unnest({_tokens('text')}) AS token FROM documents) WHERE {_stem('token')} IS NOT NULL",
    "slugs": f"WITH {_NOTES} SELECT path, {_SLUG.format('title')} AS slug FROM notes",
    "doc_frequency": f"WITH {_NOTES}, {_occ('notes', 'path', NOTE_WEIGHTS)} SELECT term, count(DISTINCT row_id) AS df FROM occ GROUP BY term",
    "bm25_strict_docs": _search([("strict", 0)], 3),
    "bm25_or_docs": _search([("or", 2)], 3),
    "bm25_prefix_docs": _search([("prefix", 3)], 3),
    "bm25_glossary_docs": _search([("glossary", 1)], 3),
    "bm25_passages": f"WITH {_SPLIT}, topics AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id), {_QWORDS}, {_occ('parts', 'passage_id', PASSAGE_WEIGHTS)}, phrases AS (SELECT * FROM ({_run('strict', 0)}) WHERE len(terms) > 0), {_BM25}, {_ranked(3)} SELECT query_id, row_id, round(score, 6) AS score, rank FROM ranked",
    "search_filtered": _search([("or", 2)], 100, ", kept AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ranked r JOIN notes ON path = row_id WHERE list_contains(string_split(lower(tags), ' '), 'en')) SELECT query_id, row_id, round(score, 6) AS score, k AS rank FROM kept WHERE k <= 3"),
    "rrf_docs": _search(_VARIANTS, 100, _FUSED),
    "rrf_passages": _search(_VARIANTS, 100, _FUSED, _PARTS),
    "signal_groups": _search([("groups", 0)], 1, f", {_GROUPS} SELECT query_id, group_id, array_to_string(members, ' ') AS members, df, status, round(idf, 6) AS idf FROM sg"),
    "relaxed_search": _search(_STAGES, 1, f", {_LADDER} SELECT query_id, run AS stage, row_id, round(score, 6) AS score, rk AS rank FROM top3"),
    "relaxed_titles": _search(_STAGES, 1, f", {_LADDER} SELECT query_id, run AS stage, row_id, round(score, 6) AS score, rk AS rank FROM top3", _BASE.replace(_TOPICS, _TITLES)),
    "diagnostics_titles": _search(_STAGES, 1, f", {_DIAGNOSE}", _BASE.replace(_TOPICS, _TITLES)),
    "search_passages": _search(_STAGES, 1, f", {_LADDER} SELECT query_id, run AS stage, row_id, round(score, 6) AS score, rk AS rank FROM top3", _PARTS),
    "abstain_diagnostics": _search(_STAGES, 1, f", {_DIAGNOSE}"),
    "diagnostics_passages": _search(_STAGES, 1, f", {_DIAGNOSE}", _PARTS),
    "snippet_window": _search([("or", 2)], 1, f", shown AS (SELECT query_id, row_id FROM ranked), {_SNIPPETS} SELECT * FROM snip"),
    "retrieve_docs_budget": _search(_STAGES, 1, f", {_LADDER}, shown AS (SELECT query_id, row_id FROM top3), {_SNIPPETS}, {_packets(3200)} SELECT query_id, 'bm25' AS ranker, sha256(ctx) AS context_sha256, ceil(length(ctx) / 4.0e0)::BIGINT AS used_tokens, len(ps) AS source_count, array_to_string(ps, ' ') AS sources FROM pk3"),
    "retrieve_docs_auto": _search([*_STAGES, ("strict", 10), ("glossary", 11), ("or", 12), ("prefix", 13)], 100, f", {_LADDER}{_FUSED.split('SELECT query_id, row_id, round(s, 6)')[0].rstrip().replace('FROM ranked GROUP', 'FROM (SELECT * FROM ranked WHERE run >= 10) GROUP')}, auto AS (SELECT query_id, row_id, rk FROM top3 UNION ALL SELECT query_id, row_id, k FROM fr WHERE k <= 3 AND query_id NOT IN (SELECT query_id FROM top3)), shown AS (SELECT query_id, row_id FROM auto), {_SNIPPETS}, {_packets(3200, 'auto')} SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM top3) THEN 'bm25' ELSE 'rrf' END AS ranker, sha256(ctx) AS context_sha256, ceil(length(ctx) / 4.0e0)::BIGINT AS used_tokens, len(ps) AS source_count, array_to_string(ps, ' ') AS sources FROM pk3"),
    "retrieve_passages_budget": _search(_STAGES, 1, f", {_LADDER}, shown AS (SELECT query_id, row_id FROM top3), {_SNIPPETS.replace('JOIN notes n ON n.path = s.row_id', 'JOIN parts n ON n.passage_id = s.row_id').replace('n.body', 'n.text')}, {_packets(3200, passages=True)} SELECT query_id, 'bm25' AS ranker, sha256(ctx) AS context_sha256, ceil(length(ctx) / 4.0e0)::BIGINT AS used_tokens, len(ps) AS source_count, array_to_string(ps, ' ') AS sources FROM pk3", _PARTS.replace(_TOPICS, "topics AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id)")),
    "grep_baseline": f"WITH {_NOTES}, {_TOPICS}, {_QWORDS}, qs AS (SELECT query_id, list(lower(token)) AS ws FROM qwords GROUP BY 1), hit AS (SELECT query_id, path AS row_id FROM notes JOIN qs ON len(list_filter(ws, lambda w: NOT contains(lower(path || chr(10) || body), w))) = 0) SELECT query_id, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS rank FROM hit) WHERE rank <= 20",
    "grep_metrics": f"WITH {_NOTES}, {_TOPICS}, {_QWORDS}, qs AS (SELECT query_id, list(lower(token)) AS ws FROM qwords GROUP BY 1), hit AS (SELECT query_id, path AS row_id FROM notes JOIN qs ON len(list_filter(ws, lambda w: NOT contains(lower(path || chr(10) || body), w))) = 0), ranked AS (SELECT query_id, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS rank FROM hit) WHERE rank <= 20), {_METRICS.replace('r <= 3', 'r <= 20')}, {_CATEGORIES}, rd AS (SELECT query_id, count(*) AS f, sum(ceil(length(body) / 4.0e0)) AS t FROM ranked JOIN notes ON path = row_id GROUP BY 1) SELECT count(*) AS topics, round(avg(recall), 4) AS mean_recall, round(avg(mrr), 4) AS mean_mrr, round(avg(ndcg), 4) AS mean_ndcg, coalesce(round(count(*) FILTER (category = 'no_answer' AND f > 0) / nullif(count(*) FILTER (category = 'no_answer'), 0)::DOUBLE, 4), 0) AS false_positive_rate, sum(coalesce(f, 0))::BIGINT AS files_read, round(avg(coalesce(f, 0)), 4) AS mean_files_read, sum(coalesce(t, 0))::BIGINT AS returned_tokens, round(avg(coalesce(t, 0)), 4) AS mean_returned_tokens FROM cats JOIN metrics USING (query_id) LEFT JOIN rd USING (query_id)",
    "passage_split": f"WITH {_SPLIT} SELECT path, heading, start_line, end_line, sha256(text) AS text_sha256 FROM parts",
    "section_extract": f"WITH {_TALK}, s0 AS (SELECT path, min(line) AS a, arg_min(level, line) AS l FROM lv WHERE level > 0 AND strip_accents(lower(heading)) = 'user 2' GROUP BY path), e0 AS (SELECT path, min(line) AS b FROM lv JOIN s0 USING (path) WHERE line > a AND level > 0 AND level <= l GROUP BY path) SELECT path, sha256(string_agg(t, chr(10) ORDER BY line)) AS text_sha256 FROM lv JOIN s0 USING (path) LEFT JOIN e0 USING (path) WHERE line >= a AND (b IS NULL OR line < b) GROUP BY path",
    "line_range": f"WITH {_NOTES} SELECT path, array_to_string(string_split(body, chr(10))[2:3], chr(10)) AS text FROM notes",
    "needle_snippet": f"WITH {_NOTES}, nl AS (SELECT path, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM notes), at0 AS (SELECT path, min(line) AS a FROM nl WHERE contains(lower(t), 'license version') OR (contains(lower(t), 'license') AND contains(lower(t), 'version')) GROUP BY path) SELECT path, a AS line, string_agg(t, chr(10) ORDER BY nl.line) AS text FROM nl JOIN at0 USING (path) WHERE abs(nl.line - a) <= 1 GROUP BY path, a",
    "lexical_pairs": f"WITH {_NOTES}, {_TOPICS}, {_SIMILAR} SELECT query_id, path, similarity FROM lex WHERE similarity >= 0.55",
    "simhash_md5": _SIMHASH,
    "find_similar": _find(3) + " SELECT fs.query_id, fs.path, n.title, n.type, n.tags, round_even(sim, 4) AS similarity, CASE WHEN sim >= 0.8e0 THEN 'duplicate_candidate' ELSE 'related' END AS kind, CASE WHEN hit THEN round(score, 6) ELSE 0 END AS score, CASE WHEN hit THEN snippet ELSE trim(regexp_replace(n.body, '\\s+', ' ', 'g'))[1:160] END AS snippet, rank FROM fs JOIN notes n USING (path) LEFT JOIN snip s ON s.query_id = fs.query_id AND s.row_id = fs.path",
    "find_similar_filtered": _find(3, " WHERE list_contains(string_split(lower(tags), ' '), 'en')") + " SELECT fs.query_id, fs.path, n.tags, round_even(sim, 4) AS similarity, CASE WHEN sim >= 0.8e0 THEN 'duplicate_candidate' ELSE 'related' END AS kind, rank FROM fs JOIN notes n USING (path)",
    "secret_findings": f"WITH {_NOTES}, nl AS (SELECT path, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM notes), f AS ("
    + " UNION ALL ".join(f"SELECT path, line, '{k}' AS kind, len(regexp_extract_all(t, '{p}')) AS hits FROM nl" for k, p in SECRETS)
    + ") SELECT path, line, kind, hits FROM f WHERE hits > 0",
    "redacted": f"WITH {_NOTES} SELECT path, sha256({_redact('body')}) AS text_sha256 FROM notes WHERE {_redact('body')} <> body",
    "schema_validate": f"WITH {_NOTES} SELECT path, 'missing required field: ' || f AS issue FROM (SELECT path, unnest(['type', 'title', 'description', 'tags']) AS f, unnest([type, title, description, tags]) AS v FROM notes) WHERE coalesce(v, '') = '' UNION ALL SELECT path, f || ' must be a non-empty string' FROM (SELECT path, unnest(['type', 'title', 'description']) AS f, unnest([type, title, description]) AS v FROM notes) WHERE v <> '' AND trim(v) = '' UNION ALL SELECT path, 'type ' || chr(39) || type || chr(39) || ' is not declared in SCHEMA.md' FROM notes WHERE type <> '' AND type NOT IN ("
    + ", ".join(f"'src{k}'" for k in range(15))
    + ") UNION ALL SELECT path, 'tag ' || chr(39) || tags || chr(39) || ' is not declared in SCHEMA.md' FROM notes WHERE tags NOT IN ('en', 'de') AND tags <> ''",
    "vault_stats": f"WITH {_NOTES} SELECT count(*) AS documents, sum(length(body))::BIGINT AS chars, ceil(sum(length(body)) / 4.0e0)::BIGINT AS estimated_tokens FROM notes",
    "type_counts": "SELECT source AS value, count(*) AS documents FROM documents WHERE source <> '' GROUP BY 1",
    "tag_counts": "SELECT lang AS value, count(*) AS documents FROM documents WHERE lang <> '' GROUP BY 1",
    "glossary_expand": f"WITH {_TOPICS}, {_QWORDS}, {_TGROUPS}, m AS (SELECT query_id, list_sort(list_distinct(flatten(list(members)))) AS more FROM qwords JOIN tgroups ON strip_accents(lower(token)) = token_low GROUP BY 1), w AS (SELECT query_id, list(lower(token) ORDER BY pos) AS ws FROM qwords GROUP BY 1) SELECT query_id, array_to_string(list_concat(ws, list_filter(more, lambda x: NOT list_contains(ws, x))), ' ') AS tokens FROM w JOIN m USING (query_id)",
    "glossary_lookup": f"WITH {_TOPICS}, {_TGROUPS}, fs AS (SELECT title, list_concat([title], list_filter(aliases, lambda a: a <> title)) AS forms FROM terms0 WHERE status = 'approved'), fm AS (SELECT title, forms, unnest(forms) AS form, generate_subscripts(forms, 1) AS k FROM fs) SELECT query_id, title, array_to_string(list(form ORDER BY k), ' | ') AS matched, array_to_string(any_value(forms), ' | ') AS expansion FROM topics JOIN fm ON list_has_all({_words('query')}, {_words('form')}) GROUP BY query_id, title, forms",
    "glossary_validate": f"WITH {_TGROUPS}, k AS (SELECT *, lower(title) AS k FROM terms0), o AS (SELECT DISTINCT title, k, unnest(list_transform(list_concat([title], aliases), lambda x: lower(x))) AS a FROM k), f AS (SELECT a, min(k) AS owner FROM o GROUP BY a) SELECT DISTINCT title, 'duplicate title' AS issue FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) UNION ALL SELECT title, 'alias taken: ' || a FROM o JOIN f USING (a) WHERE k <> owner UNION ALL SELECT title, 'unknown status: ' || status FROM k WHERE status NOT IN ('approved', 'proposed', 'deprecated')",
    "explain_matches": _search([("or", 2)], 1, f", {_EXPLAIN}, hay AS (" + " UNION ALL ".join(f"SELECT path AS row_id, '{f}' AS field, strip_accents(lower({f})) AS hay FROM notes" for f in ("title", "description", "tags", "aliases", "systems", "signals", "body")) + f") {_EXPLAINED}"),
    "explain_passages": f"WITH {_SPLIT}, topics AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id), {_QWORDS}, {_TGROUPS}, {_occ('parts', 'passage_id', PASSAGE_WEIGHTS)}, phrases AS (SELECT * FROM ({_run('strict', 0)}) WHERE len(terms) > 0), {_BM25}, {_ranked(1)}, {_EXPLAIN}, hay AS (SELECT passage_id AS row_id, unnest(['body', 'passage']) AS field, unnest([strip_accents(lower(talk.body)), strip_accents(lower(text))]) AS hay FROM parts JOIN talk USING (path)) {_EXPLAINED}",
    "glossary_suggest": f"WITH {_NOTES}, nn AS (SELECT path, title, description, body, array_to_string(list_transform(list_filter(string_split(description, ' '), lambda w: regexp_full_match(w, '\\p{{L}}{{5,9}}')), lambda w: w[1] || (length(w) - 2) || w[-1]), ' ') AS aliases FROM notes), nw AS (SELECT DISTINCT path, strip_accents(lower(t)) AS w FROM (SELECT path, unnest({_tokens("concat_ws(chr(10), title, description, aliases, body)")}) AS t FROM nn)), qw AS (SELECT DISTINCT query_id, strip_accents(lower(t)) AS w FROM (SELECT item_id AS query_id, unnest({_tokens('text')}) AS t FROM benchmark)), sh AS (SELECT query_id, path, count(*) AS shared FROM nw JOIN qw USING (w) GROUP BY 1, 2), al AS (SELECT q.query_id, n.path, q.w AS term, n.w AS alias FROM qw q JOIN nw n ON n.w[1] = q.w[1] AND n.w[-1] = q.w[-1] WHERE length(q.w) >= 5 AND length(n.w) <= 8 AND regexp_matches(n.w, '[0-9]')), ok AS (SELECT al.*, shared FROM al JOIN sh USING (query_id, path) WHERE NOT EXISTS (SELECT 1 FROM nw x WHERE x.path = al.path AND x.w = al.term) AND NOT EXISTS (SELECT 1 FROM qw y WHERE y.query_id = al.query_id AND y.w = al.alias)) SELECT query_id, path, term, alias, shared::INT AS shared, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, term, alias) AS rank FROM (SELECT *, round(0.5e0 + least(shared, 4) * 0.1e0, 4) AS score FROM ok)) WHERE rank <= 5",
    "sha256_signatures": f"WITH {_NOTES} SELECT path, strlen(body) AS size, sha256(body) AS sha256 FROM notes",
    "manifest_diff": f"WITH {_NOTES}, o AS (SELECT path, body FROM notes WHERE NOT ends_with(path, '3.md')), n AS (SELECT path, CASE WHEN tags = 'de' THEN body || '!' ELSE body END AS body FROM notes WHERE NOT ends_with(path, '7.md')) SELECT path, CASE WHEN o.body IS NULL THEN 'added' WHEN n.body IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'updated' ELSE 'same' END AS change FROM o FULL JOIN n USING (path)",
    "index_staleness": f"WITH {_NOTES}, d AS (SELECT ends_with(path, '3.md') AS a, ends_with(path, '7.md') AS r, tags = 'de' AS u FROM notes) SELECT count(*) FILTER (NOT a AND NOT r AND u) AS changed, count(*) FILTER (a) AS missing, count(*) FILTER (r) AS removed, count(*) FILTER (NOT a AND NOT r AND NOT u) AS fresh FROM d",
    "sync_search": _search([("or", 2)], 3, base=_LATER),
    "sync_compacted_terms": f"{_LATER} SELECT term, count(DISTINCT row_id) AS df FROM occ GROUP BY term",
    "create_outcomes": f"WITH {_NOTES}, there AS (SELECT DISTINCT 'knowledge/' || {_SLUG.format("type || ' ' || tags")} || '.md' AS path FROM notes WHERE tags = 'en'), rq AS (SELECT source || ' ' || lang AS title, text FROM documents), p AS (SELECT *, 'knowledge/' || {_SLUG.format('title')} || '.md' AS path FROM rq) SELECT path, CASE WHEN {_secret('text')} THEN 'secret' WHEN path IN (SELECT path FROM there) THEN 'exists' ELSE 'created' END AS outcome, count(*) AS n FROM p GROUP BY 1, 2",
    "append_outcomes": f"WITH {_NOTES}, rq AS (SELECT 'docs/' || lpad((doc_id + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END)::VARCHAR, 8, '0') || '.md' AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS addition, doc_id % 7 = 1 AS wrong FROM documents), oc AS (SELECT rq.path, addition, body, CASE WHEN body IS NULL THEN 'missing' WHEN wrong THEN 'conflict' WHEN coalesce(addition, '') = '' THEN 'empty' WHEN {_secret('addition')} THEN 'secret' WHEN contains(body, addition) THEN 'noop' ELSE 'update' END AS outcome FROM rq LEFT JOIN notes USING (path)) SELECT path, outcome, sha256(CASE WHEN outcome = 'update' THEN body || CASE WHEN ends_with(body, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END || addition || chr(10) ELSE body END) AS text_sha256 FROM oc",
    "usage_summary": f"WITH {_USAGE} SELECT count(*) AS events, arg_min(ts, event_id) AS first_event, arg_max(ts, event_id) AS last_event, count(*) FILTER (command = 'view') AS searches, count(*) FILTER (command = 'click') AS retrieves, count(*) FILTER (command IN ('purchase', 'signup')) AS writes, count(*) FILTER (status <> 'ok') AS errors, round(sum(coalesce(duration_ms, 0)) / count(*), 3) AS avg_duration_ms, coalesce(sum(floor(duration_ms)), 0)::BIGINT AS total_estimated_tokens FROM log",
    "usage_by_command": f"WITH {_USAGE} SELECT command, count(*) AS events, count(*) FILTER (status <> 'ok') AS errors FROM log GROUP BY 1",
    "usage_top_documents": f"WITH {_USAGE}, d AS (SELECT event_id, 0 AS k, user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 1, 'doc-' || (event_id % 11) FROM events WHERE event_id % 4 = 0) SELECT value, count FROM (SELECT value, count(*) AS count, min(event_id * 10 + k) AS f FROM d GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10)",
    "usage_top_terms": "WITH d AS (SELECT event_id, 0 AS k, lower(event_type) AS value FROM events UNION ALL SELECT event_id, 1, 'u' || (user_id % 7) FROM events) SELECT value, count FROM (SELECT value, count(*) AS count, min(event_id * 10 + k) AS f FROM d GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10)",
    "usage_evidence": f"WITH {_USAGE}, c AS (SELECT count(*) AS events, count(*) FILTER (command = 'view') AS searches, count(*) FILTER (command = 'click') AS retrieves, count(*) FILTER (command IN ('purchase', 'signup')) AS writes, count(*) FILTER (status <> 'ok') AS errors, count(*) FILTER (command = 'view' AND duration_ms < 10) AS zero_result_searches, count(*) FILTER (command = 'click' AND duration_ms < 20) AS zero_source_retrieves, count(*) FILTER (command = 'click' AND event_id % 2 = 0) AS passage_retrieves, count(*) FILTER (command = 'click' AND event_id % 5 = 0) AS auto_ranker_retrieves, count(*) FILTER (command = 'view' AND event_id % 3 = 0) AS rrf_searches FROM log), r AS (SELECT *, round(zero_result_searches / searches::DOUBLE, 4) AS zero_result_search_rate, round(zero_source_retrieves / retrieves::DOUBLE, 4) AS zero_source_retrieve_rate, round(retrieves / searches::DOUBLE, 4) AS retrieve_per_search_rate, round(passage_retrieves / retrieves::DOUBLE, 4) AS passage_retrieve_rate, round(errors / events::DOUBLE, 4) AS error_rate FROM c) SELECT *, CASE WHEN events >= 30 AND searches >= 10 AND retrieves >= 5 THEN 'ready_for_review' ELSE 'needs_more_usage' END AS ranker_status, CASE WHEN zero_result_search_rate >= 0.2 OR zero_source_retrieve_rate >= 0.2 THEN 'watch' ELSE 'ok' END AS no_answer_status FROM r",
    "ir_metrics": _search([("or", 2)], 3, f", {_METRICS} SELECT * FROM metrics"),
    "agent_sufficiency": _search([("or", 2)], 1, f", {_CONTEXTS}, facts AS (SELECT query_id, unnest([query, text]) AS fact FROM topics) SELECT query_id, count(*) AS facts, count(*) FILTER (contains(lower(context), lower(fact))) AS covered, round(count(*) FILTER (contains(lower(context), lower(fact))) / count(*)::DOUBLE, 4) AS coverage FROM contexts JOIN facts USING (query_id) GROUP BY query_id"),
    "agent_tasks": _search(_STAGES, 1, f"{_AGENTS} SELECT * FROM td"),
    "agent_summary": _search(_STAGES, 1, f"{_AGENTS} SELECT slice, count(*) AS tasks, round(avg(sufficient::INT), 4) AS sufficiency, round(avg(correct_abstention::INT), 4) AS abstention_accuracy, round(avg(coverage), 4) AS mean_coverage, round(stddev_pop(coverage), 4) AS stddev_coverage FROM td GROUP BY slice"),
    "context_reduction": _search([("or", 2)], 1, f", {_CONTEXTS}, corpus AS (SELECT sum(ceil(length(body) / 4.0e0)) AS all_tokens FROM notes) SELECT query_id, ceil(length(context) / 4.0e0)::BIGINT AS returned, round(1 - ceil(length(context) / 4.0e0) / all_tokens, 4) AS reduction FROM contexts, corpus"),
    "slice_metrics": _search([*_STAGES, ("or", 4)], 3, f", {_LADDER}, shown AS (SELECT query_id, row_id FROM top3), {_SNIPPETS}, {_packets(3200)}, {_METRICS.replace('FROM ranked JOIN qrels', 'FROM (SELECT * FROM ranked WHERE run = 4) ranked JOIN qrels')}, {_CATEGORIES}, corpus AS (SELECT sum(ceil(length(body) / 4.0e0)) AS corpus FROM notes), used AS (SELECT query_id, ceil(length(ctx) / 4.0e0)::BIGINT AS u, len(ps) AS n FROM pk3) SELECT category, count(*) AS topics, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, sum(u)::BIGINT AS returned_tokens, round(avg(u), 4) AS mean_returned_tokens, round(1 - sum(u) / (any_value(corpus) * count(*)), 4) AS context_reduction, round(avg((u <= 800)::INT), 4) AS budget_compliance_rate, CASE WHEN category = 'no_answer' THEN round(avg((n > 0)::INT), 4) ELSE 0.0 END AS false_positive_rate FROM cats JOIN metrics USING (query_id) JOIN used USING (query_id) CROSS JOIN corpus GROUP BY category"),
    "corpus_metadata": f"WITH {_NOTES}, {_TOPICS}, {_QRELS}, {_CATEGORIES}, pos AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) SELECT count(*) AS topics, count(*) FILTER (category <> 'no_answer') AS answerable_topics, count(*) FILTER (category = 'no_answer') AS no_answer_topics, coalesce(round(avg(coalesce(n, 0)) FILTER (category <> 'no_answer'), 4), 0) AS mean_positive_qrels, string_agg(DISTINCT category, ',' ORDER BY category) AS slices, (SELECT count(*) FROM qrels) AS qrel_rows, (SELECT count(*) FROM qrels) AS positive_qrels, (SELECT count(*) FROM notes) AS notes FROM cats LEFT JOIN pos USING (query_id)",
    "golden_prefix_compare": _search([("or", 2), ("strict", 0)], 3, ", m AS (SELECT query_id, list(row_id ORDER BY rank) AS mine FROM ranked WHERE run = 2 GROUP BY 1), g AS (SELECT query_id, list(row_id ORDER BY rank) AS want FROM ranked WHERE run = 0 AND rank <= 1 GROUP BY 1) SELECT query_id, CASE WHEN mine IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN mine[1:len(want)] = want THEN 'match' ELSE 'differs' END AS verdict FROM m FULL JOIN g USING (query_id)"),
    "latency_percentiles": "WITH p AS (SELECT event_type AS command, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT command, round(min(value), 3) AS min, round(median(value), 3) AS p50, round(max(value) FILTER (i = round_even((n - 1) * 0.95e0, 0)), 3) AS p95, round(max(value), 3) AS max FROM p GROUP BY 1",
    "metric_deltas": "WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS label, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2), d AS (SELECT *, round(value - lag(value) OVER (PARTITION BY label ORDER BY date), 4) AS delta FROM l) SELECT label, date, round(value, 4) AS value, delta, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN delta IS NULL OR delta = 0 THEN 'same' WHEN delta > 0 THEN 'better' ELSE 'worse' END AS verdict FROM d",
    "writeback_decisions": f"{_WRITE} SELECT query_id, path, action, CASE action WHEN 'create' THEN 'created' WHEN 'noop' THEN 'already_present' WHEN 'conflict' THEN 'conflict' ELSE 'updated' END AS reason, round_even(sim, 4) AS similarity, candidates, margin FROM wb",
    "writeback_changes": f"{_MERGE} SELECT path, 'updated' AS change, sha256(body) AS text_sha256 FROM un WHERE body <> was UNION ALL SELECT path, 'created', sha256(addition || chr(10)) FROM cc WHERE reason IS NULL",
    "writeback_rejects": f"{_MERGE} SELECT query_id, path, reason FROM cc WHERE reason IS NOT NULL UNION ALL SELECT query_id, path, 'conflict' FROM ad WHERE action = 'conflict' UNION ALL SELECT query_id, path, 'secret' FROM ad WHERE action = 'update' AND ({_secret('addition')})",
    "writeback_summary": f"{_WRITE}, c AS (SELECT wb.action AS a, wb.path, CASE WHEN wb.path IS NULL THEN 'create' WHEN wb.query_id % 9 = 0 THEN 'conflict' WHEN wb.query_id % 2 = 0 THEN 'noop' ELSE 'update' END AS e, CASE WHEN wb.query_id % 3 = 0 THEN wb.path END AS ep, margin, candidates, coalesce(contains(n.body, trim(t.text)), false) AS present FROM wb JOIN topics t USING (query_id) LEFT JOIN notes n ON n.path = wb.path) SELECT count(*) AS cases, {_rate('a = e', 'true')} AS decision_accuracy, {_rate('path = ep', 'ep IS NOT NULL')} AS target_path_accuracy, {_rate('a = e', 'true')} AS reason_accuracy, {_rate('a = e', "a = 'update'")} AS update_precision, {_rate('a = e', "e = 'update'")} AS update_recall, {_rate('a = e', "a = 'create'")} AS create_precision, {_rate('a = e', "e = 'create'")} AS create_recall, {_rate('a = e', "e = 'noop'")} AS noop_accuracy, {_rate("a = 'conflict'", "e = 'conflict'")} AS conflict_detection_rate, {_rate('NOT present', "e = 'conflict'")} AS conflict_write_block_rate, {_rate("a <> 'create'", "e <> 'create'")} AS duplicate_avoidance_rate, {_rate("a = 'update'", "e = 'create'")} AS false_update_rate, {_rate("a = 'create'", "e <> 'create'")} AS false_create_rate, {_rate("a = 'noop'", "e = 'noop'")} AS idempotency_rate, median(candidates)::DOUBLE AS median_candidate_count, round(avg(margin), 4) AS mean_similarity_margin FROM c",
}
