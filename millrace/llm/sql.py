"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from .mixing import PASSES
from .quality import CUTOFFS, FAILURE, TOLERATED
from .repeats import SPAN
from .url_filter import LISTED, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixing(weights=(3.0, 1.0, 2.0), share=1.5, seed="mix") -> str:
    listed = "[" + ", ".join(f"{w:.1f}::DOUBLE" for w in weights) + "]"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS hash
  FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS source_size FROM base GROUP BY skey),
weighted AS (SELECT *, {listed}[((row_number() OVER (ORDER BY skey) - 1) % {len(weights)} + 1)::BIGINT] AS weight FROM src),
limited AS (SELECT *, {PASSES} * source_size / weight AS lim FROM weighted),
levelled AS (
  SELECT *, ({share} * (sum(source_size) OVER ())::DOUBLE
             - (sum({PASSES} * source_size) OVER (ORDER BY lim, skey ROWS UNBOUNDED PRECEDING) - {PASSES} * source_size)::DOUBLE)
            / sum(weight) OVER (ORDER BY lim, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM limited),
chosen AS (SELECT level AS fill FROM levelled WHERE level <= lim ORDER BY lim, skey LIMIT 1),
goals AS (
  SELECT skey, source_size,
         CASE WHEN fill IS NULL OR fill >= lim THEN ({PASSES} * source_size)::DOUBLE ELSE fill * weight END AS target
  FROM levelled LEFT JOIN chosen ON true),
queued AS (
  SELECT b.*, source_size, target, sum(size) OVER (PARTITION BY b.skey ORDER BY hash, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM base b JOIN goals USING (skey)),
entries AS (
  SELECT doc_id, skey, hash, size, turn, (upto + turn * source_size)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest(range({PASSES})) AS turn) WHERE size > 0 AND target > 0),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, hash, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM entries),
taken AS (SELECT doc_id, skey, count(*) AS n FROM merged WHERE total <= {share} * (SELECT sum(size) FROM base) GROUP BY doc_id, skey)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.skey = t.skey
"""


def _url_filter() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda at, below: f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{below}')"
    rule = " ".join(f"WHEN {fits(at, below)} THEN '{at + below}'" for _, at, below in ordered)
    ruled = " ".join(f"WHEN rule = '{at + below}' THEN '{what}'" for what, at, below in ordered)
    listed = " OR ".join(f"host = '{x.split('/')[2]}' OR ends_with(host, '.{x.split('/')[2]}')" for x in LISTED)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
parsed AS (
  SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
ruled AS (SELECT *, CASE {rule} END AS rule FROM parsed)
SELECT page_id, host, path, rule,
       CASE {ruled} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _repeats(span: int = SPAN) -> str:
    return f"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * span}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {span - 1})) AS p FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {span} THEN 1 ELSE 0 END AS new FROM windows JOIN firsts USING (s) WHERE first < doc_id),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM hits),
runs AS (SELECT doc_id, min(p) AS b, max(p) + {span} AS e FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS prev FROM runs),
kept AS (
  SELECT c.doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev + 1, 2 * (b - prev)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS k
  FROM cuts c JOIN bytes USING (doc_id) GROUP BY c.doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM bytes b LEFT JOIN kept USING (doc_id)
"""


#: Closes ``links (a, b)`` into ``comp (node, component)`` over ``nodes (node)``.
_CLOSED = """ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, w.b FROM reach r JOIN ways w ON r.other = w.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def _near_vectors(cosine: float = 0.95) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
nodes AS (SELECT vec_id AS node FROM embeddings), {_CLOSED},
degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, component = node AS kept FROM comp LEFT JOIN degree ON a = node
"""


def _near_texts(width: int = 3, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
items AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * n >= {percent} * (na + nb - n)),
nodes AS (SELECT doc_id AS node FROM documents), {_CLOSED}
SELECT node AS doc_id, len(g)::BIGINT AS n_shingles, component AS component_id, component = node AS kept FROM comp JOIN sets ON doc_id = node
"""


def _quality() -> str:
    word, per = "[^\\x20\\x09-\\x0D]", lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    measures = {"symbols_per_word": per("n_symbols", "n_words"), "chars_per_word": per("word_chars", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}
    steps = ", ".join(f"('{m}', {i}, {c:.17g}::DOUBLE)" for m, cutoffs in CUTOFFS.items() for i, c in enumerate(cutoffs))
    value = "CASE measure " + " ".join(f"WHEN '{m}' THEN {m}" for m in CUTOFFS) + " END"
    p, level = TOLERATED / len(CUTOFFS), FAILURE / len(CUTOFFS)
    chance = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, regexp_extract_all(coalesce(text, ''), '{word}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
repeated AS (SELECT doc_id, sum(least(5, coalesce(following - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM windows WHERE times > 1) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN repeated r ON b.doc_id = r.doc_id),
measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"{sql} AS {m}" for m, sql in measures.items())} FROM counted),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT * FROM measured WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
steps AS (SELECT * FROM (VALUES {steps}) v(measure, step, cutoff)),
counts AS (SELECT stratum, measure, step, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM holdout, steps GROUP BY ALL),
tested AS (
  SELECT *, k < n * {p!r} AND list_sum(list_transform(range(0, k + 1), lambda j: {chance})) <= {level!r} / (SELECT count(DISTINCT stratum) FROM holdout) AS passes FROM counts),
chosen AS (
  SELECT stratum, measure, arg_max(cutoff, step) AS cutoff FROM (SELECT *, min(CASE WHEN passes THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, measure ORDER BY step) AS so_far FROM tested)
  WHERE so_far = 1 GROUP BY stratum, measure),
beyond AS (SELECT DISTINCT doc_id FROM measured JOIN chosen USING (stratum) WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept, {", ".join(CUTOFFS)} FROM measured
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repeats": _repeats(), "op2_near_vectors": _near_vectors(), "op3_quality_rules": _quality(), "op4_near_texts": _near_texts(),
        "op7_mixing": _mixing(), "op8_url_filter": _url_filter(),
    }
