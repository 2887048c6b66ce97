"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

from agrolith.llm import licenses, quality_rules

_SPACE = r"[\x20\x09-\x0D]"


def _half(x: str, p: str, q: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) / 2 ELSE 0 END"


def _term(p: str, q: str) -> str:
    return f"({_half(p, p, q)} + {_half(q, p, q)})"


def divergence_rules() -> str:
    """op4: counts, both distances and the verdict."""
    classes = {
        "space": _SPACE, "upper": "[A-Z]", "digit": "[0-9]", "symbol": quality_rules.SYMBOLS, "sign": r"[!\"''()+,\-./:;=?@\[\\\]^_`{}~]", "other": r"[^\x00-\x7F]",
    }
    counted = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS c_{n}" for n, p in classes.items())
    rest = "length(t) - " + " - ".join(f"c_{n}" for n in classes)
    names = [*classes, "lower"]
    total = " + ".join(f"c_{n}" for n in names)
    share = " + ".join(_term(f"(c_{n} / chars)", f"r_{n}") for n in names)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
c0 AS (SELECT doc_id, lang, t, w, {counted} FROM d), c AS (SELECT *, {rest} AS c_lower, CAST(length(t) AS DOUBLE) AS chars FROM c0),
cr AS (SELECT lang, {", ".join(f"sum(c_{n}) / sum({total}) AS r_{n}" for n in names)} FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum({total}) > 0),
cd AS (SELECT doc_id, min(sqrt(greatest(0, {share}))) AS dist FROM c, cr WHERE chars > 0 GROUP BY doc_id),
wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d WHERE lang IS NOT NULL) GROUP BY lang, word),
tops AS (SELECT lang, word, n / total AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r, sum(n) OVER (PARTITION BY lang) AS total FROM wc) WHERE r <= {quality_rules.COMMON}),
langs AS (SELECT lang, greatest(0, 1 - sum(q)) AS rest FROM tops GROUP BY lang),
p AS (SELECT doc_id, word, count(*) / n AS p FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tops) GROUP BY doc_id, word, n),
k AS (SELECT doc_id, l.lang, rest, p.p, coalesce(q, 0) AS q FROM p CROSS JOIN langs l LEFT JOIN tops ON tops.lang = l.lang AND tops.word = p.word),
ks AS (SELECT doc_id, lang, sum({_term("p", "q")}) AS d, sum(p) AS p, sum(q) AS q FROM k GROUP BY doc_id, lang),
ka AS (SELECT d.doc_id, rest, coalesce(ks.d, 0) AS dd, greatest(1 - coalesce(p, 0), 0) AS pr, coalesce(q, 0) AS q FROM d CROSS JOIN langs l LEFT JOIN ks ON ks.doc_id = d.doc_id AND ks.lang = l.lang WHERE len(w) > 0),
wd AS (SELECT doc_id, min(sqrt(greatest(0, dd + greatest(1 - rest - q, 0) / 2 + {_term("pr", "rest")}))) AS dist FROM ka GROUP BY doc_id),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
j AS (SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 chars, cd.dist AS cdist, wd.dist AS wdist FROM c LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(chars >= {quality_rules.LEAST_CHARS} AND cdist > {quality_rules.MOST_CLASS_DISTANCE}, false)
 AND NOT coalesce(n_words >= {quality_rules.LEAST_WORDS} AND wdist > {quality_rules.MOST_WORD_DISTANCE}, false) AS kept, round(cdist, 6) AS class_distance, round(wdist, 6) AS word_distance FROM j"""


def tfidf_licenses() -> str:
    """op8: own licences by cosine, and the nearest directory's."""
    quoted = ", ".join(f"({k}, '{t.license}', '{t.text}', {t.strength}, {t.least})" for k, t in enumerate(licenses.TEMPLATES))
    terms = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    known = ", ".join(f"'{t}'" for t in sorted({t.removesuffix("-only").removesuffix("-or-later") for t in licenses.TAGS}))
    return f"""
WITH tpl(k, name, body, strength, least) AS (VALUES {quoted}), tt AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({terms.format("body")}) AS term FROM tpl) GROUP BY k, term),
f0 AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang, 'd' || CAST(doc_id // 10 % 100 AS VARCHAR)) AS dir, n_chars <= 400 AS is_file FROM documents),
n AS (SELECT count(*) AS n FROM f0), dt AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({terms.format("t")}) AS term FROM f0) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT v.term, ln(1 + n) + 1 - ln(1 + coalesce(df, 0)) AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN n LEFT JOIN dt USING (term)),
tn AS (SELECT k, sqrt(sum((tf * idf) ** 2)) AS norm FROM tt JOIN idf USING (term) GROUP BY k),
post AS (SELECT k, term, tf * idf / norm AS weight FROM tt JOIN idf USING (term) JOIN tn USING (k)),
u AS (SELECT doc_id, unnest(range(len(ls))) AS unit, unnest(ls) AS body FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM f0) UNION ALL SELECT doc_id, -1, t FROM f0 WHERE is_file
 UNION ALL SELECT doc_id, -2 - unnest(range(len(ss))), unnest(ss) FROM (SELECT doc_id, regexp_split_to_array(t, '{licenses.SENTENCE_END}') AS ss FROM f0)),
ut AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest({terms.format("body")}) AS term FROM u) GROUP BY 1, 2, 3),
ux AS (SELECT doc_id, unit, term, tf * coalesce(idf, ln(1 + n) + 1) AS x FROM ut CROSS JOIN n LEFT JOIN idf USING (term)),
un AS (SELECT doc_id, unit, sqrt(sum(x * x)) AS norm FROM ux GROUP BY 1, 2),
s AS (SELECT doc_id, unit, k, round(sum(x * weight) / any_value(norm), 6) AS score FROM ux JOIN post USING (term) JOIN un USING (doc_id, unit) GROUP BY 1, 2, 3),
ex AS (SELECT doc_id, unit, regexp_replace(x, '{licenses.LATER}', '', 'g') AS name FROM (SELECT doc_id, unit, regexp_extract(body, '{licenses.EXPRESSION}', 1) AS x FROM u WHERE unit >= 0) WHERE x <> ''),
cand AS (SELECT doc_id, unit, k, name, strength, score FROM s JOIN tpl USING (k) JOIN f0 USING (doc_id) WHERE score >= least AND (strength > {licenses.RESERVED} OR unit >= -1 OR regexp_matches(t, '{licenses.COPYRIGHT}'))
 UNION ALL SELECT doc_id, unit, -1, name, {licenses.DECIDING}, 1.0 FROM ex WHERE len(list_filter(regexp_split_to_array(regexp_replace(name, '{licenses.EXCEPTION}', '', 'g'), '{licenses.BETWEEN}'), lambda x: x NOT IN ('', 'AND', 'OR', {known}))) = 0),
best AS (SELECT doc_id, name, score, strength FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, score DESC, k, unit) AS r FROM cand) WHERE r = 1),
lf AS (SELECT dir AS above, name, strength FROM (SELECT dir, name, strength, row_number() OVER (PARTITION BY dir ORDER BY strength DESC, score DESC, dir || '/LICENSE.' || doc_id) AS r FROM best JOIN f0 USING (doc_id) WHERE is_file) WHERE r = 1),
up AS (SELECT DISTINCT dir, i AS up, array_to_string(string_split(dir, '/')[1:len(string_split(dir, '/')) - i], '/') AS above FROM f0, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i <= len(string_split(dir, '/'))),
near AS (SELECT dir, min(struct_pack(up := up, name := name, strength := strength)) AS m FROM up JOIN lf USING (above) GROUP BY dir),
own AS (SELECT doc_id, best.* EXCLUDE (doc_id) FROM best JOIN f0 USING (doc_id) LEFT JOIN near USING (dir) WHERE NOT coalesce(best.strength = {licenses.RESERVED} AND m.strength > {licenses.RESERVED}, false))
SELECT doc_id, own.name AS own_license, own.score AS own_score, coalesce(own.name, m.name) AS license, CASE WHEN own.name IS NOT NULL THEN 'own' WHEN m IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
 CASE WHEN own.name IS NULL THEN CAST(m.up AS INTEGER) END AS up FROM f0 LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)"""


def hard_negatives() -> str:
    """op11: all scores of the anchors, both rankings and the windows."""
    product = "list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i]))"
    return f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(coalesce({product}, 0) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE label = own) WHERE r <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS r
 FROM p JOIN s USING (anchor_id) WHERE s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10"""


def merkle_manifest() -> str:
    """op12: levels by recursion over (tree, level, place), proofs and folds by recursion over a leaf's ancestors; CRC-32 bit by bit."""
    field = lambda x: f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: list_reduce(list_prepend(xor(c, d), CAST(range(8) AS BIGINT[])), {step})), 4294967295)"
    levels = lambda name, base: f"""{name} AS ({base} UNION ALL
 SELECT tree, level + 1, place // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8)"""  # noqa: E731
    run = lambda name: f"SELECT tree, level, place // 8 AS run, list(h ORDER BY place) AS hs FROM {name} WHERE n > 1 GROUP BY ALL"
    beside = "array_to_string(hs[1:place % 8], '') AS b, array_to_string(hs[place % 8 + 2:], '') AS a"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim FROM documents),
x AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
{levels("lv", "SELECT tree, 0 AS level, place, n, leaf AS h FROM x")}, sub AS (SELECT tree, h FROM lv WHERE n = 1),
{levels("tv", "SELECT 0 AS tree, 0 AS level, tree AS place, count(*) OVER () AS n, h FROM sub")}, top AS (SELECT h FROM tv WHERE n = 1),
lr AS ({run("lv")}), tr AS ({run("tv")}),
path AS (SELECT tree, leaf_place, level, 0 AS upper, {beside} FROM (SELECT x.tree, x.place AS leaf_place, level, hs, x.place // CAST(8 ** level AS BIGINT) AS place FROM x JOIN lr ON lr.tree = x.tree AND run = x.place // CAST(8 ** (level + 1) AS BIGINT))
 UNION ALL SELECT tree, leaf_place, level, 1, {beside} FROM (SELECT x.tree, x.place AS leaf_place, level, hs, x.tree // CAST(8 ** level AS BIGINT) AS place FROM x JOIN tr ON run = x.tree // CAST(8 ** (level + 1) AS BIGINT))),
steps AS (SELECT tree, leaf_place, list(struct_pack(b := b, a := a) ORDER BY upper, level) AS s FROM path GROUP BY ALL)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(array_to_string(list_transform(s, lambda p: p.b || p.a), ''), '')) AS proof_sha256,
 list_reduce(list_prepend(coalesce(claim, leaf), list_transform(s, lambda p: p.b || chr(1) || p.a)), lambda h, p: sha256(replace(p, chr(1), h))) AS folded_root, folded_root = root AS verified
FROM x JOIN sub USING (tree) CROSS JOIN top LEFT JOIN steps ON steps.tree = x.tree AND leaf_place = x.place"""


ORACLES = {"op4_divergence_rules": divergence_rules(), "op8_tfidf_licenses": tfidf_licenses(), "op11_residual_pq_negatives": hard_negatives(), "op12_duckdb_merkle": merkle_manifest()}
