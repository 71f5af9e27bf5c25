"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from tapeloom.llm import rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\x20\x09-\x0D"


def _bits(names) -> str:
    return " + ".join(f"CASE WHEN {rules.RULES[n]} THEN {1 << rules.BITS[n]} ELSE 0 END" for n in names)


OP6 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
     x AS (SELECT doc_id, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i, w FROM t WHERE len(w) >= {rules.WINDOW}),
     y AS (SELECT doc_id, i, array_to_string(w[i : i + {rules.WINDOW - 1}], ' ') AS win FROM x),
     z AS (SELECT doc_id, i FROM y QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
     r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM z) GROUP BY 1),
     l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^{SPACE}]')) AS lines FROM t),
     m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
           FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
     b AS (SELECT *, CAST({_bits(rules.RULES)} AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_bits & {rules.mask(rules.BASE)} <> 0 AS base_failed, rule_bits & {rules.mask(rules.BASE) | rules.mask(rules.POLICIES["corpus-1"])} = 0 AS kept, rule_bits FROM b
"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP9 = f"""
WITH u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) g(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_examples
FROM u GROUP BY conv_id
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark), p AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM i WHERE len(w) > 0),
     q AS (SELECT DISTINCT item, k, array_to_string(w[a : a + k - 1], ' ') AS win FROM p),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents), x AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k),
     y AS (SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS win FROM x), h AS (SELECT doc_id, a, y.k, item FROM y JOIN q ON y.win = q.win AND y.k = q.k),
     n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS pos FROM h) GROUP BY 1), g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_Q = "list_transform(embedding, lambda x: CAST(floor({0} * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"

OP11 = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_Q.format(256)} AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
     s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST({_DOT.format("a.v", "x.v")} AS BIGINT) AS score FROM r a JOIN r x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
     x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20), y AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win FROM x),
     z AS (SELECT doc_id, i FROM y QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
     c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM z) GROUP BY 1),
     e AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, unnest(gone) AS p FROM c)), g AS (SELECT doc_id, count(DISTINCT run) AS n_intervals FROM e GROUP BY 1),
     u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM u ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM c) USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_intervals, 0) AS n_intervals
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _kmeans(rounds: int) -> str:
    """Rounds of nearest centroids by plain squared distances."""
    away = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "SELECT vec_id, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d FROM (SELECT x.vec_id, c.cluster, CAST({0} AS BIGINT) AS d FROM x, c{1} c) c GROUP BY 1"
    means = """SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT cluster, list(CAST(floor_of AS BIGINT) ORDER BY i) AS v FROM
        (SELECT cluster, i, (s - ((s % n) + n) % n) // n AS floor_of FROM (SELECT cluster, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM
            (SELECT cluster, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{0} JOIN x USING (vec_id)) GROUP BY 1, 2)) GROUP BY 1) m USING (cluster)"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS ({nearest.format(away, k)})")
        if k < rounds:
            steps.append(f"c{k + 1} AS ({means.format(k)})")
    start = "SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS cluster, v FROM x QUALIFY cluster < 16"
    return f"""WITH x AS (SELECT vec_id, {_Q.format(64)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}), c0 AS ({start}), {", ".join(steps)}
        SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES: dict[str, str] = {
    "op6_rule_ledger": OP6,
    "op9_chat_prefix_target": OP9,
    "op10_wu_manber": OP10,
    "op11_gnat_negatives": OP11,
    "op12_rabin_karp": OP12,
    "op13_walsh_hadamard": _kmeans(3),
}
