"""DuckDB counterparts of the registered queries that SQL can express; they compute by the plain rules, not by the operators' methods."""

from __future__ import annotations

import string

from ratewright.llm import personal_data as pii

WORDS = r"[^\x20\x09-\x0D]+"

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT b, c FROM r JOIN both_ways ON a = doc_id)
SELECT n.doc_id, n AS n_shingles, component_id, n.doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

#: The same kinds in the dialect of SQL: no look-around, no possessive repeats.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
TESTS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: "
    f"CASE WHEN i % 2 = 1 THEN CAST(reverse({DIGITS})[i] AS INTEGER) ELSE (CAST(reverse({DIGITS})[i] AS INTEGER) * 2) % 10 + (CAST(reverse({DIGITS})[i] AS INTEGER) * 2) // 10 END)) % 10 = 0",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
    "ssn": "true",
}


def _matches(kind: str) -> str:
    """Rows (doc_id, start, rank, kind, m) of one kind: lengths of the pieces between matches give the places."""
    pattern, rank = PLAIN[kind], pii.KINDS.index(kind)
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(found) AS m, unnest(list_transform(range(1, len(found) + 1), lambda i:
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS a, t
FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS parts FROM d) WHERE len(found) > 0"""


def _kept(kind: str) -> str:
    score = ""
    if kind not in pii.BASE:
        around = f"concat_ws(' ', substr(t, greatest(a - {pii.CONTEXT_REACH}, 0) + 1, a - greatest(a - {pii.CONTEXT_REACH}, 0)), substr(t, a + length(m) + 1, {pii.CONTEXT_REACH}))"
        gain = f"CASE WHEN regexp_matches({around}, '{pii.CONTEXT[kind]}') THEN {pii.CONTEXT_GAIN} ELSE 0 END"
        loss = f"CASE WHEN regexp_matches({around}, '{pii.AGAINST}') THEN {pii.AGAINST_LOSS} ELSE 0 END"
        score = f" AND {pii.PRIOR[kind]} + {gain} - {loss} >= {pii.LEAST_SCORE}"
    return f"SELECT doc_id, a, rank, kind, a + length(m) AS b FROM ({_matches(kind)}) WHERE ({TESTS[kind]}){score}"


def op4() -> str:
    """Base kinds by their plain rules; of the added kinds, the social security numbers (no table here holds a bank account number)."""
    kinds = [kind for kind in pii.KINDS if kind != "iban"]
    spans = " UNION ALL ".join(_kept(kind) for kind in kinds)
    said = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in pii.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (rank < {len(pii.BASE)}), '')) AS base_sha256,
  coalesce({said} FILTER (rank IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id
"""


LETTERS = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, {WHITE}), {LETTERS}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, line, place, coalesce(doc_id < keeper, false) AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op13(rounds: int = 3, clusters: int = 16, size: int = 64, scale: int = 64) -> str:
    """Every round assigns the vectors and takes means, spelled out one after the other."""
    steps = []
    for i in range(rounds + 1):
        gap = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - x[i]) * (v[i] - x[i])))"
        steps.append(f"d{i} AS (SELECT vec_id, c, v, CAST({gap} AS BIGINT) AS distance FROM kept, c{i})")
        steps.append(f"a{i} AS (SELECT vec_id, v, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)")
        if i < rounds:
            parts = f"SELECT c, unnest(v) AS x, unnest(range({size})) AS k FROM a{i}"
            mean = "CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT)"
            steps.append(f"m{i} AS (SELECT c, list(x ORDER BY k) AS x FROM (SELECT c, k, {mean} AS x FROM ({parts}) GROUP BY c, k) GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    return f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS x FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {clusters})),
{", ".join(steps)},
s AS (SELECT c, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a{rounds}) AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN s ON s.c = a.c JOIN c{rounds} f ON f.c = a.c
"""


SQL = {"op4_personal_data": op4(), "op8_near_duplicates": OP8, "op11_line_dedup": OP11, "op13_centroid_clusters": op13()}
