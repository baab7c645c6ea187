"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from scorecraft.llm import lm, url_filter

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_HASH = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT"

OP2 = f"""
WITH sized AS (SELECT doc_id, source, {_WORDS} AS size, {_HASH} AS h FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ssize,
    [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 3 * ssize AS lim,
    sum(ssize) OVER () - coalesce(sum(3 * ssize) OVER (ORDER BY 3.0 * ssize / w, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 3.0 * ssize / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest,
    row_number() OVER (ORDER BY 3.0 * ssize / w, source) AS rn
  FROM sources),
level AS (SELECT rest, wrest FROM steps WHERE rest * w <= lim * wrest ORDER BY rn LIMIT 1),
targets AS (
  SELECT s.source, s.ssize,
    CASE WHEN l.rest IS NOT NULL AND s.lim * l.wrest >= s.w * l.rest
      THEN CAST(s.w * l.rest AS DOUBLE) / CAST(l.wrest AS DOUBLE) ELSE CAST(s.lim AS DOUBLE) END AS target
  FROM steps s LEFT JOIN level l ON true),
plans AS (
  SELECT *, target - whole * ssize AS extra FROM (
    SELECT *, CASE WHEN ssize > 0 THEN CAST(floor(target / ssize) AS BIGINT) ELSE 0 END AS whole FROM targets)),
cells AS (
  SELECT source, h >> 30 AS cell, CAST(sum(size) AS BIGINT) AS tokens FROM sized GROUP BY source, h >> 30),
running AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY cell ROWS UNBOUNDED PRECEDING) AS upto FROM cells),
edges AS (
  SELECT r.source, min(r.cell) AS cell, arg_min(r.upto, r.cell) AS upto, arg_min(r.tokens, r.cell) AS tokens
  FROM running r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source WHERE r.upto > p.extra GROUP BY r.source),
cuts AS (
  SELECT p.*, coalesce(
    e.cell + CASE WHEN 2 * (p.extra - (e.upto - e.tokens)) >= e.tokens THEN 1 ELSE 0 END,
    CASE WHEN p.extra > 0 THEN 1073741824 ELSE 0 END) AS cut
  FROM plans p LEFT JOIN edges e ON p.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, c.ssize AS source_size, c.target,
  CAST(d.size * (c.whole + CASE WHEN (d.h >> 30) < c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ASC NULLS LAST
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _op6() -> str:
    host = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cases = {"rule": "", "ruled": ""}
    for verdict, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        cases["rule"] += fits + f"'{h}{p}' "
        cases["ruled"] += fits + f"'{verdict}' "
    up, down = url_filter.DAMPING
    unit, link = url_filter.UNIT, url_filter.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE judged AS MATERIALIZED (
  SELECT page_id, host, path, CASE {cases['rule']}END AS rule, CASE {cases['ruled']}END AS ruled FROM (
    SELECT page_id, {host.format('url')} AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
per_host AS (
  SELECT host, (count(*) FILTER (ruled = 'allow') * {unit}) // count(*) AS t,
    (count(*) FILTER (ruled = 'block') * {unit}) // count(*) AS d FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'T' AS kind, host, t AS mass FROM per_host WHERE t > 0 UNION ALL SELECT 'D', host, d FROM per_host WHERE d > 0),
found AS (
  SELECT src, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (
    SELECT {host.format('url')} AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS target FROM pages)),
links AS (SELECT src, dst, count(*) AS w FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
pairs AS (SELECT 'T' AS kind, src AS host, dst, w FROM links UNION ALL SELECT 'D', dst, src, w FROM links),
arcs AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY kind, host) AS out FROM pairs),
waves AS (
  SELECT 0 AS n, kind, host, CAST(mass * {down - up} // {down} AS HUGEINT) AS mass FROM seeds WHERE mass * {down - up} // {down} > 0
  UNION ALL
  SELECT any_value(v.n) + 1, a.kind, a.dst, CAST(sum((v.mass * a.w) // a.out * {up} // {down}) AS HUGEINT)
  FROM waves v JOIN arcs a ON a.kind = v.kind AND a.host = v.host GROUP BY a.kind, a.dst
  HAVING sum((v.mass * a.w) // a.out * {up} // {down}) > 0),
ranks AS (
  SELECT host, sum(mass) FILTER (kind = 'T') AS t, sum(mass) FILTER (kind = 'D') AS d FROM waves GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.ruled, CASE WHEN coalesce(r.d, 0) > {url_filter.RATIO} * coalesce(r.t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN ranks r ON j.host = r.host
"""


OP10 = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT DISTINCT vec_id, vec FROM sound WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.vec AS qv, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM queries q JOIN sound c ON c.vec_id IS DISTINCT FROM q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# CRC-32 by its table: eight steps of the reflected polynomial for each byte value.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc(values: str) -> str:
    """CRC-32 of a list of bytes, in a query that has ``crc_table``."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {values}), "
        "lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])))"
    )


_ID_BYTES = "CAST(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)) AS BIGINT[])"
_BYTES = "list_transform(range(octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))"
_HASH60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"

OP1 = f"""
WITH {_CRC_TABLE},
keyed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, encode(coalesce(text, '')) AS b,
    (({_HASH60.format("coalesce(text, '')")} >> 30) << 30) | ({_HASH60.format("coalesce(CAST(doc_id AS VARCHAR), '')")} >> 30) AS k
  FROM documents),
lined AS (
  SELECT doc_id, size, b, row_number() OVER w AS pos, 2 * sum(size) OVER w - size AS middle, sum(size) OVER () AS total
  FROM keyed WINDOW w AS (ORDER BY k, doc_id ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)),
sharded AS (SELECT *, least(CAST(middle * 40 AS HUGEINT) // (2 * total), 39) AS shard FROM lined)
SELECT doc_id, CAST(size AS BIGINT) AS size, CASE WHEN size = 16 THEN 0 ELSE {_crc(_BYTES)} END AS text_crc32, 'bytes' AS law,
  CAST(shard AS INTEGER) AS shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded, crc_table
"""

_LOWER_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT a, b FROM sym UNION SELECT r.doc_id, l.b FROM reached r JOIN sym l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

OP8 = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_crc(_ID_BYTES)} % 5 = 1 AS held_out, list_append({_LOWER_WORDS}, ' ') AS w FROM documents, crc_table),
tokens AS (
  SELECT doc_id, held_out, unnest(w) AS token, unnest(list_prepend(chr(10), w[:len(w) - 1])) AS before FROM d),
uni AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
contexts AS (SELECT before, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY before),
bi AS (SELECT before, token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY before, token),
totals AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM uni),
weighed AS (
  SELECT x.doc_id, x.held_out, coalesce(u.c, 0) AS c, coalesce(b.c, 0) AS cb, coalesce(k.c, 0) AS ck, n,
    (coalesce(u.c, 0) + {lm.ADDED}::DOUBLE) / (n + {lm.ADDED}::DOUBLE * (v + 1)) AS p
  FROM tokens x CROSS JOIN totals LEFT JOIN uni u ON u.token = x.token LEFT JOIN contexts k ON k.before = x.before
  LEFT JOIN bi b ON b.before = x.before AND b.token = x.token)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
  fsum(log10(p)) AS base_score, fsum(log10((cb + {lm.MU}::DOUBLE * p) / (ck + {lm.MU}::DOUBLE))) AS score
FROM weighed GROUP BY doc_id, held_out
"""


def _op11(source_levels: int = 6, top_levels: int = 4) -> str:
    """Trees of up to 16^source_levels leaves a source and 16^top_levels sources."""
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joined = "array_to_string(hs, '')"
    left, right = "array_to_string(hs[1:pos % 16], '')", "array_to_string(hs[pos % 16 + 2:], '')"
    steps = []

    def climb(nodes: str, ways: str, levels: int) -> None:
        for k in range(levels):
            steps.append(
                f"{nodes}_runs{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n "
                f"FROM {nodes}{k} GROUP BY tree, pos // 16)"
            )
            steps.append(
                f"{nodes}{k + 1} AS MATERIALIZED (SELECT tree, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256({joined}) END AS h, "
                f"(n + 15) // 16 AS n FROM {nodes}_runs{k})"
            )
            steps.append(
                f"{ways}{k + 1} AS (SELECT w.* EXCLUDE (pos, s, f), w.pos // 16 AS pos, "
                f"w.s || CASE WHEN n = 1 THEN '' ELSE {left} || {right} END AS s, "
                f"CASE WHEN n = 1 THEN w.f ELSE sha256({left} || w.f || {right}) END AS f "
                f"FROM {ways}{k} w JOIN {nodes}_runs{k} r ON r.tree = w.tree AND r.run = w.pos // 16)"
            )

    climb("node", "way", source_levels)
    steps.append(
        f"top0 AS MATERIALIZED (SELECT '' AS tree, tree AS source_tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, "
        f"count(*) OVER () AS n FROM node{source_levels})"
    )
    steps.append(
        f"up0 AS (SELECT w.doc_id, w.leaf, t.h AS subroot, w.s, w.f, t.pos, '' AS tree "
        f"FROM way{source_levels} w JOIN top0 t ON t.source_tree = w.tree)"
    )
    climb("top", "up", top_levels)
    return f"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {hashed('text')} AS leaf,
    CASE WHEN {_crc(_ID_BYTES)} % 5 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS f FROM documents, crc_table),
node0 AS MATERIALIZED (
  SELECT doc_id, tree, leaf AS h, f, row_number() OVER (PARTITION BY tree ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM d),
way0 AS (SELECT doc_id, tree, h AS leaf, '' AS s, f, pos FROM node0),
{', '.join(steps)}
SELECT u.doc_id, u.leaf, u.subroot, t.h AS root, sha256(u.s) AS proof_sha256, u.f AS folded_root, u.f = t.h AS verified
FROM up{top_levels} u JOIN top{top_levels} t ON t.tree = u.tree
"""


_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "((('0x' || substr(hx, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '')"
)

OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hx FROM pages),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS response
  FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN response END AS refers_to
FROM ranked
"""

SQL = {
    "op1_sharding": OP1,
    "op2_mixing": OP2,
    "op3_exact_dedup": OP3,
    "op5_near_dedup": OP5,
    "op6_url_filter": _op6(),
    "op8_lm": OP8,
    "op10_topk": OP10,
    "op11_merkle": _op11(),
    "op13_warc": OP13,
}
