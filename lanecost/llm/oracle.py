"""DuckDB statements for the queries that SQL can express; none shares code with the Spark side."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op8_quality_rules"] = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
),
m AS (
    SELECT doc_id, body, words, lines, len(words)::BIGINT AS n_words,
        coalesce(list_sum([length(w) for w in words]), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(regexp_extract_all(body, '[^\pL\x20\x09-\x0D]')) AS not_letters,
        len(list_filter(words, lambda w: list_contains([{stops}], w))) AS stops,
        len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...'))) AS dotted
    FROM t
),
w AS (
    SELECT doc_id, g.i AS i, array_to_string(m.words[g.i : g.i + 4], ' ') AS seq
    FROM m, unnest(range(1, greatest(len(m.words) - 3, 1))) AS g(i)
),
hit AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, seq) > 1),
cover AS (
    SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit)
    GROUP BY doc_id
),
j AS (SELECT m.*, coalesce(cover.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN cover USING (doc_id)),
v AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        list_filter([
            CASE WHEN coalesce(word_chars / nullif(n_words, 0), 0) NOT BETWEEN 1.5 AND 25 THEN 'mean_word_length' END,
            CASE WHEN coalesce(n_symbols / nullif(n_words, 0), 0) > 0.3 THEN 'symbol_ratio' END,
            CASE WHEN n_words >= 50 AND stops / n_words < 0.02 THEN 'stop_word_ratio' END,
            CASE WHEN coalesce((word_chars - not_letters) / nullif(word_chars, 0), 0) < 0.4 THEN 'letter_ratio' END,
            CASE WHEN coalesce(n_dup_lines / nullif(len(lines), 0), 0) > 0.5 THEN 'dup_line_ratio' END,
            CASE WHEN coalesce(dotted / nullif(len(lines), 0), 0) > 0.7 THEN 'ellipsis_line_ratio' END
        ], lambda x: x IS NOT NULL) AS failed
    FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed
FROM v
""".replace(
    "{stops}",
    ", ".join(
        f"'{w}'"
        for w in (
            "the of and to in is that it was for on are as with be by at this have from "
            "der die das und ist von zu den mit sich auf für im dem nicht ein eine als auch es an "
            "le la les de des et un une du en que est pour dans par sur au ne pas avec "
            "el los las del que y a se por con una su para es al lo como o"
        ).split()
    ),
)


# Matches of a kind with their places: the text is cut by the pattern, and lengths add up.
SPANS = """
{kind}_m AS (
    SELECT doc_id, rid, source, lang, string_split_regex(body, '{pattern}') AS gaps,
        regexp_extract_all(body, '{pattern}') AS hits, regexp_extract_all(body, '{pattern}', {group}) AS vals
    FROM t WHERE regexp_matches(body, '{pattern}')
),
{kind}_s AS (
    SELECT doc_id, rid, source, lang, {rank} AS rank, '{kind}' AS kind, vals[g.i] AS val,
        list_sum([length(x) for x in gaps[1 : g.i]])::BIGINT
            + coalesce(list_sum([length(x) for x in hits[1 : g.i - 1]]), 0)::BIGINT AS begin,
        length(hits[g.i]) AS size
    FROM {kind}_m, unnest(range(1, len(hits) + 1)) AS g(i)
    WHERE length(vals[g.i]) >= {shortest}
)"""

STATEMENTS["op7_secret_scans"] = (
    "WITH t AS (SELECT *, coalesce(text, '') AS body, row_number() OVER () AS rid FROM documents),"
    + ",".join(
        SPANS.format(kind=kind, pattern=pattern, group=group, rank=rank, shortest=shortest)
        for rank, (kind, pattern, group, shortest) in enumerate(
            [
                (
                    "assign",
                    """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
                    2,
                    6,
                ),
                ("access", "AKIA[A-Z0-9]+", 0, 20),
                ("hex", "[0-9a-f]+", 0, 24),
                ("runs", "[A-Za-z0-9+/_=-]+", 0, 20),
            ]
        )
    )
    + r"""
,
base AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
mixed AS (
    SELECT * REPLACE ('owned' AS kind) FROM runs_s
    WHERE regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]')
),
alone AS (
    SELECT * FROM mixed AS m WHERE NOT EXISTS (
        SELECT 1 FROM base AS b WHERE b.rid = m.rid AND b.begin < m.begin + m.size AND m.begin < b.begin + b.size)
),
found AS (SELECT * FROM base UNION ALL SELECT * FROM alone),
held AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) < 3 AS live FROM found GROUP BY val),
kept AS (SELECT * FROM found JOIN held USING (val) WHERE rank < 3 OR live),
agg AS (
    SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
        count(*) FILTER (NOT live) AS n_example,
        string_agg(kind || ':' || begin || ':' || (begin + size), ',' ORDER BY begin, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || begin || ':' || (begin + size), ',' ORDER BY begin, rank) AS spans
    FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN agg USING (rid)
"""
)


STATEMENTS["op6_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""

STATEMENTS["op10_substring_dedup"] = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
w AS (
    SELECT doc_id, g.i AS i, sha256(array_to_string(t.words[g.i : g.i + 19], ' ')) AS seq
    FROM t, unnest(range(1, greatest(len(t.words) - 18, 1))) AS g(i)
),
late AS (
    SELECT doc_id, i FROM w
    QUALIFY (doc_id, i) > (
        first_value(doc_id) OVER (PARTITION BY seq ORDER BY doc_id, i),
        first_value(i) OVER (PARTITION BY seq ORDER BY doc_id, i))
),
gone AS (SELECT DISTINCT doc_id, i + g.k AS i FROM late, unnest(range(20)) AS g(k)),
cut AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(
        list_filter(words, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' '), '')) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""


def _mixing(rounds: int = 10, fraction: float = 0.5) -> str:
    """Every scaling step is a CTE of its own."""
    parts = [
        r"""d AS (
    SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(lang, chr(0)) AS lang,
        CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty'
            WHEN (length(text) - length(replace(text, '|', ''))) * 50 > length(text) THEN 'table'
            WHEN (length(text) - length(replace(text, '!!', ''))) * 50 > length(text) THEN 'shouted'
            WHEN length(text) < 800 THEN 'short' WHEN length(text) < 4000 THEN 'plain' ELSE 'long' END AS topic,
        greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS n_tokens
    FROM documents
)""".replace("\\\\", "\\"),
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "f0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS weight FROM c)",
    ]
    for m in ("source", "lang", "topic"):
        share = f"SELECT {m}, sqrt(sum(tokens)) AS p FROM c GROUP BY {m}"
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS target FROM ({share}))")
    step = 0
    for _ in range(rounds):
        for m in ("source", "lang", "topic"):
            scaled = f"weight * target / sum(weight) OVER (PARTITION BY {m})"
            parts.append(
                f"f{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {scaled} AS weight"
                f" FROM f{step} JOIN t_{m} USING ({m}))"
            )
            step += 1
    parts.append(
        f"""o AS (
    SELECT *, weight / tokens AS r, row_number() OVER b AS pos,
        sum(tokens) OVER b - tokens AS given, sum(weight) OVER a AS rest, sum(tokens) OVER () AS total
    FROM f{step}
    WINDOW b AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS UNBOUNDED PRECEDING),
        a AS (ORDER BY weight / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)"""
    )
    parts.append(
        f"k AS (SELECT arg_min(({fraction} * total - given) / rest, pos) AS scale FROM o"
        f" WHERE ({fraction} * total - given) / rest * r < 1)"
    )
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS cell_weight,
    round(least(1.0, weight / tokens * scale), 9) AS prob,
    ('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0
        < least(1.0, weight / tokens * scale) AS sampled
FROM d JOIN f{step} USING (source, lang, topic), k
""".replace("{step}", str(step))
    )


# sparse cells of the small tables settle within 28 rounds, those of the larger ones within 12
STATEMENTS["op4_mixing"] = _mixing(rounds=60)

STATEMENTS["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(t.w[g.i : g.i + 4], ' ') AS shingle
    FROM t, unnest(range(1, greatest(len(t.w) - 3, 2))) AS g(i) WHERE len(t.w) > 0
),
each AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles),
sizes AS (SELECT doc_id, count(shingle) AS n FROM t LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
    SELECT doc_id, doc_id AS root FROM sizes
    UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id
),
classes AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN classes USING (doc_id)
"""


def _crc32_step(c: str, byte: str) -> str:
    """A byte's step of crc32 in SQL, four bits at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ 0xEDB88320 * (k & 1)
        table.append(k)
    x = f"xor({c}, {byte})"
    for _ in range(2):
        x = f"xor(({x}) >> 4, list_extract({table}, (({x}) & 15) + 1))"
    return x


STATEMENTS["op11_spelling_variants"] = r"""
WITH d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS text FROM documents),
t AS (
    SELECT id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM d
),
runs AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM t WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
    SELECT run, n, [4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
    FROM runs
),
sums AS (SELECT run, n, xor(list_reduce(b, lambda c, x: {step}), 4294967295) AS h FROM bytes),
slipped AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM sums
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
    SELECT word, g.i AS i, substr(word, 1, g.i - 1) || substr(word, g.i + 1) AS cut
    FROM words, unnest(range(1, length(word) + 1)) AS g(i)
),
near AS (
    SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION SELECT w.word, c.word FROM words w JOIN cuts c ON w.word = c.cut
    UNION SELECT c.word, w.word FROM words w JOIN cuts c ON w.word = c.cut
),
best AS (
    SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, o.n AS other_n
    FROM near JOIN words o ON o.word = near.other
    QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1
),
judged AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best ON best.word = w.word
),
chain AS (
    SELECT word, form AS root, 1 AS step FROM judged WHERE form IS NOT NULL
    UNION ALL
    SELECT c.word, j.form, step + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n
FROM judged LEFT JOIN roots USING (word)
""".replace("WITH d AS", "WITH RECURSIVE d AS").replace("{step}", _crc32_step("c", "x"))

STATEMENTS["op12_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents
),
t AS (
    SELECT id, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM d
),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT lang, source, coalesce(any_value(total), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source)
    GROUP BY ALL
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * s.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
    GROUP BY ALL
),
pairs AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
    FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
),
both_parts AS (
    SELECT * FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, pos::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS pos FROM both_parts)
WHERE part = 'pair' OR pos <= 50
"""


def statements() -> dict[str, str]:
    return dict(STATEMENTS)
