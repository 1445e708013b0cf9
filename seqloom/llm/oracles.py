"""DuckDB SQL for the training-data operators that SQL can express."""

LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, {LINE_KEY} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, line, pos, common.key IS NOT NULL AND doc_id <> top AS dropped
  FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _step(rows: str, cap: str) -> str:
    """The next row of a fold over frames: x, had, from rows with weights b, their sum w and their number n."""
    return f"""
  SELECT * EXCLUDE (low, keys, b, w, n, had, x, last), x + 1 AS x, list_transform(low, lambda l, i: l + CASE WHEN keys[i] <= last THEN 1 ELSE 0 END) AS had
  FROM (SELECT *, list_sort(list_filter(keys, lambda k: k IS NOT NULL))[({cap} * (x + 1) - list_sum(low))::INTEGER] AS last
  FROM (SELECT *, list_transform(low, lambda l, i: CASE WHEN l * w < b[i] * {cap} * (x + 1) THEN (((l + 1) * w + b[i] * {cap} - 1) // (b[i] * {cap})) * n + i END) AS keys
  FROM (SELECT *, list_transform(b, lambda v, i: greatest(had[i], (v * {cap} * (x + 1)) // w)) AS low FROM ({rows}))))"""


#: Two levels of frames, which hold up to 65,536 slots.
OP9 = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS rows, round(pow(count(*)::DOUBLE, 0.5::DOUBLE), 6) AS weight FROM documents GROUP BY source),
src AS (SELECT source, (rows + 1) // 2 AS q, greatest(round(weight / max(weight) OVER () * 1099511627776)::BIGINT, 1) AS g FROM sizes),
e AS (SELECT list(source ORDER BY source NULLS FIRST) AS names, list(g ORDER BY source NULLS FIRST) AS g, list(q ORDER BY source NULLS FIRST) AS q, sum(g)::BIGINT AS w, count(*) AS n FROM src),
r AS (
  SELECT 0::BIGINT AS x, list_transform(g, lambda v: 0::BIGINT) AS had FROM e
  UNION ALL
  SELECT x, had FROM ({_step("SELECT r.x, r.had, e.g AS b, e.w, e.n FROM r, e WHERE r.x * 256 < list_max(list_transform(e.q, lambda v, i: (v * e.w + e.g[i] - 1) // e.g[i]))", "256")})),
frames AS (
  SELECT a.x AS f, a.had AS base, list_transform(z.had, lambda h, i: h - a.had[i]) AS b FROM r a JOIN r z ON z.x = a.x + 1),
s AS (
  SELECT f, 0::BIGINT AS x, list_transform(base, lambda v: 0::BIGINT) AS had FROM frames
  UNION ALL
  SELECT f, x, had FROM ({_step("SELECT s.f, s.x, s.had, frames.b, 256::BIGINT AS w, e.n FROM s JOIN frames USING (f), e WHERE s.x < 256", "1")})),
picked AS (
  SELECT f, a.x, base, a.had, list_position(list_transform(z.had, lambda h, i: h - a.had[i]), 1) AS i FROM s a JOIN s z USING (f) JOIN frames USING (f) WHERE z.x = a.x + 1),
plan AS (SELECT names[i] AS source, g[i] AS g, w, base[i] + had[i] AS nth, f * 256 + x AS slot FROM picked, e WHERE base[i] + had[i] < q[i]),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents)
SELECT doc_id, ranked.source, ranked.nth // 8 AS block, (ranked.nth % 8)::INTEGER AS seq, slot,
       (4 * (ranked.nth // 8)::HUGEINT * w // g)::BIGINT AS release, ((4 * (ranked.nth // 8 + 1)::HUGEINT * w + g - 1) // g)::BIGINT AS deadline
FROM ranked JOIN plan ON ranked.source IS NOT DISTINCT FROM plan.source AND ranked.nth // 2 = plan.nth
"""


def op10(rules: dict, alpha: float, delta: float) -> str:
    def measure(rule: str) -> str:
        over, under = rules[rule][0].split(" / ")
        return f"(({over})::DOUBLE / nullif({under}, 0))"

    tests = ", ".join(f"{{rule: '{rule}', nr: {i}, cutoff: {c}::DOUBLE, k: count(*) FILTER (coalesce({measure(rule)}, 0) > {c}::DOUBLE)}}" for rule, (_, grid) in rules.items() for i, c in enumerate(grid))
    beyond = " OR ".join(f"coalesce({measure(rule)} > cut_{rule}, false)" for rule in rules)
    cuts = ", ".join(f"min(t.cutoff) FILTER (t.rule = '{rule}') AS cut_{rule}" for rule in rules)
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counted AS (
  SELECT lang, count(*) AS n, [{tests}] AS tests
  FROM b SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY lang),
flat AS (SELECT lang, n, count(*) OVER () AS strata, tests FROM counted),
tested AS (SELECT lang, n, strata, unnest(tests) AS t FROM flat),
valued AS (
  SELECT *, {delta}::DOUBLE / (strata * {len(rules)}) AS level, CASE WHEN n = 0 OR t.k > n * {alpha}::DOUBLE THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, t.k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}::DOUBLE) + (n - j) * ln(1 - {alpha}::DOUBLE)))) END AS p_value
  FROM tested),
safe AS (SELECT *, bool_and(p_value <= level) OVER (PARTITION BY lang, t.rule ORDER BY t.nr) AS ok FROM valued),
chosen AS (SELECT lang, {cuts} FROM safe WHERE ok GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
FROM b LEFT JOIN chosen ON b.lang IS NOT DISTINCT FROM chosen.lang
"""

#: Words near each other share what is left when a character is taken out, or one is what is left of the other.
OP12 = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, flatten(list_transform(string_split(concat(coalesce(doc_id::VARCHAR, ''), ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)) AS bytes FROM own),
hashed AS (SELECT run, n, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, crc),
planted AS (SELECT n, CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM planted WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -other_n, 'w': encode(other)}) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 2 * words.n THEN decode(b.w) END AS form, CASE WHEN -b.m >= 2 * words.n THEN -b.m END AS form_n
  FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, coalesce(form, word) AS root, 1 AS step FROM formed UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(root, step) AS root FROM up GROUP BY word) USING (word)
"""


def op13(clusters: int, rounds: int, scale: int, dimensions: int, seed: int) -> str:
    """Plain rounds, every vector compared with every centroid."""
    parts = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1)::INTEGER AS cluster, x AS c FROM kept QUALIFY cluster < {clusters})"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': cluster}}) AS b FROM (
    SELECT r, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY p) AS c FROM (
    SELECT b.c AS cluster, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM (SELECT a{i}.b, x, unnest(range(1, {dimensions + 1})) AS p FROM kept JOIN a{i} USING (r)) GROUP BY ALL) GROUP BY cluster)"""
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    last = f"""SELECT vec_id, b.c AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON cluster = b.c"""
    return ",\n".join(parts) + "\n" + last
