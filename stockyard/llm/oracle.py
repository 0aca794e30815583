"""DuckDB texts of the queries that SQL can express.

The rest have none: trained models (1, 6), a vocabulary's segmentation (2, 9), learned
region weights (5), XXH64 fingerprints (10) and MinHash (8). Their tests compare with
brute force, public libraries or held-out labels.
"""

from stockyard.llm import centroids, nearest, quality_rules, url_filter


def _nearest():
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.rid AS query_row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {nearest.EVERY} = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM pairs WINDOW w AS (PARTITION BY query_row ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {nearest.K}
"""


def _quality_rules():
    rates = {
        "letters": "1000 * word_chars // greatest(n_words, 1)",
        "symbols": "1000 * n_symbols // greatest(n_words, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    }
    unpivot = " UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS rate, CAST({value} AS BIGINT) AS x FROM m WHERE NOT base_failed"
        for name, value in rates.items()
    )

    def quantiles(keys):
        by = ", ".join([*keys, "rate"])
        at = ", ".join(
            f"min(CASE WHEN upto * 100 >= total * {p} THEN bucket END) AS q{p}" for p in (25, 50, 75)
        )
        return f"""
  SELECT {by}, max(total) AS total, {at} FROM (
    SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
    FROM (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket)
  ) GROUP BY {by}"""

    pick = ", ".join(
        f"CASE WHEN o.total >= {quality_rules.MIN_GROUP} THEN o.q{p} "
        f"WHEN l.total >= {quality_rules.MIN_GROUP} THEN l.q{p} ELSE a.q{p} END AS q{p}" for p in (25, 50, 75)
    )
    tests = []
    for name, (least, both) in quality_rules.RATES.items():
        fence = quality_rules.FENCE
        tests.append(f"WHEN rate = '{name}' THEN x > q75 + greatest({fence} * (q75 - q50), {least})"
                     + (f" OR x < q25 - greatest({fence} * (q50 - q25), {least})" if both else ""))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), grams AS (
  SELECT rid, i, array_to_string(ws[i : i + {quality_rules.RUN - 1}], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {quality_rules.RUN - 2})) AS i FROM w)
), twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + {quality_rules.RUN})) AS p FROM twice) GROUP BY rid
), counts AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid
), m AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
    OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM counts
), sketch AS (
  SELECT lang, source, rate, (x >> e) << e AS bucket, count(*) AS n FROM (
    SELECT *, greatest(length(bin(x)) - {quality_rules.DIGITS}, 0) AS e FROM ({unpivot})
  ) GROUP BY ALL
), own AS ({quantiles(["lang", "source"])}
), by_lang AS ({quantiles(["lang"])}
), overall AS ({quantiles([])}
), cuts AS (
  SELECT o.lang, o.source, o.rate, {pick} FROM own o
  JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN overall a ON o.rate = a.rate
), broken AS (
  SELECT DISTINCT m.rid FROM (
    SELECT rid, lang, source, unnest([{", ".join(f"'{r}'" for r in rates)}]) AS rate,
      unnest([{", ".join(rates.values())}]) AS x FROM m
  ) m JOIN cuts c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
    AND m.rate = c.rate
  WHERE CASE {" ".join(t.replace("rate =", "c.rate =") for t in tests)} END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken.rid IS NULL AS kept
FROM m LEFT JOIN broken ON m.rid = broken.rid
"""


def _url_filter():
    order, strength = url_filter.ORDER, url_filter.STRENGTH

    def first_rule(value):
        cases = []
        for verdict, rule in sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r)):
            host, slash, rest = rule.partition("/")
            cases.append(
                f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') "
                f"THEN '{value((verdict, rule))}'"
            )
        return f"CASE {' '.join(cases)} END"

    sides = {"accepted": "allow", "rejected": "block"}
    tables, joins, chance = [], [], {side: str(1.0 / url_filter.ALPHABET) for side in sides}
    for k in range(order + 1):
        for name, key in ((f"s{k}", f"right(gram, {k + 1})"), (f"b{k}", f"substr(gram, {order + 1 - k}, {k})")):
            sums = ", ".join(
                f"sum(CASE WHEN verdict = '{v}' THEN n ELSE 0 END) AS {side}" for side, v in sides.items()
            )
            tables.append(f"{name} AS (SELECT {key} AS key, {sums} FROM known GROUP BY 1)")
            joins.append(f"LEFT JOIN {name} ON {key.replace('gram', 'g.gram')} = {name}.key")
        for side in sides:
            chance[side] = (
                f"((coalesce(s{k}.{side}, 0) + CAST({strength} AS DOUBLE) * {chance[side]}) "
                f"/ (coalesce(b{k}.{side}, 0) + CAST({strength} AS DOUBLE)))"
            )
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, {first_rule(lambda r: r[1])} AS rule, {first_rule(lambda r: r[0])} AS decided,
    repeat(chr(2), {order}) || host || path || chr(3) AS padded FROM p
), grams AS (
  SELECT rid, decided AS verdict, substr(padded, i, {order + 1}) AS gram
  FROM (SELECT rid, decided, padded, unnest(range(1, length(padded) - {order - 1})) AS i FROM r)
), counts AS (SELECT gram, verdict, count(*) AS n FROM grams GROUP BY ALL
), known AS (SELECT * FROM counts WHERE verdict IS NOT NULL
), {", ".join(tables)}
, ratios AS (
  SELECT g.gram, ln({chance["accepted"]}) - ln({chance["rejected"]}) AS ratio
  FROM (SELECT DISTINCT gram FROM counts) g {" ".join(joins)}
), scores AS (
  SELECT rid, sum(ratio) / count(*) AS score FROM grams JOIN ratios USING (gram) GROUP BY rid
), scored AS (SELECT * FROM r JOIN scores USING (rid)
), sides AS (
  SELECT avg(score) FILTER (decided = 'allow') AS ma, stddev_pop(score) FILTER (decided = 'allow') AS sa,
    avg(score) FILTER (decided = 'block') AS mb, stddev_pop(score) FILTER (decided = 'block') AS sb FROM scored
), cutoff AS (
  SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN CAST('-inf' AS DOUBLE)
    WHEN sa + sb = 0 THEN (ma + mb) / 2 ELSE (ma * sb + mb * sa) / (sa + sb) END AS c FROM sides
)
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN score >= c THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM scored, cutoff
"""


def _centroids():
    k, dim = centroids.CLUSTERS, centroids.DIM
    far = "list_sum(list_transform(range(1, len(x.p) + 1), lambda i: (x.p[i] - c.p[i]) * (x.p[i] - c.p[i])))"

    def assigned(n):
        """The best of distance * k + number is the nearest centroid, the smallest number of a tie."""
        return f"""a{n} AS (
  SELECT rid, vec_id, p, best % {k} AS k, best // {k} AS distance FROM (
    SELECT x.rid, any_value(x.vec_id) AS vec_id, any_value(x.p) AS p, min(CAST({far} AS BIGINT) * {k} + c.k) AS best
    FROM kept x, c{n} c GROUP BY x.rid))"""

    def moved(n):
        return f"""m{n} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM (
    SELECT k, i, CAST(sum(p[i]) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT k, p, unnest(range(1, {dim + 1})) AS i FROM a{n}) GROUP BY k, i) GROUP BY k
), c{n + 1} AS (SELECT c.k, coalesce(m.p, c.p) AS p FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k)"""

    rounds = ", ".join(f"{assigned(n)}, {moved(n)}" for n in range(centroids.ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {centroids.SCALE}) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, p
  FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k}
), {rounds}, {assigned(centroids.ROUNDS)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN c{centroids.ROUNDS} c ON a.k = c.k
"""


def _conversation_trie():
    """Nodes are keyed by the digest of their path, chained turn by turn."""
    # CRC-32 of the decimal id: eight shifts for every byte
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""
    return f"""
WITH turns AS (
  SELECT conv_id, sha256(length(r) || ':' || r || t) AS digest, turn,
    len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({crc} AS BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT c.conv_id, p.digest, p.words, row_number() OVER (PARTITION BY c.conv_id ORDER BY p.conv_id = c.base AND p.place <= c.h DESC, p.place) AS place
  FROM convs c JOIN placed p ON (p.conv_id = c.base AND p.place <= c.h) OR (p.conv_id = c.conv_id AND p.place > c.h)
), paths AS (
  SELECT conv_id, place AS depth, words, string_agg(digest, '') OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), node AS (
  SELECT path, p.depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e.depth = p.depth), '')) AS ends
  FROM paths p JOIN ends e USING (conv_id) GROUP BY path, p.depth
), child AS (
  SELECT parent.path, count(*) AS n FROM node parent JOIN node c
    ON c.depth = parent.depth + 1 AND left(c.path, 64 * parent.depth) = parent.path GROUP BY 1
), subtree AS (
  SELECT top.path, count(*) FILTER (child.n IS NULL) AS n_leaves, sum((below.n_convs - 1) * below.words) AS saved
  FROM node top JOIN node below ON below.depth >= top.depth AND left(below.path, 64 * top.depth) = top.path
  LEFT JOIN child ON child.path = below.path GROUP BY 1
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM node n JOIN subtree s ON s.path = n.path LEFT JOIN child c ON c.path = n.path
LEFT JOIN node up ON up.depth = n.depth - 1 AND up.path = left(n.path, 64 * (n.depth - 1))
"""


def oracle_sql():
    return {
        "op11_conversation_trie": _conversation_trie(),
        "op12_centroids": _centroids(),
        "op3_nearest": _nearest(),
        "op4_url_filter": _url_filter(),
        "op7_quality_rules": _quality_rules(),
    }
