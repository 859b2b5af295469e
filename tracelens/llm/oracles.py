"""DuckDB SQL of those queries that SQL can express, over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"
BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({LOWER.format(column)}, '{pattern}')"


OP1 = f"""WITH d AS (SELECT doc_id, {_words("text", BENCHMARK_WORD)} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", BENCHMARK_WORD)} AS w FROM benchmark),
 win AS (SELECT item, j, n, array_to_string(w[j:j+n-1], ' ') AS k FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM win),
 dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
 hit AS (SELECT doc_id, i, j, n, item FROM dw JOIN win USING (n, k)),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
 chains AS (SELECT doc_id, min(i) AS i, max(i) - min(i) + any_value(n) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS g FROM hit) GROUP BY doc_id, item, n, i - j, g),
 longest AS (SELECT doc_id, n AS longest_words, i - 1 AS longest_at FROM chains QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
   CAST(coalesce(longest_words, 0) AS BIGINT) AS longest_words, CAST(coalesce(longest_at, -1) AS BIGINT) AS longest_at
 FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)"""

#: Classes of equal word sets; candidates share one of the rarest words that must be shared.
OP8 = f"""WITH l AS (SELECT doc_id, i, x.line AS line, list_sort(list_distinct({_words("x.line", WORD)})) AS w
   FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(len(string_split(coalesce(text, ''), chr(10))))), recursive := false) AS z FROM documents) q, LATERAL (SELECT z[1] AS line, z[2] AS i) x),
 c AS (SELECT row_number() OVER (ORDER BY min((doc_id, i))) AS id, w, len(w) AS n FROM l WHERE len(w) > 0 GROUP BY w),
 cw AS (SELECT id, n, unnest(w) AS word FROM c),
 f AS (SELECT word, count(*) AS f FROM cw GROUP BY 1),
 p AS (SELECT id, n, word FROM cw JOIN f USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, word) <= n - (n * 80 + 99) // 100 + 1),
 cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND b.id < a.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
 gone AS (SELECT DISTINCT a FROM (SELECT a, x.n + y.n AS s, len(list_intersect(x.w, y.w)) AS k FROM cand JOIN c x ON x.id = a JOIN c y ON y.id = b) WHERE k * 100 >= (s - k) * 80),
 m AS (SELECT l.doc_id, l.i, l.line, l.w != [] AND (a IS NOT NULL OR row_number() OVER (PARTITION BY l.w ORDER BY l.doc_id, l.i) > 1) AS cut FROM l LEFT JOIN c ON l.w = c.w LEFT JOIN gone ON a = c.id)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", WORD)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
 e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
 low AS (SELECT id, min(seen) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN low ON id = d.doc_id"""

#: Levels of 16 that the SQL climbs: enough for 16 ** 5 rows a source, and 16 ** 3 sources.
MERKLE_LEVELS, MERKLE_TOP = 5, 3
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _merkle() -> str:
    """Levels l0, l1, .. of each source, u0, u1, .. of the subroots; r* their runs; f* the folds of each row."""

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: ascii(CAST(doc_id AS VARCHAR)[p])::UBIGINT), lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS (SELECT doc_id, source, coalesce('1' || source, '0') AS s, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS sib, coalesce(other, leaf) AS v FROM leaves)",
        "l0 AS (SELECT s, p, leaf AS h FROM f0)",
    ]

    def climb(name: str, first: int, levels: int, key: str) -> None:
        for k in range(levels):
            parts.append(f"r{name}{k} AS (SELECT s, p // 16 AS q, list(h ORDER BY p) AS run FROM (SELECT *, count(*) OVER ({key}) AS n FROM {name}{k}) WHERE n > 1 GROUP BY s, q)")
            parts.append(f"{name}{k + 1} AS (SELECT s, q AS p, sha256(array_to_string(run, '')) AS h FROM r{name}{k})")
            row, pos = ("p", f"p // {16**k}") if name == "l" else ("pos", f"pos // {16**k}")
            left, right = f"coalesce(array_to_string(run[1:({pos}) % 16], ''), '')", f"coalesce(array_to_string(run[({pos}) % 16 + 2:], ''), '')"
            parts.append(f"f{first + k + 1} AS (SELECT f.* EXCLUDE (sib, v), CASE WHEN run IS NULL THEN sib ELSE sib || {left} || {right} END AS sib, CASE WHEN run IS NULL THEN v ELSE sha256({left} || v || {right}) END AS v FROM f{first + k} f LEFT JOIN r{name}{k} r ON r.q = f.{row} // {16 ** (k + 1)}" + (" AND r.s = f.s" if name == "l" else "") + ")")

    climb("l", 0, MERKLE_LEVELS, "PARTITION BY s")
    tops = " UNION ALL ".join(f"SELECT s, min(h) AS h, {k} AS k FROM l{k} GROUP BY s HAVING count(*) = 1" for k in range(MERKLE_LEVELS + 1))
    parts.append(f"subs AS (SELECT s, arg_min(h, k) AS subroot FROM ({tops}) GROUP BY s)")
    parts.append("u0 AS (SELECT 'all' AS s, row_number() OVER (ORDER BY encode(s)) - 1 AS p, subroot AS h, s AS src FROM subs)")
    n = MERKLE_LEVELS
    parts.append(f"f{n + 1} AS (SELECT f.*, subs.subroot, u0.p AS pos FROM f{n} f JOIN subs ON subs.s = f.s JOIN u0 ON u0.src = f.s)")
    climb("u", n + 1, MERKLE_TOP, "PARTITION BY s")
    tops = " UNION ALL ".join(f"SELECT min(h) AS h, {k} AS k FROM u{k} HAVING count(*) = 1" for k in range(MERKLE_TOP + 1))
    parts.append(f"top AS (SELECT arg_min(h, k) AS root FROM ({tops}))")
    return "WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, v AS folded_root, v = root AS verified FROM f{n + 1 + MERKLE_TOP}, top"


OP12 = _merkle()

OP13 = """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 first AS (SELECT text, min(doc_id) AS first FROM t GROUP BY 1),
 lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
 d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text), regexp_matches(t.text, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS fails
   FROM t LEFT JOIN first ON first.text = t.text LEFT JOIN lab ON lab.doc_id = t.doc_id),
 c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2),
 l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
 o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step, o[step] AS f, o[1:step-1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 m AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS own, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM c, s),
 r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
   CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op8_line_dedup": OP8, "op10_superminhash": OP10, "op12_merkle_manifest": OP12, "op13_filter_audit": OP13}
