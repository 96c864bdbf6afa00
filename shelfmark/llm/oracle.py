"""SQL twins of the training-data queries, for DuckDB."""

from __future__ import annotations

from shelfmark.llm import secret_links
from shelfmark.llm.licenses import RULES, SENTENCES

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({FOLD}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array({FOLD}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
word AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
hits AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items
  FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({FOLD}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""

LINE_DEDUP = """
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
bare AS (
  SELECT doc_id, source, list_distinct(list_filter(list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '')) AS names
  FROM l),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
seen AS (SELECT source, unnest(names) AS line FROM bare),
counts AS (SELECT source, line, count(*) AS pages FROM seen GROUP BY source, line HAVING count(*) >= 2),
bad AS (
  SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.pages > 0.05 * t.total GROUP BY c.source),
kept AS (
  SELECT doc_id, l.lines AS before,
    list_filter(l.lines, lambda x: NOT list_contains(coalesce(bad.lines, []), trim(x, chr(32) || chr(9) || chr(13)))) AS lines
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, coalesce(len(before), 0)::BIGINT AS n_lines, coalesce(len(lines), 0)::BIGINT AS n_kept,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS text_sha256
FROM kept
"""

MIX = """
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce(source, '') AS name FROM documents),
numbered AS (
  SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS r FROM given),
share AS (
  SELECT DISTINCT name, CASE name WHEN 'src0' THEN 6 WHEN 'src1' THEN 5 WHEN 'src2' THEN 4 WHEN 'src3' THEN 3 WHEN 'src4' THEN 2 ELSE 1 END AS w
  FROM given),
src AS (
  SELECT name, w, count(*) AS n, (count(*) + 31) // 32 AS blocks, ((count(*) + 31) // 32) // w AS f, ((count(*) + 31) // 32) % w AS rest
  FROM numbered JOIN share USING (name) GROUP BY name, w),
change AS (SELECT DISTINCT unnest([0, f, f + 1]) AS kind FROM src),
run AS (SELECT kind, lead(kind) OVER (ORDER BY kind) - kind AS times FROM change),
quota AS (
  SELECT kind, times, name, (CASE WHEN kind < f THEN w ELSE rest END)::BIGINT AS q
  FROM run, src WHERE times IS NOT NULL AND kind <= f AND (kind < f OR rest > 0)),
kinds AS (
  SELECT kind, any_value(times) AS times, sum(q)::BIGINT AS len, list(q ORDER BY q DESC, name) AS qs, list(name ORDER BY q DESC, name) AS names
  FROM quota GROUP BY kind),
edf AS (
  SELECT kind, 0::BIGINT AS t, list_transform(qs, lambda q: 0::BIGINT) AS had, 0::BIGINT AS c FROM kinds
  UNION ALL
  SELECT kind, t + 1, list_transform(had, lambda h, i: CASE WHEN i = pick THEN h + 1 ELSE h END), pick
  FROM (
    SELECT e.kind, e.t, e.had, list_min(list_filter(list_transform(k.qs, lambda q, i:
        CASE WHEN e.had[i] < q AND (e.had[i] * k.len) // q <= e.t
          THEN ((e.had[i] + 1) * k.len + q - 1) // q * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
    FROM edf e JOIN kinds k USING (kind) WHERE e.t < k.len)),
slots AS (
  SELECT kind, names[c] AS name, t - 1 AS off, row_number() OVER (PARTITION BY kind, c ORDER BY t) - 1 AS j
  FROM edf JOIN kinds USING (kind) WHERE t > 0),
starts AS (
  SELECT kind, len, coalesce(sum(len * times) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM kinds),
had AS (
  SELECT kind, name, q, times,
    coalesce(sum(q * times) OVER (PARTITION BY name ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
  FROM quota),
block AS (SELECT DISTINCT name, r // 32 AS b FROM numbered),
placed AS (
  SELECT block.name, b, start + ((b - had) // q) * len + off AS slot
  FROM block JOIN had ON block.name = had.name AND b >= had.had AND b < had.had + q * times
  JOIN starts USING (kind) JOIN slots ON slots.kind = had.kind AND slots.name = block.name AND slots.j = (b - had) % q)
SELECT doc_id, name AS mix_source, slot::BIGINT AS mix_slot, (row_number() OVER (ORDER BY slot, r) - 1)::BIGINT AS mix_position
FROM numbered JOIN placed USING (name) WHERE r // 32 = b
"""

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {FOLD} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""


def _license_scan() -> str:
    """The rules one after another, each a step over the texts that have a licence sentence."""
    known = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    steps, last = [], "r0"
    for i, (name, rule) in enumerate(RULES, 1):
        ids = " " + "  ".join(rule.split()) + " "
        steps.append(f"""r{i} AS (SELECT doc_id, ids, replace(rest, '{ids}', ' - ') AS rest,
  CASE WHEN contains(rest, '{ids}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found
  FROM r{i - 1})""")
        last = f"r{i}"
    return f"""
WITH known(s, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\n|[.!?:]\\s')) AS s,
    generate_subscripts(regexp_split_to_array(lower(coalesce(text, '')), '\\n|[.!?:]\\s'), 1) AS pos FROM documents),
named AS (
  SELECT doc_id, pos, coalesce(id, '-') AS id
  FROM parts LEFT JOIN known ON known.s = trim(regexp_replace(parts.s, '[^a-z0-9]+', ' ', 'g'))),
runs AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM named),
r0 AS (
  SELECT doc_id, list(id ORDER BY pos) FILTER (id <> '-') AS ids, ' ' || string_agg(id, '  ' ORDER BY pos) || ' ' AS rest,
    []::VARCHAR[] AS found
  FROM runs WHERE id <> '-' OR before IS NULL OR before <> '-' GROUP BY doc_id),
{", ".join(steps)}
SELECT documents.doc_id, coalesce(array_to_string(found, ','), '') AS licences, coalesce(len(ids), 0)::BIGINT AS n_sentences,
  coalesce(array_to_string(list_filter(regexp_split_to_array(rest, ' +'), lambda x: x <> '' AND x <> '-'), ','), '') AS unexplained
FROM documents LEFT JOIN {last} USING (doc_id)
"""


PREFERENCES = """
WITH t AS (
  SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT pair_id, chosen, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY pair_id, chosen),
ab AS (
  SELECT a.pair_id, a.turns AS a, b.turns AS b, least(len(a.turns), len(b.turns)) AS m
  FROM c a JOIN c b ON a.pair_id = b.pair_id AND a.chosen AND NOT b.chosen),
cut AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])) - 1, m) AS k FROM ab)
SELECT pair_id, k::BIGINT AS n_shared,
  coalesce(array_to_string(list_transform(a[:k], lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(a[k + 1:], lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(b[k + 1:], lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(list_sum(list_transform(a[k + 1:], lambda x: CASE WHEN x.r = 'assistant' THEN length(x.t) + 8 ELSE 0 END)), 0)::BIGINT AS chosen_loss_chars,
  coalesce(list_sum(list_transform(b[k + 1:], lambda x: CASE WHEN x.r = 'assistant' THEN length(x.t) + 8 ELSE 0 END)), 0)::BIGINT AS rejected_loss_chars
FROM cut
"""

FILTER_AUDIT = """
WITH d AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS t, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
marked AS (
  SELECT part, doc_id,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (FROM good)) AS good,
    count(*) FILTER (doc_id IN (FROM toxic)) AS toxic
  FROM marked GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS l, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
hits AS (
  SELECT c.*, s.*, contains(fails, l) AS fail, before <> '' AND fails <> '' AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AS gone
  FROM cell c, (SELECT filter_order, step, l, before FROM steps) s),
found AS (
  SELECT part, filter_order, step, l,
    sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM found
"""

COLLOCATIONS = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({FOLD}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
score AS (
  SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y),
low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, a AS f, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS n) WHERE n < k)),
gone AS (
  SELECT DISTINCT cand.lang, cand.phrase FROM cand JOIN inner_ USING (lang, phrase) WHERE 100::HUGEINT * inner_.f >= 80::HUGEINT * cand.a),
kept AS (SELECT * FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def _secret_links() -> str:
    """Places as running sums of what stands between the matches, links as joins of all parts of a text."""
    def plain(pattern: str) -> str:
        return pattern.replace("(", "(?:").replace("'", "''")

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def places(kind: str, pattern: str, text: str, condition: str = "true") -> str:
        return f"""
  SELECT k, '{kind}' AS kind, m, s FROM (
    SELECT k, m, i, sum(length(g) + length(m)) OVER (PARTITION BY k ORDER BY i) - length(m) AS s FROM (
      SELECT k, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT k, regexp_extract_all({text}, '{plain(pattern)}') AS m, regexp_split_to_array({text}, '{plain(pattern)}') AS g
        FROM d WHERE regexp_matches({text}, '{plain(pattern)}')))) WHERE {condition}"""

    def reaches(role: str) -> str:
        return (f"EXISTS (SELECT 1 FROM part o WHERE o.k = p.k AND o.scope = p.scope AND {role} "
                f"AND o.s <= p.e + {secret_links.REACH} AND o.e >= p.s - {secret_links.REACH})")

    kinds = [
        places("assign", secret_links.ASSIGN, "l", f"length(regexp_extract(m, '{quoted(secret_links.ASSIGN)}', 2)) >= 12"),
        places("access", secret_links.ACCESS, "t", "length(m) >= 18"),
        places("hex", secret_links.HEX, "t"),
        places("login", secret_links.LOGIN, "l", f"length(regexp_extract(m, '{quoted(secret_links.LOGIN)}', 2)) >= 3"),
        places("key", secret_links.KEY, "t",
               "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
        places("endpoint", secret_links.ENDPOINT, "l"),
    ]
    over = "SELECT 1 FROM {0} o WHERE o.k = p.k AND o.s < p.e AND o.e > p.s"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {FOLD} AS l FROM documents),
raw AS ({" UNION ALL ".join(kinds)}),
ended AS ({places("end", secret_links.SCOPE_END, "t")}),
p1 AS (
  SELECT k, kind, s, s + length(m) AS e, kind IN ('assign', 'access', 'hex') AS strong,
    (SELECT count(*) FROM ended x WHERE x.k = raw.k AND x.s < raw.s) AS scope FROM raw),
base AS (FROM p1 WHERE strong),
p2 AS (FROM p1 p WHERE strong OR NOT EXISTS ({over.format("base")})),
named AS (FROM p2 WHERE kind IN ('login', 'endpoint')),
part AS (FROM p2 p WHERE kind <> 'key' OR NOT EXISTS ({over.format("named")})),
seen AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'login', 'key', 'endpoint'], kind) AS o,
    {reaches("o.kind IN ('access', 'login')")} AS has_id, {reaches("o.kind IN ('assign', 'hex', 'key')")} AS has_secret
  FROM part p),
kept AS (
  SELECT *, concat_ws(':', kind, s::BIGINT, e::BIGINT) AS span FROM seen
  WHERE strong OR (kind = 'login' AND has_secret) OR (kind = 'key' AND has_id) OR (kind = 'endpoint' AND has_id AND has_secret)),
per AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT strong) AS n_linked,
    string_agg(span, ',' ORDER BY s, o) FILTER (strong) AS base, string_agg(span, ',' ORDER BY s, o) AS spans
  FROM kept GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_linked, 0)::BIGINT AS n_linked
FROM d LEFT JOIN per USING (k)
"""


ORACLE = {
    "op8_license_scan": _license_scan(),
    "op10_preferences": PREFERENCES,
    "op1_mix_sources": MIX,
    "op9_line_dedup": LINE_DEDUP,
    "op6_ngram_join": NGRAM_JOIN,
    "op2_exact_dedup": EXACT_DEDUP,
    "op5_decontaminate": DECONTAMINATE,
    "op13_filter_audit": FILTER_AUDIT,
    "op12_collocations": COLLOCATIONS,
    "op11_secret_links": _secret_links(),
}
