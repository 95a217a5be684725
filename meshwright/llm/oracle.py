"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), s AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), r(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT s.page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY s.page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
  FROM s JOIN r ON (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)
)
SELECT s.page_id, s.host, s.path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.k = 1
"""

OP1 = r"""
WITH p AS (
  SELECT page_id, url, strlen(html) AS n, length(url) % 6 AS kind, '"' || md5(html)[1:16] || '"' AS tag, 'day ' || (page_id // 7) AS stamp,
    regexp_replace(url, '#.*$', '') AS bare FROM pages
), c AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p
), d AS (
  SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host0, regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path0 FROM c
), e AS (
  SELECT *, scheme || '://' ||
    CASE WHEN scheme = 'http' THEN regexp_replace(host0, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host0, ':443$', '') ELSE host0 END ||
    CASE WHEN starts_with(path0, '/') THEN path0 ELSE '/' || path0 END AS canon FROM d
), f AS (
  SELECT 2 * page_id AS id, canon, 10 * page_id AS ts, tag, stamp, n FROM e
), r AS (
  SELECT 2 * page_id + 1 AS record_id, canon, 10 * page_id + CASE WHEN kind = 5 THEN -5 ELSE 5 END AS ts, page_id,
    CASE WHEN kind IN (0, 5) THEN tag WHEN kind = 1 THEN 'W/' || tag WHEN kind = 3 THEN '"other"' END AS sent, CASE WHEN kind = 2 THEN stamp END AS sent_stamp FROM e
), j AS (
  SELECT r.*, f.id, f.tag, f.stamp, f.n FROM r ASOF LEFT JOIN f ON r.canon = f.canon AND r.ts > f.ts
), k AS (
  SELECT *, CASE WHEN id IS NULL THEN 'no response'
    WHEN sent IS NOT NULL THEN CASE WHEN regexp_replace(sent, '^W/', '') = tag THEN 'etag' ELSE 'mismatch' END
    WHEN sent_stamp IS NOT NULL THEN CASE WHEN sent_stamp = stamp THEN 'last-modified' ELSE 'mismatch' END
    ELSE 'none' END AS "check" FROM j
), l AS (
  SELECT *, "check" IN ('etag', 'last-modified') AS resolved FROM k
)
SELECT record_id, canon AS url, id AS refers_to, "check", resolved,
  CASE WHEN resolved THEN 'cache-control: max-age=' || page_id || '; content-length: ' || n || '; content-type: text/html; etag: ' || coalesce(sent, tag) || '; last-modified: ' || coalesce(sent_stamp, stamp)
  ELSE concat_ws('; ', 'cache-control: max-age=' || page_id, 'content-length: 0', 'etag: ' || sent, 'last-modified: ' || sent_stamp) END AS headers
FROM l
"""

OP8 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s FROM bw, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS t(i) WHERE len(w) > 0
), pos AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)
), hit AS (
  SELECT doc_id, i, k, item_id FROM pos JOIN win USING (k, s)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS names FROM hit GROUP BY 1
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS t(i)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY 1
), l AS (
  SELECT doc_id, line, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), f AS (
  SELECT doc_id, line, NOT regexp_matches(t, '[.!?…:;。！？：；．؟۔؛।॥።]')
    OR (right(t, 1) NOT IN ('.', '!', '?', '…', ':', ';', '。', '！', '？', '：', '；', '．', '؟', '۔', '؛', '।', '॥', '።', '"', '''', '”', '’', '»', ')', ']', '」', '』', '》', '）', '】') AND NOT regexp_matches(t, '^\s*\S+\s+\S+\s+\S+\s+\S|[\x{0E00}-\x{0EFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]{8}'))
    OR regexp_matches(t, '\|[^|]*\|')
    OR (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 10 > length(t)
    OR length(regexp_replace(t, '(https?://|www\.)\S+', '', 'g')) * 2 < length(t)
    OR regexp_matches(lower(t), '^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to content|read more|share|contact|sitemap|startseite|menü|anmelden|registrieren|suche|weiter|zurück|nach oben|zum inhalt|weiterlesen|mehr lesen|teilen|kontakt|impressum|inicio|menú|iniciar sesión|registrarse|buscar|siguiente|anterior|volver arriba|ir al contenido|leer más|compartir|contacto|accueil|connexion|se connecter|s''inscrire|rechercher|suivant|précédent|haut de page|aller au contenu|lire la suite|partager|plan du site)([^\p{L}\p{N}_.!?。！？؟۔।][^.!?。！？؟۔।]*)?$')
    OR regexp_matches(lower(t), 'enable javascript|uses cookies|use of cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|lorem ipsum|subscribe to our|click here|javascript aktivieren|verwendet cookies|cookie-richtlinie|datenschutzerklärung|nutzungsbedingungen|alle rechte vorbehalten|newsletter abonnieren|hier klicken|activar javascript|utiliza cookies|política de cookies|política de privacidad|términos de uso|todos los derechos reservados|haga clic aquí|haz clic aquí|activer javascript|utilise des cookies|politique de cookies|politique de confidentialité|conditions d''utilisation|tous droits réservés|cliquez ici') AS bad
  FROM l
), by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(CASE WHEN bad THEN length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) END), 0) AS n_lost FROM f GROUP BY 1
), c AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), a AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost, 0)::bigint AS n_lost_chars
  FROM c LEFT JOIN by_line USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT n_lost_chars * 100 > word_chars * 50 AS kept
FROM a
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), ends AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), r(id, c) AS (
  SELECT a, a FROM ends UNION SELECT ends.b, r.c FROM r JOIN ends ON r.id = ends.a WHERE ends.b > r.c
), comp AS (
  SELECT id, min(c) AS c FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.id = d.doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS b FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(s)
), late AS (
  SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM (SELECT *, min(doc_id) OVER (PARTITION BY b) AS first FROM win) WHERE doc_id > first
), grouped AS (
  SELECT doc_id, s, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM late
), runs AS (
  SELECT doc_id, g, min(s) AS s, max(s) + 50 AS e FROM grouped GROUP BY 1, 2
), gone AS (
  SELECT doc_id, sum(e - s)::bigint AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1
), keep AS (
  SELECT doc_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY 1
), text_left AS (
  SELECT keep.doc_id, string_agg(substr(h, 2 * keep.s + 1, 2 * (coalesce(keep.e, length(h) // 2) - keep.s)), '' ORDER BY keep.s) AS k FROM keep JOIN d ON d.doc_id = keep.doc_id GROUP BY 1
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN text_left ON text_left.doc_id = d.doc_id
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, 0 AS kind, string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS m FROM d
  UNION ALL SELECT doc_id, 1, string_split_regex(t, 'AKIA[A-Z0-9]{14,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{14,}') FROM d
  UNION ALL SELECT doc_id, 2, string_split_regex(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}') FROM d
  UNION ALL SELECT doc_id, 3, string_split_regex(t, '[A-Za-z0-9+/_-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}') FROM d
), found AS (
  SELECT doc_id, kind, m[j] AS s, (list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::bigint AS b
  FROM parts, unnest(range(1, len(m) + 1)) AS t(j)
), windows AS (
  SELECT doc_id, b, s, i, substr(s, i, 24) AS w FROM (SELECT * FROM found WHERE kind = 3 AND regexp_matches(s, '[0-9]')), unnest(range(1, length(s) - 22)) AS t(i)
), letters AS (
  SELECT doc_id, b, s, i, ch, count(*) AS c FROM (SELECT doc_id, b, s, i, unnest(string_split(w, '')) AS ch FROM windows) WHERE ch <> '' GROUP BY ALL
), dense AS (
  SELECT doc_id, b, s, max(h) AS h FROM (SELECT doc_id, b, s, i, -sum(c / 24.0 * log2(c / 24.0)) AS h FROM letters GROUP BY ALL) GROUP BY ALL
), spans AS (
  SELECT doc_id, kind, b, b + length(s) AS e FROM found
  WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(s, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 12
  UNION ALL
  SELECT doc_id, 3, b, b + length(s) FROM dense
  WHERE NOT regexp_matches(s, '(?i)(example|placeholder|changeme|your[_-]|xxxx|abcdefgh|01234567|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})')
    AND h >= CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]+$') THEN 3.0 WHEN regexp_matches(s, '^[A-Za-z0-9]+$') THEN 3.75 ELSE 3.9 END
), named AS (
  SELECT doc_id, kind, b, e, (['assign', 'access', 'hex', 'entropy'])[kind + 1] || ':' || b || ':' || e AS name FROM spans
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
    string_agg(name, ',' ORDER BY b, kind, e) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY b, kind, e) AS spans FROM named GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc ON by_doc.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op1_revisits": OP1,
    "op4_url_trie": OP4,
    "op5_suffix_index": OP5,
    "op7_secret_scan": OP7,
    "op8_wu_manber": OP8,
    "op9_line_clean": OP9,
    "op10_minhash": OP10,
}
