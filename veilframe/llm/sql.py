"""DuckDB oracles of the training-data queries that SQL can express on whole tables."""

P2_FOUND = """
SELECT DISTINCT e.extraction_id FROM extractions e
LEFT JOIN (SELECT stream_id, max(buffer_size) AS buffer_size FROM stream_scanners GROUP BY 1) s ON e.stream_id = s.stream_id
WHERE strlen(e.text) > greatest(coalesce(s.buffer_size, 4096), 1024)
"""

P6_FOUND = """
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
doc_runs AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS run FROM words),
item_runs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS run FROM item)
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)
"""



P2_RESTORED = "SELECT DISTINCT extraction_id, text, true AS sound FROM extractions WHERE text IS NOT NULL AND extraction_id IS NOT NULL"

#: Near-duplicate groups stated anew: shared runs by a join of runs, equal signature values where a text is missing, components by recursion.
P1_GROUPS = """
WITH RECURSIVE e AS (SELECT DISTINCT doc_id, CASE WHEN text IS NULL THEN to_json(signature) END AS sig_key, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t, signature FROM document_entries WHERE doc_id IS NOT NULL AND (text IS NOT NULL OR signature IS NOT NULL)),
c AS (SELECT coalesce('t' || t, 's' || sig_key) AS k, any_value(t) AS t, any_value(signature) AS signature FROM e GROUP BY 1),
m AS (SELECT DISTINCT doc_id, coalesce('t' || t, 's' || sig_key) AS k FROM e),
w AS (SELECT k, string_split(t, ' ') AS w FROM c WHERE t IS NOT NULL),
r AS (SELECT k, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) AS run FROM w WHERE len(w) >= 3),
n AS (SELECT k, count(*) AS n FROM r GROUP BY 1),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS common FROM r a JOIN r b ON a.run = b.run AND a.k < b.k GROUP BY 1, 2),
texts AS (SELECT x, y, common / (p.n + q.n - common) AS similarity FROM shared JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE common / (p.n + q.n - common) >= 0.6),
v AS (SELECT k, t, unnest(signature) AS value, generate_subscripts(signature, 1) AS place FROM c WHERE signature IS NOT NULL AND (t IS NULL OR k IN (SELECT k FROM n))),
sigs AS (SELECT least(a.k, b.k) AS x, greatest(a.k, b.k) AS y, count(*) / 128 AS similarity FROM v a JOIN v b ON a.place = b.place AND a.value = b.value AND a.k <> b.k WHERE a.t IS NULL AND (b.t IS NOT NULL OR a.k < b.k) GROUP BY 1, 2 HAVING count(*) / 128 >= 0.6),
links AS (SELECT * FROM texts UNION ALL SELECT * FROM sigs),
usable AS (SELECT k FROM n UNION SELECT k FROM c WHERE t IS NULL),
near AS (SELECT x AS k, y AS o, similarity FROM links UNION ALL SELECT y, x, similarity FROM links UNION ALL SELECT k, k, NULL FROM usable),
pairs AS (SELECT a.doc_id, b.doc_id AS other, max(coalesce(near.similarity, 1.0)) AS similarity FROM near JOIN m a ON a.k = near.k JOIN m b ON b.k = near.o WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
reach AS (SELECT DISTINCT doc_id, doc_id AS member FROM m UNION SELECT reach.doc_id, pairs.other FROM reach JOIN pairs ON pairs.doc_id = reach.member),
groups AS (SELECT doc_id, min(member) AS group_id FROM reach GROUP BY 1),
sums AS (SELECT doc_id, count(*) AS n_links, max(similarity) AS best_similarity FROM pairs GROUP BY 1)
SELECT doc_id, group_id, coalesce(n_links, 0) AS n_links, best_similarity FROM groups LEFT JOIN sums USING (doc_id)
"""

#: Re-parameterised and exact leaks stated anew: windows of template words as strings, slots as lists, one-to-one mapping per alignment.
P6_LEAKS = """
WITH inner_runs AS (SELECT text, unnest(regexp_extract_all(text, '[\\p{Ll},] (\\p{Lu}\\p{L}*\\p{Ll}(?: \\p{Lu}\\p{L}*\\p{Ll})*)', 1)) AS run FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
inner_words AS (SELECT text, unnest(string_split(run, ' ')) AS w FROM inner_runs),
names AS (SELECT DISTINCT lower(w) AS w FROM inner_words JOIN (SELECT text, count(*) AS n FROM inner_words GROUP BY 1) USING (text) WHERE n < 0.12 * len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))),
units AS (SELECT unnest(string_split('UNIT_WORDS', ' ')) AS w),
spelled AS (SELECT 'd' AS side, doc_id AS id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
  UNION ALL SELECT 'i', item_id, unnest(w), generate_subscripts(w, 1) FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL)),
shaped AS (SELECT side, id, i, w, CASE WHEN regexp_matches(w, '[0-9]') THEN '<num>' WHEN w IN (SELECT w FROM units) THEN '<unit>' WHEN w IN (SELECT w FROM names) THEN '<name>' ELSE w END AS p FROM spelled),
windows AS (SELECT side, id, i, string_agg(p, ' ') OVER run AS shape, list(w) OVER run AS words, list(p) OVER run AS plain, count(*) OVER run AS n FROM shaped WINDOW run AS (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
met AS (SELECT d.id AS doc_id, t.id AS item_id, d.i - 1 AS doc_pos, t.i - 1 AS item_pos, d.words AS dw, t.words AS tw, d.plain AS plain FROM windows d JOIN windows t ON d.shape = t.shape WHERE d.side = 'd' AND t.side = 'i' AND d.n = 12 AND t.n = 12),
slots AS (SELECT DISTINCT doc_id, item_id, doc_pos - item_pos AS shift, tw[k] AS a, dw[k] AS b FROM met, unnest(range(1, 13)) AS u(k) WHERE plain[k] LIKE '<%'),
mapping AS (SELECT doc_id, item_id, shift, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS consistent FROM slots GROUP BY 1, 2, 3),
aligned AS (SELECT doc_id, item_id, doc_pos - item_pos AS shift, count(*) AS windows, count(*) FILTER (dw = tw) AS exact_windows, min(doc_pos) AS doc_pos, min(item_pos) AS item_pos, min(doc_pos) FILTER (dw = tw) AS exact_doc_pos, min(item_pos) FILTER (dw = tw) AS exact_item_pos FROM met GROUP BY 1, 2, 3),
kinds AS (SELECT a.*, CASE WHEN exact_windows > 0 THEN 'exact' WHEN coalesce(consistent, true) THEN 'reparameterised' END AS kind FROM aligned a LEFT JOIN mapping USING (doc_id, item_id, shift))
SELECT doc_id, item_id, kind, CAST(sum(CASE WHEN kind = 'exact' THEN exact_windows ELSE windows END) AS BIGINT) AS windows, min(CASE WHEN kind = 'exact' THEN exact_doc_pos ELSE doc_pos END) AS doc_word_start, min(CASE WHEN kind = 'exact' THEN exact_item_pos ELSE item_pos END) AS item_word_start
FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2, 3
""".replace(
    "UNIT_WORDS",
    "percent day days week weeks month months year years hour hours minute minutes second seconds kb mb gb tb km kg cm mm rows lines pages "
    "tage tagen wochen monate jahre stunden minuten sekunden zeilen seiten jours semaines mois ans heures secondes lignes días semanas meses años horas minutos segundos filas líneas páginas monday tuesday wednesday thursday friday saturday sunday",
)

#: The consistent form stated anew, character by character: widths by arithmetic, look-alikes from a list of pairs.
LOOK = """
nfc_normalize(replace(translate(nfc_normalize(replace(replace(replace(replace(replace(replace(replace(
  array_to_string(list_transform(string_split(regexp_replace(text, '[\\x{00AD}\\x{061C}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]', '', 'g'), ''), lambda c:
    CASE WHEN c = '' THEN '' WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN (160, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' ' ELSE c END), ''),
  'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st')),
  'асԁеһіјӏорԛѕԝхукАВСЕНІӀЈКМОРЅТХҮёЁїЇѐЀӓӒӧӦӑӐќЌӯӱαορυνχκΑΒΕΖΗΙΚΜΝΟΡΤΥΧόύάϋΆΈΊΌΎΪΫΓΠΦµ', 'acdehijlopqswxykABCEHIIJKMOPSTXYëËïÏèÈäÄöÖăĂḱḰȳÿaopuvxkABEZHIKMNOPTYXóúáüÁÉÍÓÝÏŸГПФμ'), 'ў', 'y̆'))
"""
RECORDS = "(SELECT DISTINCT 'extractions' AS origin, extraction_id AS record_id, text FROM extractions UNION ALL SELECT DISTINCT 'scan_results', result_id, text FROM scan_results)"
P5_FORMS = f"SELECT origin, record_id, {LOOK} AS uniform_text FROM {RECORDS}"
P5_FOUND = f"WITH r AS (SELECT origin, record_id, text, {LOOK} AS look FROM {RECORDS} WHERE text IS NOT NULL) SELECT DISTINCT a.origin, a.record_id AS id_a, b.record_id AS id_b FROM r a JOIN r b ON a.origin = b.origin AND a.look = b.look AND a.record_id < b.record_id AND a.text <> b.text"

#: Pairs of ids from the same statement as the groups.
P1_FOUND = P1_GROUPS[: P1_GROUPS.index(",\nreach AS")] + "\nSELECT doc_id AS doc_id_a, other AS doc_id_b FROM pairs WHERE doc_id < other"

ORACLES = {"p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p2_restored": P2_RESTORED, "p5_found": P5_FOUND, "p5_forms": P5_FORMS, "p6_found": P6_FOUND, "p6_leaks": P6_LEAKS}
