"""Queries of the scan engine, protective actions, similarity lookups and stream operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.catalog import patterns
from veilframe.functions import scoring
from veilframe.operators import protect, scan, similarity
from veilframe.session import cut, table
from veilframe.plans.enrich_sql import hmac_sql
from veilframe.streaming import operators as stream

KEY = b"vault-key"


def answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scan_results").dropDuplicates(["result_id"]).select(F.col("result_id").alias("doc_id"), "text")


def scan_answers(s, d):
    return scan.scan(answers(s, d))


def scan_extractions(s, d):
    return scan.scan(table(s, d, "extractions").dropDuplicates(["extraction_id"]), doc_id="extraction_id")


def scan_severity_counts(s, d):
    found = scan.scan(table(s, d, "documents"))
    return found.groupBy("category", scoring.console_severity(F.col("category"), F.col("confidence")).alias("severity")).agg(F.count("*").alias("n"))


def scan_baseline_contact(s, d):
    return scan.scan(answers(s, d), scan.ScanConfig(categories=frozenset(["Contact Information"]), baseline_only=True, min_confidence=0.5))


def scan_status(s, d):
    return scan.statuses(answers(s, d)).groupBy("status").agg(F.count("*").alias("n"))


def entropy_tokens(s, d):
    found = scan.high_entropy_tokens(answers(s, d), least=3.5, gated=False)
    return found.select("doc_id", "token", F.round("entropy", 6).alias("entropy"), F.round("confidence", 6).alias("confidence"))


def guard_redact(s, d):
    docs = answers(s, d)
    return protect.guard(docs, cut(scan.scan(docs)), "redact")


def guard_obfuscate(s, d):
    docs = answers(s, d)
    return protect.obfuscate(docs, scan.scan(docs))


def token_round_trip(s, d):
    """Texts before and after tokens were put in and taken out again; ``same`` is true everywhere."""
    docs = cut(answers(s, d))
    hidden, vault = protect.tokenize(docs, cut(scan.scan(docs)), KEY)
    back = protect.detokenize(hidden, vault)
    return docs.join(back.withColumnRenamed("text", "back"), "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


def vault_entries(s, d):
    return similarity.register(table(s, d, "document_entries")).select("doc_id", F.size("signature").alias("n_values"))


def vault_lookup(s, d):
    """Every twentieth entry (ids divisible by 20) looked up among all."""
    entries = table(s, d, "document_entries").where("text is not null")
    asked = entries.where(F.regexp_extract("doc_id", "([0-9]+)$", 1).cast("bigint") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    return similarity.lookup(asked, cut(similarity.register(table(s, d, "document_entries"))), 0.8)


def catalogue_categories(s, d):
    return patterns.frame(s).groupBy("category").agg(F.count("*").alias("n"))


def vault_signatures(s, d):
    """Signatures computed anew for every entry that was registered with one."""
    entries = table(s, d, "document_entries").where("text is not null and signature is not null")
    return entries.select("doc_id", F.md5(F.array_join(similarity.signature_udf("text"), ",")).alias("digest")).distinct()


def catalogue_keywords(s, d):
    return patterns.frame(s).select("category", "sub_category", F.explode("keywords").alias("keyword"), "distance")


def text_entropy(s, d):
    files = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return similarity.byte_entropy(files).select("path", F.round("bits", 6).alias("bits"), scoring.entropy_class(F.col("bits"), F.lit(".txt")).alias("class"))


def requests(s, d):
    return table(s, d, "scans").dropDuplicates(["id"]).where("api_key_hash is not null").select(F.hex("api_key_hash").alias("client_id"), "id", F.unix_micros("created_at").alias("at_us"))


def sliding_limit(s, d):
    return stream.sliding_admission_batch(requests(s, d), 3, 60_000_000)


def fixed_window_limit(s, d):
    return stream.fixed_window_admission(requests(s, d), 2, 600_000_000)


def dedup_60s(s, d):
    writes = table(s, d, "scans").dropDuplicates(["id"]).where("input_hash is not null").select("id", F.hex("input_hash").alias("input_hash"), F.unix_micros("created_at").alias("at_us"))
    return stream.stored_once(writes, 60_000_000)


def event_windows(s, d):
    w = stream.windowed_counts(table(s, d, "events"))
    return w.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(s, d):
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


def audit_signatures(s, d):
    rows = table(s, d, "scans").dropDuplicates(["id"]).select(F.coalesce("source_pod", F.lit("none")).alias("source"), "id", F.unix_micros("created_at").alias("at_us"), F.lower("action").alias("action"))
    return stream.audit_chain(rows, KEY)


def audit_broken(s, d):
    return stream.broken_links(cut(audit_signatures(s, d)))


def cidr_list(s, d):
    from veilframe.plans.text_queries import ipv4_public

    hits = ipv4_public(s, d).where(protect.list_predicate("cidr", "198.51.100.0/24", F.col("candidate")) | protect.list_predicate("cidr", "203.0.113.128/25", F.col("candidate")))
    return hits.groupBy("candidate").agg(F.countDistinct("doc_id").alias("n_docs"))


def path_list(s, d):
    files = table(s, d, "extractions").select("path").distinct()
    return files.where(protect.list_predicate("path", "**/*.pdf", F.col("path")))




SQL = {
    "scan_status": "SELECT CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT any_value(text) AS text FROM scan_results GROUP BY result_id) GROUP BY 1",
    "token_round_trip": "SELECT result_id AS doc_id, true AS same FROM scan_results GROUP BY 1",
    "vault_entries": "SELECT DISTINCT doc_id, 128 AS n_values FROM document_entries WHERE text IS NOT NULL OR signature IS NOT NULL",
    "fixed_window_limit": "WITH r AS (SELECT hex(any_value(api_key_hash)) AS client_id, id, any_value(epoch_us(created_at)) AS at_us FROM scans WHERE api_key_hash IS NOT NULL GROUP BY id) SELECT client_id, id, at_us, row_number() OVER (PARTITION BY client_id, at_us // 600000000 ORDER BY at_us, id) <= 2 AS admitted FROM r",
    "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 6 * 3600000000 THEN 0 ELSE 1 END AS opens FROM events WHERE user_id IS NOT NULL), g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, k",
    "audit_broken": "SELECT '' AS source, '' AS id, 0::BIGINT AS at_us, '' AS action, '' AS prev_signature, '' AS signature, '' AS expected WHERE false",
    "cidr_list": "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]{1,3}[.]){3}[0-9]{1,3}')) AS candidate FROM documents) SELECT candidate, count(DISTINCT doc_id) AS n_docs FROM c WHERE (candidate LIKE '198.51.100.%' AND cast(split_part(candidate, '.', 4) AS int) <= 255) OR (candidate LIKE '203.0.113.%' AND cast(split_part(candidate, '.', 4) AS int) BETWEEN 128 AND 255) GROUP BY 1",
    "path_list": "SELECT DISTINCT path FROM extractions WHERE lower(path) LIKE '%.pdf'",
}
#: Admission and suppression by recursion over the requests of a key in order of time.
ORDERED = "SELECT *, row_number() OVER (PARTITION BY k ORDER BY at_us, id) AS n FROM (SELECT id, hex(any_value({key})) AS k, any_value(epoch_us(created_at)) AS at_us FROM scans WHERE {key} IS NOT NULL GROUP BY id)"
SQL |= {
    "sliding_limit": f"WITH RECURSIVE r AS ({ORDERED.format(key='api_key_hash')}), s AS (SELECT k, id, n, true AS admitted, [at_us] AS held FROM r WHERE n = 1 UNION ALL SELECT r.k, r.id, r.n, len(list_filter(s.held, lambda x: x > r.at_us - 60000000)) < 3, CASE WHEN len(list_filter(s.held, lambda x: x > r.at_us - 60000000)) < 3 THEN list_append(list_filter(s.held, lambda x: x > r.at_us - 60000000), r.at_us) ELSE list_filter(s.held, lambda x: x > r.at_us - 60000000) END FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1) SELECT k AS client_id, id, admitted FROM s",
    "dedup_60s": f"WITH RECURSIVE r AS ({ORDERED.format(key='input_hash')}), s AS (SELECT k, id, n, true AS kept, at_us AS last FROM r WHERE n = 1 UNION ALL SELECT r.k, r.id, r.n, r.at_us - s.last >= 60000000, CASE WHEN r.at_us - s.last >= 60000000 THEN r.at_us ELSE s.last END FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1) SELECT id FROM s WHERE kept",
    "text_entropy": "WITH t AS (SELECT DISTINCT doc_id::VARCHAR AS path, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), b AS (SELECT path, unnest(list_transform(range(0, least(length(h) // 2, 8192)), lambda i: substr(h, 2 * i + 1, 2))) AS x FROM t), c AS (SELECT path, x, count(*) AS n FROM b GROUP BY 1, 2), e AS (SELECT path, -sum(n / total * log2(n / total)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY path) AS total FROM c) GROUP BY 1) SELECT path, round(coalesce(bits, 0), 6) AS bits, CASE WHEN bits >= 7.9 THEN 'likely_encrypted' WHEN bits >= 7.5 THEN 'compressed_or_encrypted' WHEN bits > 5.5 THEN 'suspicious_for_format' WHEN bits >= 6.0 THEN 'moderately_random' ELSE 'normal' END AS class FROM t LEFT JOIN e USING (path)",
}
BODY = "'{{\"action\": ' || CASE WHEN r.action IS NULL THEN 'null' ELSE '\"' || r.action || '\"' END || ', \"at_us\": ' || r.at_us || ', \"id\": \"' || r.id || '\", \"prev\": \"' || {prev} || '\"}}'"
SQL |= {
    "audit_signatures": f"WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY at_us, id) AS n FROM (SELECT coalesce(any_value(source_pod), 'none') AS source, id, any_value(epoch_us(created_at)) AS at_us, lower(any_value(action)) AS action FROM scans GROUP BY id)), s AS (SELECT source, id, at_us, action, n, '' AS prev_signature, {hmac_sql(BODY.format(prev="''"), KEY)} AS signature FROM r WHERE n = 1 UNION ALL SELECT r.source, r.id, r.at_us, r.action, r.n, s.signature, {hmac_sql(BODY.format(prev='s.signature'), KEY)} FROM s JOIN r ON r.source = s.source AND r.n = s.n + 1) SELECT source, id, at_us, action, prev_signature, signature FROM s",
    "entropy_tokens": """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\\s,;''"()\\[\\]{}=:]{16,256}')) AS token FROM (SELECT result_id AS doc_id, any_value(text) AS text FROM scan_results GROUP BY 1)), c AS (SELECT doc_id, token, ch, count(*) AS n FROM (SELECT doc_id, token, unnest(string_split(token, '')) AS ch FROM t WHERE NOT regexp_full_match(token, '[0-9.-]+') AND NOT regexp_full_match(token, '[a-z]+')) GROUP BY 1, 2, 3),
e AS (SELECT doc_id, token, -sum(n / total * log2(n / total)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, token) AS total FROM c) GROUP BY 1, 2) SELECT doc_id, token, round(entropy, 6) AS entropy, round(least(greatest(0.40 + (entropy - 4.5) / 1.5 * 0.5, 0.40), 0.90), 6) AS confidence FROM e WHERE entropy >= 3.5""",
}
#: Patterns of each category by the blueprint, "category n" by region.
SIZES = """
Others: Credit Card Numbers 7; Primary Account Numbers 2; Card Track Data 2; Card Expiration Dates 1; Banking and Financial 5; Wire Transfer Data 6; Check and MICR Data 3; Securities Identifiers 7; Loan and Mortgage Data 4; Regulatory Identifiers 6; Banking Authentication 3; Customer Financial Data 4; Internal Banking References 2; PCI Sensitive Data 1; Contact Information 5; Generic Secrets 6; Cryptocurrency 7; Vehicle Identification 1; Dates 3; URLs with Credentials 2; Personal Identifiers 2; Geolocation 3; Postal Codes 5; Device Identifiers 5; Medical Identifiers 5; Insurance Identifiers 2; Authentication Tokens 1; Social Media Identifiers 2; Education Identifiers 1; Legal Identifiers 2; Employment Identifiers 2; Biometric Identifiers 2; Property Identifiers 2; Supervisory Information 6; Privileged Information 7; Data Classification Labels 8; Corporate Classification 9; Traffic Light Protocol 6; Financial Regulatory Labels 7; Privacy Classification 10; Cloud Provider Secrets 3; Code Platform Secrets 5; Payment Service Secrets 2; Messaging Service Secrets 6
North America: United States 63; US Generic DL 1; Canada 29; Mexico 7
Europe: United Kingdom 7; Germany 6; France 5; Italy 5; Netherlands 4; Spain 5; Poland 6; Sweden 4; Portugal 4; Switzerland 4; Turkey 4; Austria 5; Belgium 4; Ireland 4; Denmark 3; Finland 3; Norway 4; Czech Republic 4; Hungary 5; Romania 4; Greece 5; Croatia 4; Bulgaria 4; Slovakia 3; Lithuania 3; Latvia 3; Estonia 3; Slovenia 4; Luxembourg 3; Malta 3; Cyprus 3; Iceland 2; Liechtenstein 2; EU 2
Asia-Pacific: India 6; China 5; Japan 6; South Korea 3; Singapore 4; Australia 11; New Zealand 4; Philippines 6; Thailand 4; Malaysia 2; Indonesia 3; Vietnam 3; Pakistan 3; Bangladesh 3; Sri Lanka 3
Latin America: Brazil 6; Argentina 3; Colombia 4; Chile 2; Peru 4; Venezuela 3; Ecuador 3; Uruguay 3; Paraguay 3; Costa Rica 3
Middle East: Saudi Arabia 2; UAE 3; Israel 2; Qatar 2; Kuwait 2; Bahrain 2; Jordan 2; Lebanon 2; Iraq 2; Iran 2
Africa: South Africa 3; Nigeria 6; Kenya 4; Egypt 3; Ghana 4; Ethiopia 3; Tanzania 3; Morocco 3; Tunisia 2; Uganda 2
"""
LISTED = [(item.rpartition(" ")[0] if region == "Others" else f"{region} - {item.rpartition(' ')[0]}", int(item.rpartition(" ")[2])) for region, _, items in (line.partition(": ") for line in SIZES.strip().splitlines()) for item in items.split("; ")]
#: The signature rules in SQL: word runs, their 64-bit FNV-1a hashes cut to 32 bits, and 128 linear functions drawn by a recursive generator.
WRAP = "18446744073709551616::UHUGEINT"
BYTES = "list_transform(range(0, length(hex(encode(run))) // 2), lambda i: ('0x' || substr(hex(encode(run)), 2 * i + 1, 2))::UHUGEINT)"
SIGNED = f"""draws AS (SELECT 0 AS i, 42::UHUGEINT AS state UNION ALL SELECT i + 1, (state * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT) % {WRAP} FROM draws WHERE i < 256),
drawn AS (SELECT i, (state // 65536::UHUGEINT) % 2305843009213693951::UHUGEINT AS v FROM draws WHERE i > 0),
functions AS (SELECT a.i // 2 AS j, greatest(a.v, 1::UHUGEINT) AS a, b.v AS b FROM drawn a JOIN drawn b ON b.i = a.i + 1 WHERE a.i % 2 = 1),
newest AS (SELECT doc_id, arg_max(struct_pack(t := text, s := signature, v := sensitivity), registered_at) AS r FROM document_entries WHERE doc_id IS NOT NULL AND (text IS NOT NULL OR signature IS NOT NULL) GROUP BY 1),
unsigned AS (SELECT doc_id, regexp_extract_all(lower(r.t), '[^\\s]+') AS w FROM newest WHERE r.s IS NULL),
runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS run FROM unsigned WHERE len(w) >= 3),
hashed AS (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, {BYTES}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {WRAP}) % 4294967296::UHUGEINT AS h FROM runs),
smallest AS (SELECT doc_id, j, min((a * h + b) % {WRAP} % 2305843009213693951::UHUGEINT % 4294967295::UHUGEINT)::BIGINT AS value FROM hashed CROSS JOIN functions GROUP BY 1, 2),
vault AS (SELECT doc_id, unnest(r.s) AS value, generate_subscripts(r.s, 1) - 1 AS j FROM newest WHERE r.s IS NOT NULL UNION ALL SELECT doc_id, value, j FROM smallest)"""
SQL |= {
    "catalogue_categories": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {n})" for c, n in LISTED) + ") AS t(category, n)",
    "vault_signatures": "SELECT DISTINCT doc_id, md5(array_to_string(signature, ',')) AS digest FROM document_entries WHERE text IS NOT NULL AND signature IS NOT NULL",
    "vault_lookup": f"WITH RECURSIVE {SIGNED} SELECT q.doc_id AS query_id, v.doc_id, count(*) / 128.0::DOUBLE AS similarity, any_value(n.r.v) AS sensitivity FROM vault q JOIN vault v ON q.j = v.j AND q.value = v.value JOIN newest n ON n.doc_id = v.doc_id WHERE try_cast(regexp_extract(q.doc_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0 AND q.doc_id IN (SELECT doc_id FROM newest WHERE r.t IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 0.8 * 128",
}
NAMES = ["scan_answers", "scan_extractions", "scan_severity_counts", "scan_baseline_contact", "guard_redact", "guard_obfuscate", "catalogue_keywords"]


def queries() -> dict:
    return {name: globals()[name] for name in [*NAMES, *SQL]}


def oracle_sql() -> dict[str, str]:
    return SQL
