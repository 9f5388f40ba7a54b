"""Queries of lists, explanations, run reports and containment, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import enrich, protect
from veilframe.operators import findings as O
from veilframe.plans.enrich_queries import E1, docs, places
from veilframe.session import table
from veilframe.sources import sinks
from veilframe.streaming import operators as stream

NOW = 1_735_689_600_000_000  # the beginning of 2025, as the time of asking

EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
TOKEN = r"[^\s,;'()\[\]{}=:]{16,256}"
LISTS = [("org", 1, "mask", "domain", "example.org"), ("post", 2, "allow", "email", "@post.example"), ("names", 3, "block", "keyword", "nest"), ("one", 4, "tag", "exact", "nobody@example.com"), ("anna", 5, "tag", "path", "*anna*")]


def addresses(s, d):
    found = table(s, d, "extractions").select(F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"))).alias("matched_text")).distinct()
    return found.select(F.col("matched_text").alias("id"), "matched_text")


def list_kinds(s, d):
    return O.list_verdicts(addresses(s, d), s.createDataFrame(LISTS, "list_id string, binding_no int, action string, kind string, entry string"))


def explain_join(s, d):
    found = table(s, d, "findings").dropDuplicates(["id"]).select("id", "scan_id", "sub_category")
    events = table(s, d, "scans").select(F.col("id").alias("scan_id"), F.lower("action").alias("action"), F.col("source_pod").alias("actor"), F.unix_micros("created_at").alias("at"))
    return O.explain_events(found, events).select("id", "sub_category", "event_action", F.col("event_at").alias("at_us"))


def runs(s, d):
    found = table(s, d, "findings").dropDuplicates(["id"]).where("scanner_version is not null")
    return found.groupBy(F.col("scanner_version").alias("id")).agg(F.count("*").alias("n_payloads"), F.count_if(~F.coalesce("has_context", F.lit(False))).alias("n_missed"), F.max(F.unix_micros("created_at")).alias("created_at"))


def run_summary(s, d):
    return O.run_summary(runs(s, d))


def audit_page(s, d):
    """The second hundred of the blocked scans, newest first."""
    events = table(s, d, "scans").dropDuplicates(["id"]).select("id", F.coalesce("source_pod", F.lit("none")).alias("source"), F.lower("action").alias("action"), F.unix_micros("created_at").alias("at"))
    return O.audit_list(events, action="redact", limit=100, offset=100)


def results_added(s, d):
    per = lambda name, key: table(s, d, name).dropDuplicates([key]).groupBy(F.coalesce("format" if name == "extractions" else "classification_level", F.lit("none")).alias("category")).agg(F.count("*").alias("n_files"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_findings"))
    return O.summed_results(per("extractions", "extraction_id"), per("scan_results", "result_id"))


def entropy_uncovered(s, d):
    """Long tokens that no address overlaps."""
    span = lambda shape: enrich.matches_of(docs(s, d), shape).select("doc_id", "match", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return O.without_contained(span(EMAIL), span(TOKEN))


def metric_lines(s, d):
    counts = table(s, d, "findings").dropDuplicates(["id"]).groupBy("category", F.lower("sub_category").alias("kind")).agg(F.count("*").alias("n"))
    return sinks.metric_lines(counts, "findings_total", ["category", "kind"])


def webhook_counts(s, d):
    sent = sinks.webhook(table(s, d, "findings").dropDuplicates(["id"]).where("scan_id is not null"))
    return sent.select("scan_id", F.get_json_object("payload", "$.count").cast("bigint").alias("n"), F.get_json_object("payload", "$.highest").cast("double").alias("highest"))


def known_prefixes(s, d):
    """Numbers made of order keys whose prefix is one of those made of customer keys."""
    cards = table(s, d, "orders").select(F.concat((F.col("o_orderkey") * 7919 % 5000 + 400_000).cast("string"), F.lit("-0000000000")).alias("value"))
    return enrich.known_prefixes(cards, table(s, d, "customer").select((F.col("c_custkey") * 37 % 5000 + 400_000).cast("int").alias("bin")).distinct())


def pattern_trial(s, d):
    return enrich.try_pattern(docs(s, d), "(?:INC|REQ|CHG)-[0-9]{6}")


def audit_events(s, d):
    return O.audit_of_scans(table(s, d, "scans").dropDuplicates(["id"]).where("action is not null")).groupBy("source", "action").agg(F.count("*").alias("n"), F.max("at").alias("last_us"))


def live_tokens(s, d):
    """Scan ids as tokens that live a day, seen from the newest."""
    vault = table(s, d, "findings").where("scan_id is not null and matched_text is not null and created_at is not null").select(F.col("matched_text").alias("token"), F.lit("v").alias("value"), F.lit("c").alias("category"), F.unix_micros("created_at").alias("stored_at_us"))
    return protect.live_tokens(vault, NOW, 30 * 86_400_000_000).select("token", "stored_at_us")


def requests_left(s, d):
    asked = table(s, d, "scans").dropDuplicates(["id"]).where("api_key_hash is not null").select(F.hex("api_key_hash").alias("client_id"), F.unix_micros("created_at").alias("at_us"), F.lit(True).alias("admitted"))
    return stream.remaining(asked, 20, 30 * 86_400_000_000, NOW)


def document_times(s, d):
    """Times written as document dates and as file times, and read back."""
    t = table(s, d, "scans").dropDuplicates(["id"]).where("created_at is not null").select("id", "created_at")
    written = F.concat(F.lit("D:"), F.date_format("created_at", "yyyyMMddHHmmss"), F.lit("+02'30'"))
    ticks = (F.unix_micros("created_at") + F.lit(11_644_473_600_000_000)) * 10
    return t.select("id", T.pdf_time(written).alias("pdf_time"), T.file_time(ticks).alias("file_time"))


def safe_paths(s, d):
    p = table(s, d, "extractions").where("path is not null").select("path", F.explode(F.array(F.lit(""), F.lit("/../x"))).alias("step")).distinct()
    return p.select("path", "step", T.safe_path(F.concat("path", "step"), "/data").alias("safe"))


F1 = "(SELECT id, any_value(scan_id) AS scan_id, any_value(sub_category) AS sub_category, any_value(scanner_version) AS scanner_version, any_value(has_context) AS has_context, any_value(epoch_us(created_at)) AS at_us FROM findings GROUP BY id)"
SQL = {
    "list_kinds": f"WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS id FROM extractions), v AS (SELECT id, CASE WHEN contains(lower(id), 'nest') THEN 'block' WHEN lower(id) LIKE '%@post.example' THEN 'allow' WHEN regexp_matches(lower(id), '[@.]example[.]org$') THEN 'mask' WHEN lower(id) = 'nobody@example.com' OR contains(lower(id), 'anna') THEN 'tag' END AS list_action, lower(id) = 'nobody@example.com' AS one FROM a) SELECT id, list_action, CASE list_action WHEN 'block' THEN 'names' WHEN 'allow' THEN 'post' WHEN 'mask' THEN 'org' ELSE CASE WHEN one THEN 'one' ELSE 'anna' END END AS list_matched FROM v WHERE list_action IS NOT NULL",
    "explain_join": f"WITH e AS (SELECT id AS scan_id, max(epoch_us(created_at)) AS at, arg_max(lower(action), epoch_us(created_at)) AS action FROM scans GROUP BY id) SELECT f.id, f.sub_category, e.action AS event_action, e.at AS at_us FROM {F1} f LEFT JOIN e ON e.scan_id = f.scan_id",
    "run_summary": f"WITH r AS (SELECT scanner_version AS id, count(*) AS n_payloads, count(*) FILTER (NOT coalesce(has_context, false)) AS n_missed, max(at_us) AS made FROM {F1} WHERE scanner_version IS NOT NULL GROUP BY 1) SELECT count(*) AS n_runs, sum(n_payloads)::BIGINT AS n_payloads, sum(n_missed)::BIGINT AS n_missed, round(100.0::DOUBLE * (1 - sum(n_missed)::DOUBLE / sum(n_payloads)::DOUBLE), 2) AS detection_percent, arg_max(id, made) AS last_id, max(made) AS last_at FROM r",
    "audit_page": "SELECT id, coalesce(any_value(source_pod), 'none') AS source, lower(any_value(action)) AS action, any_value(epoch_us(created_at)) AS \"at\" FROM scans GROUP BY id HAVING lower(any_value(action)) = 'redact' ORDER BY any_value(epoch_us(created_at)) DESC, id LIMIT 100 OFFSET 100",
    "results_added": "SELECT category, count(*) AS n_files, sum(n)::BIGINT AS n_findings FROM (SELECT coalesce(any_value(format), 'none') AS category, length(coalesce(any_value(text), '')) AS n FROM extractions GROUP BY extraction_id UNION ALL SELECT coalesce(any_value(classification_level), 'none'), length(coalesce(any_value(text), '')) FROM scan_results GROUP BY result_id) GROUP BY 1",
    "metric_lines": "SELECT 'findings_total{category=\"' || coalesce(category, '') || '\",kind=\"' || coalesce(kind, '') || '\"} ' || n AS line FROM (SELECT category, kind, count(*) AS n FROM (SELECT any_value(category) AS category, lower(any_value(sub_category)) AS kind FROM findings GROUP BY id) GROUP BY 1, 2)",
    "webhook_counts": "SELECT scan_id, count(*) AS n, round(max(c), 2) AS highest FROM (SELECT any_value(scan_id) AS scan_id, any_value(confidence)::DOUBLE AS c FROM findings GROUP BY id) WHERE scan_id IS NOT NULL GROUP BY 1",
    "known_prefixes": "WITH v AS (SELECT (o_orderkey * 7919 % 5000 + 400000)::VARCHAR || '-0000000000' AS value FROM orders) SELECT value FROM v WHERE substr(value, 1, 6)::INT IN (SELECT c_custkey * 37 % 5000 + 400000 FROM customer)",
    "pattern_trial": f"SELECT match, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:INC|REQ|CHG)-[0-9]{{6}}')) AS match FROM {E1}) GROUP BY 1",
    "audit_events": "SELECT source, action, count(*) AS n, max(made) AS last_us FROM (SELECT coalesce(any_value(source_pod), 'none') AS source, CASE WHEN coalesce(any_value(finding_count), 0) > 0 THEN 'scan.findings:' ELSE 'scan.clean:' END || lower(any_value(action)) AS action, any_value(epoch_us(created_at)) AS made FROM scans WHERE action IS NOT NULL GROUP BY id) GROUP BY 1, 2",
    "live_tokens": f"SELECT matched_text AS token, max(epoch_us(created_at)) AS stored_at_us FROM findings WHERE scan_id IS NOT NULL AND matched_text IS NOT NULL AND created_at IS NOT NULL GROUP BY 1 HAVING max(epoch_us(created_at)) + 2592000000000 > {NOW}",
    "requests_left": f"SELECT k AS client_id, greatest(20 - count(*) FILTER (made > {NOW} - 2592000000000 AND made <= {NOW}), 0) AS \"left\" FROM (SELECT hex(any_value(api_key_hash)) AS k, any_value(epoch_us(created_at)) AS made FROM scans WHERE api_key_hash IS NOT NULL GROUP BY id) GROUP BY 1",
    "document_times": "SELECT id, strftime(make_timestamp(made // 1000000 * 1000000 - 9000000000), '%Y-%m-%dT%H:%M:%SZ') AS pdf_time, strftime(make_timestamp(made), '%Y-%m-%dT%H:%M:%SZ') AS file_time FROM (SELECT id, any_value(epoch_us(created_at)) AS made FROM scans WHERE created_at IS NOT NULL GROUP BY id)",
    "safe_paths": "SELECT DISTINCT path, step, path LIKE '/data/%' AND step = '' AND NOT contains(path, '..') AS safe FROM extractions, unnest(['', '/../x']) AS u(step) WHERE path IS NOT NULL",
    "entropy_uncovered": f"WITH e AS (SELECT doc_id, p.pos AS a, p.pos + length(p.m)::INT AS b FROM {places('text', EMAIL, E1)}), t AS (SELECT doc_id, p.m AS match, p.pos AS span_start, p.pos + length(p.m)::INT AS span_end FROM {places('text', TOKEN.replace(chr(39), chr(39) * 2), E1)}) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = t.doc_id AND e.a < t.span_end AND e.b > t.span_start)",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
