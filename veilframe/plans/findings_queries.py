"""Queries over the findings store with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import scoring
from veilframe.operators import findings as O
from veilframe.session import table


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_rows(table(spark, sf_dir, "findings"), "id")


STORE = "(SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
SCANS = "(SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"

RULES = [
    ("cards", 1, 10, "redact", ["Credit Card Numbers"], None, 0.5),
    ("visa", 2, 20, "block", ["Credit Card Numbers"], ["Visa"], 0.8),
    ("contact", 3, 5, "flag", ["Contact Information", "Personal Identifiers"], ["Email Address", "USA SSN"], 0.3),
    ("people", 4, 5, "mask", ["Personal Identifiers"], None, 0.6),
]
RULE_SCHEMA = "rule string, rule_no int, priority int, action string, categories array<string>, sub_categories array<string>, min_confidence double"
LISTS = [("corp", 1, "allow", "******4890"), ("hot", 2, "block", "******6749"), ("hot", 2, "block", "******4890"), ("soft", 3, "tag", "******1111"), ("softer", 4, "mask", "******1111")]


def findings_top_categories(s, d):
    return O.category_counts(store(s, d))


def daily_scans(s, d):
    return O.daily_counts(store(s, d))


def findings_totals(s, d):
    return O.totals(store(s, d))


def match_rate(s, d):
    return O.match_rate(table(s, d, "similarity_matches"), 0.8)


def findings_page(s, d):
    return O.page(store(s, d), 50, 100, "Contact Information").select("id", "sub_category")


def findings_export_join(s, d):
    return O.with_scans(store(s, d), O.first_rows(table(s, d, "scans"), "id")).select("id", "scan_id", "category", "action", "duration_ms")


def compliance_categories(s, d):
    return O.compliance_categories(store(s, d))


def compliance_status(s, d):
    return O.framework_status(store(s, d))


def severity_compliance(s, d):
    return O.severity_histogram(store(s, d))


def severity_console(s, d):
    f = store(s, d).where("confidence is not null")
    return f.groupBy("category", scoring.console_severity(F.col("category"), F.col("confidence").cast("double")).alias("severity")).agg(F.count("*").alias("n"))


def retention_prune(s, d):
    return O.prune(store(s, d), 7).select("id")


def insert_if_absent(s, d):
    return O.insert_if_absent(store(s, d).select("scan_id"), table(s, d, "scans").select(F.col("id").alias("scan_id")), "scan_id")


def unique_threshold(s, d):
    return O.over_unique_limit(store(s, d), 2)


def batch_summary(s, d):
    return O.batch_summary(table(s, d, "scan_results").dropDuplicates(["result_id"]))


def batch_categories(s, d):
    return O.batch_categories(table(s, d, "scan_results").dropDuplicates(["result_id"]))


def technique_bypass_top10(s, d):
    return O.worst_sub_categories(store(s, d))


def policy_rule_pick(s, d):
    return O.rule_pick(store(s, d), s.createDataFrame(RULES, RULE_SCHEMA)).select("id", "rule", "action")


def list_verdict(s, d):
    return O.list_verdicts(store(s, d), s.createDataFrame(LISTS, "list_id string, binding_no int, action string, entry string"))


def disabled_anti(s, d):
    disabled = s.createDataFrame([("Credit Card Numbers", "Visa"), ("Contact Information", "IPv4 Address")], "category string, sub_category string")
    return O.without_disabled(store(s, d), disabled).select("id")


def allowlist_anti(s, d):
    return O.not_allowed(store(s, d), s.createDataFrame([("Custom",), ("VIN",), ("******4890",)], "name string")).select("id")


def confidence_score(s, d):
    f = store(s, d).where("confidence is not null and has_context is not null and context_required is not null")
    score = scoring.confidence(F.col("confidence").cast("double"), F.col("has_context"), F.col("context_required"))
    return f.groupBy("category").agg(F.round(F.sum(score), 2).alias("total_score"), F.count("*").alias("n"))


def classification_max(s, d):
    rows = table(s, d, "similarity_matches").select("scan_id", scoring.level_of(F.col("sensitivity")).alias("level")).where("level is not null")
    return rows.groupBy("scan_id").agg(F.max("level").alias("highest_level"))


def findings_filter(s, d):
    f = store(s, d)
    return f.where((F.col("category") == "Contact Information") & F.lower("matched_text").contains("98") & (F.unix_micros("created_at") > 1735689600000000)).select("id")


def scan_action_counts(s, d):
    return O.first_rows(table(s, d, "scans"), "id").groupBy(F.lower("action").alias("action")).agg(F.count("*").alias("n"), F.sum("finding_count").alias("n_findings"), F.max("duration_ms").alias("slowest_ms"))


def scans_without_findings(s, d):
    scans = O.first_rows(table(s, d, "scans"), "id")
    return scans.join(store(s, d).select(F.col("scan_id").alias("id")).distinct(), "id", "left_anti").select("id")


def orphan_findings(s, d):
    return store(s, d).join(table(s, d, "scans").select(F.col("id").alias("scan_id")).distinct(), "scan_id", "left_anti").select("id", "scan_id")


def finding_count_check(s, d):
    """Scans whose stored finding_count differs from the findings that are there."""
    counted = store(s, d).groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("counted"))
    scans = O.first_rows(table(s, d, "scans"), "id").select("id", "finding_count")
    return scans.join(counted, "id", "left").select("id", "finding_count", F.coalesce("counted", F.lit(0)).alias("counted")).where("finding_count <> counted")


def pattern_pairs(s, d):
    """Categories found together in one scan, by pre-aggregated sets of categories (bounded by the catalogue)."""
    sets = store(s, d).where("category is not null").groupBy("scan_id").agg(F.array_sort(F.collect_set("category")).alias("cats")).groupBy("cats").agg(F.count("*").alias("n"))
    pairs = sets.select("n", F.explode("cats").alias("category_a"), "cats").select("n", "category_a", F.explode("cats").alias("category_b")).where("category_a < category_b")
    return pairs.groupBy("category_a", "category_b").agg(F.sum("n").alias("n_scans"))


SQL = {
    "findings_top_categories": f"SELECT category, count(*) AS n FROM {STORE} GROUP BY 1 ORDER BY n DESC, category NULLS LAST LIMIT 20",
    "daily_scans": f"WITH f AS (SELECT epoch_us(created_at) // 86400000000 AS day FROM {STORE}) SELECT day, count(*) AS n FROM f WHERE day > (SELECT max(day) FROM f) - 30 GROUP BY 1",
    "findings_totals": f"SELECT count(*) AS n_findings, count(DISTINCT scan_id) AS n_scans, max(epoch_us(created_at)) AS last_us FROM {STORE}",
    "match_rate": "SELECT count(*) AS n, count(*) FILTER (similarity >= 0.8) AS n_matched, count(*) FILTER (similarity >= 0.8) / greatest(count(*), 1) AS rate FROM similarity_matches",
    "findings_page": f"SELECT id, sub_category FROM {STORE} WHERE category = 'Contact Information' ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 100",
    "findings_export_join": f"SELECT f.id, f.scan_id, f.category, lower(s.action) AS action, s.duration_ms FROM {STORE} f LEFT JOIN {SCANS} s ON f.scan_id = s.id",
    "compliance_categories": f"SELECT category, sub_category, count(*) AS n, round(avg(confidence::DOUBLE), 4) AS mean_confidence, min_by(matched_text, id) AS sample FROM {STORE} GROUP BY 1, 2",
    "compliance_status": "WITH r AS (SELECT unnest(['PCI-DSS','PCI-DSS','HIPAA','SOC2','SOC2','SOC2','GDPR','GDPR']) AS framework, unnest(['Credit Card Numbers','Primary Account Numbers','Medical Identifiers','Generic Secrets','Cloud Provider Secrets','Code Platform Secrets','Contact Information','Personal Identifiers']) AS category) "
    f"SELECT framework, count(f.id) AS n_findings, count(f.id) = 0 AS passed FROM r LEFT JOIN {STORE} f USING (category) GROUP BY 1",
    "severity_compliance": f"SELECT s.severity, count(f.id) AS n FROM (SELECT unnest(['high', 'medium', 'low']) AS severity) s LEFT JOIN (SELECT id, CASE WHEN confidence::DOUBLE >= 0.75 THEN 'high' WHEN confidence::DOUBLE >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM {STORE} WHERE confidence IS NOT NULL) f USING (severity) GROUP BY 1",
    "severity_console": f"SELECT category, CASE WHEN (confidence::DOUBLE >= 0.8 AND regexp_matches(lower(category), 'credit card|primary account|secret|medical identifier')) OR confidence::DOUBLE >= 0.9 THEN 'red' WHEN confidence::DOUBLE >= 0.7 THEN 'warn' ELSE 'safe' END AS severity, count(*) AS n FROM {STORE} WHERE confidence IS NOT NULL GROUP BY 1, 2",
    "retention_prune": f"SELECT id FROM {STORE} WHERE epoch_us(created_at) >= (SELECT max(epoch_us(created_at)) FROM findings) - 7 * 86400000000",
    "insert_if_absent": "SELECT DISTINCT id AS scan_id FROM scans WHERE id IS NOT NULL AND id NOT IN (SELECT scan_id FROM findings WHERE scan_id IS NOT NULL)",
    "unique_threshold": f"SELECT scan_id, category, sub_category, count(DISTINCT matched_text) AS unique_count FROM {STORE} GROUP BY 1, 2, 3 HAVING unique_count > 2",
    "batch_summary": "WITH r AS (SELECT any_value(coalesce(len(findings), 0)) AS n FROM scan_results GROUP BY result_id) SELECT count(*) AS n_items, count(*) FILTER (n > 0) AS n_with_findings, sum(n)::BIGINT AS n_findings FROM r",
    "batch_categories": "WITH r AS (SELECT DISTINCT result_id, unnest(list_transform(findings, lambda f: f.category)) AS category FROM scan_results) SELECT category, count(*) AS n_items FROM r GROUP BY 1",
    "technique_bypass_top10": f"SELECT sub_category, count(*) AS n, count(*) FILTER (NOT has_context) AS n_missed, 100.0::DOUBLE * count(*) FILTER (NOT has_context) / count(*) AS percent FROM {STORE} WHERE sub_category IS NOT NULL GROUP BY 1 ORDER BY percent DESC, sub_category LIMIT 10",
    "policy_rule_pick": f"WITH hit AS (SELECT id, CASE WHEN category = 'Credit Card Numbers' AND sub_category = 'Visa' AND confidence::DOUBLE >= 0.8 THEN 'visa' WHEN category = 'Credit Card Numbers' AND confidence::DOUBLE >= 0.5 THEN 'cards' WHEN category IN ('Contact Information', 'Personal Identifiers') AND sub_category IN ('Email Address', 'USA SSN') AND confidence::DOUBLE >= 0.3 THEN 'contact' WHEN category = 'Personal Identifiers' AND confidence::DOUBLE >= 0.6 THEN 'people' END AS rule FROM {STORE}) SELECT id, rule, CASE rule WHEN 'visa' THEN 'block' WHEN 'cards' THEN 'redact' WHEN 'contact' THEN 'flag' ELSE 'mask' END AS action FROM hit WHERE rule IS NOT NULL",
    "list_verdict": f"SELECT id, CASE WHEN matched_text IN ('******6749', '******4890') THEN 'block' ELSE 'mask' END AS list_action, CASE WHEN matched_text IN ('******6749', '******4890') THEN 'hot' ELSE 'softer' END AS list_matched FROM {STORE} WHERE matched_text IN ('******6749', '******4890', '******1111')",
    "disabled_anti": f"SELECT id FROM {STORE} WHERE NOT coalesce((category = 'Credit Card Numbers' AND sub_category = 'Visa') OR (category = 'Contact Information' AND sub_category = 'IPv4 Address'), false)",
    "allowlist_anti": f"SELECT id FROM {STORE} WHERE coalesce(category NOT IN ('Custom', 'VIN', '******4890'), true) AND coalesce(sub_category NOT IN ('Custom', 'VIN', '******4890'), true) AND coalesce(matched_text NOT IN ('Custom', 'VIN', '******4890'), true)",
    "confidence_score": f"SELECT category, round(sum(floor((CASE WHEN has_context THEN least(confidence::DOUBLE + 0.2, 1.0) WHEN context_required THEN confidence::DOUBLE * 0.3 ELSE confidence::DOUBLE END) * 100 + 0.5) / 100), 2) AS total_score, count(*) AS n FROM {STORE} WHERE confidence IS NOT NULL AND has_context IS NOT NULL AND context_required IS NOT NULL GROUP BY 1",
    "classification_max": "WITH l AS (SELECT scan_id, CASE lower(trim(sensitivity)) WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'restricted' THEN 2 WHEN 'confidential' THEN 3 WHEN 'secret' THEN 4 WHEN 'top_secret' THEN 5 WHEN 'top-secret' THEN 5 END AS level FROM similarity_matches) SELECT scan_id, max(level) AS highest_level FROM l WHERE level IS NOT NULL GROUP BY 1",
    "findings_filter": f"SELECT id FROM {STORE} WHERE category = 'Contact Information' AND contains(lower(matched_text), '98') AND epoch_us(created_at) > 1735689600000000",
    "scan_action_counts": f"SELECT lower(action) AS action, count(*) AS n, sum(finding_count)::BIGINT AS n_findings, max(duration_ms) AS slowest_ms FROM {SCANS} GROUP BY 1",
    "scans_without_findings": f"SELECT id FROM {SCANS} WHERE id NOT IN (SELECT scan_id FROM findings WHERE scan_id IS NOT NULL)",
    "orphan_findings": f"SELECT id, scan_id FROM {STORE} f WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.id = f.scan_id)",
    "finding_count_check": f"SELECT s.id, s.finding_count, coalesce(c.counted, 0) AS counted FROM {SCANS} s LEFT JOIN (SELECT scan_id, count(*) AS counted FROM {STORE} GROUP BY 1) c ON c.scan_id = s.id WHERE s.finding_count <> coalesce(c.counted, 0)",
    "pattern_pairs": f"WITH c AS (SELECT DISTINCT scan_id, category FROM {STORE} WHERE category IS NOT NULL) SELECT a.category AS category_a, b.category AS category_b, count(*) AS n_scans FROM c a JOIN c b ON a.scan_id IS NOT DISTINCT FROM b.scan_id AND a.category < b.category GROUP BY 1, 2",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
