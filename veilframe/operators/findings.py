"""Analytics over the findings store: relations of findings and scans in, aggregates out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import scoring
from veilframe.operators.protect import list_predicate


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per id: repeated deliveries of a row are dropped before anything is counted."""
    return df.dropDuplicates([key])


def category_counts(findings: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent categories; ties by name."""
    return findings.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category")).limit(top)


def day_of(ts: Column) -> Column:
    """Days since 1970 in UTC."""
    return F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("bigint")


def daily_counts(findings: DataFrame, days: int = 30) -> DataFrame:
    """Findings per day over the last days before the newest row."""
    newest = findings.agg(F.max(day_of(F.col("created_at"))).alias("newest"))
    rows = findings.select(day_of(F.col("created_at")).alias("day")).where("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(newest), rows.day > newest.newest - days).select("day", "n")


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n_findings"), F.countDistinct("scan_id").alias("n_scans"), F.max(F.unix_micros("created_at")).alias("last_us"))


def match_rate(lookups: DataFrame, threshold: float) -> DataFrame:
    """Lookups, those at or above the threshold, and their share (0 without lookups)."""
    matched = F.count_if(F.col("similarity") >= threshold)
    return lookups.agg(F.count("*").alias("n"), matched.alias("n_matched"), F.coalesce(F.try_divide(matched, F.count("*")), F.lit(0.0)).alias("rate"))


def page(findings: DataFrame, size: int, offset: int, category: str | None = None) -> DataFrame:
    """A page of the newest findings, ties by id."""
    rows = findings if category is None else findings.where(F.col("category") == category)
    return rows.orderBy(F.desc_nulls_last("created_at"), "id").offset(offset).limit(size)


def with_scans(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings with their scan, also those whose scan is missing."""
    s = scans.select(F.col("id").alias("scan_id"), F.lower("action").alias("action"), "duration_ms", "file_name")
    return findings.join(s, "scan_id", "left")


def compliance_categories(findings: DataFrame) -> DataFrame:
    """Per category and sub-category: count, mean confidence and the sample of the least id."""
    return findings.groupBy("category", "sub_category").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence"), F.min_by("matched_text", "id").alias("sample")
    )


#: Categories in which a finding fails a framework.
FRAMEWORKS = {
    "PCI-DSS": ["Credit Card Numbers", "Primary Account Numbers"],
    "HIPAA": ["Medical Identifiers"],
    "SOC2": ["Generic Secrets", "Cloud Provider Secrets", "Code Platform Secrets"],
    "GDPR": ["Contact Information", "Personal Identifiers"],
}


def framework_status(findings: DataFrame) -> DataFrame:
    """(framework, n_findings, passed) for every framework, also without findings."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(f, c) for f, cs in FRAMEWORKS.items() for c in cs], "framework string, category string")
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(rules).join(counts, "category", "left").groupBy("framework").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings")).withColumn("passed", F.col("n_findings") == 0)


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Counts of high, medium and low, zero-filled."""
    spark = findings.sparkSession
    every = spark.createDataFrame([("high",), ("medium",), ("low",)], "severity string")
    counts = findings.where("confidence is not null").groupBy(scoring.report_severity(F.col("confidence").cast("double")).alias("severity")).agg(F.count("*").alias("n"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def prune(rows: DataFrame, days: int) -> DataFrame:
    """Rows that a retention of so many days before the newest row keeps."""
    newest = rows.agg(F.max(F.unix_micros("created_at")).alias("newest"))
    return rows.join(F.broadcast(newest), F.unix_micros("created_at") >= F.col("newest") - days * 86_400_000_000).drop("newest")


def insert_if_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't stored yet, one per key."""
    return new.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def over_unique_limit(findings: DataFrame, limit: int) -> DataFrame:
    """(scan_id, category, sub_category, unique_count) where one scan has more distinct values than allowed."""
    counts = findings.groupBy("scan_id", "category", "sub_category").agg(F.countDistinct("matched_text").alias("unique_count"))
    return counts.where(F.col("unique_count") > limit)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts of a batch of scan answers."""
    n = F.coalesce(F.size("findings"), F.lit(0))
    return results.agg(F.count("*").alias("n_items"), F.count_if(n > 0).alias("n_with_findings"), F.sum(F.greatest(n, F.lit(0))).alias("n_findings"))


def batch_categories(results: DataFrame) -> DataFrame:
    """Number of items (not findings) per category."""
    return results.select("result_id", F.explode(F.array_distinct(F.transform("findings", lambda f: f["category"]))).alias("category")).groupBy("category").agg(F.count("*").alias("n_items"))


def worst_sub_categories(findings: DataFrame, top: int = 10) -> DataFrame:
    """Sub-categories with the largest share of findings without context; ties by name."""
    missed = F.count_if(~F.col("has_context"))
    return (
        findings.where("sub_category is not null").groupBy("sub_category").agg(F.count("*").alias("n"), missed.alias("n_missed"), (F.lit(100.0) * missed / F.count("*")).alias("percent"))
        .orderBy(F.desc("percent"), "sub_category").limit(top)
    )


def attribution_pairs(files: DataFrame, weak_alone: bool = False) -> DataFrame:
    """Scores of pairs of files: (a, b, total, signals).

    Pairs are made by equi-joins on the strong signals (session ids, document ids), whose values few files share; the weak ones
    (creator, application, company) are then looked up for these pairs. With ``weak_alone`` pairs that share nothing
    but a weak signal are listed too, which for a common application are all pairs of its files.
    ``files``: path, creator, application, company, rsids ARRAY<STRING>, pdf_doc_id STRING.
    """
    weak = [("creator", 0.20), ("application", 0.10), ("company", 0.15)]
    shared_values = lambda name: files.select(F.col("path").alias("a"), F.col(name).alias("v")).where("v is not null and v <> ''").join(files.select(F.col("path").alias("b"), F.col(name).alias("v")), "v").where("a < b").select("a", "b")
    ids = files.select("path", F.explode(F.array_distinct("rsids")).alias("rsid"))
    shared = ids.alias("x").join(ids.alias("y"), F.col("x.rsid") == F.col("y.rsid")).where("x.path < y.path").groupBy(F.col("x.path").alias("a"), F.col("y.path").alias("b")).agg(F.count("*").alias("common"))
    pairs = shared.select("a", "b").union(shared_values("pdf_doc_id"))
    for name, _ in weak if weak_alone else ():
        pairs = pairs.union(shared_values(name))
    facts = files.select("path", "creator", "application", "company", "pdf_doc_id", F.size(F.array_distinct("rsids")).alias("n"), F.try_element_at("rsids", F.lit(1)).alias("root"))
    side = lambda end: facts.select(F.col("path").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in facts.columns[1:]])
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left")
    same = lambda c: F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != ""), F.lit(False))
    scores = [(name, F.when(same(name), weight)) for name, weight in [*weak, ("pdf_doc_id", 0.40), ("root", 0.50)]]
    scores.append(("rsids", 0.25 * F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))))
    total = sum((F.coalesce(score, F.lit(0.0)) for _, score in scores), F.lit(0.0))
    signals = F.array_sort(F.array_compact(F.array(*[F.when(score > 0, F.lit(name)) for name, score in scores])))
    return both.select("a", "b", F.least(total, F.lit(1.0)).alias("total"), signals.alias("signals"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: totals of adversarial runs with the latest one (id, created_at, n_payloads, n_missed)."""
    return runs.agg(
        F.count("*").alias("n_runs"), F.sum("n_payloads").alias("n_payloads"), F.sum("n_missed").alias("n_missed"),
        F.round(100.0 * (1 - F.sum("n_missed") / F.sum("n_payloads")), 2).alias("detection_percent"), F.max_by("id", "created_at").alias("last_id"), F.max("created_at").alias("last_at"),
    )


def runs_list(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of runs, newest first."""
    return runs.orderBy(F.desc_nulls_last("created_at"), "id").offset(offset).limit(limit)


def explain_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings with the audit event of their scan: what was decided, by whom; findings without an event keep nulls.

    ``events``: scan_id, action, actor, at; the latest event of a scan counts.
    """
    last = events.groupBy("scan_id").agg(F.max_by(F.struct("action", "actor", "at"), "at").alias("e"))
    return findings.join(last, "scan_id", "left").select(*findings.columns, F.col("e.action").alias("event_action"), F.col("e.actor").alias("event_actor"), F.col("e.at").alias("event_at"))


def summed_results(*results: DataFrame) -> DataFrame:
    """Batch results (category, n_files, n_findings) added up category by category."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.groupBy("category").agg(F.sum("n_files").alias("n_files"), F.sum("n_findings").alias("n_findings"))


def audit_of_scans(scans: DataFrame) -> DataFrame:
    """Audit events (id, source, action, at) that scans leave: what was done, and whether something was found."""
    found = F.when(F.coalesce("finding_count", F.lit(0)) > 0, F.lit("scan.findings")).otherwise("scan.clean")
    return scans.select("id", F.coalesce("source_pod", F.lit("none")).alias("source"), F.concat_ws(":", found, F.lower("action")).alias("action"), F.unix_micros("created_at").alias("at"))


def lost_categories(scans: DataFrame) -> DataFrame:
    """(id, lost): categories of a scan's findings that its own summary leaves out; a set difference per row."""
    there = F.array_compact(F.transform("findings", lambda f: f["category"]))
    lost = F.array_sort(F.array_except(there, F.coalesce("categories_found", F.array().cast("array<string>"))))
    return scans.select("id", lost.alias("lost")).where(F.size("lost") > 0)


def audit_list(events: DataFrame, source: str | None = None, action: str | None = None, since=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of audit events, newest first, filtered by source, action and time."""
    for condition in (source is not None and F.col("source") == source, action is not None and F.col("action") == action, since is not None and F.col("at") >= F.lit(since)):
        events = events.where(condition) if condition is not False else events
    return events.orderBy(F.desc("at"), "id").offset(offset).limit(limit)


def without_contained(findings: DataFrame, tokens: DataFrame) -> DataFrame:
    """High-entropy tokens (doc_id, span_start, span_end, ...) that no finding of their document overlaps.

    The findings of a document are gathered once and tested by a higher-order function, so no pairs are built.
    """
    spans = findings.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"))).alias("found"))
    hit = F.exists("found", lambda f: (f["s"] < F.col("span_end")) & (f["e"] > F.col("span_start")))
    return tokens.join(spans, "doc_id", "left").where(~F.coalesce(hit, F.lit(False))).drop("found")


def ring(records: DataFrame, last: int = 500) -> DataFrame:
    """The newest records, newest first."""
    return records.orderBy(F.desc_nulls_last("created_at"), "id").limit(last)


def rule_pick(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that decides each finding: highest priority, then definition order; findings without a rule drop out.

    ``rules``: rule, rule_no, priority, action, categories ARRAY<STRING>, sub_categories ARRAY<STRING>
    (null or empty: any), min_confidence.  Rules are a configuration table, exploded by category and
    joined by equality.
    """
    by_category = rules.select("rule", "rule_no", "priority", "action", "sub_categories", "min_confidence", F.explode("categories").alias("category"))
    met = findings.join(by_category, "category").where(
        (F.col("confidence").cast("double") >= F.col("min_confidence")) & (F.col("sub_categories").isNull() | (F.size("sub_categories") == 0) | F.array_contains("sub_categories", F.col("sub_category")))
    )
    order = Window.partitionBy("id").orderBy(F.desc("priority"), "rule_no")
    return met.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "sub_categories", "min_confidence", "priority", "rule_no")


def list_verdicts(findings: DataFrame, entries: DataFrame, most_rules: int = 2000) -> DataFrame:
    """(id, list_action, list_matched): the strongest list action on a finding's text.

    ``entries``: list_id, binding_no, action (block, allow, mask, tag), entry and optionally kind: exact (default), hash,
    domain, email, keyword, url, path or cidr.  Entries of the first four kinds are joined by equality with the forms of
    the text that they could equal, so lists may hold millions; the others are rules, compiled into one
    expression (more than ``most_rules`` of them raise an error).  block beats allow beats mask beats tag; inside an action the
    first binding wins.
    """
    strength = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "mask", 2).otherwise(3)
    kinds = entries if "kind" in entries.columns else entries.withColumn("kind", F.lit("exact"))
    kinds = kinds.where("entry is not null").withColumn("kind", F.lower(F.coalesce("kind", F.lit("exact"))))
    low = F.lower("matched_text")
    host = F.regexp_extract(low, r"(?:^|@|://)([^@/:]+)(?:[:/].*)?$", 1)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    forms = F.flatten(
        F.array(
            F.array(F.struct(F.lit("exact").alias("kind"), low.alias("form")), F.struct(F.lit("hash").alias("kind"), low.alias("form")), F.struct(F.lit("email").alias("kind"), low.alias("form")), F.struct(F.lit("email").alias("kind"), F.regexp_extract(low, "(@.*)$", 1).alias("form"))),
            F.transform(suffixes, lambda x: F.struct(F.lit("domain").alias("kind"), x.alias("form"))),
        )
    )
    rows = findings.where("matched_text is not null")
    equal = kinds.where("kind in ('exact', 'hash', 'email', 'domain')").select("kind", F.lower("entry").alias("form"), "list_id", "binding_no", "action")
    hits = rows.select("id", F.explode(F.array_distinct(forms)).alias("f")).select("id", "f.kind", "f.form").join(equal, ["kind", "form"]).select("id", "list_id", "binding_no", "action")
    rules = kinds.where("kind in ('keyword', 'url', 'path', 'cidr')").select("kind", "entry", "list_id", "binding_no", "action").limit(most_rules + 1).collect()
    if len(rules) > most_rules:
        raise ValueError("more keyword, url, path and cidr entries than most_rules")
    if rules:
        verdict = F.array_compact(F.array(*[F.when(list_predicate(r.kind, r.entry, F.col("matched_text")), F.struct(F.lit(r.list_id).alias("list_id"), F.lit(r.binding_no).alias("binding_no"), F.lit(r.action).alias("action"))) for r in rules]))
        hits = hits.union(rows.select("id", F.explode(verdict).alias("v")).select("id", "v.list_id", "v.binding_no", "v.action"))
    best = hits.groupBy("id").agg(F.min_by(F.struct("action", "list_id"), F.struct(strength, F.col("binding_no"))).alias("v"))
    return best.select("id", F.col("v.action").alias("list_action"), F.col("v.list_id").alias("list_matched"))


def without_disabled(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings whose (category, sub_category) isn't disabled."""
    return findings.join(disabled, ["category", "sub_category"], "left_anti")


def not_allowed(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings not suppressed by the allowlist: its names are texts, sub-categories or categories."""
    a = allowed.select(F.col("name").alias("allowed_name")).where("allowed_name is not null").distinct()
    out = findings
    for column in ("matched_text", "sub_category", "category"):
        out = out.join(a, out[column] == a.allowed_name, "left_anti")
    return out
