"""Queries of readers and sinks: contents are built from whole tables, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.session import table
from veilframe.sources import extract, sinks


def built(s, d, name: str, content) -> object:
    docs = table(s, d, "extractions").dropDuplicates(["extraction_id"])
    return docs.select(F.concat(F.lit("/data/"), F.col("extraction_id").cast("string"), F.lit("." + name)).alias("path"), F.encode(content, "UTF-8").alias("content"))


def read(s, d, name: str, content):
    return extract.extract(built(s, d, name, content)).select("path", "format", F.md5("text").alias("digest"))


def src_plain(s, d):
    return read(s, d, "txt", F.col("text"))


def src_eml(s, d):
    return read(s, d, "eml", F.concat(F.lit("From: a@example.com\nTo: b@example.com\nSubject: s\nX-Other: y\n\n"), F.col("text")))


def src_rtf(s, d):
    return read(s, d, "rtf", F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Arial;}}id "), F.col("extraction_id").cast("string"), F.lit("\\par end}")))


def src_vcard(s, d):
    return read(s, d, "vcf", F.concat(F.lit("BEGIN:VCARD\nFN:N"), F.col("extraction_id").cast("string"), F.lit("\nEMAIL;TYPE=home:x@example.com\nX-A:b\nEND:VCARD\n")))


def src_ics(s, d):
    """Calendar events that describe themselves with the whole texts, escaped."""
    plain = F.regexp_replace("text", "\\r\\n?", "\n")
    escaped = F.replace(F.replace(F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,")), F.lit(";"), F.lit("\\;")), F.lit("\n"), F.lit("\\n"))
    return read(s, d, "ics", F.concat(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:S"), F.col("extraction_id").cast("string"), F.lit("\nATTENDEE;CN=Jo:mailto:jo@example.com\nDESCRIPTION:"), escaped, F.lit("\nEND:VEVENT\nEND:VCALENDAR\n")))


def src_ldif(s, d):
    """Directory entries with the whole texts as encoded values."""
    return read(s, d, "ldif", F.concat(F.lit("dn: x\ncn: C"), F.col("extraction_id").cast("string"), F.lit("\nmail:: "), F.base64(F.lit(b"m@example.com")), F.lit("\npostalAddress: a$b\ndescription:: "), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), F.lit("\n")))


def src_unknown_content(s, d):
    return read(s, d, "bin2", F.concat(F.lit("BEGIN:VCARD\nFN:"), F.col("extraction_id").cast("string"), F.lit("\nEND:VCARD\n")))


def src_formats(s, d):
    return table(s, d, "extractions").groupBy(F.coalesce("format", F.lit("unknown")).alias("format")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


def blocked_paths(s, d):
    segments = F.slice(F.split(F.lower(F.element_at(F.split("path", "/"), -1)), r"\."), 2, 20)
    paths = table(s, d, "extractions").select(F.concat("path", F.when(F.col("extraction_id") % 3 == 0, ".EXE.txt").otherwise("")).alias("path"), "extraction_id").where("path is not null")
    return paths.where(F.arrays_overlap(segments, F.array(*[F.lit(x) for x in sorted(extract.BLOCKED)]))).select("extraction_id").distinct()


def stored(s, d):
    """The stored findings as a relation for the sinks."""
    return table(s, d, "findings").dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "category", "sub_category", F.col("matched_text").alias("text"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


def sink_csv_lines(s, d):
    return sinks.csv_lines(stored(s, d)).groupBy("line").agg(F.count("*").alias("n"))


def sink_events(s, d):
    return sinks.event(stored(s, d), "answers").groupBy("event").agg(F.count("*").alias("n"))


E1 = "(SELECT extraction_id, any_value(text) AS text FROM extractions GROUP BY 1)"


def sql(ext: str, kind: str, text: str) -> str:
    return f"SELECT '/data/' || extraction_id || '.{ext}' AS path, '{kind}' AS format, md5({text}) AS digest FROM {E1}"


SQL = {
    "src_plain": sql("txt", "text", "text"),
    "src_eml": sql("eml", "eml", "'From: a@example.com' || chr(10) || 'To: b@example.com' || chr(10) || 'Subject: s' || chr(10) || chr(10) || replace(text, chr(13) || chr(10), chr(10))"),
    "src_rtf": sql("rtf", "rtf", "'id ' || extraction_id || chr(10) || 'end'"),
    "src_vcard": sql("vcf", "vcard", "'Name: N' || extraction_id || chr(10) || 'Home: x@example.com'"),
    "src_ics": sql("ics", "ics", "'Summary: S' || extraction_id || chr(10) || 'Attendee: Jo jo@example.com' || chr(10) || 'Description: ' || regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g')"),
    "src_ldif": sql("ldif", "ldif", "'Name: C' || extraction_id || chr(10) || 'Email: m@example.com' || chr(10) || 'Address: a, b' || chr(10) || 'Description: ' || text"),
    "src_unknown_content": sql("bin2", "vcard", "'Name: ' || extraction_id"),
    "src_formats": "SELECT coalesce(format, 'unknown') AS format, count(*) AS n, count(DISTINCT path) AS n_paths FROM extractions GROUP BY 1",
    "blocked_paths": "SELECT DISTINCT extraction_id FROM extractions WHERE path IS NOT NULL AND extraction_id % 3 = 0",
}
REDACTED = "CASE WHEN strlen(matched_text) <= 8 THEN repeat('*', strlen(matched_text)) ELSE left(matched_text, 3) || repeat('*', greatest(length(matched_text) - 6, 0)) || right(matched_text, 3) END"
STORED = f"(SELECT id, any_value(category) AS category, any_value(sub_category) AS sub_category, any_value({REDACTED}) AS t, any_value(round(confidence::DOUBLE, 4)) AS c FROM findings GROUP BY id)"
FIELD = "CASE WHEN regexp_matches({v}, '[,\"\\n\\r]|^[=+@-]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"
QUOTED = "'\"' || replace(replace({v}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
CSV = ", ".join(FIELD.format(v=f"coalesce({v}, '')") for v in ("id", "category", "sub_category", "t", "printf('%.2f', c)"))
MEMBERS = " || ".join(f"CASE WHEN {v} IS NULL THEN '' ELSE ',\"{k}\":' || {e} END" for k, v, e in (("category", "category", QUOTED.format(v="category")), ("sub_category", "sub_category", QUOTED.format(v="sub_category")), ("text", "t", QUOTED.format(v="t")), ("confidence", "c", "c::VARCHAR")))
SQL |= {
    "sink_csv_lines": f"SELECT concat_ws(',', {CSV}) AS line, count(*) AS n FROM {STORED} GROUP BY 1",
    "sink_events": f"SELECT '{{\"source\":\"answers\",\"host\":\"spark\"' || {MEMBERS} || '}}' AS event, count(*) AS n FROM {STORED} GROUP BY 1",
}
NAMES: list[str] = []


def queries() -> dict:
    return {name: globals()[name] for name in [*NAMES, *SQL]}


def oracle_sql() -> dict[str, str]:
    return SQL
