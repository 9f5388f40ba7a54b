"""Scans whose findings plain SQL can state as well: addresses and national numbers of whole tables.

The oracle undoes width, invisible characters and separators by its own expressions, takes the tokens of the
result and checks them digit by digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import protect, scan
from veilframe.session import table

SOURCES = {"answers": ("scan_results", "result_id"), "extractions": ("extractions", "extraction_id")}
NUMBERS = {"Poland PESEL": "Europe - Poland", "France NIR": "Europe - France", "Netherlands BSN": "Europe - Netherlands", "Spain DNI": "Europe - Spain"}


def texts(s: SparkSession, d: str, source: str) -> DataFrame:
    name, key = SOURCES[source]
    return table(s, d, name).dropDuplicates([key]).select(F.col(key).alias("doc_id"), "text")


def plain(c):
    """The finding with usual width, without separators and in lower case."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.lower(F.regexp_replace(F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F)))), r"[­​-‏⁠﻿]", ""))


def emails(source: str):
    def run(s, d):
        found = scan.scan(texts(s, d, source), scan.ScanConfig(categories=frozenset(["Contact Information"]), alternative_bytes=0))
        return found.where("sub_category = 'Email Address'").select("doc_id", plain(F.col("text")).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))

    return run


def numbers(source: str):
    def run(s, d):
        found = scan.scan(texts(s, d, source), scan.ScanConfig(categories=frozenset(NUMBERS.values()), alternative_bytes=0))
        found = found.where(F.col("sub_category").isin(list(NUMBERS)))
        return found.select("doc_id", "sub_category", F.regexp_replace(plain(F.col("text")), "[^0-9a-z]", "").alias("value"), "specificity").distinct()

    return run


def email_redaction(s: SparkSession, d: str) -> DataFrame:
    """Texts of the answers with their addresses struck out byte by byte."""
    docs = texts(s, d, "answers").where("text is not null")
    found = scan.scan(docs, scan.ScanConfig(categories=frozenset(["Contact Information"]), alternative_bytes=0)).where("sub_category = 'Email Address'")
    return protect.guard(docs, found).select("doc_id", "is_clean", F.octet_length("redacted_text").cast("bigint").alias("n_bytes"), F.size(F.regexp_extract_all("redacted_text", F.lit("X{6,}"), 0)).alias("struck"))


# ---------------------------------------------------------------------------------------------- oracles
TLDS = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel asia cat post app dev cloud online site tech store blog xyz shop agency email example test invalid"
WIDTH = """array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '[\\x{AD}\\x{34F}\\x{61C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FE00}-\\x{FE0F}\\x{FEFF}]', '', 'g'), '[\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g'), ''),
 lambda c: CASE WHEN c = '' THEN '' WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), '')"""
HOMOGLYPHS = "translate({t}, 'АВЕЅІЈКМНОРСТУХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧοκνρɡԁһ', 'ABESIJKMHOPCTYXaesijopcyxABEZHIKMNOPTYXokvpgdh')"


def source_sql(source: str) -> str:
    name, key = SOURCES[source]
    return f"(SELECT doc_id, {HOMOGLYPHS.format(t='t')} AS t FROM (SELECT doc_id, {WIDTH} AS t FROM (SELECT {key} AS doc_id, any_value(text) AS text FROM {name} WHERE text IS NOT NULL GROUP BY 1)))"


def email_sql(source: str) -> str:
    return f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\b[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,24}}\\b')) AS v FROM {source_sql(source)}),
p AS (SELECT doc_id, lower(v) AS value, split_part(v, '@', 1) AS local, split_part(v, '@', 2) AS host, lower(string_split(v, '.')[-1]) AS tld FROM m)
SELECT doc_id, value, count(*) AS n FROM p
WHERE local NOT LIKE '%..%' AND local NOT LIKE '%.' AND NOT regexp_matches(host, '(^|[.])-|-([.]|$)') AND (length(tld) = 2 OR tld IN (SELECT unnest(string_split('{TLDS}', ' ')))) GROUP BY 1, 2"""


def weighted(weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * cast(substr(v, {i}, 1) AS int)" for i, w in enumerate(weights, 1)) + ")"


def number_sql(source: str) -> str:
    joined = "regexp_replace(regexp_replace(t, '([^A-Za-z\\s])\\s+([^A-Za-z\\s])', '\\1\\2', 'g'), '([^A-Za-z\\s])\\s+([^A-Za-z\\s])', '\\1\\2', 'g')"
    between = "regexp_replace(regexp_replace({t}, '([0-9A-Z])[-/\\\\_]([0-9A-Za-z])', '\\1\\2', 'g'), '([0-9A-Za-z])[-/\\\\_]([0-9A-Z])', '\\1\\2', 'g')"
    between = between.format(t=between.format(t="t"))
    same = "length(replace(v, substr(v, 1, 1), '')) = 0"
    check = {
        "Poland PESEL": f"length(v) = 11 AND regexp_full_match(v, '[0-9]+') AND cast(substr(v, 3, 2) AS int) % 20 BETWEEN 1 AND 12 AND cast(substr(v, 5, 2) AS int) BETWEEN 1 AND 31 AND {weighted([1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1])} % 10 = 0",
        "Netherlands BSN": f"length(v) = 9 AND regexp_full_match(v, '[0-9]+') AND {weighted([9, 8, 7, 6, 5, 4, 3, 2, -1])} >= 0 AND {weighted([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0",
        "France NIR": "regexp_full_match(v, '[12][0-9]{4}([0-9]{2}|2[AB])[0-9]{8}') AND 97 - cast(replace(replace(substr(v, 1, 13), '2A', '19'), '2B', '18') AS bigint) % 97 = cast(substr(v, 14, 2) AS int)",
        "Spain DNI": "regexp_full_match(v, '[0-9]{8}[A-Z]') AND substr('TRWAGMYFPDXBNJZSQVHLCKE', 1 + cast(substr(v, 1, 8) AS int) % 23, 1) = substr(v, 9, 1)",
    }
    parts = " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{name}' AS sub_category, lower(v) AS value, 0.65::DOUBLE AS specificity FROM w WHERE CASE WHEN regexp_full_match(v, '[0-9A-Z]{{9,15}}') AND regexp_matches(v, '^[0-9]{{8}}|^[12]') THEN try({rule}) ELSE false END" for name, rule in check.items())
    return f"""
WITH a AS (SELECT doc_id, {joined} AS t FROM {source_sql(source)}),
b AS (SELECT doc_id, {between} AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9.])([0-9]{{1,6}})[.]([0-9]{{1,6}})[.]([0-9]{{1,6}})[.]([0-9]{{4,6}})($|[^0-9.])', '\\1\\2\\3\\4\\5\\6', 'g'), '(^|[^0-9.])([0-9]{{1,6}})[.]([0-9]{{1,6}})[.]([0-9]{{1,6}})($|[^0-9.]|[.]($|[^0-9]))', '\\1\\2\\3\\4\\5', 'g') AS t FROM b),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS v FROM c)
{parts}"""


QUERIES = {f"scan_emails_{x}": (emails(x), email_sql(x)) for x in SOURCES} | {f"scan_numbers_{x}": (numbers(x), number_sql(x)) for x in SOURCES}


QUERIES["guard_emails"] = (
    email_redaction,
    f"""WITH t AS (SELECT result_id AS doc_id, any_value(text) AS text FROM scan_results WHERE text IS NOT NULL GROUP BY 1), f AS (SELECT doc_id, sum(n)::INT AS n FROM ({email_sql("answers")}) GROUP BY 1)
SELECT doc_id, n IS NULL AS is_clean, strlen(text) AS n_bytes, coalesce(n, 0) + len(regexp_extract_all(text, 'X{{6,}}')) AS struck FROM t LEFT JOIN f USING (doc_id)""",
)


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: o for name, (_, o) in QUERIES.items()}
