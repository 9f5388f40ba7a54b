"""Queries of enriching joins with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.catalog.patterns import Pattern
from veilframe.functions import text as T
from veilframe.operators import enrich, scan
from veilframe.plans.engine_queries import answers
from veilframe.plans.enrich_sql import hmac_sql
from veilframe.session import cut, table

WORDS = ["mobile", "call", "identity", "reach", "caller", "records"]
PHONE = r"\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
KEY = b"registry"


def docs(s, d):
    return table(s, d, "scan_results").dropDuplicates(["result_id"]).select(F.col("result_id").alias("doc_id"), "text")


def words(s):
    return s.createDataFrame([(w,) for w in WORDS], "keyword string")


def keyword_hits(s, d):
    return enrich.keyword_hits(docs(s, d), words(s))


def keyword_prefilter(s, d):
    """Texts in which a gated pattern has to run: they hold one of its keywords."""
    return docs(s, d).join(enrich.keyword_hits(docs(s, d), words(s)).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")


def context_window(s, d):
    return enrich.with_context(enrich.matches_of(docs(s, d), PHONE), enrich.keyword_hits(docs(s, d), words(s)), 20)


def card_prefix(s, d):
    found = s.createDataFrame([], "category string, text string, confidence double")
    orders = table(s, d, "orders").select(F.lit("Credit Card Numbers").alias("category"), F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "1")).alias("text"), F.lit(0.98).alias("confidence"))
    prefixes = s.createDataFrame([(411111, "Visa", "credit", "US", "A"), (411112, "Visa", "debit", "DE", "B")], "bin int, brand string, card_type string, country string, issuer string")
    return enrich.with_card_prefix(found.union(orders), prefixes).groupBy("brand", "country", F.round("confidence", 2).alias("confidence")).agg(F.count("*").alias("n"))


def edm_register(s, d):
    values = table(s, d, "customer").select(F.lit("customer").alias("category"), F.col("c_name").alias("value"))
    return enrich.register_values(None, values, KEY)


ADDRESS = r"[0-9][0-9 ./-]{3,18}[0-9]|[\w.+-]+@[\w-]+\.[\w.-]+"


def edm_matches(s, d):
    """Addresses and numbers of all extracted files, registered and looked for in the answers."""
    values = table(s, d, "extractions").select(F.lit("seen in files").alias("category"), F.explode(F.regexp_extract_all("text", F.lit(f"({ADDRESS})"))).alias("value"))
    return enrich.exact_matches(docs(s, d), enrich.register_values(None, values, KEY), KEY, ADDRESS)


def custom_patterns(s, d):
    mine = [Pattern(1, "Tickets", "Ticket", r"(?:INC|REQ|CHG|DLP|CASE)-[0-9]{6}", 0.8, True, False, (), 50), Pattern(2, "Tickets", "Held file", r"/(?:srv|data|mnt|share)/hold/[0-9]+", 0.6, True, True, ("moved", "hold"), 40)]
    found = enrich.custom_pattern_findings(table(s, d, "documents"), mine)
    return found.groupBy("sub_category", "has_context").agg(F.count("*").alias("n"), F.countDistinct("match").alias("n_values"))


def recall_by_sub(s, d):
    """How much of the old scanner's findings the scan meets, by sub-category."""
    old = table(s, d, "scan_results").dropDuplicates(["result_id"]).select(F.col("result_id").alias("doc_id"), F.explode("findings").alias("f")).select("doc_id", "f.sub_category", "f.text")
    return enrich.recall(old, cut(scan.scan(answers(s, d))))


HOSTS = r"www[.][a-z0-9.-]*[a-z0-9]|(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"


def url_safety(s, d):
    """Hosts and addresses that the documents name, as addresses of pages."""
    found = table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({HOSTS})"))).alias("host")).distinct()
    return found.select("host", enrich.url_is_safe(F.concat(F.lit("https://"), "host", F.lit("/a?b=c"))).alias("safe"))


def close_words(s, d):
    w = table(s, d, "documents").select(F.explode(F.array_distinct(T.words(F.regexp_replace("text", "[^A-Za-z]+", " ")))).alias("word")).where("length(word) between 4 and 12").distinct()
    vocabulary = s.createDataFrame([(x,) for x in ("labels", "records", "bridge", "scanned", "office", "reader", "masked")], "entry string")
    return enrich.close_words(w, vocabulary, 1)


def wire_keys(s, d):
    f = table(s, d, "findings").select(F.concat_ws("/", "category", "sub_category").alias("key")).where("key <> ''").distinct()
    return f.select("key", F.split("key", "/", 2)[0].alias("category"), F.try_element_at(F.split("key", "/", 2), F.lit(2)).alias("sub_category"))


def iso_times(s, d):
    return table(s, d, "scans").dropDuplicates(["id"]).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


E1 = "(SELECT result_id AS doc_id, any_value(text) AS text FROM scan_results GROUP BY 1)"
SHAPE = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
PLACES = "list_transform(range(1, len(h) + 1), lambda i: {{'m': h[i], 'pos': coalesce(list_sum(list_transform(list_slice(b, 1, i), lambda x: length(x))), 0)::INT + coalesce(list_sum(list_transform(list_slice(h, 1, i - 1), lambda x: length(x))), 0)::INT}})"


def places(col: str, shape: str, table_: str) -> str:
    return f"(SELECT doc_id, unnest({PLACES.replace('{{', '{').replace('}}', '}')}) AS p FROM (SELECT doc_id, regexp_extract_all({col}, '{shape}') AS h, regexp_split_to_array({col}, '{shape}') AS b FROM {table_}) WHERE len(h) > 0)"


CLEAN = "regexp_replace(trim(lower({v})), '[\\s\\-./()]+', '', 'g')"

SQL = {
    "edm_register": f"SELECT DISTINCT 'customer' AS category, {hmac_sql(CLEAN.format(v='c_name'), KEY)} AS digest FROM customer WHERE c_name IS NOT NULL",
    "edm_matches": f"WITH held AS (SELECT DISTINCT {CLEAN.format(v='v')} AS k FROM (SELECT unnest(regexp_extract_all(text, '{ADDRESS}')) AS v FROM extractions)), m AS (SELECT doc_id, p.m AS match, p.pos AS start, p.pos + length(p.m)::INT AS \"end\" FROM {places('text', ADDRESS, E1)}) SELECT doc_id, 'EDM: seen in files' AS category, match, start, \"end\" FROM m WHERE {CLEAN.format(v='match')} IN (SELECT k FROM held)",
    "keyword_hits": f"SELECT doc_id, p.m AS keyword, p.pos AS pos FROM {places('lower(text)', SHAPE, E1)}",
    "keyword_prefilter": f"SELECT doc_id FROM {E1} WHERE regexp_matches(lower(text), '{SHAPE}')",
    "context_window": f"WITH k AS (SELECT doc_id, p.pos AS pos FROM {places('lower(text)', SHAPE, E1)}), m AS (SELECT doc_id, p.m AS match, p.pos AS start, p.pos + length(p.m)::INT AS \"end\" FROM {places('text', PHONE, E1)}) SELECT doc_id, match, start, \"end\", EXISTS (SELECT 1 FROM k WHERE k.doc_id = m.doc_id AND k.pos >= m.start - 20 AND k.pos < m.\"end\" + 20) AS has_context FROM m",
    "card_prefix": "WITH o AS (SELECT substr('4' || lpad(o_orderkey::VARCHAR, 15, '1'), 1, 6) AS b FROM orders) SELECT CASE WHEN b IN ('411111', '411112') THEN 'Visa' END AS brand, CASE b WHEN '411111' THEN 'US' WHEN '411112' THEN 'DE' END AS country, CASE WHEN b IN ('411111', '411112') THEN 1.0 ELSE 0.98 END::DOUBLE AS confidence, count(*) AS n FROM o GROUP BY 1, 2, 3",
    "custom_patterns": "WITH t AS (SELECT unnest(regexp_extract_all(text, '(?:INC|REQ|CHG|DLP|CASE)-[0-9]{6}')) AS m FROM documents), h AS (SELECT unnest(regexp_extract_all(text, '/(?:srv|data|mnt|share)/hold/[0-9]+')) AS m FROM documents) SELECT 'Ticket' AS sub_category, false AS has_context, count(*) AS n, count(DISTINCT m) AS n_values FROM t UNION ALL SELECT 'Held file', true, count(*), count(DISTINCT m) FROM h",
    "url_safety": f"WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{HOSTS}')) AS host FROM documents), p AS (SELECT host, try_cast(split_part(host, '.', 1) AS int) AS a, try_cast(split_part(host, '.', 2) AS int) AS b, try_cast(split_part(host, '.', 3) AS int) AS c, try_cast(split_part(host, '.', 4) AS int) AS e FROM h) SELECT host, host LIKE 'www%' OR coalesce(greatest(a, b, c, e) <= 255 AND a NOT IN (0, 10, 127) AND a < 224 AND NOT (a = 100 AND b BETWEEN 64 AND 127) AND NOT (a = 169 AND b = 254) AND NOT (a = 172 AND b BETWEEN 16 AND 31) AND NOT (a = 192 AND b = 168) AND NOT (a = 192 AND b = 0 AND c IN (0, 2)) AND NOT (a = 198 AND b IN (18, 19)) AND NOT (a = 198 AND b = 51 AND c = 100) AND NOT (a = 203 AND b = 0 AND c = 113), false) AS safe FROM p",
    "close_words": "WITH w AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS word FROM documents), v AS (SELECT unnest(['labels', 'records', 'bridge', 'scanned', 'office', 'reader', 'masked']) AS entry) SELECT word, entry, levenshtein(word, entry)::INT AS distance FROM w JOIN v ON levenshtein(word, entry) <= 1 WHERE length(word) BETWEEN 4 AND 12",
    "wire_keys": "SELECT DISTINCT concat_ws('/', category, sub_category) AS key, split_part(concat_ws('/', category, sub_category), '/', 1) AS category, CASE WHEN contains(concat_ws('/', category, sub_category), '/') THEN substr(concat_ws('/', category, sub_category), strpos(concat_ws('/', category, sub_category), '/') + 1) END AS sub_category FROM findings WHERE category IS NOT NULL OR sub_category IS NOT NULL",
    "iso_times": "SELECT id, strftime(make_timestamp(any_value(epoch_us(created_at))), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM scans GROUP BY id",
}
NAMES = ["recall_by_sub"]


def queries() -> dict:
    return {name: globals()[name] for name in [*NAMES, *SQL]}


def oracle_sql() -> dict[str, str]:
    return SQL
