"""Queries of text projections over whole tables with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.functions import validators as V
from veilframe.session import table

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
TOKEN = r"[A-Za-z0-9_/+.-]{12,64}"
SQL_EMAIL = EMAIL


def extractions(s, d):
    return table(s, d, "extractions").dropDuplicates(["extraction_id"])


def email_candidates(s, d):
    return extractions(s, d).select("extraction_id", F.explode(F.regexp_extract_all("text", F.lit(f"({EMAIL})"))).alias("candidate"))


def email_valid(s, d):
    return email_candidates(s, d).where(V.email(F.col("candidate"))).groupBy(F.lower(F.substring_index("candidate", "@", -1)).alias("domain")).agg(F.count("*").alias("n"))


def ipv4_public(s, d):
    c = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"((?:[0-9]{1,3}\.){3}[0-9]{1,3})"))).alias("candidate"))
    return c.withColumn("public", V.ipv4(F.col("candidate")))


def norm_rot13(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.rot13(F.col("text"))).alias("digest"))


def norm_leet(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.unleet(F.col("text"))).alias("digest"))


def norm_spaces(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.plain_spaces(F.col("text"))).alias("digest"))


def norm_zero_width(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.strip_zero_width(F.col("text"))).alias("digest"))


def norm_comments(s, d):
    broken = F.regexp_replace("text", " ", "/**/")
    return extractions(s, d).select("extraction_id", F.md5(T.strip_empty_comments(broken)).alias("digest"))


def tag_strip(s, d):
    html = F.concat(F.lit("<p>"), F.replace("text", F.lit(". "), F.lit(".</p> <p class='x'>")), F.lit("</p>"))
    return extractions(s, d).select("extraction_id", F.md5(T.strip_tags(html)).alias("digest"))


def redact_mask(s, d):
    f = table(s, d, "extractions").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word rlike '^[A-Za-z0-9@.-]+$'").distinct()
    return f.select("word", T.redacted(F.col("word")).alias("redacted"), T.masked(F.col("word")).alias("masked"))


def text_truncate(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.truncated(F.col("text"))).alias("digest"))


def csv_fields(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.csv_field(F.col("text"))).alias("digest"))


def html_escape(s, d):
    return extractions(s, d).select("extraction_id", F.md5(T.html_escape(F.col("text"))).alias("digest"))


def char_entropy(s, d):
    words = table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"))).alias("token")).distinct()
    return words.select("token", F.round(T.char_entropy(F.col("token")), 6).alias("bits"))


def high_entropy_tokens(s, d):
    words = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({TOKEN})"))).alias("token"))
    return words.where(~F.col("token").rlike("^[0-9.-]+$") & ~F.col("token").rlike("^[a-z]+$") & (T.char_entropy(F.col("token")) >= 3.9)).groupBy("token").agg(F.countDistinct("doc_id").alias("n_docs"))


def word_ngrams(s, d):
    grams = table(s, d, "eval_items").select(F.explode(F.concat(*[T.ngrams(T.words(F.col("text")), n) for n in (1, 2, 3)])).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def shingles(s, d):
    w = table(s, d, "eval_items").select("item_id", F.array_distinct(T.ngrams(T.words(F.col("text")), 3)).alias("runs"))
    return w.select("item_id", F.size("runs").alias("n_runs"))


def jaccard_pairs(s, d):
    """Items that share word runs, joined on the runs."""
    runs = table(s, d, "eval_items").select("item_id", F.explode(F.array_distinct(T.ngrams(T.words(F.col("text")), 3))).alias("run"))
    sizes = runs.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = runs.alias("a").join(runs.alias("b"), F.col("a.run") == F.col("b.run")).where("a.item_id < b.item_id").groupBy(F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b")).agg(F.count("*").alias("common"))
    joined = shared.join(sizes.select(F.col("item_id").alias("item_a"), F.col("n").alias("na")), "item_a").join(sizes.select(F.col("item_id").alias("item_b"), F.col("n").alias("nb")), "item_b")
    return joined.select("item_a", "item_b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


KEY = b"round-trip-secret"


def tokenize_hmac(s, d):
    mails = email_candidates(s, d).select("candidate").distinct()
    return mails.select("candidate", F.concat(F.lit("TOK_"), T.initials(F.lit("Contact Information")), F.lit("_"), F.left(T.hmac_sha256(F.col("candidate"), KEY), F.lit(32))).alias("token"))


NUMERIC = r"[0-9][0-9./-]{5,18}[0-9]"


def edm_scan(s, d):
    """Exact matches by keyed hash: numbers of the scan answers that are registered from the documents."""
    norm = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"[\s./()-]+", "")
    registered = table(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({NUMERIC})"))).alias("value")).select(T.hmac_sha256(norm(F.col("value")), KEY).alias("digest")).distinct()
    tokens = table(s, d, "scan_results").dropDuplicates(["result_id"]).select("result_id", F.explode(F.regexp_extract_all("text", F.lit(f"({NUMERIC})"))).alias("token"))
    return tokens.withColumn("digest", T.hmac_sha256(norm(F.col("token")), KEY)).join(registered, "digest", "left_semi").select("result_id", "token").distinct()


def signature_jaccard(s, d):
    """Share of equal signature values between re-registrations of one vault entry."""
    e = table(s, d, "document_entries").where("signature is not null").select("doc_id", "signature", F.unix_micros("registered_at").alias("at"))
    pairs = e.alias("a").join(e.alias("b"), "doc_id").where("a.at < b.at")
    same = F.aggregate(F.zip_with("a.signature", "b.signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return pairs.select("doc_id", (same / 128.0).alias("similarity")).groupBy("doc_id").agg(F.max("similarity").alias("similarity"))


Z = "".join(T.ZERO_WIDTH)
E1 = "(SELECT extraction_id, any_value(text) AS text FROM extractions GROUP BY 1)"
UL = T.UPPER + T.LOWER
ROT = T.UPPER[13:] + T.UPPER[:13] + T.LOWER[13:] + T.LOWER[:13]
ENTROPY = "list_sum(list_transform(list_distinct(string_split(token, '')), lambda x: -((length(token) - length(replace(token, x, ''))) / length(token)) * log2((length(token) - length(replace(token, x, ''))) / length(token))))"
INNER, OUTER = ("".join(f"\\x{b ^ k:02X}" for b in KEY.ljust(64, b"\0")) for k in (0x36, 0x5C))


def duck_hmac(v: str) -> str:
    return f"sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode({v}))))"


WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


def grams(n: int) -> str:
    return f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))"


SQL = {
    "email_candidates": f"SELECT extraction_id, unnest(regexp_extract_all(text, '{SQL_EMAIL}')) AS candidate FROM {E1}",
    "email_valid": f"WITH c AS (SELECT unnest(regexp_extract_all(text, '{SQL_EMAIL}')) AS candidate FROM {E1}), p AS (SELECT candidate, split_part(candidate, '@', 1) AS l, lower(split_part(candidate, '@', 2)) AS h FROM c) "
    f"SELECT h AS domain, count(*) AS n FROM p WHERE length(l) <= 64 AND NOT contains(l, '..') AND right(l, 1) <> '.' AND NOT regexp_matches(h, '(^|[.])-|-([.]|$)') AND (regexp_full_match(split_part(h, '.', -1), '[a-z]{{2}}') OR split_part(h, '.', -1) IN {tuple(V.LONG_TLDS)}) GROUP BY 1",
    "ipv4_public": "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:[0-9]{1,3}[.]){3}[0-9]{1,3}')) AS candidate FROM documents), p AS (SELECT *, list_transform(string_split(candidate, '.'), lambda x: cast(x AS int)) AS o FROM c) "
    "SELECT doc_id, candidate, list_max(o) <= 255 AND NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) AS public FROM p",
    "norm_rot13": f"SELECT extraction_id, md5(translate(text, '{UL}', '{ROT}')) AS digest FROM {E1}",
    "norm_leet": f"SELECT extraction_id, md5(translate(text, '{T.LEET_FROM}', '{T.LEET_TO}')) AS digest FROM {E1}",
    "norm_spaces": f"SELECT extraction_id, md5(regexp_replace(text, '[{T.SPACES}]', ' ', 'g')) AS digest FROM {E1}",
    "norm_zero_width": f"SELECT extraction_id, md5(regexp_replace(text, '[{Z}]', '', 'g')) AS digest FROM {E1}",
    "norm_comments": f"SELECT extraction_id, md5(replace(text, ' ', '')) AS digest FROM {E1}",
    "tag_strip": f"SELECT extraction_id, md5(trim(regexp_replace(regexp_replace('<p>' || replace(text, '. ', '.</p> <p class=''x''>') || '</p>', '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS digest FROM {E1}",
    "redact_mask": "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS word FROM extractions) SELECT word, CASE WHEN strlen(word) <= 8 THEN repeat('*', strlen(word)) ELSE left(word, 3) || repeat('*', length(word) - 6) || right(word, 3) END AS redacted, repeat('*', length(word)) AS masked FROM w WHERE regexp_full_match(word, '[A-Za-z0-9@.-]+')",
    "text_truncate": f"SELECT extraction_id, md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS digest FROM {E1}",
    "csv_fields": f"SELECT extraction_id, md5(CASE WHEN regexp_matches(text, '[,\"\\n\\r]|^[=+@-]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END) AS digest FROM {E1}",
    "html_escape": f"SELECT extraction_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM {E1}",
    "char_entropy": f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) SELECT token, round({ENTROPY}, 6) AS bits FROM w",
    "high_entropy_tokens": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS n_docs FROM w WHERE NOT regexp_full_match(token, '[0-9.-]+') AND NOT regexp_full_match(token, '[a-z]+') AND round({ENTROPY}, 9) >= 3.9 GROUP BY 1",
    "word_ngrams": f"WITH t AS (SELECT {WORDS} AS w FROM eval_items), g AS (SELECT unnest(list_concat({grams(1)}, list_concat({grams(2)}, {grams(3)}))) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "shingles": f"WITH t AS (SELECT item_id, {WORDS} AS w FROM eval_items) SELECT item_id, len(list_distinct({grams(3)})) AS n_runs FROM t",
    "jaccard_pairs": f"WITH t AS (SELECT item_id, {WORDS} AS w FROM eval_items), r AS (SELECT DISTINCT item_id, unnest({grams(3)}) AS run FROM t), n AS (SELECT item_id, count(*) AS n FROM r GROUP BY 1), c AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS common FROM r a JOIN r b ON a.run = b.run AND a.item_id < b.item_id GROUP BY 1, 2) SELECT item_a, item_b, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN n x ON x.item_id = item_a JOIN n y ON y.item_id = item_b",
    "tokenize_hmac": f"WITH c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{SQL_EMAIL}')) AS candidate FROM extractions) SELECT candidate, 'TOK_CI_' || left({duck_hmac('candidate')}, 32) AS token FROM c",
    "edm_scan": f"WITH reg AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '{NUMERIC}')), '[./()-]+', '', 'g') AS k FROM documents), t AS (SELECT DISTINCT result_id, unnest(regexp_extract_all(text, '{NUMERIC}')) AS token FROM scan_results) SELECT result_id, token FROM t WHERE regexp_replace(token, '[./()-]+', '', 'g') IN (SELECT k FROM reg)",
    "signature_jaccard": "WITH e AS (SELECT doc_id, signature, epoch_us(registered_at) AS at FROM document_entries WHERE signature IS NOT NULL) SELECT a.doc_id, max(len(list_filter(range(1, 129), lambda i: a.signature[i] = b.signature[i])) / 128.0::DOUBLE) AS similarity FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.at < b.at GROUP BY 1",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
