"""Joins that enrich or narrow findings: keyword proximity, card prefixes, exact-value registries, custom patterns, quality."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.catalog.patterns import Pattern
from veilframe.functions import text as T


def keyword_hits(documents: DataFrame, keywords: DataFrame, doc_id: str = "doc_id", column: str = "text", most: int = 20_000) -> DataFrame:
    """(doc_id, keyword, pos): every occurrence of the keywords in the lower-cased text, places in characters from 0.

    ``keywords`` is a dimension; one alternation, longest first, finds all of them. More than ``most`` raise an error.
    """
    rows = keywords.select("keyword").where("keyword <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("more keywords than an alternation can hold")
    words = sorted((r[0].lower() for r in rows), key=lambda w: (-len(w), w))
    shape = "(" + "|".join(re.escape(w) for w in words) + ")" if words else "(?!)"
    low = documents.select(F.col(doc_id).alias("doc_id"), F.lower(column).alias("low"))
    parts = low.select("doc_id", F.split("low", shape, -1).alias("between"), F.regexp_extract_all("low", F.lit(shape)).alias("hits")).where(F.size("hits") > 0)
    places = F.transform("hits", lambda h, i: F.struct(h.alias("keyword"), (F.aggregate(F.slice("between", 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("hits", 1, i), F.lit(0), lambda s, x: s + F.length(x))).alias("pos")))
    return parts.select("doc_id", F.explode(places).alias("h")).select("doc_id", "h.keyword", "h.pos")


def matches_of(documents: DataFrame, regex: str, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, match, start, end) of one expression, natively: places from the lengths of what lies between."""
    parts = documents.select(F.col(doc_id).alias("doc_id"), F.split(column, regex, -1).alias("between"), F.regexp_extract_all(column, F.lit(f"({regex})")).alias("hits")).where(F.size("hits") > 0)
    places = F.transform("hits", lambda h, i: F.struct(h.alias("match"), (F.aggregate(F.slice("between", 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("hits", 1, i), F.lit(0), lambda s, x: s + F.length(x))).alias("start")))
    return parts.select("doc_id", F.explode(places).alias("h")).select("doc_id", "h.match", "h.start", (F.col("h.start") + F.length("h.match")).alias("end"))


def with_context(matches: DataFrame, hits: DataFrame, distance: int) -> DataFrame:
    """``matches`` with ``has_context``: a keyword begins in [start - distance, end + distance).

    A band join inside each document: hits are gathered per document once and tested by a higher-order function, so
    no pairs are built.
    """
    per_doc = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    near = F.exists("positions", lambda p: (p >= F.col("start") - distance) & (p < F.col("end") + distance))
    return matches.join(per_doc, "doc_id", "left").withColumn("has_context", F.coalesce(near, F.lit(False))).drop("positions")


def with_card_prefix(findings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Card findings with brand, type, country and issuer of their first six digits; a known prefix adds 0.05, at most 1.

    ``prefixes`` (bin INT, brand, card_type, country, issuer) is joined by equality; its size decides the join.
    """
    key = F.substring(F.regexp_replace("text", "[^0-9]", ""), 1, 6).try_cast("int")
    joined = findings.withColumn("bin", F.when(F.col("category") == "Credit Card Numbers", key)).join(prefixes, "bin", "left")
    return joined.withColumn("confidence", F.when(F.col("brand").isNotNull(), F.least(F.col("confidence") + 0.05, F.lit(1.0))).otherwise(F.col("confidence")))


def known_prefixes(values: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Numbers (``value``) whose first six digits are a known prefix: a semi-join."""
    return values.withColumn("bin", F.substring(F.regexp_replace("value", "[^0-9]", ""), 1, 6).try_cast("int")).join(prefixes.select("bin"), "bin", "left_semi").drop("bin")


def try_pattern(documents: DataFrame, regex: str, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """What an expression would find: (match, n, n_documents), before it becomes part of a catalogue."""
    found = matches_of(documents, regex, doc_id, column)
    return found.groupBy("match").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@F.pandas_udf(StringType())
def compatible(values: pd.Series) -> pd.Series:
    """NFKC of values beyond ASCII, which no built-in function gives."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def save_registry(registry: DataFrame, path: str) -> None:
    """Writes a registry of digests, split by category so that removing one rewrites nothing else."""
    registry.write.mode("overwrite").partitionBy("category").parquet(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, category string").parquet(path).select("category", "digest")


def registry_sizes(registry: DataFrame) -> DataFrame:
    """(category, n) of a registry."""
    return registry.groupBy("category").agg(F.count("*").alias("n"))


def registered(values: DataFrame, registry: DataFrame, key: bytes) -> DataFrame:
    """``values`` (category, value) that are registered: a semi-join on the digest."""
    return values.withColumn("digest", exact_key(F.col("value"), key)).join(registry, ["category", "digest"], "left_semi").drop("digest")


def exact_key(value: Column, key: bytes) -> Column:
    """Keyed digest of a value: compatibility form, lower case, trimmed, without blanks and separators."""
    plain = F.when(value.rlike(r"^[\x00-\x7f]*$"), value).otherwise(compatible(value))
    return T.hmac_sha256(F.regexp_replace(F.trim(F.lower(plain)), r"[\s\-./()]+", ""), key)


def register_values(registry: DataFrame | None, values: DataFrame, key: bytes) -> DataFrame:
    """(category, digest) with the values added, each once."""
    new = values.where("value is not null").select("category", exact_key(F.col("value"), key).alias("digest"))
    return (new if registry is None else registry.union(new)).distinct()


def remove_category(registry: DataFrame, category: str) -> DataFrame:
    return registry.where(F.col("category") != category)


def exact_matches(documents: DataFrame, registry: DataFrame, key: bytes, shape: str = r"[0-9][0-9 ./-]{3,18}[0-9]|[\w.+-]+@[\w-]+\.[\w.-]+", doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, category, match, start, end) of registered values among the tokens of a text; one row per token and category."""
    tokens = matches_of(documents, shape, doc_id, column).withColumn("digest", exact_key(F.col("match"), key))
    return tokens.join(registry, "digest").select("doc_id", F.concat(F.lit("EDM: "), "category").alias("category"), "match", "start", "end")


def custom_pattern_findings(documents: DataFrame, patterns: list[Pattern], doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """Findings of runtime patterns on the original text, with keywords near by and without validator."""
    spark = documents.sparkSession
    out = None
    for p in patterns:
        found = matches_of(documents, p.regex, doc_id, column)
        if p.keywords:
            words = spark.createDataFrame([(k,) for k in p.keywords], "keyword string")
            found = with_context(found, keyword_hits(documents, words, doc_id, column), p.distance)
        else:
            found = found.withColumn("has_context", F.lit(False))
        found = found.where(F.col("has_context") | F.lit(not p.context_required)).select("doc_id", F.lit(p.category).alias("category"), F.lit(p.sub_category).alias("sub_category"), "match", "start", "end", "has_context")
        out = found if out is None else out.union(found)
    return out


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(sub_category, n_expected, n_met): an expected text is met by a finding of its kind in the same document that holds it.

    ``expected`` and ``found``: doc_id, sub_category, text.
    """
    e = expected.select("doc_id", "sub_category", F.col("text").alias("wanted")).distinct()
    f = found.select("doc_id", "sub_category", F.col("text").alias("got"))
    met = e.join(f, ["doc_id", "sub_category"], "left").groupBy("doc_id", "sub_category", "wanted").agg(F.coalesce(F.bool_or(F.col("got").contains(F.col("wanted"))), F.lit(False)).alias("met"))
    return met.groupBy("sub_category").agg(F.count("*").alias("n_expected"), F.count_if("met").alias("n_met"))


def url_is_safe(url: Column) -> Column:
    """http(s) to a host that isn't local, private or a bare number."""
    from veilframe.functions.validators import ipv4

    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]+)", 1))
    numeric = host.rlike(r"^[0-9.]+$")
    local = host.isin("localhost", "metadata.google.internal", "") | host.endswith(".local") | host.endswith(".internal") | host.endswith(".localhost") | host.startswith("[")
    return F.coalesce(url.rlike("^https?://"), F.lit(False)) & ~local & (~numeric | ipv4(host))


def close_words(words: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """(word, entry, distance): vocabulary entries within an edit distance of ``most``.

    Both sides are joined on what is left of them after deleting up to ``most`` characters: words within that
    distance always share such a rest, so nothing is lost, and no pairs of all words are built.
    """

    def keys(c: Column) -> Column:
        one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        rests = F.array(c)
        for _ in range(most):
            rests = F.array_distinct(F.concat(rests, F.flatten(F.transform(rests, one))))
        return rests

    left = words.select("word", F.explode(keys(F.col("word"))).alias("k"))
    right = vocabulary.select("entry", F.explode(keys(F.col("entry"))).alias("k"))
    return left.join(right, "k").select("word", "entry").distinct().withColumn("distance", F.levenshtein("word", "entry", most)).where("distance >= 0")
