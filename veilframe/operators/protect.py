"""Actions on texts with findings: classification gate, redaction, tokens and their way back, fake values."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions import text as T

#: Categories of the presets.
PRESETS = {
    "pci_dss": ["Credit Card Numbers", "Primary Account Numbers", "Card Track Data", "Card Expiration Dates", "Banking and Financial", "PCI Sensitive Data"],
    "ssn_sin": ["North America - United States", "North America - Canada"],
    "pii": ["Personal Identifiers", "Contact Information", "Geolocation", "Postal Codes", "Device Identifiers", "Social Media Identifiers", "Education Identifiers", "Employment Identifiers", "Biometric Identifiers", "Property Identifiers"],
    "credentials": ["Generic Secrets", "Cloud Provider Secrets", "Code Platform Secrets", "Payment Service Secrets", "Messaging Service Secrets"],
    "healthcare": ["Medical Identifiers", "Insurance Identifiers"],
    "contact_info": ["Contact Information"],
}
#: Categories that are always scanned so that the classification gate can work.
GATE_CATEGORIES = ["Traffic Light Protocol", "Data Classification Labels", "Corporate Classification", "Financial Regulatory Labels"]


def resolve_categories(presets: list[str] = (), categories: list[str] = ()) -> frozenset[str] | None:
    """Union of presets, named categories and the gate's; None (all) where nothing is named."""
    if not presets and not categories:
        return None
    return frozenset([*categories, *GATE_CATEGORIES, *(c for p in presets for c in PRESETS[p])])


def classification_level(category: Column, sub: Column) -> Column:
    """Level 0 to 5 of a marking, null for other findings."""
    return (
        F.when(category == "Traffic Light Protocol", F.when(sub.isin("TLP:CLEAR", "TLP:WHITE"), 0).when(sub == "TLP:GREEN", 1).when(sub.isin("TLP:AMBER", "TLP:AMBER+STRICT"), 3).when(sub == "TLP:RED", 4))
        .when(category == "Data Classification Labels", F.when(sub == "Top Secret", 5).when(sub.isin("Secret Classification", "NOFORN"), 4).when(sub == "Confidential Classification", 3).when(sub.isin("CUI", "FOUO", "SBU", "LES"), 2))
        .when(category == "Corporate Classification", F.when(sub == "Highly Confidential", 4).when(sub.isin("Corporate Confidential", "Eyes Only", "Need to Know"), 3).when(sub.isin("Restricted", "Do Not Distribute", "Proprietary", "Embargoed"), 2).when(sub == "Internal Only", 1))
        .when((category == "Financial Regulatory Labels") & (sub == "MNPI"), 3)
    )


def spans_by_document(findings: DataFrame) -> DataFrame:
    """(doc_id, spans): the findings of a document in order of their places. Bounded by the scan's max_matches."""
    return findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end", "category", "sub_category", F.col("text").alias("value")))).alias("spans"))


def filled(char: str = "X"):
    """Redaction that keeps the byte length: every byte of a span becomes the character."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for whole, found in zip(texts, spans):
            if whole is None or found is None:
                out.append(whole)
                continue
            raw = bytearray(whole.encode("utf-8"))
            for s in sorted(found, key=lambda s: -s["span_start"]):
                size = s["span_end"] - s["span_start"]
                mark = char.encode("utf-8")
                raw[s["span_start"] : s["span_end"]] = mark * (size // len(mark)) + b" " * (size % len(mark))
            out.append(raw.decode("utf-8", "replace"))
        return pd.Series(out)

    return run


def guard(documents: DataFrame, findings: DataFrame, action: str = "redact", block_level: int = 3, char: str = "X") -> DataFrame:
    """One row per document: doc_id, status, is_clean, n_findings, categories_found, classification, redacted_text.

    Status is ``blocked`` from ``block_level`` on whatever the action, ``rejected`` for the action reject
    with findings, else ``ok``.
    """
    level = classification_level(F.col("category"), F.col("sub_category"))
    spans = F.sort_array(F.collect_list(F.struct("span_start", "span_end")))
    per_doc = findings.groupBy("doc_id").agg(F.max(level).alias("classification"), F.count("*").alias("n_findings"), F.sort_array(F.collect_set("category")).alias("categories_found"), spans.alias("spans"))
    joined = documents.select("doc_id", "text").join(per_doc, "doc_id", "left")
    status = F.when(F.col("classification") >= block_level, "blocked").when((F.lit(action) == "reject") & (F.col("n_findings") > 0), "rejected").otherwise("ok")
    changed = filled(char)(F.col("text"), F.col("spans")) if action == "redact" else F.lit(None).cast("string")
    return joined.select("doc_id", status.alias("status"), F.col("n_findings").isNull().alias("is_clean"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "categories_found", "classification", changed.alias("redacted_text"))


def token_of(value: Column, category: Column, key: bytes, prefix: str = "TOK") -> Column:
    return F.concat(F.lit(prefix + "_"), T.initials(category), F.lit("_"), F.left(T.hmac_sha256(value, key), F.lit(32)))


def tokenize(documents: DataFrame, findings: DataFrame, key: bytes, prefix: str = "TOK") -> tuple[DataFrame, DataFrame]:
    """(documents with tokens for findings, vault: token, value, category)."""
    # the value is what stands in the text, also where the match was found in another reading of it
    raw = documents.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    value = F.decode(F.substring(F.col("raw"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")), "UTF-8")
    tokens = findings.drop("text").join(raw, "doc_id").withColumn("value", value).drop("raw").withColumn("token", token_of(F.col("value"), F.col("category"), key, prefix))
    vault = tokens.select("token", "value", "category").distinct()
    spans = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end", "token"))).alias("spans"))

    @F.pandas_udf(StringType())
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for whole, found in zip(texts, spans):
            if whole is None or found is None:
                out.append(whole)
                continue
            raw, last, parts = whole.encode("utf-8"), 0, []
            for s in found:
                if s["span_start"] >= last:
                    parts += [raw[last : s["span_start"]], s["token"].encode()]
                    last = s["span_end"]
            out.append(b"".join([*parts, raw[last:]]).decode("utf-8", "replace"))
        return pd.Series(out)

    return documents.join(spans, "doc_id", "left").select("doc_id", put("text", "spans").alias("text")), vault


def live_tokens(vault: DataFrame, now_us: int, ttl_us: int, stored_at: str = "stored_at_us") -> DataFrame:
    """The vault without tokens that are older than their time to live; a token stored again counts from then."""
    last = vault.groupBy("token").agg(F.max_by(F.struct("value", "category"), stored_at).alias("v"), F.max(stored_at).alias(stored_at))
    return last.where(F.col(stored_at) + ttl_us > now_us).select("token", "v.value", "v.category", stored_at)


def detokenize(documents: DataFrame, vault: DataFrame, prefix: str = "TOK") -> DataFrame:
    """Tokens replaced by their values in one pass, unknown tokens kept: split, join, put together again."""
    shape = prefix + r"_[A-Z]*_[0-9a-f]{32}"
    parts = documents.select("doc_id", F.split("text", shape, -1).alias("between"), F.regexp_extract_all("text", F.lit(f"({shape})")).alias("tokens"))
    tokens = parts.select("doc_id", F.posexplode("tokens").alias("n", "token")).join(vault.select("token", "value").dropDuplicates(["token"]), "token", "left")
    values = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("value", "token").alias("v")))).alias("values"))
    put = F.concat_ws("", F.flatten(F.zip_with("between", F.transform("values", lambda x: x["v"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    return parts.join(values, "doc_id", "left").select("doc_id", F.when(F.col("values").isNull(), F.element_at("between", 1)).otherwise(put).alias("text"))


def fake(value: str, sub_category: str, rnd: random.Random) -> str:
    """A value of the same shape: digits for digits, letters for letters; cards keep brand and satisfy Luhn."""
    if "@" in value:
        return "".join(rnd.choices(string.ascii_lowercase, k=8)) + "@example.com"
    out = []
    for i, c in enumerate(value):
        if c.isdigit():
            out.append(c if sub_category in ("Visa", "MasterCard", "Amex", "Discover", "JCB", "UnionPay", "Diners Club") and sum(x.isdigit() for x in value[: i + 1]) <= 2 else rnd.choice(string.digits))
        elif c.isalpha():
            out.append(rnd.choice(string.ascii_uppercase if c.isupper() else string.ascii_lowercase))
        else:
            out.append(c)
    if sub_category in ("Visa", "MasterCard", "Amex", "Discover", "JCB", "UnionPay", "Diners Club", "PAN"):
        at = [i for i, c in enumerate(out) if c.isdigit()]
        digits = [int(out[i]) for i in at]
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed([*digits[:-1], 0])))
        out[at[-1]] = str(-total % 10)
    return "".join(out)


def obfuscate(documents: DataFrame, findings: DataFrame, seed: int = 42) -> DataFrame:
    """Findings replaced by fake values; the same seed, document and span give the same value anywhere."""
    joined = documents.join(spans_by_document(findings), "doc_id", "left").select("doc_id", "text", "spans")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for doc_id, whole, spans in zip(frame["doc_id"], frame["text"], frame["spans"]):
                if whole is None or spans is None:
                    made.append(whole)
                    continue
                raw, last, parts = whole.encode("utf-8"), 0, []
                for s in spans:
                    if s["span_start"] >= last:
                        rnd = random.Random(f"{seed}/{doc_id}/{s['span_start']}")
                        parts += [raw[last : s["span_start"]], fake(s["value"], s["sub_category"], rnd).encode()]
                        last = s["span_end"]
                made.append(b"".join([*parts, raw[last:]]).decode("utf-8", "replace"))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": made})

    return joined.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string")


# ------------------------------------------------------------------------------------- lists
def glob_pattern(glob: str) -> str:
    """Java expression of a path glob: ** and * cross nothing and one level, ? is one character."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return "(?i)^" + out + "$"


def ipv4_number(c: Column) -> Column:
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).try_cast("bigint")
    return part(1) * 16_777_216 + part(2) * 65_536 + part(3) * 256 + part(4)


def list_predicate(kind: str, entry: str, value: Column) -> Column:
    """Whether a value is on a list: keyword, domain, email, hash, url, path, cidr or exact."""
    low, e = F.lower(value), entry.lower()
    if kind == "keyword":
        return low.contains(e)
    if kind == "domain":
        return (low == e) | low.endswith("." + e) | low.endswith("@" + e)
    if kind == "email":
        return low.endswith(e) if e.startswith("@") else low == e
    if kind == "url":
        return low.startswith(e)
    if kind == "path":
        return value.rlike(glob_pattern(entry)) if re.search(r"[*?]", entry) else low.contains(e)
    if kind == "cidr":
        base, _, bits = entry.partition("/")
        size = 1 << (32 - int(bits or 32))
        number = 0
        for p in base.split("."):
            number = number * 256 + int(p)
        low_end = number // size * size
        return F.coalesce(ipv4_number(value).between(low_end, low_end + size - 1), F.lit(False))
    return low == e
