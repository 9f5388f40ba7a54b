"""Lookups in the vault of registered texts: MinHash signatures, banded join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from veilframe.session import in_parts, spread_over, with_parts

# Fixed values of the signature rules.
VALUES, BAND_COUNT, BAND_ROWS, SEED = 128, 16, 8, 42
MERSENNE, TOP = (1 << 61) - 1, (1 << 32) - 1


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    state, drawn = SEED, []
    for _ in range(2 * VALUES):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        drawn.append((state >> 16) % MERSENNE)
    return np.array([max(x, 1) for x in drawn[::2]], np.uint64), np.array(drawn[1::2], np.uint64)


def fnv(item: str) -> int:
    h = 14695981039346656037
    for b in item.encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h & TOP


def signature(text: str, a: np.ndarray, b: np.ndarray) -> list[int]:
    low = text.lower()
    w = low.split()
    runs = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {low[i : i + min(3, len(low))] for i in range(max(len(low) - 2, 1))} - {""}
    if not runs:
        return [TOP] * VALUES
    h = np.array([fnv(x) for x in runs], np.uint64)
    best = np.full(VALUES, TOP, np.uint64)
    for i in range(0, len(h), 2048):
        best = np.minimum(best, ((a[:, None] * h[None, i : i + 2048] + b[:, None]) % np.uint64(MERSENNE) % np.uint64(TOP)).min(axis=1))
    return best.astype(np.int64).tolist()


@F.pandas_udf(ArrayType(LongType()))
def signature_udf(texts: pd.Series) -> pd.Series:
    a, b = hash_functions()
    return texts.map(lambda t: None if t is None else signature(t, a, b))


def band_keys(sig: Column) -> Column:
    """One bucket key per band of eight values."""
    return F.transform(F.sequence(F.lit(0), F.lit(BAND_COUNT - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * BAND_ROWS + 1, BAND_ROWS)))


def equal_share(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v) / float(VALUES)


def register(texts: DataFrame) -> DataFrame:
    """(doc_id, signature): the latest registration of each id; later registrations replace earlier ones."""
    latest = texts.where("doc_id is not null and (signature is not null or text is not null)").groupBy("doc_id").agg(F.max_by(F.struct("text", "signature", "sensitivity"), "registered_at").alias("r"))
    return latest.select("doc_id", "r.sensitivity", F.coalesce(F.col("r.signature"), signature_udf(F.col("r.text"))).alias("signature"))


def save_vault(vault: DataFrame, path: str) -> None:
    """Writes a vault (doc_id, sensitivity, signature) for later lookups."""
    vault.write.mode("overwrite").parquet(path)


def load_vault(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unregister(vault: DataFrame, ids: DataFrame) -> DataFrame:
    """The vault without the entries whose doc_id is listed."""
    return vault.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def lookup(queries: DataFrame, vault: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, doc_id, similarity, sensitivity) of registered texts with that share of equal values.

    Both sides are exploded by band and joined on the bucket; candidates are distinct before the signatures are
    fetched, so the wide columns move once per candidate.
    """
    sigs = queries.select("query_id", signature_udf("text").alias("q_signature"))
    left = sigs.select("query_id", F.explode(F.array_distinct(band_keys(F.col("q_signature")))).alias("bucket"))
    right = vault.select("doc_id", F.explode(F.array_distinct(band_keys(F.col("signature")))).alias("bucket"))
    # a bucket that holds much of the vault is cut into parts, and its queries go to each of them
    placed = spread_over(with_parts(right, ["bucket"], 8192, ["doc_id"]), ["doc_id"])
    parts = placed.groupBy("bucket").agg(F.max("parts").alias("parts"))
    met = in_parts(left.join(parts, "bucket")).join(placed.select("bucket", "part", "doc_id"), ["bucket", "part"]).select("query_id", "doc_id").distinct()
    both = met.join(sigs, "query_id").join(vault, "doc_id")
    return both.select("query_id", "doc_id", equal_share(F.col("q_signature"), F.col("signature")).alias("similarity"), "sensitivity").where(F.col("similarity") >= threshold)


def byte_entropy_frame(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bits = []
        for raw in frame["content"]:
            counts = np.bincount(np.frombuffer(raw[:8192], np.uint8), minlength=256) if raw else np.zeros(256)
            p = counts[counts > 0] / max(counts.sum(), 1)
            bits.append(float(-(p * np.log2(p)).sum()))
        yield pd.DataFrame({"path": frame["path"], "bits": bits})


def byte_entropy(files: DataFrame) -> DataFrame:
    """(path, bits): Shannon entropy of the first 8,192 bytes of binary contents."""
    return files.select("path", "content").mapInPandas(byte_entropy_frame, "path string, bits double")
