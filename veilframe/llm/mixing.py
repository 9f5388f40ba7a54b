"""Mixing sources to target shares: min-cost flow over membership patterns, then seeded selection.

Documents with the same text are one document that belongs to several sources; documents are
aggregated by this membership pattern.  Token capacity flows from patterns to the sources' quotas;
using a pattern's tokens for the k-th time costs k - 1, so repetition is spread and avoided where other
documents serve.  The flow is solved on the driver over patterns and sources only; documents
are then selected by position on a seeded line of each pattern, computed with bucketed prefix sums.

Bounds: the driver sees one row per pattern and per source (``most_patterns``, more raise an error); the line
of a pattern is cut into ``buckets`` buckets, more for patterns of many documents, so no window holds more than a
bucket of a pattern. The only window over everything is that over the report, a row per source.

Defined results: documents without text, or whose sources have no target, are not used; a source without
documents gets nothing and is reported as not met; a null share or cap counts as 0; copies count
as one document; no document is used more often than the smallest cap of its sources allows.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import by_key, cut

BUCKETS = 4096


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(path: str):
    """Partition function: (key, text) to (key, n_tokens)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokenizer = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "n_tokens": [len(tokenizer.encode_ordinary(t)) for t in frame["text"]]})

    return run


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], repeats: dict[str, int], quota: dict[str, int]) -> dict[tuple[str, str], int]:
    """Tokens from each pattern to each source: maximal, and of least repetition cost (successive shortest paths)."""
    names = ["<in>", "<out>", *(f"p:{p}" for p in capacity), *(f"s:{s}" for s in quota)]
    at = {n: i for i, n in enumerate(names)}
    edges: list[list[int]] = []  # to, capacity, cost
    out: list[list[int]] = [[] for _ in names]

    def link(a: str, b: str, size: int, cost: int) -> int:
        edges.append([at[b], size, cost])
        edges.append([at[a], 0, -cost])
        out[at[a]].append(len(edges) - 2)
        out[at[b]].append(len(edges) - 1)
        return len(edges) - 2

    arcs = {}
    for p, size in capacity.items():
        uses = min((repeats[s] for s in members[p]), default=0)
        for k in range(uses):
            link("<in>", f"p:{p}", size, k)
        for s in members[p]:
            arcs[p, s] = link(f"p:{p}", f"s:{s}", size * uses, 0)
    for s, size in quota.items():
        link(f"s:{s}", "<out>", size, 0)
    potential = [0] * len(names)
    while True:
        far = [float("inf")] * len(names)
        by = [-1] * len(names)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b, size, cost = edges[e]
                if size > 0 and d + cost + potential[a] - potential[b] < far[b]:
                    far[b] = d + cost + potential[a] - potential[b]
                    by[b] = e
                    heapq.heappush(heap, (far[b], b))
        if by[1] < 0:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        size, b = float("inf"), 1
        while b != 0:
            size = min(size, edges[by[b]][1])
            b = edges[by[b] ^ 1][0]
        b = 1
        while b != 0:
            edges[by[b]][1] -= size
            edges[by[b] ^ 1][1] += size
            b = edges[by[b] ^ 1][0]
    return {k: edges[e ^ 1][1] for k, e in arcs.items() if edges[e ^ 1][1] > 0}


def largest_total(total: int, least: float, shares: dict[str, float], feasible: Callable[[dict[str, int]], bool]) -> int:
    """The largest total, not under ``least`` of the wanted one, of which every source can give its share; found by bisection to a thousandth."""
    quota = lambda t: {s: round(share * t) for s, share in shares.items()}
    if feasible(quota(total)):
        return total
    low, high = int(total * least), total
    if not feasible(quota(low)):
        return total if least <= 0 else low
    while high - low > max(1, total // 1000):
        middle = (low + high) // 2
        low, high = (middle, high) if feasible(quota(middle)) else (low, middle)
    return low


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str | None = None, buckets: int = BUCKETS, most_patterns: int = 20_000, least_total: float = 0.5, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: doc_id, source, repeats, n_tokens; shares: source, target_share, target_tokens, tokens, actual_share,
    documents, repeats_used, max_repeats, met.  ``total_tokens`` defaults to the tokens of all usable documents.

    Where sources are too small for their share of the total at their cap, the total is made smaller, down to
    ``least_total`` of it, until the shares hold; sources that are still too small give all that their cap allows. Target shares of
    sources without any document can't be met; the others then divide the mix in proportion. ``met`` says whether the
    reached part lies within ``tolerance`` of the target share, or nearer to it than the longest document's part.
    """
    spark = documents.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").limit(most_patterns + 1).collect()
    if len(listed) > most_patterns:
        raise ValueError("more sources than most_patterns")
    wanted = [(r.source, float(r.share or 0), int(r.repeats or 0)) for r in listed]
    repeats = {s: n for s, _, n in wanted}
    text_key = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "source", text_key.alias("key"), "text")
    known = rows.where(F.col("source").isin(list(repeats)))
    patterns = known.groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("doc_id").alias("doc_id"))
    # one text per key for the tokenizer, picked without moving texts twice
    first = by_key(rows.join(patterns.select("key", "doc_id"), ["key", "doc_id"], "left_semi").select("key", "text"), "key").dropDuplicates(["key"])
    sizes = first.mapInPandas(count_tokens(tokenizer or tokenizer_path()), "key string, n_tokens bigint")
    units = cut(patterns.join(sizes, "key").where("n_tokens > 0").select("doc_id", F.to_json("sources").alias("pattern"), "n_tokens", F.xxhash64(F.lit(seed), "key").alias("turn")))
    held = units.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("documents"), F.max("n_tokens").alias("longest")).limit(most_patterns + 1).collect()
    if len(held) > most_patterns:
        raise ValueError("more membership patterns than most_patterns")
    capacity = {r.pattern: int(r.n) for r in sorted(held)}
    buckets = max(buckets, max((r.documents for r in held), default=0) // 200_000)
    units = units.withColumn("bucket", F.pmod("turn", F.lit(buckets)))
    longest = max((r.longest for r in held), default=0)
    members = {p: json.loads(p) for p in capacity}
    total = int(sum(capacity.values()) if total_tokens is None else total_tokens)
    there = {s for m in members.values() for s in m if repeats[s] > 0}
    asked = sum(share for s, share, _ in wanted if s in there)
    parts = {s: share / asked for s, share, _ in wanted if s in there and share > 0} if asked > 0 else {}
    full = lambda quota: sum(min_cost_flow(capacity, members, repeats, {**dict.fromkeys(repeats, 0), **quota}).values()) >= sum(quota.values())
    total = largest_total(total, least_total, parts, full)
    quota = {s: round(parts.get(s, 0.0) * total) for s, _, _ in wanted}
    flow = min_cost_flow(capacity, members, repeats, quota)
    # every source takes an interval of the pattern's line; the line goes over all its documents again and again
    intervals, start = [], dict.fromkeys(capacity, 0)
    for (p, s), size in sorted(flow.items()):
        intervals.append((p, s, start[p], start[p] + size, capacity[p]))
        start[p] += size
    lines = spark.createDataFrame(intervals, "pattern string, source string, low bigint, high bigint, round bigint")
    per_bucket = units.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = per_bucket.withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("in_bucket")).select("pattern", "bucket", "offset")
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = units.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, ["pattern", "bucket"]).withColumn("place", F.col("offset") + F.col("inner"))
    # uses of a document by a source: rounds k with low <= place + k * round < high
    lowest = F.greatest(F.ceil((F.col("low") - F.col("place")) / F.col("round")), F.lit(0))
    uses = (F.ceil((F.col("high") - F.col("place")) / F.col("round")) - lowest).cast("int")
    selection = placed.join(F.broadcast(lines) if len(intervals) <= most_patterns else lines, "pattern").withColumn("repeats", uses).where("repeats > 0").select("doc_id", "source", "repeats", "n_tokens")
    wish = spark.createDataFrame([(s, share, n, round(share * total)) for s, share, n in wanted], "source string, target_share double, max_repeats int, target_tokens bigint")
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("repeats_used"))
    report = wish.join(used, "source", "left").fillna({"tokens": 0, "documents": 0, "repeats_used": 0})
    share = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    shares = report.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1)))).select(
        "source", "target_share", "target_tokens", "tokens", share.alias("actual_share"), "documents", "repeats_used", "max_repeats",
        (F.abs(share - F.col("target_share")) <= F.greatest(F.col("target_share") * tolerance, F.lit(float(longest)) / F.greatest("all_tokens", F.lit(1)))).alias("met"),
    )
    return selection, shares
