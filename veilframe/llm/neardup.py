"""Near-duplicate records by bit-sliced sketch comparison inside signature buckets.

Every record is reduced to a MinHash signature (128 values over three-word runs), the
signature to a 256-bit sketch (two mixed bits of every value).  Records are bucketed by
bands of three signature values, so only records that share a bucket are compared.
Inside a bucket the sketches are stored *vertically*: plane ``k`` holds bit ``k`` of 64
records in one machine word.  One query record is compared with 64 records at a time by
XOR with the plane; the distances are kept as vertical counters that are advanced by
carry-save adders, and a block is abandoned as soon as every distance in it exceeds the
radius.  Survivors are verified exactly on their run sets.

Scale: exact copies are collapsed to classes first.  Only 24 bytes of a record (bucket and key) are
shuffled for each band; buckets of one record are dropped before the sketches are fetched.  Buckets of
more than ``tile`` records are cut into tiles before they meet, and every pair of tiles is a group of its
own, so no task holds more than two tiles.  Joins on a class or record with many copies are cut the same
way.  Nothing is collected to the driver; the only broadcast is that of counted hot keys.

Groups are connected components by alternating large-star and small-star contraction until the links
stand still, so chains of any length become one group.

Defined results: a null id is ignored; a record with neither text nor signature, and a
text of fewer than three words (no run), is similar to nothing; repeated rows count once; a
doc_id registered with several texts is similar to whatever one of them is similar to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.similarity import MERSENNE, TOP, hash_functions
from veilframe.operators.similarity import VALUES as SIGNATURE_VALUES
from veilframe.session import by_key, cut, in_parts, shuffle_width, spread_over, with_parts, written

# Fixed values of the signature rules.
FNV_START = 14695981039346656037
FNV_FACTOR = 1099511628211

RUN = 3  # words in a run
KEPT = 0.9999  # share of the pairs at the threshold that must meet in a bucket
COPIES = 4096  # copies of one text in a part of a join
SKETCH_WORDS = 4  # 256 bits
STAGE = 32  # planes between two tests for abandonment
LANES = 64


coefficients = hash_functions


def banding(threshold: float) -> tuple[int, int]:
    """(bands, values in a band): the widest bands with which ``KEPT`` of the pairs at the threshold share one.

    1 - (1 - 0.6**3)**42 = 0.99996 at 0.6; wider bands for higher thresholds, single values for the lowest.
    """
    for rows in range(8, 0, -1):
        bands = SIGNATURE_VALUES // rows
        if 1 - (1 - threshold**rows) ** bands >= KEPT:
            return bands, rows
    raise ValueError(f"signatures of {SIGNATURE_VALUES} values can't find pairs of similarity {threshold}")


def runs_of(text: str, k: int = RUN) -> list[str]:
    """The distinct runs of k lower-cased words; k-character runs for shorter texts (signature only)."""
    low = text.lower()
    words = low.split()
    if len(words) < k:
        size = max(1, min(k, len(low)))
        return sorted({low[i : i + size] for i in range(len(low) - size + 1)} - {""})
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)))


def fnv32(items: list[str]) -> np.ndarray:
    """Lower 32 bits of 64-bit FNV-1a of every item, all items advanced together byte by byte."""
    raw = [x.encode() for x in items]
    size = np.array([len(x) for x in raw])
    wide = np.zeros((len(raw), int(size.max(initial=0))), np.uint64)
    for i, x in enumerate(raw):
        wide[i, : len(x)] = np.frombuffer(x, np.uint8)
    state = np.full(len(raw), FNV_START, np.uint64)
    for j in range(wide.shape[1]):
        live = size > j
        state[live] = (state[live] ^ wide[live, j]) * np.uint64(FNV_FACTOR)
    return state & np.uint64(TOP)


def signature_of(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signature of a text; every value is the upper bound for an empty text."""
    runs = runs_of(text)
    if not runs:
        return np.full(len(a), TOP, np.int64)
    h = fnv32(runs)
    best = np.full(len(a), TOP, np.uint64)
    for i in range(0, len(h), 4096):
        part = (a[:, None] * h[None, i : i + 4096] + b[:, None]) % np.uint64(MERSENNE) % np.uint64(TOP)
        best = np.minimum(best, part.min(axis=1))
    return best.astype(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """256 bits of an n x 128 array of signatures, as n x 4 words: two mixed bits of every value."""
    x = signature.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.stack([(x >> np.uint64(s)) & np.uint64(1) for s in (40, 52)], axis=2).reshape(len(x), -1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def radius_for(threshold: float, values: int = SIGNATURE_VALUES, deviations: float = 4.0) -> int:
    """Sketch distance below which a pair of that similarity stays with near certainty."""
    share = max(0.0, threshold - deviations * (threshold * (1 - threshold) / values) ** 0.5)
    apart = (1 - share) * values
    return int(apart + deviations * (apart * 2 * 0.25) ** 0.5)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (key, text, signature): the signature where missing, the sketch and the hashed runs."""
    a, b = coefficients()
    for batch in batches:
        d = batch.to_pydict()
        signatures, runs = [], []
        for text, given in zip(d["text"], d["signature"]):
            whole = given is not None and len(given) == SIGNATURE_VALUES and None not in given
            signatures.append(np.array(given, np.int64) if whole else signature_of(text or "", a, b))
            if text is None:
                runs.append(None)
            elif len(text.split()) < RUN:
                runs.append([])
            else:
                runs.append(pd.util.hash_array(np.array(runs_of(text), object), categorize=False).view(np.int64).tolist())
        s = np.array(signatures, np.int64).reshape(-1, SIGNATURE_VALUES)
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(d["key"], pa.binary()),
                "signature": pa.array(list(s), pa.list_(pa.int64())),
                "sketch": pa.array(list(sketch_of(s).view(np.int64)), pa.list_(pa.int64())),
                "runs": pa.array(runs, pa.list_(pa.int64())),
            }
        )


def vertical(sketch: np.ndarray) -> np.ndarray:
    """Bit planes of n x w words: planes[k, block] holds bit k of 64 records."""
    n = len(sketch)
    blocks = -(-n // LANES)
    bits = np.zeros((blocks * LANES, sketch.shape[1] * 64), np.uint8)
    bits[:n] = np.unpackbits(sketch.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    turned = bits.reshape(blocks, LANES, -1).transpose(2, 0, 1)
    return np.packbits(np.ascontiguousarray(turned), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    if radius >> len(counters):
        return above
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above |= equal & counters[i]
            equal = equal & ~counters[i]
    return above


def within(sketch: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (r, s), low[r] <= s < high[r], whose sketches differ in at most ``radius`` bits."""
    planes = vertical(sketch)
    rows = np.flatnonzero(high > low)
    first, last = low[rows] // LANES, (high[rows] - 1) // LANES
    ends = np.cumsum(last - first + 1)
    left, right = [], []
    at = 0
    while at < len(rows):
        # as many query rows as give about ``most`` cells; a cell is a query row and a block of 64 records
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        q, times = rows[at:to], (last - first + 1)[at:to]
        at = to
        query = np.repeat(q, times)
        block = np.repeat(first[at - len(q) : at], times) + np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        from_, until = np.maximum(low[query] - block * LANES, 0), np.minimum(high[query] - block * LANES, LANES)
        ones = ~np.uint64(0)
        alive = (ones >> (LANES - until).astype(np.uint64)) & (ones << from_.astype(np.uint64))
        qblock, lane = query // LANES, (query % LANES).astype(np.uint64)
        counters = [np.zeros(len(query), np.uint64)]
        for start in range(0, len(planes), STAGE):
            pending: list[list[np.ndarray]] = [[]]
            for plane in planes[start : start + STAGE]:
                bit = (plane[qblock] >> lane) & np.uint64(1)
                pending[0].append(plane[block] ^ (np.uint64(0) - bit))
                level = 0
                while len(pending[level]) == 3:  # carry-save adder: three words of weight 2^level become one and a carry
                    x, y, z = pending[level]
                    half = x ^ y
                    pending[level] = [half ^ z]
                    if len(pending) == level + 1:
                        pending.append([])
                    pending[level + 1].append((x & y) | (half & z))
                    level += 1
            for level, words in enumerate(pending):
                for word in words:
                    carry, i = word, level
                    while carry.any():
                        while len(counters) <= i:
                            counters.append(np.zeros_like(word))
                        counters[i], carry = counters[i] ^ carry, counters[i] & carry
                        i += 1
            alive = alive & ~over(counters, radius)
            keep = alive != 0
            if not keep.any():
                break
            if keep.mean() < 0.7:
                query, block, alive, qblock, lane = query[keep], block[keep], alive[keep], qblock[keep], lane[keep]
                counters = [c[keep] for c in counters]
        else:
            keep = alive != 0
            bits = np.unpackbits(alive[keep].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, lane_no = np.nonzero(bits)
            left.append(query[keep][cell])
            right.append(block[keep][cell] * LANES + lane_no)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def compare_groups(radius: int):
    """Partition function: rows sorted by (grp, part) to candidate pairs of class keys."""

    def pairs(grp: np.ndarray, part: np.ndarray, split: np.ndarray, keys: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        n = len(grp)
        edge = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        size = np.diff(np.r_[edge, n])
        end = np.repeat(edge + size, size)
        low, high = np.arange(n) + 1, end.copy()
        if split.any():  # group of two tiles: rows of the first against rows of the second only
            starts = np.repeat(edge, size)
            ones = np.concatenate([[0], np.cumsum(part == 0)])
            border = starts + (ones[end] - ones[starts])
            low = np.where(split, border, low)
            high = np.where(split & (part == 1), 0, high)
        a, b = within(sketch, low, high, radius)
        x, y = keys[a], keys[b]
        swap = x > y
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        seen = pd.DataFrame({"a": x, "b": y}).drop_duplicates()
        return pa.RecordBatch.from_pandas(seen[seen.a != seen.b], schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS)
            held.append((batch.column("grp").to_numpy(), batch.column("part").to_numpy(), batch.column("split").to_numpy(zero_copy_only=False), np.array(batch.column("key").to_pylist(), object), flat))
            rows += batch.num_rows
            if rows >= 30_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                stop = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
                if stop:
                    yield pairs(*(c[:stop] for c in cols))
                held = [tuple(c[stop:] for c in cols)]
                rows = len(held[0][0])
        if held:
            yield pairs(*(np.concatenate(c) for c in zip(*held)))

    return run


def classes_of(entries: DataFrame, doc_id: str = "doc_id", text: str = "text", signature: str = "signature") -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row per distinct content with signature, sketch and runs; and (key, doc_id).

    The key is half of a SHA-256 over the words, or over the signature where there is no text.
    """
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    hashed = F.when(F.col(text).isNotNull(), F.sha2(F.concat(F.lit("t"), words), 256)).otherwise(F.sha2(F.concat(F.lit("s"), F.to_json(F.col(signature))), 256))
    rows = (
        entries.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.col(signature).alias("signature"), F.unhex(F.substring(hashed, 1, 32)).alias("key"))
        .where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
    )
    one = rows.groupBy("key").agg(F.first("text", True).alias("text"), F.first("signature", True).alias("signature"))
    classes = cut(by_key(one, "key").mapInArrow(signed, "key binary, signature array<bigint>, sketch array<bigint>, runs array<bigint>"))
    return classes, rows.select("key", "doc_id").distinct()


def usable(classes: DataFrame) -> DataFrame:
    """Classes that can be similar to something: with runs, or with a signature only."""
    return classes.where(F.col("runs").isNull() | (F.size("runs") > 0))


def candidates(classes: DataFrame, threshold: float, tile: int = 8192) -> DataFrame:
    """Distinct candidate pairs (a, b) of class keys within the sketch radius in some bucket."""
    bands, rows = banding(threshold)
    buckets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, *(F.element_at("signature", i * rows + j) for j in range(1, rows + 1))))
    places = usable(classes).select("key", F.explode(buckets).alias("bucket"))
    # hot buckets are cut before they are joined with anything; buckets of one record end here
    own = spread_over(with_parts(places, ["bucket"], tile, ["key"], "tiles"), ["key"], "tiles", "own")
    several = places.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("of"))
    met = own.join(in_parts(several, "of", "own"), ["bucket", "own"]).select("key", "bucket", "own", "tiles")
    tiled = in_parts(met.join(usable(classes).select("key", "sketch"), "key"), "tiles", "other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    grouped = tiled.select(F.xxhash64("bucket", low, high).alias("grp"), (F.col("own") > F.col("other")).cast("int").alias("part"), (F.col("own") != F.col("other")).alias("split"), "key", "sketch")
    lined = grouped.repartition(shuffle_width(classes), "grp").sortWithinPartitions("grp", "part")
    return lined.mapInArrow(compare_groups(radius_for(threshold)), "a binary, b binary").distinct()


def class_pairs(classes: DataFrame, threshold: float, tile: int = 8192) -> DataFrame:
    """Verified pairs (a, b, similarity) of different classes: exact on runs, by signature where a text is missing."""
    found = candidates(classes, threshold, tile)
    left = classes.select(F.col("key").alias("a"), F.col("signature").alias("sa"), F.col("runs").alias("ra"))
    right = classes.select(F.col("key").alias("b"), F.col("signature").alias("sb"), F.col("runs").alias("rb"))
    both = found.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    exact = shared / (F.size("ra") + F.size("rb") - shared)
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SIGNATURE_VALUES))
    similarity = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), exact).otherwise(equal)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(entries: DataFrame, threshold: float = 0.6, tile: int = 8192, **names: str) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b, similarity) of different ids with at least that similarity, smaller id first.

    Every pair of ids is listed, so the result grows with the square of the copies; ``near_duplicate_groups`` is the
    form for large collections. The copies of a class are cut into parts on both sides of every join here.
    """
    classes, members = classes_of(entries, **names)
    members = cut(members)  # keys and ids only, read several times below
    classes_similar = class_pairs(classes, threshold, tile)
    # a class is similar to itself; its copies are pairs
    itself = usable(classes).select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    sized = cut(with_parts(members, ["key"], COPIES, ["doc_id"]))
    parts = sized.groupBy("key").agg(F.max("parts").alias("parts"))
    placed = spread_over(sized, ["doc_id"])

    def side(key: str, id_: str, part: str) -> DataFrame:
        return placed.select(F.col("key").alias(key), F.col("doc_id").alias(id_), F.col("part").alias(part))

    several = members.groupBy("key").count().where("count > 1").select(F.col("key").alias("a"))
    all_pairs = classes_similar.union(itself.join(several, "a", "left_semi").select("a", "b", "similarity"))
    cut_left = in_parts(all_pairs.join(parts.withColumnRenamed("key", "a"), "a"), "parts", "part_a").drop("parts")
    cut_both = in_parts(cut_left.join(parts.withColumnRenamed("key", "b"), "b"), "parts", "part_b").drop("parts")
    met = cut_both.join(side("a", "x", "part_a"), ["a", "part_a"]).join(side("b", "y", "part_b"), ["b", "part_b"])
    met = met.where((F.col("a") != F.col("b")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
    pair = [F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")]
    return met.groupBy(*pair).agg(F.max("similarity").alias("similarity"))


def star(edges: DataFrame, large: bool, hot: int) -> DataFrame:
    """One contraction step over edges (u, v), v < u: links move to the least smaller neighbour of their smaller (large) or larger end."""
    least = edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("near"))
    end = "v" if large else "u"
    placed = spread_over(with_parts(edges.withColumn("at", F.col(end)), ["at"], hot, ["u", "v"]), ["u", "v"])
    parts = placed.groupBy("at").agg(F.max("parts").alias("parts")).where("parts > 1")
    everywhere = in_parts(least.join(parts, "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))).select("at", "part", "near")
    met = placed.join(everywhere, ["at", "part"], "left")
    if large:
        return met.select("u", F.coalesce("near", "v").alias("v")).distinct()
    moved = met.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("near").alias("v")), F.struct(F.col("v").alias("u"), F.col("near").alias("v")))).alias("e")).select("e.u", "e.v")
    return moved.where("u <> v").distinct()


def connected(nodes: DataFrame, links: DataFrame, hot: int = 100_000, most_rounds: int = 1000) -> DataFrame:
    """(key, root): least key of every component, by alternating stars until no link moves.

    The number of rounds grows with the logarithm of the longest chain; ``most_rounds`` raises, it doesn't end early.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        edges = written(star(star(edges, True, hot), False, hot))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return nodes.select("key").join(edges.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))
        state = now
    raise RuntimeError("links still move")


def near_duplicate_groups(entries: DataFrame, threshold: float = 0.6, tile: int = 8192, **names: str) -> DataFrame:
    """One row per document: (doc_id, group_id, n_links, best_similarity).

    ``group_id`` is the least doc_id of its component, ``n_links`` the number of other documents
    that are similar to one of its texts, copies included; nothing is expanded into pairs of copies.
    """
    classes, members = classes_of(entries, **names)
    members = cut(members)
    live = cut(usable(classes).select("key"))
    links = cut(class_pairs(classes, threshold, tile))
    both = links.select(F.col("a").alias("key"), F.col("b").alias("other"), "similarity").union(links.select(F.col("b").alias("key"), F.col("a").alias("other"), "similarity"))
    near = both.union(live.select("key", F.col("key").alias("other"), F.lit(None).cast("double").alias("similarity")))
    copies = members.join(live, "key", "left_semi").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    # documents with several texts link the classes of these texts
    texts = members.groupBy("doc_id").agg(F.count("*").alias("texts"), F.min("key").alias("first_key"))
    several = cut(members.join(texts.where("texts > 1"), "doc_id").join(live, "key", "left_semi").select("doc_id", "key", "first_key"))
    own = several.groupBy("doc_id").agg(F.min("key").alias("first_key"))
    bridges = several.drop("first_key").join(own, "doc_id").where("key <> first_key").select(F.col("key").alias("a"), F.col("first_key").alias("b"))
    roots = connected(live, links.select("a", "b").union(bridges))
    named = roots.join(copies, "key").groupBy("root").agg(F.min("least_id").alias("group_id"))
    group_of = roots.join(named, "root").select("key", "group_id")

    def linked(owner: str, pairs: DataFrame) -> DataFrame:
        """(owner, ids, best): distinct documents in the classes near to each owner, and the best similarity to another class."""
        sums = pairs.join(copies.select(F.col("key").alias("other"), "copies"), "other").groupBy(owner).agg(F.sum("copies").alias("ids"), F.max("similarity").alias("best"), F.max(F.when(F.col("similarity").isNull(), F.col("copies"))).alias("copies"))
        twice = pairs.join(several.select(F.col("key").alias("other"), "doc_id").withColumnRenamed("doc_id", "who"), "other").groupBy(owner, "who").count().where("count > 1")
        less = twice.groupBy(owner).agg(F.sum(F.col("count") - 1).alias("less"))
        return sums.join(less, owner, "left").select(owner, (F.col("ids") - F.coalesce("less", F.lit(0)) - 1).alias("n_links"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("best_similarity"))

    by_class = group_of.join(linked("key", near), "key")
    reach = several.select("doc_id", "key").join(near, "key").groupBy("doc_id", "other").agg(F.max("similarity").alias("similarity"), F.max(F.col("similarity").isNull()).alias("own"))
    # a class that the document is in itself counts as its own, whatever else links to it
    by_doc = linked("doc_id", reach.select("doc_id", "other", F.when(~F.col("own") | F.col("similarity").isNotNull(), F.col("similarity")).alias("similarity")))
    own_copies = several.join(copies, "key").groupBy("doc_id").agg(F.max("copies").alias("own_copies"))
    several_rows = own.join(group_of, own.first_key == group_of.key).select("doc_id", "group_id").join(by_doc, "doc_id").join(own_copies, "doc_id")
    several_rows = several_rows.select("doc_id", "group_id", "n_links", F.when(F.col("own_copies") > 1, 1.0).otherwise(F.col("best_similarity")).alias("best_similarity"))
    parts = spread_over(with_parts(members.join(several, ["doc_id"], "left_anti"), ["key"], 100 * COPIES, ["doc_id"]), ["doc_id"])
    hot = parts.groupBy("key").agg(F.max("parts").alias("parts"))
    single = parts.join(in_parts(by_class.join(hot, "key")), ["key", "part"], "left").select("doc_id", "group_id", "n_links", "best_similarity")
    lone = single.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("group_id", "n_links", "best_similarity")))
    lone = lone.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "best_similarity")
    return lone.union(several_rows)
