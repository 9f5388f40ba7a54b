"""Evaluation items inside a corpus: windows of template words, joined by hash, checked slot by slot.

Every word is lower-cased and canonicalised: numbers become ``<num>``, units ``<unit>`` and the
names that the items themselves use ``<name>``.  Windows of twelve template words are hashed and joined
with the items' windows, so a question that was re-parameterised meets its original.  The slots of
joined windows on one alignment must map one to one (slot consistency); where the slots of a window are equal, value
by value, the passage is the item's own text.

Scale: a worker passes over each text once and emits only windows whose hash an item has.  The items'
hashes go to the workers as one sorted array, and their windows are broadcast, while there are at most
``most_windows`` of them (rows are counted); beyond it all windows are exploded and joined by a shuffle in which
every hash is spread over ``SPREAD`` places, so a boilerplate passage is no hot key.  The names of all items form
the lexicon; more than ``most_names`` raise an error instead of being cut.

Defined results: null or short texts (under twelve words) contain and match nothing; repeated
rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import cut, spread

WINDOW = 12
WORD = re.compile(r"[^\W_]+")
#: Units that follow or precede numbers in the languages of the items.
UNITS = frozenset(
    "percent day days week weeks month months year years hour hours minute minutes second seconds kb mb gb tb km kg cm mm rows lines pages "
    "tage tagen wochen monate jahre stunden minuten sekunden zeilen seiten jours semaines mois ans heures minutes secondes lignes pages "
    "días semanas meses años horas minutos segundos filas líneas páginas monday tuesday wednesday thursday friday saturday sunday".split()
)
FACTOR = 0x100000001B3


SPREAD = 16
INNER = regex.compile(r"[\p{Ll},] (\p{Lu}\p{L}*\p{Ll}(?: \p{Lu}\p{L}*\p{Ll})*)")


def name_words(text: str) -> set[str]:
    """Words that a text writes with a capital inside sentences, in any script with case; none where nouns have capitals."""
    inner = [w for run in INNER.findall(text) for w in run.split(" ")]
    words = WORD.findall(text)
    return {w.lower() for w in inner} if len(inner) < 0.12 * len(words) else set()


def names_of(items: DataFrame, most_names: int) -> frozenset[str]:
    """The names of all items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"name": sorted(set().union(*(name_words(t) for t in frame["text"])))}, dtype=object)

    found = items.select("text").mapInPandas(run, "name string").distinct().limit(most_names + 1).collect()
    if len(found) > most_names:
        raise ValueError("the items use more names than most_names")
    return frozenset(r.name for r in found)


def template(word: str, names: frozenset[str]) -> str:
    if any(c.isdigit() for c in word):
        return "<num>"
    if word in UNITS:
        return "<unit>"
    return "<name>" if word in names else word


def rolling(h: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Hash of every window of ``width`` word hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(FACTOR) + h[j : len(h) - width + 1 + j]
    return out ^ (out >> np.uint64(31))


def windows_of(texts: list[str], names: frozenset[str]) -> tuple[np.ndarray, ...]:
    """Windows of many texts at once: (text no., word no., place in the batch, template hash, hash of each word, slot of each word).

    Different words are hashed and canonicalised once; windows that reach over the end of a text are dropped.
    """
    words, sizes = [], []
    for text in texts:
        found = WORD.findall(text.lower())
        words += found
        sizes.append(len(found))
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    codes, different = pd.factorize(np.array(words, object))
    plain = [template(w, names) for w in different]
    exact = pd.util.hash_array(np.array(different, object), categorize=False)[codes]
    shaped = pd.util.hash_array(np.array(plain, object), categorize=False)[codes]
    slot = np.array([p[0] == "<" for p in plain])[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    number = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    shape = rolling(shaped)
    whole = owner[: len(shape)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    return owner[at], number[at], at, shape[at], exact, slot


WINDOW_SCHEMA = "id {kind}, pos int, shape bigint, slots array<bigint>"


def emit(names: frozenset[str], wanted: np.ndarray | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owner, number, begin, shape, word, slot = windows_of(frame["text"].tolist(), names)
            if wanted is None or not len(shape):
                hit = np.arange(len(shape))
            else:
                place = np.searchsorted(wanted, shape)
                hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == shape) if len(wanted) else np.zeros(0, np.int64)
            slots = pd.Series([word[i : i + WINDOW][slot[i : i + WINDOW]].view(np.int64).tolist() for i in begin[hit]], dtype=object)
            yield pd.DataFrame({"id": frame["id"].to_numpy()[owner[hit]], "pos": number[hit].astype(np.int32), "shape": shape[hit].view(np.int64), "slots": slots})

    return run


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", most_windows: int = 500_000, most_names: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, kind, windows, doc_word_start, item_word_start) of every leaked passage.

    ``kind`` is ``exact`` (twelve or more consecutive words of the item) or ``reparameterised``
    (template and slot mapping agree, values differ); one row per document, item and kind with
    the number of windows and the first place.
    """
    docs = spread(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"))
    held = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").distinct()
    names = names_of(held, most_names)
    item_kind, doc_kind = held.schema["id"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()
    item_windows = cut(held.mapInPandas(emit(names, None), WINDOW_SCHEMA.format(kind=item_kind)).toDF("item_id", "item_pos", "shape", "item_slots"))
    few = item_windows.count() <= most_windows
    wanted = np.sort(np.array([r[0] for r in item_windows.select("shape").distinct().collect()], np.int64).view(np.uint64)) if few else None
    doc_windows = docs.mapInPandas(emit(names, wanted), WINDOW_SCHEMA.format(kind=doc_kind)).toDF("doc_id", "doc_pos", "shape", "doc_slots")
    if few:
        met = doc_windows.join(F.broadcast(item_windows), "shape")
    else:
        places = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        met = doc_windows.withColumn("place", F.pmod(F.xxhash64("doc_id", "doc_pos"), F.lit(SPREAD)).cast("int")).join(item_windows.withColumn("place", places), ["shape", "place"])
    met = met.withColumn("same", F.col("doc_slots") == F.col("item_slots"))
    # slot consistency on one alignment: as many pairs as values on either side, over the item's length
    aligned = met.groupBy("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).agg(
        F.count("*").alias("windows"),
        F.count_if("same").alias("exact_windows"),
        F.min("doc_pos").alias("doc_pos"),
        F.min("item_pos").alias("item_pos"),
        F.min(F.when(F.col("same"), F.col("doc_pos"))).alias("exact_doc_pos"),
        F.min(F.when(F.col("same"), F.col("item_pos"))).alias("exact_item_pos"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "doc_slots")))).alias("mapping"),
    )
    size = lambda side: F.size(F.array_distinct(F.transform("mapping", lambda p: p[side])))
    consistent = (F.size("mapping") == size("item_slots")) & (F.size("mapping") == size("doc_slots"))
    kinds = aligned.withColumn("kind", F.when(F.col("exact_windows") > 0, "exact").when(consistent, "reparameterised")).where("kind is not null")
    exact = F.col("kind") == "exact"
    return kinds.groupBy("doc_id", "item_id", "kind").agg(
        F.sum(F.when(exact, F.col("exact_windows")).otherwise(F.col("windows"))).alias("windows"),
        F.min(F.when(exact, F.col("exact_doc_pos")).otherwise(F.col("doc_pos"))).alias("doc_word_start"),
        F.min(F.when(exact, F.col("exact_item_pos")).otherwise(F.col("item_pos"))).alias("item_word_start"),
    )
