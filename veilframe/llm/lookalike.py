"""One consistent form for text that looks the same, computed by DuckDB inside Arrow partitions.

Every Arrow batch is registered as a table of an in-process DuckDB connection and one embedded SQL
statement maps it: invisible characters are removed, ligatures spelled out, width variants and
blanks brought to one width, accents composed (``nfc_normalize``) and look-alike letters of
other scripts replaced by one prototype.  Case, accents, digits and raised digits are kept.

Defined results: a null text stays null, an empty text stays empty; texts are taken whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.confusables import LOOK_ALIKE
from veilframe.session import by_key, cut, in_parts, spread_over, with_parts

COPIES = 4096  # rows of one look or spelling in a part of a join

# Characters without a look of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff"
# The blanks that are a blank of another width.
BLANKS = "               　"


#: Kinds of compatibility forms that look like their plain characters: other widths, positions, fonts, blanks and squared words.
SAME_LOOK = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>", "<square>", "<noBreak>"}


@cache
def tables() -> tuple[str, str, list[tuple[str, str]], str, str, list[tuple[str, str]]]:
    """(width from, width to, ligatures, look-alike from, look-alike to, look-alikes with marks of their own), by rule over all code points of the Unicode database."""
    width, ligatures = dict.fromkeys(BLANKS, " "), []
    alike = {x: k for k, v in LOOK_ALIKE.items() for x in v}
    marked: list[tuple[str, str]] = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind, *rest = unicodedata.decomposition(char).split() or [""]
        if not kind:
            continue
        if kind[0] == "<":
            plain = unicodedata.normalize("NFKC", char)
            # ligatures, numerals and radicals; signs and the long s have looks of their own
            spelled = kind == "<compat>" and plain.isalpha() and plain.upper() != "S" and unicodedata.category(char)[0] in "LN"
            spelled |= 0x2E80 <= code < 0x2FE0
            if kind not in SAME_LOOK and not spelled or plain == char:
                continue
            if len(plain) == 1:
                width[char] = plain
            elif not plain.startswith(" "):
                ligatures.append((char, plain))
        else:  # a letter with marks whose base has a prototype
            base, *marks = unicodedata.normalize("NFD", char)
            if base in alike and marks and char not in alike:
                plain = unicodedata.normalize("NFC", alike[base] + "".join(marks))
                if len(plain) == 1:
                    alike[char] = plain
                else:
                    marked.append((char, plain))
    width["ﾞ"], width["ﾟ"] = "゙", "゚"  # the half-width voice marks compose with what is before them
    return "".join(width), "".join(width.values()), ligatures, "".join(alike), "".join(alike.values()), marked


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(column: str, pairs: list[tuple[str, str]]) -> str:
    """SQL that spells out single characters, only in texts that have one."""
    for_all = column
    for x, y in pairs:
        for_all = f"replace({for_all}, {quoted(x)}, {quoted(y)})"
    return f"case when regexp_matches({column}, '[{''.join(x for x, _ in pairs)}]') then {for_all} else {column} end"


def translated(column: str, source: str, target: str) -> str:
    """SQL that maps characters, only in texts that have one."""
    return f"case when regexp_matches({column}, '[{source}]') then translate({column}, {quoted(source)}, {quoted(target)}) else {column} end"


@cache
def statement() -> str:
    """The embedded SQL; its input is the table ``batch`` with a column ``t``."""
    width_from, width_to, ligatures, alike_from, alike_to, marked = tables()
    common = [(x, y) for x, y in ligatures if ord(x) < 0xFB50]
    rare = [(x, y) for x, y in ligatures if ord(x) >= 0xFB50]
    steps = [
        f"regexp_replace(t, '[{INVISIBLE}]', '', 'g')", replaced("t", common), *(replaced("t", rare[i : i + 300]) for i in range(0, len(rare), 300)), translated("t", width_from, width_to), "nfc_normalize(t)",
        translated("t", alike_from, alike_to), *([replaced("t", marked)] if marked else []), "nfc_normalize(t)",
    ]
    inner = "select rowid as i, t from batch"
    for step in steps:
        inner = f"select i, {step} as t from ({inner})"
    return f"select t as form from ({inner}) order by i"


def uniform(texts: pa.Array) -> pa.Array:
    """The consistent form of every text of an Arrow array."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": "1"}) as con:
        con.register("source", pa.table({"t": texts.cast(pa.string())}))
        con.execute("create table batch as select t from source")
        made = con.sql(statement()).to_arrow_table().column("form").combine_chunks()
    return made.cast(pa.string())


def with_form(df: DataFrame, text: str = "text", form: str = "uniform_text") -> DataFrame:
    """``df`` with the consistent form of its column ``text`` added as ``form`` (an existing column of that name is replaced)."""
    kept = [f for f in df.schema.fields if f.name != form]
    names = [f"c{i}" for i in range(len(kept))]
    place = [f.name for f in kept].index(text)
    plain = df.select([c for c in df.columns if c != form]).toDF(*names)
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, kept)] + [T.StructField("form", T.StringType(), True)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = uniform(batch.column(place)) if batch.num_rows else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, "form"])

    return plain.mapInArrow(mapped, schema).toDF(*[f.name for f in kept], form)


def same_look_pairs(records: DataFrame, record_id: str, text: str = "text", origin: str | None = None) -> DataFrame:
    """Pairs (id_a, id_b), smaller id first, of records that look the same but differ in characters.

    Exact copies are collapsed before texts are mapped or compared: pairs are made between
    the different spellings of one look, and only then spread to the ids of each spelling.
    A record without text has no pair. With ``origin``, a column, only records of the same origin are paired, in one pass over
    all of them, and the result has the column. The result lists every pair; ``with_form`` is the form for large groups of
    one look, whose rows are cut into parts here on both sides of each join.
    """
    of = F.lit("") if origin is None else F.col(origin)
    rows = records.select(of.alias("origin"), F.col(record_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    spelling: Column = F.unhex(F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 32))
    members = rows.select("origin", "id", spelling.alias("spelling")).distinct()
    distinct = by_key(rows.select("text"), "text").distinct()
    forms = with_form(distinct, "text").select(spelling.alias("spelling"), F.unhex(F.substring(F.sha2("uniform_text", 256), 1, 32)).alias("look"))
    forms = cut(forms)  # hashes only
    several = forms.groupBy("look").count().where("count > 1").select("look")
    sized = cut(with_parts(forms.join(several, "look", "left_semi"), ["look"], COPIES, ["spelling"]))
    other = in_parts(sized).select("look", "part", F.col("spelling").alias("b"))
    pairs = spread_over(sized, ["spelling"]).select("look", "part", F.col("spelling").alias("a")).join(other, ["look", "part"]).where("a < b").select("a", "b")
    held = cut(with_parts(members.join(sized.select("spelling"), "spelling", "left_semi"), ["origin", "spelling"], COPIES, ["id"]))
    parts = held.groupBy("origin", "spelling").agg(F.max("parts").alias("parts"))
    placed = spread_over(held, ["id"])
    for key, id_, part in (("a", "x", "part_a"), ("b", "y", "part_b")):
        on = [key] if key == "a" else ["origin", key]
        pairs = in_parts(pairs.join(parts.withColumnRenamed("spelling", key), on), "parts", part).drop("parts")
        pairs = pairs.join(placed.select("origin", F.col("spelling").alias(key), F.col("part").alias(part), F.col("id").alias(id_)), ["origin", key, part])
    found = pairs.where("x <> y").select("origin", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    return found.drop("origin") if origin is None else found.withColumnRenamed("origin", origin)
