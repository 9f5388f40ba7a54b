"""Files to text: readers by extension and content, applied to binary rows in one Arrow stage.

``extract(files)`` takes rows of the ``binaryFile`` source (path, content) and returns path, text, format,
metadata, warnings, error.  Readers use the standard library only; formats that need another one (RAR, 7z,
bar codes) are reported as unsupported.  An unreadable file gives an error row, never an exception; what a bound of a
reader (``ROW_LIMITS``, ``STRING_BYTES``) leaves out is named in its warnings.
"""

from __future__ import annotations

import base64
import html
import io
import json
import os
import re
import sqlite3
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilframe.sources import ole

MOST_BYTES = 100 * 1024 * 1024
MOST_RATIO = 100
#: Bounds of single files, for a task's memory; set an entry to None for no bound.
ROW_LIMITS: dict[str, int | None] = {"sqlite": 5_000, "parquet": 10_000}
STRING_BYTES = 10 * 1024 * 1024

Extracted = tuple[str, str, dict[str, str], list[str]]
Reader = Callable[[bytes, str], Extracted]
CUSTOM: dict[str, Reader] = {}


def register_extractor(extension: str, reader: Reader) -> None:
    """A reader of one's own; it goes before the built-in ones."""
    CUSTOM[extension.lower().lstrip(".")] = reader


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def strip_tags(markup: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", markup))).strip()


def unfold(text: str) -> str:
    return re.sub(r"\r?\n[ \t]", "", text)


def lines_of(text: str) -> list[str]:
    """Lines by line breaks only; other separators of Unicode belong to the text."""
    return re.split(r"\r\n|\n|\r", text)


def printable_strings(raw: bytes, least: int = 8) -> str:
    return "\n".join(x.decode("ascii") for x in re.findall(rb"[\x20-\x7e\t]{%d,}" % least, raw))[:STRING_BYTES]


def plain(raw: bytes, name: str) -> Extracted:
    return decoded(raw), "text", {}, []


def rtf(raw: bytes, name: str) -> Extracted:
    """Words of an RTF document: groups of tables and pictures are skipped, par and line break lines."""
    skip = re.compile(r"\\\*|\\(?:fonttbl|colortbl|stylesheet|info|pict|header|footer|footnote|annotation)\b")
    out, stack, hidden = [], [], False
    for m in re.finditer(r"([{}])|\\u(-?\d+)\??|\\([a-zA-Z]+)(-?\d+)? ?|\\'[0-9a-fA-F]{2}|\\([^a-zA-Z])|([^\\{}\r\n]+)", decoded(raw)):
        brace, code, word, _, sign, text = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif skip.match(m.group()):
            hidden = True
        elif hidden:
            continue
        elif code:
            out.append(chr(int(code) % 65536))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif text or sign:
            out.append(text or (sign if sign in "{}\\" else ""))
    return "".join(out).strip(), "rtf", {}, []


MAIL_HEADERS = ("from", "to", "subject", "date", "cc", "bcc")


def eml(raw: bytes, name: str) -> Extracted:
    head, _, body = decoded(raw).replace("\r\n", "\n").partition("\n\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in unfold(head).split("\n"))}
    kept = {k: fields[k] for k in MAIL_HEADERS if fields.get(k)}
    return "\n".join([*(f"{k.capitalize()}: {v}" for k, v in kept.items()), "", body]), "eml", kept, []


def mbox(raw: bytes, name: str) -> Extracted:
    messages = [m for m in re.split(r"(?m)^From .*\n", decoded(raw).replace("\r\n", "\n")) if m.strip()]
    texts = [re.sub(r"(?m)^--[\w=.+-]{6,}$\n?", "", eml(m.encode(), name)[0]) for m in messages]
    return "\n".join(texts), "mbox", {"message_count": str(len(messages))}, []


def mhtml(raw: bytes, name: str) -> Extracted:
    text = decoded(raw).replace("\r\n", "\n")
    boundary = re.search(r'boundary="?([^"\s;]+)', text)
    if not boundary:
        return eml(raw, name)[0], "mhtml", {}, []
    out = []
    for part in text.split("--" + boundary.group(1))[1:]:
        head, _, body = part.partition("\n\n")
        if "text/plain" in head.lower():
            out.append(body.strip())
        elif "text/html" in head.lower():
            out.append(strip_tags(body))
    return "\n".join(out), "mhtml", {}, []


def warc(raw: bytes, name: str) -> Extracted:
    out, count = [], 0
    for record in re.split(r"(?m)^WARC/1\.\d\s*$", decoded(raw).replace("\r\n", "\n")):
        head, _, body = record.strip("\n").partition("\n\n")
        if re.search(r"(?im)^WARC-Type:\s*(?:response|resource)", head):
            count += 1
            uri = re.search(r"(?im)^WARC-Target-URI:\s*(\S+)", head)
            out += [f"URI: {uri.group(1)}"] if uri else []
            out.append(strip_tags(body.partition("\n\n")[2] if body.startswith("HTTP/") else body))
    return "\n".join(out), "warc", {"record_count": str(count)}, []


CARD_LABELS = {"FN": "Name", "N": "Full Name", "EMAIL": "Email", "TEL": "Phone", "ADR": "Address", "ORG": "Organization", "TITLE": "Title", "BDAY": "Birthday", "URL": "URL", "NOTE": "Note", "NICKNAME": "Nickname", "ROLE": "Role", "UID": "UID", "GEO": "Geo", "IMPP": "IM", "TZ": "Timezone", "REV": "Revision"}


def card_line(key: str, value: str) -> str | None:
    base, *params = key.upper().split(";")
    if base not in CARD_LABELS:
        return None
    kind = next((p.partition("=")[2] for p in params if p.startswith("TYPE=")), "")
    if any("QUOTED-PRINTABLE" in p for p in params):
        import quopri

        value = quopri.decodestring(value.encode()).decode("utf-8", "replace")
    label = kind.capitalize() if kind and base in ("EMAIL", "TEL", "ADR") else CARD_LABELS[base]
    return f"{label}: " + ", ".join(x for x in re.split(r"(?<!\\);", value) if x)


def vcard(raw: bytes, name: str) -> Extracted:
    cards, lines = 0, []
    for line in lines_of(unfold(decoded(raw))):
        key, _, value = line.partition(":")
        if key.upper() == "BEGIN":
            cards += 1
            lines += ["---"] if cards > 1 else []
        elif made := card_line(key, value):
            lines.append(made)
    return "\n".join(lines), "vcard", {"contact_count": str(cards)}, []


def jcard(raw: bytes, name: str) -> Extracted:
    data = json.loads(decoded(raw))
    cards = [data] if data and data[0] == "vcard" else data
    lines = []
    for i, card in enumerate(cards):
        lines += ["---"] if i else []
        for prop in card[1]:
            if len(prop) >= 4:
                value = prop[3]
                flat = ", ".join(str(x) for x in value if x) if isinstance(value, list) else str(value).removeprefix("tel:")
                made = card_line(str(prop[0]), flat.replace(";", ","))
                lines += [made] if made else []
    return "\n".join(lines), "jcard", {"contact_count": str(len(cards))}, []


def contact_xml(raw: bytes, name: str) -> Extracted:
    lines = []
    for tag, value in re.findall(r"<(?:c:)?(\w+)[^>/]*>([^<]+)</(?:c:)?\w+>", decoded(raw)):
        if value.strip():
            lines.append(f"{re.sub(r'(?<=[a-z])(?=[A-Z])', ' ', tag)}: {html.unescape(value.strip())}")
    return "\n".join(lines) or strip_tags(decoded(raw)), "contact", {}, []


LDIF_LABELS = {"cn": "Name", "sn": "Surname", "givenname": "Given Name", "mail": "Email", "telephonenumber": "Phone", "mobile": "Mobile", "homephone": "Home Phone", "facsimiletelephonenumber": "Fax", "street": "Street", "postaladdress": "Address", "l": "City", "st": "State", "postalcode": "Postal Code", "c": "Country", "o": "Organization", "ou": "Unit", "title": "Title", "uid": "User ID", "employeenumber": "Employee Number", "description": "Description", "displayname": "Display Name", "homepostaladdress": "Home Address"}


def ldif(raw: bytes, name: str) -> Extracted:
    records, lines = 0, []
    for line in lines_of(unfold(decoded(raw))):
        key, _, value = line.partition(":")
        if value.startswith(":"):
            value = base64.b64decode(value[1:].strip()).decode("utf-8", "replace")
        else:
            value = value.strip()
        if key.lower() == "dn":
            records += 1
            lines += ["---"] if records > 1 else []
        elif key.lower() in LDIF_LABELS:
            lines.append(f"{LDIF_LABELS[key.lower()]}: " + (value.replace("$", ", ") if "address" in key.lower() else value))
    return "\n".join(lines), "ldif", {"record_count": str(records)}, []


ICS_ESCAPE = re.compile(r"\\([nN,;\\])")
ICS_LABELS = {"SUMMARY": "Summary", "DESCRIPTION": "Description", "LOCATION": "Location", "ORGANIZER": "Organizer", "ATTENDEE": "Attendee", "DTSTART": "Start", "DTEND": "End", "COMMENT": "Comment", "CONTACT": "Contact", "URL": "URL", "UID": "UID", "CATEGORIES": "Categories", "X-WR-CALNAME": "Calendar"}


def ics(raw: bytes, name: str) -> Extracted:
    events, lines = 0, []
    for line in lines_of(unfold(decoded(raw))):
        key, _, value = line.partition(":")
        base = key.split(";")[0].upper()
        if base == "BEGIN" and value.upper() in ("VEVENT", "VTODO", "VJOURNAL", "VFREEBUSY"):
            events += 1
        elif base in ICS_LABELS:
            who = re.search(r'CN="?([^";:]+)', key)
            value = re.sub(r"(?i)^mailto:", "", ICS_ESCAPE.sub(lambda m: "\n" if m.group(1) in "nN" else m.group(1), value))
            lines.append(f"{ICS_LABELS[base]}: " + (f"{who.group(1)} {value}" if who else value))
    return "\n".join(lines), "ics", {"event_count": str(events)}, []


def safe_parts(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of a ZIP that are neither bombs nor outside of it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            bomb = info.file_size > MOST_RATIO * max(info.compress_size, 1) or info.file_size > MOST_BYTES
            if not bomb and ".." not in info.filename.split("/") and not info.filename.startswith("/"):
                yield info.filename, z.read(info)


def zipped(raw: bytes, name: str) -> Extracted:
    """Office Open XML, OpenDocument or a plain archive (no text); a corrupt one gives its printable strings."""
    try:
        parts = dict(safe_parts(raw))
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
        return printable_strings(raw), "zip", {}, ["archive is corrupt"]
    spaced = lambda x: strip_tags(re.sub(r"</(?:w:p|a:p|text:p|text:h|row|si)>", r" \g<0>", decoded(x)))
    kinds = [("docx", r"word/(?:document|header\d*|footer\d*|comments|footnotes)\.xml"), ("xlsx", r"xl/(?:sharedStrings|worksheets/[^/]+)\.xml"), ("pptx", r"ppt/(?:slides|notesSlides)/[^/]+\.xml")]
    for kind, wanted in kinds:
        chosen = [n for n in parts if re.fullmatch(wanted, n)]
        if chosen:
            return "\n".join(spaced(parts[n]) for n in sorted(chosen)), kind, {}, []
    if "content.xml" in parts:
        return "\n".join(spaced(parts[n]) for n in ("content.xml", "meta.xml", "styles.xml") if n in parts), "opendocument", {}, []
    return "", "zip", {"members": str(len(parts))}, []


def sqlite(raw: bytes, name: str) -> Extracted:
    """Every user table, tab-separated."""
    lines, warnings, most = [], [], ROW_LIMITS["sqlite"]
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(raw)
        tables = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        for t in tables:
            quoted = '"' + t.replace('"', '""') + '"'
            rows = con.execute(f"select * from {quoted} limit {-1 if most is None else most}")
            if most is not None and con.execute(f"select count(*) from {quoted}").fetchone()[0] > most:
                warnings.append(f"table {t} has more than {most} rows")
            lines += [t, "\t".join(d[0] for d in rows.description)]
            lines += ["\t".join("" if v is None else str(v) for v in r) for r in rows]
    finally:
        con.close()
    return "\n".join(lines), "sqlite", {"table_count": str(len(tables))}, warnings


def parquet(raw: bytes, name: str) -> Extracted:
    import pyarrow.parquet as pq

    t = pq.read_table(io.BytesIO(raw))
    most = ROW_LIMITS["parquet"]
    head = (t if most is None else t.slice(0, most)).to_pylist()
    warnings = [f"more than {most} rows"] if most is not None and t.num_rows > most else []
    lines = ["\t".join(t.column_names), *("\t".join("" if v is None else str(v) for v in r.values()) for r in head)]
    return "\n".join(lines), "parquet", {"num_rows": str(t.num_rows), "num_columns": str(t.num_columns)}, warnings


def strings(raw: bytes, name: str) -> Extracted:
    try:
        return raw.decode("utf-8"), "dat", {}, []
    except UnicodeDecodeError:
        return printable_strings(raw), "dat", {}, []


def compound(raw: bytes, name: str) -> Extracted:
    """Outlook messages and older Office files: labelled fields, document properties and the text of their streams."""
    parts = ole.streams(raw)
    if any(k.startswith("__substg1.0_") for k in parts):
        return ole.message(parts), "msg", {}, []
    about = ole.summary(parts)
    kind, main = next(((k, parts[n]) for n, k in (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt")) if n in parts), ("ole", b"".join(v for k, v in sorted(parts.items()) if not k.startswith("\x05"))))
    return "\n".join([*(f"{k}: {v}" for k, v in about.items()), ole.words_of(main)]), kind, about, ["text is gathered from the streams, without layout"]


BY_EXTENSION: dict[str, Reader] = {
    **dict.fromkeys("txt text md markdown rst log csv tsv json jsonl xml html htm yaml yml toml ini cfg conf env properties py js ts java c h cpp hpp cs go rs rb php sh bash ps1 bat sql r scala kt swift tex srt vtt diff patch".split(), plain),
    "rtf": rtf, "eml": eml, "mbox": mbox, "mht": mhtml, "mhtml": mhtml, "warc": warc, "vcf": vcard, "vcard": vcard, "jcard": jcard, "contact": contact_xml, "ldif": ldif, "ldf": ldif, "ics": ics, "ical": ics,
    **dict.fromkeys("docx xlsx pptx docm xlsm pptm zip odt ods odp".split(), zipped), "db": sqlite, "sqlite": sqlite, "sqlite3": sqlite, "parquet": parquet, "dat": strings, "cab": strings, "pdf": plain, **dict.fromkeys("msg doc xls ppt".split(), compound),
}
#: Extensions that are never read, and those that cannot be.
BLOCKED = frozenset("exe dll so dylib msi com scr sys drv ocx cpl vbs".split())
UNREADABLE = frozenset("gpg pgp asc aes enc kdbx axx rar 7z png jpg jpeg gif bmp tiff webp".split())


def by_content(raw: bytes) -> Reader:
    """Reader by magic bytes, then by the first lines."""
    for magic, reader in ((b"%PDF", plain), (b"{\\rtf", rtf), (b"PK\x03\x04", zipped), (b"SQLite format 3\0", sqlite), (b"PAR1", parquet), (b"MSCF", strings), (ole.MAGIC, compound)):
        if raw.startswith(magic):
            return reader
    head = raw[:8192].decode("utf-8", "ignore").lstrip()
    for start, reader in (("BEGIN:VCARD", vcard), ("BEGIN:VCALENDAR", ics), ("dn:", ldif), ("From ", mbox), ("WARC/", warc), ('["vcard"', jcard)):
        if head.startswith(start):
            return reader
    if re.search(r"(?i)^content-type:\s*multipart/related", head, re.M):
        return mhtml
    return contact_xml if "<c:contact" in head else plain


def suffix(path: str) -> str:
    return os.path.basename(path).rpartition(".")[2].lower() if "." in os.path.basename(path) else ""


def is_blocked(path: str) -> bool:
    """Any dot segment of the name counts, so ``invoice.exe.txt`` is blocked."""
    return any(x in BLOCKED for x in os.path.basename(path).lower().split(".")[1:])


def extract_one(path: str, raw: bytes) -> tuple[str, str, str, dict[str, str], list[str], str | None]:
    ext = suffix(path)
    if is_blocked(path):
        return path, "", "blocked", {}, [], "blocked extension"
    if ext in UNREADABLE:
        return path, "", ext, {}, [], "unsupported format"
    if len(raw) > MOST_BYTES:
        return path, "", ext, {}, [], "file is too large"
    reader = CUSTOM.get(ext) or BY_EXTENSION.get(ext) or by_content(raw)
    try:
        text, kind, metadata, warnings = reader(raw, path)
        return path, text, kind, metadata, warnings, None
    except Exception as e:  # a file that breaks its reader is a row with an error
        return path, printable_strings(raw, 12), ext, {}, [f"reader failed: {type(e).__name__}"], str(e)[:200]


def extract(files: DataFrame) -> DataFrame:
    """(path, text, format, metadata, warnings, error) of binary rows (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([extract_one(p, bytes(c or b"")) for p, c in zip(frame["path"], frame["content"])], columns=["path", "text", "format", "metadata", "warnings", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, format string, metadata map<string,string>, warnings array<string>, error string")


def listed(spark: SparkSession, paths: str | list[str], recursive: bool, most_files: int) -> DataFrame:
    """Binary rows of the files, names with a leading dot left out; more than ``most_files`` raise an error before any is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths).where(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    if files.select("path").limit(most_files + 1).count() > most_files:
        raise ValueError(f"more than {most_files} files")
    return files


def read_directory(spark: SparkSession, path: str, recursive: bool = True, most_files: int = 100_000) -> DataFrame:
    """Texts of all files below a folder; names that begin with a dot are left out."""
    return extract(listed(spark, path, recursive, most_files))


def scan_files(spark: SparkSession, paths: str | list[str], config=None, allowed: list[str] = (), recursive: bool = True, most_files: int = 100_000) -> DataFrame:
    """One row per file of a folder or a list of files: path, format, status, error, warnings, scan_truncated, n_findings, findings.

    Files whose path matches a glob of ``allowed`` are not read: their status is ``allowed``. Otherwise the status is
    ``error``, ``clean`` or ``findings``.
    """
    from veilframe.operators.protect import glob_pattern
    from veilframe.operators.scan import scan_documents

    files = listed(spark, paths, recursive, most_files)
    name = F.regexp_replace("path", "^file:/*", "/")
    skip = F.lit(False)
    for g in allowed:
        skip = skip | name.rlike(glob_pattern(g))
    texts = extract(files.where(~skip))
    scanned = scan_documents(texts.select(F.struct("path", "format", "error", "warnings").alias("file"), "text"), config, doc_id="file")
    status = F.when(F.col("doc_id.error").isNotNull(), "error").when(F.size("findings") > 0, "findings").otherwise("clean")
    done = scanned.select("doc_id.path", "doc_id.format", status.alias("status"), "doc_id.error", "doc_id.warnings", "scan_truncated", F.size("findings").alias("n_findings"), "findings")
    left = files.where(skip).select("path", *[F.lit("allowed" if f.name == "status" else None).cast(f.dataType).alias(f.name) for f in done.schema.fields[1:]])
    return done.union(left)


def with_row_number(rows: DataFrame) -> DataFrame:
    """Adds ``file`` and ``row``, the number of the row in its file from 1, the same in every run.

    Rows are counted per block of a file; only the blocks' counts are gathered, and each row's place in its block comes from the
    order in which the block is read.
    """
    placed = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("_before", before).drop("_size")
    return placed.join(starts, ["file", "_block"]).withColumn("row", F.col("_n") - F.col("_first") + F.col("_before") + 1).drop("_block", "_n", "_first", "_before")


def read_csv_rows(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """(source_id, text): chosen columns of each row, trimmed and joined; empty rows are left out. Ids are ``path:row:n``."""
    df = spark.read.option("header", True).option("sep", delimiter).csv(path)
    names = columns or df.columns
    text = F.concat_ws(" ", *[F.trim(F.col(f"`{c}`")) for c in names])
    rows = with_row_number(df.select(text.alias("text"), "_metadata"))
    return rows.where("text <> ''").select(F.concat("file", F.lit(":row:"), "row").alias("source_id"), "text")


def json_text(fields: list[str] | None) -> Callable:
    keys = F.array(*[F.lit(f) for f in fields]) if fields else F.sort_array(F.map_keys("m"))
    return F.array_join(F.filter(F.transform(keys, lambda k: F.try_element_at("m", k)), lambda x: x.isNotNull()), " ")


def read_json_rows(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """(source_id, text): values of JSON lines, chosen or all, in order of their keys. Ids are ``path:record:n``."""
    lines = with_row_number(spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m"), "_metadata"))
    return lines.select(F.concat("file", F.lit(":record:"), "row").alias("source_id"), json_text(fields).alias("text")).where("text <> ''")


def read_json_documents(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """(source_id, text) of whole files that hold one JSON array of objects, or one object; a file is read by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    array = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.concat(F.lit("["), "v", F.lit("]")))
    rows = files.select("file", F.posexplode(F.from_json(array, "array<map<string,string>>")).alias("n", "m"))
    return rows.select(F.concat("file", F.lit(":record:"), F.col("n") + 1).alias("source_id"), json_text(fields).alias("text")).where("text <> ''")


def file_metadata(files: DataFrame) -> DataFrame:
    """(path, content_hash, size_bytes, kind, creator, application, company, rsids, pdf_doc_id) for attribution."""

    def one(path: str, raw: bytes) -> tuple:
        creator = application = company = doc_id = None
        rsids: list[str] = []
        if raw.startswith(b"PK"):
            try:
                parts = dict(safe_parts(raw))
                tag = lambda part, name: (m.group(1) if (m := re.search(rf"<(?:\w+:)?{name}[^>]*>([^<]*)<", decoded(parts.get(part, b"")))) else None)
                creator, application, company = tag("docProps/core.xml", "creator"), tag("docProps/app.xml", "Application"), tag("docProps/app.xml", "Company")
                settings = decoded(parts.get("word/settings.xml", b""))
                rsids = list(dict.fromkeys(re.findall(r'w:rsidRoot w:val="([0-9A-F]+)"', settings) + re.findall(r'w:rsid w:val="([0-9A-F]+)"', settings)))
            except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
                pass
        elif raw.startswith(ole.MAGIC):
            try:
                about = ole.summary(ole.streams(raw))
                creator, application, company = about.get("creator"), about.get("application"), about.get("company")
            except (ValueError, struct.error):
                pass
        elif raw.startswith(b"%PDF"):
            text = raw.decode("latin-1")
            field = lambda name: (m.group(1) if (m := re.search(rf"/{name}\s*\(([^)]*)\)", text)) else None)
            creator, application = field("Author"), field("Producer")
            ids = re.search(r"/ID\s*\[\s*<([0-9A-Fa-f]+)>", text)
            doc_id = ids.group(1) if ids else None
        return path, len(raw), suffix(path), creator, application, company, rsids, doc_id

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(p, bytes(c or b"")) for p, c in zip(frame["path"], frame["content"])], columns=["path", "size_bytes", "kind", "creator", "application", "company", "rsids", "pdf_doc_id"])

    made = files.select("path", "content").mapInPandas(run, "path string, size_bytes bigint, kind string, creator string, application string, company string, rsids array<string>, pdf_doc_id string")
    return made.join(files.select("path", F.sha2("content", 256).alias("content_hash")), "path")
