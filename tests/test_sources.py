import io
import sqlite3
import zipfile

from veilframe.sources import extract as X
from veilframe.sources import sinks


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def text_of(path, raw):
    return X.extract_one(path, raw)[1]


def test_readers():
    assert text_of("a.docx", archive({"word/document.xml": "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>"})) == "one two"
    assert "two" in text_of("a.odt", archive({"content.xml": "<text:p>two</text:p>", "mimetype": "x"}))
    assert text_of("a.mbox", b"From x\nSubject: s\n\nbody1\nFrom y\nSubject: t\n\nbody2\n").count("Subject") == 2
    assert "hello" in text_of("a.mht", b'Content-Type: multipart/related; boundary="bb"\n\n--bb\nContent-Type: text/html\n\n<p>hello</p>\n--bb--')
    assert "inner" in text_of("a.warc", b"WARC/1.0\nWARC-Type: response\nWARC-Target-URI: http://h\n\nHTTP/1.1 200\nA: b\n\n<p>inner</p>\n")
    assert text_of("a.jcard", b'["vcard",[["fn",{},"text","Jo"],["tel",{},"uri","tel:+1"]]]') == "Name: Jo\nPhone: +1"
    con = sqlite3.connect(":memory:")
    con.execute("create table t (a, b)")
    con.execute("insert into t values (1, 'x')")
    con.commit()
    assert text_of("a.db", con.serialize()) == "t\na\tb\n1\tx"


def test_guards():
    assert X.extract_one("invoice.exe.txt", b"x")[5] == "blocked extension"
    assert X.extract_one("a.rar", b"x")[5] == "unsupported format"
    assert X.extract_one("broken.zip", b"PK\x03\x04 some printable text here")[3:5] == ({}, ["archive is corrupt"])
    bomb = archive({"word/document.xml": "0" * 5_000_000})
    assert text_of("a.docx", bomb) == ""
    assert X.extract_one("a.jcard", b"{")[5]
    assert X.extract_one("none", b"")[1] == ""


def test_directory_and_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.eml").write_text("From: x@y.z\n\nbeta")
    got = sorted(r.text for r in X.read_directory(spark, str(tmp_path)).collect())
    assert got == ["From: x@y.z\n\nbeta", "alpha"]
    (tmp_path / "c.csv").write_text("n,m\n a , b\n,\n")
    assert [r.text for r in X.read_csv_rows(spark, str(tmp_path / "c.csv")).collect()] == ["a b"]
    (tmp_path / "d.jsonl").write_text('{"b":"2","a":"1"}\n{"a":"3"}\n')
    assert sorted(r.text for r in X.read_json_rows(spark, str(tmp_path / "d.jsonl")).collect()) == ["1 2", "3"]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([(1, "c", "s", '=cmd,"x" is long', 0.5, True, 0, 3)], "doc_id int, category string, sub_category string, text string, confidence double, has_context boolean, span_start int, span_end int")
    assert sinks.csv_lines(f).first().line.startswith('1,c,s,"=cm')
    sinks.write_findings(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert "PASS" in sinks.compliance_text([("GDPR", 0, True)])


def test_metadata_attribution(spark):
    from veilframe.operators.findings import attribution_pairs

    core = "<dc:creator>Jo</dc:creator>"
    settings = '<w:rsidRoot w:val="00A1"/><w:rsid w:val="00B2"/>'
    files = spark.createDataFrame([("a.docx", bytearray(archive({"docProps/core.xml": core, "word/settings.xml": settings}))), ("b.docx", bytearray(archive({"docProps/core.xml": core, "word/settings.xml": settings}))), ("c.pdf", bytearray(b"%PDF /Author (Al) /ID [<ab> <cd>]"))], "path string, content binary")
    meta = X.file_metadata(files)
    pairs = attribution_pairs(meta).collect()
    assert [(r.a, r.b, round(r.total, 2)) for r in pairs] == [("a.docx", "b.docx", 0.95)]


def compound_file(streams):
    """A compound file with one level of streams, written from the published layout: 512-byte sectors, small streams in the mini stream."""
    import struct

    mini, mini_table, entries = b"", [], []
    for name, data in streams.items():
        n = -(-len(data) // 64)
        entries.append((name, 2, len(mini_table), len(data)))
        mini_table += [len(mini_table) + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        mini += data.ljust(n * 64, b"\0")
    sectors = -(-len(mini) // 512)
    directory_sectors = -(-(len(entries) + 1) // 4)
    # sectors: 0 table, 1 mini table, then directory, then the mini stream
    table = [0xFFFFFFFD, 0xFFFFFFFE] + [3 + i for i in range(directory_sectors - 1)] + [0xFFFFFFFE]
    first = len(table)
    table += [first + i + 1 for i in range(sectors - 1)] + [0xFFFFFFFE]
    pack = lambda name, kind, left, right, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", len(name) * 2 + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    none = 0xFFFFFFFF
    listing = pack("Root Entry", 5, none, none, 1, first, len(mini))
    for i, (name, kind, start, size) in enumerate(entries, 1):
        listing += pack(name, kind, none, i + 1 if i < len(entries) else none, none, start, size)
    header = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 2, 0, 4096, 1, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[none] * 108)
    words = lambda x: struct.pack(f"<{len(x)}I", *x).ljust(512, b"\xff")
    return header + words(table) + words(mini_table) + listing.ljust(directory_sectors * 512, b"\0") + mini.ljust(sectors * 512, b"\0")


def property_set(values):
    import struct

    body, places = b"", []
    for number, text in values.items():
        places.append((number, 8 + 8 * len(values) + len(body)))
        raw = text.encode("cp1252") + b"\0"
        body += struct.pack("<II", 30, len(raw)) + raw + b"\0" * (-len(raw) % 4)
    section = struct.pack("<II", 8 + 8 * len(values) + len(body), len(values)) + b"".join(struct.pack("<II", *p) for p in places) + body
    return b"\0" * 24 + struct.pack("<I", 1) + b"\0" * 16 + struct.pack("<I", 48) + section


def test_compound_files():
    from veilframe.sources import ole
    from veilframe.sources.extract import extract_one

    mail = compound_file({"__substg1.0_0037001F": "Quarterly figures".encode("utf-16-le"), "__substg1.0_0C1A001F": "Ann Lee".encode("utf-16-le"), "__substg1.0_1000001F": ("Dear all, the files are late. " * 20).encode("utf-16-le")})
    path, text, kind, _, _, error = extract_one("/x/a.msg", mail)
    assert kind == "msg" and error is None and text.startswith("Subject: Quarterly figures\nFrom: Ann Lee\nDear all,")
    old = compound_file({"WordDocument": b"\x00\x01" * 40 + b"Some words of an old document." + b"\0" * 9, "\x05SummaryInformation": property_set({2: "Plan", 4: "Bob"})})
    path, text, kind, about, _, error = extract_one("/x/b.doc", old)
    assert kind == "doc" and about == {"title": "Plan", "creator": "Bob"} and "Some words of an old document." in text
    assert ole.file_time(132_223_104_000_000_000) == "2020-01-01T00:00:00Z" and ole.file_time(0) is None
    assert extract_one("/x/c.doc", ole.MAGIC + b"broken")[5] is not None


def test_rows_have_stable_numbers(spark, tmp_path):
    from veilframe.sources import extract as X

    (tmp_path / "a.csv").write_text("name,note\n" + "".join(f"n{i},{'' if i == 3 else 'x' * 50}\n" for i in range(1, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = X.read_csv_rows(spark, str(tmp_path / "a.csv")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2999 and all(r.source_id.endswith(f"a.csv:row:{r.text.split(' ')[0][1:]}") for r in got)
    (tmp_path / "b.json").write_text('[{"a": "one", "b": 2}, {"a": "three"}]')
    (tmp_path / "c.json").write_text('{"a": "single"}')
    (tmp_path / "d.jsonl").write_text('{"a": "one"}\nbroken\n{"a": "three"}\n')
    whole = {r.source_id.rpartition("/")[2]: r.text for r in X.read_json_documents(spark, str(tmp_path / "*.json")).collect()}
    assert whole == {"b.json:record:1": "one 2", "b.json:record:2": "three", "c.json:record:1": "single"}
    assert {r.source_id.rpartition(":")[2]: r.text for r in X.read_json_rows(spark, str(tmp_path / "d.jsonl")).collect()} == {"1": "one", "3": "three"}


def test_folder_scan(spark, tmp_path):
    from veilframe.sources import extract as X

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("mail anna@example.com")
    (tmp_path / "sub" / "b.txt").write_text("nothing")
    (tmp_path / "sub" / "c.7z").write_bytes(b"7z")
    (tmp_path / "skip.txt").write_text("mail anna@example.com")
    (tmp_path / ".hidden").write_text("mail anna@example.com")
    got = {r.path.rpartition("/")[2]: (r.status, r.n_findings) for r in X.scan_files(spark, str(tmp_path), allowed=["**/skip.*"]).collect()}
    assert got == {"a.txt": ("findings", 1), "b.txt": ("clean", 0), "c.7z": ("error", 0), "skip.txt": ("allowed", None)}
    import pytest

    with pytest.raises(ValueError):
        X.scan_files(spark, str(tmp_path), most_files=2)


def test_bounds_of_readers_are_told(monkeypatch):
    import sqlite3

    from veilframe.sources import extract as X

    con = sqlite3.connect(":memory:")
    con.execute("create table t (a)")
    con.executemany("insert into t values (?)", [(i,) for i in range(9)])
    monkeypatch.setitem(X.ROW_LIMITS, "sqlite", 5)
    assert X.extract_one("x.db", con.serialize())[4] == ["table t has more than 5 rows"]
    monkeypatch.setitem(X.ROW_LIMITS, "sqlite", None)
    assert X.extract_one("x.db", con.serialize())[1].count("\n") == 10
