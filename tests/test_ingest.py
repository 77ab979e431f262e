"""FictionBook files, pages and byte decoding."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.chapters import chapter_rows, with_chapters
from lectern.sources import bookfiles, encoding, fictionbook, webpages

NS = fictionbook.NAMESPACE


def book(inner, head=""):
    return f'<?xml version="1.0"?><FictionBook xmlns="{NS}" xmlns:x="urn:x">{head}{inner}</FictionBook>'


def parsed(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.fb2").write_bytes(data if isinstance(data, bytes) else data.encode())
    rows = fictionbook.parse_books(fictionbook.read_files(spark, str(tmp_path)))
    return rows.withColumn("path", F.regexp_extract("path", r"([^/]+)\.fb2$", 1))


def chapters(rows, limit=100):
    found = chapter_rows(with_chapters(fictionbook.books(rows), limit)).orderBy("book_id", "chapter_number")
    return [(r["title"], list(r["segments"])) for r in found.collect()]


class Tree:
    """A random document of sections, built next to what reading it must give."""

    def __init__(self, seed):
        self.draw = random.Random(seed)
        self.count = 0
        self.rows = []

    def word(self):
        self.count += 1
        return f"w{self.count}"

    def block(self, section, path):
        """Mark-up of one block; its expected row is noted."""
        kind = self.draw.choice(["p", "subtitle", "split", "nested", "image", "cell", "foreign"])
        one, two = self.word(), self.word()
        mark = {
            "p": f"<p>{one}  {two}</p>", "subtitle": f"<subtitle>{one} {two}</subtitle>",
            "split": f"<p>{one}<strong> {two}</strong></p>",
            "nested": f"<cite><p>{one} {two}</p></cite>",
            "image": f'<image x:href="#i" alt="{one}   {two}"/>',
            "cell": f"<table><tr><td>{one} {two}</td></tr></table>",
            "foreign": f"<x:note>{one} {two}</x:note>"}[kind]
        if kind != "foreign":
            self.rows.append((section, path if section is not None else None, f"{one} {two}"))
        return mark

    def section(self, number, path, depth):
        titled = self.draw.random() < 0.6
        title = self.word() if titled else ""
        inner = path + [title] if titled else path
        own, parts = number[0], []
        for _ in range(self.draw.randrange(0, 4)):
            if depth < 3 and self.draw.random() < 0.4:
                number[0] += 1
                parts.append(self.section(number, inner, depth + 1))
            else:
                parts.append(self.block(own, inner))
        head = f"<title><p>{title}</p></title>" if titled else ""
        return f"<section>{head}{''.join(parts)}</section>"

    def body(self):
        number, parts = [0], []
        for _ in range(self.draw.randrange(1, 5)):
            if self.draw.random() < 0.7:
                number[0] += 1
                parts.append(self.section(number, [], 0))
            else:
                parts.append(self.block(None, []))
        return f"<body>{''.join(parts)}</body>"


def test_random_section_trees():
    """Blocks, their sections and titles in the order of the document."""
    spoken = 0
    for seed in range(200):
        tree = Tree(seed)
        found = fictionbook.read_book(book(tree.body()).encode())
        if not tree.rows:
            assert found["reject"] == "no_content"
            continue
        spoken += 1
        assert found["reject"] is None
        assert [(b["section_id"], b["section_path"], b["text"])
                for b in found["blocks"]] == tree.rows, seed
        assert [b["block_no"] for b in found["blocks"]] == list(range(len(tree.rows)))
    assert spoken > 100


def test_metadata_and_chapters(spark, tmp_path):
    people = "".join(
        f"<author>{''.join(f'<{tag}> {name} </{tag}>' for tag, name in parts)}</author>"
        for parts in ([("first-name", "Mira"), ("last-name", "Olt")], [("nickname", "quill")],
                      [("first-name", "Jo"), ("middle-name", ""), ("last-name", "Pel")]))
    head = (f"<description><title-info>{people}<book-title>Seven\n  Lamps</book-title>"
            "</title-info></description>")
    sections = "".join(
        f"<section><title><p>Lamp {n}</p></title><p>Lit at {n}.</p></section>" for n in (1, 2, 3))
    rows = parsed(spark, tmp_path, lamps=book(f"<body>{sections}</body>", head),
                  bare=book("<body><section><p>Only this.</p></section></body>"))
    meta = {r["book_id"]: (r["title"], list(r["authors"]))
            for r in fictionbook.metadata(rows).collect()}
    assert meta == {"lamps": ("Seven Lamps", ["Mira Olt", "quill", "Jo Pel"]), "bare": ("", [])}
    assert chapters(rows) == [("", ["Only this."])] + [
        (f"Lamp {n}", [f"Lit at {n}."]) for n in (1, 2, 3)]


@pytest.mark.parametrize("charset", ["utf-8", "utf-16", "windows-1251", "koi8-r"])
def test_charsets(charset):
    line = "Съешь ещё этих булок"
    text = book(f"<body><section><p>{line}</p></section></body>").replace(
        '"1.0"', f'"1.0" encoding="{charset}"')
    assert [b["text"] for b in fictionbook.read_book(text.encode(charset))["blocks"]] == [line]


def test_every_cut_document_is_refused():
    whole = book("<body><section><p>lantern</p></section></body>").encode()
    assert fictionbook.read_book(whole)["reject"] is None
    for size in range(len(whole)):
        reason = fictionbook.read_book(whole[:size])["reject"]
        assert reason in ("malformed", "not_fb2"), size
    for size in range(1, 40):
        tail = b"<" + b"z" * size + b"/>"
        assert fictionbook.read_book(whole + tail)["reject"] == "trailing_data"
    for fine in (b"\n", b"  <!-- z -->", b"<?z z?>"):
        assert fictionbook.read_book(whole + fine)["reject"] is None


def test_documents_without_a_readable_body():
    def swapped(old, new):
        return book("<body><section><p>lantern</p></section></body>").replace(old, new).encode()

    reasons = {
        "no_body": [swapped("body>", "poem>"), swapped("body>", "x:body>")],
        "no_content": [swapped("lantern", " "), swapped("lantern", "* * *"),
                       swapped("<p>lantern</p>", "")],
        "not_fb2": [swapped(NS, "urn:lantern"), swapped("FictionBook", "Lantern"), b"", b"lantern",
                    None],
    }
    for reason, documents in reasons.items():
        assert [fictionbook.read_book(d)["reject"] for d in documents] == [reason] * len(documents)


def test_oversized_files_are_rejects(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fictionbook, "MAX_FILE_BYTES", 300)
    for name, words in (("small", 3), ("large", 300)):
        (tmp_path / f"{name}.fb2").write_text(
            book(f"<body><section><p>{'word ' * words}</p></section></body>"))
    rows = fictionbook.parsed_files(spark, str(tmp_path))
    found = {r["path"].rpartition("/")[2]: r["reject"] for r in rows.collect()}
    assert found == {"small.fb2": None, "large.fb2": "too_large"}
    assert [r["reject"] for r in fictionbook.rejects(rows).collect()] == ["too_large"]


def test_pages_keep_their_text():
    assert webpages.page_text("<p>a</p><embed src=x><p>b</p>") == ["a", "b"]
    assert webpages.page_text("<body><p>a</p><form><p>b</p><p>c</p></body>") == ["a", "b", "c"]
    assert webpages.page_text("<body><p>a</p><form><p>b</p></form><p>c</p></body>") == ["a", "c"]
    assert webpages.page_text("<title>t</title><p>a</p>") == ["a"]
    assert webpages.page_text("<html><head><title>t</title></head><p>a</p></html>") == ["a"]
    assert webpages.page_text("<body><script>x") == []


def test_page_text():
    page = ("<html><head><title>no</title></head><body><nav><ul><li>menu</ul></nav>"
            "<script>var a='</p>'</script><h1>Head</h1>one<br>two <b>bold</b> <i>it</i>"
            "<ul><li>first<li>second</ul><hr>end&nbsp;&amp; done<svg><text>x</text></svg></body>")
    assert webpages.page_text(page) == [
        "Head", "one\ntwo bold it", "- first", "- second", "* * *", "end & done"]


def test_empty_page(spark):
    rows = spark.createDataFrame([(1, "<body><script>x</script></body>")], "page_id int, html string")
    row = webpages.page_texts(rows).first()
    assert (list(row["blocks"]), row["warning"]) == ([], "EMPTY_BODY")


def test_decoding(spark):
    cases = [
        (b"plain", None, "utf-8", "plain", "ok"),
        ("жук".encode("cp1251"), "windows-1251", "windows-1251", "жук", "ok"),
        ("жук".encode("utf-16"), None, "utf-16", "жук", "ok"),
        (b"\xef\xbb\xbfbom", "latin-1", "utf-8-sig", "bom", "ok"),
        (b"a\xff\xfeb", None, "utf-8-replace", "a\ufffd\ufffdb", "too_many_replacements"),
        (b"", None, "utf-8", "", "empty"),
    ]
    frame = spark.createDataFrame(
        [(i, bytearray(c[0]), c[1]) for i, c in enumerate(cases)],
        "i int, content binary, charset string")
    found = sorted(encoding.decode_audit(frame).collect(), key=lambda r: r["i"])
    assert [(r["encoding"], r["text"], r["verdict"]) for r in found] == [c[2:] for c in cases]


@pytest.fixture
def book_files(spark, tmp_path):
    for k in range(12):
        folder = tmp_path / f"part{k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.fb2").write_text(book(
            f"<body><p>Line {k}</p></body>",
            f"<description><title-info><book-title>T{k}</book-title></title-info></description>"))
    (tmp_path / "note.txt").write_text("no book")
    bookfiles.register(spark)
    return str(tmp_path)


def test_the_data_source_reads_as_the_parser_does(spark, book_files):
    rows = spark.read.format("fb2").load(book_files)
    wanted = fictionbook.parsed_files(spark, book_files)
    names = ["reject", "book_title", "authors", "body_title", "blocks"]
    assert sorted(map(tuple, rows.select(*names).collect()), key=repr) == sorted(
        map(tuple, wanted.select(*names).collect()), key=repr)
    assert rows.where("length > 0").count() == 12


def test_partitions_are_packed_by_size(spark, book_files, monkeypatch):
    whole = spark.read.format("fb2").load(book_files)
    assert whole.rdd.getNumPartitions() == 1
    small = spark.read.format("fb2").option("partitionBytes", 3 * (bookfiles.OPEN_BYTES + 1_000)
                                            ).load(book_files)
    assert small.rdd.getNumPartitions() == 4 and small.count() == 12
    parts = bookfiles.packed(bookfiles.listed(book_files), 1)
    assert [len(p.files) for p in parts] == [1] * 12


def test_metadata_does_not_walk_bodies(spark, book_files, monkeypatch):
    """Only the columns asked for are built."""
    walked = []
    monkeypatch.setattr(fictionbook, "_body_blocks", lambda body: walked.append(body) or [])
    part = bookfiles.packed(bookfiles.listed(book_files), 1 << 30)[0]
    schema = T.StructType().add("path", "string").add("book_title", "string")
    rows = [row for batch in bookfiles.read_files(book_files, part, schema)
            for row in batch.to_pylist()]
    assert not walked and sorted(r["book_title"] for r in rows) == sorted(
        f"T{k}" for k in range(12))
    titles = spark.read.format("fb2").schema("path string, book_title string").load(book_files)
    assert titles.columns == ["path", "book_title"] and titles.distinct().count() == 12


def test_large_files_are_not_opened(monkeypatch, book_files):
    monkeypatch.setattr(bookfiles, "MAX_FILE_BYTES", 10)
    part = bookfiles.packed(bookfiles.listed(book_files), 1 << 30)[0]
    schema = T.StructType().add("reject", "string")
    rows = [row["reject"] for batch in bookfiles.read_files(book_files, part, schema)
            for row in batch.to_pylist()]
    assert rows == ["too_large"] * 12


def test_the_stream_takes_each_file_once(spark, book_files, tmp_path_factory, monkeypatch):
    """Files that come later are added; files already read are not read again."""
    old = time.time() - 60
    for root, _, names in os.walk(book_files):
        for name in names:
            os.utime(os.path.join(root, name), (old, old))
    out, checkpoint = (str(tmp_path_factory.mktemp(x)) for x in ("out", "checkpoint"))

    def run():
        query = (spark.readStream.format("fb2").load(book_files).select("path", "book_title")
                 .writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", checkpoint).start())
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["book_title"] for r in spark.read.parquet(out).collect())

    assert run() == sorted(f"T{k}" for k in range(12))
    late = os.path.join(book_files, "late.fb2")
    with open(late, "w") as file:
        file.write(book("<body><p>Late</p></body>"))
    os.utime(late, (old + 10, old + 10))
    assert run() == sorted([*(f"T{k}" for k in range(12)), ""])
