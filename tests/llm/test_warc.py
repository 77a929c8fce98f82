"""Derivative records: links, digests and the written form."""

import glob
import hashlib

from folioflow.llm import warc


def test_plain_text(spark):
    pages = [
        "<html><head><title>T</title></head><body><p>One&amp;two</p><script>x<y</script><div>a <b>b</b>\n c</div><!-- <p>no --></body>",
        "",
        "no tags  here &lt;b&gt; &amp;lt;",
        "<p>open <!-- never closed <p>x",
        "<" * 20000 + "p>",
    ]
    got = [r.t for r in warc.with_text(spark.createDataFrame(list(enumerate(pages)), "i int, html string"), "html", "t").orderBy("i").collect()]
    assert got[:4] == ["One&two\na b\nc", "", "no tags here <b> &lt;", "open"]


def test_derivatives(spark):
    rows = [(1, "http://a", '<html lang="fr"><title> A  b </title><a href="x">é</a>', "clash"), (2, None, None, "c"), (None, "http://a", "", "c"), (1, "http://a", "again", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block string")
    sources = warc.responses(pages).collect()
    assert len(sources) == 4
    records = warc.derivatives(warc.responses(pages)).collect()
    assert sorted(r.record_type for r in records) == ["conversion"] * 4 + ["metadata"] * 4
    for r in records:
        assert r.refers_to in {s.record_id for s in sources} and r.record_id != r.refers_to
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
    first = "sha256:" + hashlib.sha256(rows[0][2].encode()).hexdigest()
    meta = next(r for r in records if r.source_digest == first and r.record_type == "metadata")
    text = next(r for r in records if r.source_digest == first and r.record_type == "conversion")
    assert meta.concurrent_to == text.record_id and text.block == "A b é"
    assert f"source-payload-digest: {first}\r\n" in meta.block and "title: A b\r\nlanguage: fr\r\noutlinks: 1\r\n" in meta.block
    assert "http-status-line: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html; charset=utf-8\r\n" in meta.block
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    other = warc.responses(pages).withColumn("record_type", warc.F.lit("request"))
    assert warc.derivatives(other).count() == 0


def test_blocks_without_a_body(spark):
    rows = [(1, "response", "<urn:x>", "u", "d", "c", "p", b) for b in (None, "", "HTTP/1.1 204 No Content", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore")]
    frame = spark.createDataFrame(rows, "page_id int, record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, block string")
    texts = sorted(r.block for r in warc.derivatives(frame).collect() if r.record_type == "conversion")
    assert texts[:3] == ["", "", ""] and texts[3].split() == ["body", "more"]


def test_written_files_hold_whole_records(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>text {k}\n</p>") for k in range(7)], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    warc.write(records, f"{tmp_path}/w")
    data, found = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/w/part-*"))), {}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(fields["Content-Length"])
        found[fields["WARC-Record-ID"]] = fields["WARC-Type"], fields["WARC-Refers-To"], rest[:size].decode()
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    assert found == {r.record_id: (r.record_type, r.refers_to, r.block) for r in records.collect()}


def test_unclosed_heads_and_references(spark):
    pages = {
        "<html><head><title>T</title><meta charset=utf-8><body><p>One</p>": "One",
        "<head><meta a=b><style>x{}</style><title>T</title><p>Two <b>b</b>": "Two b",
        "<head><title>T</title>\nBare text": "Bare text",
        "<head><script>if (a<b) '<body>'</script><title>T</title></head><p>x</p>": "x",
        "<header>kept</header>": "kept",
        "caf&eacute; &mdash; &#8364;&#x1F642; &#39;q&#39; &nosuch; &amp;eacute; &#128; a&#160;b &#0; &#xD800;": "café — €🙂 'q' &nosuch; &eacute; € a b � �",
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").orderBy("i")
    assert [r.t for r in warc.with_text(rows, "html", "t").orderBy("i").collect()] == list(pages.values())


def test_titles_links_and_references(spark):
    """Expected by hand, without the module's own patterns."""
    page = (
        "<html lang=de><head><!-- <title>no</title> --><title>A &amp; B &eacute;&#8212;&#x41;\n c</title><script>var x = '<a href=1>'</script></head>"
        "<body><!-- <a href=2> --><a href=3>x</a><A class=k HREF='4'>y</A><style><a href=5></style>&amp;eacute; &copy; &unknown; &nbsp;z</body></html>"
    )
    long = "<p>a &eacute; b</p>" * 60_000
    rows = [(1, "u", page), (2, "u", long), (2, "u", long), (3, "u", "<title>x &lt;b&gt;</title>&amp;lt; &lt")]
    records = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    meta = {r.page_id: dict(line.split(": ", 1) for line in r.block.split("\r\n") if ": " in line) for r in records if r.record_type == "metadata"}
    text = {r.page_id: r.block for r in records if r.record_type == "conversion"}
    assert (meta[1]["title"], meta[1]["language"], meta[1]["outlinks"]) == ("A & B é—A c", "de", "2")
    assert text[1] == "xy&eacute; © &unknown; z"
    assert meta[3]["title"] == "x <b>" and text[3] == "x <b>&lt; &lt"
    assert text[2] == "\n".join(["a é b"] * 60_000)
    assert len(records) == 8 and len({r.record_id for r in records}) == 6  # repeated pages have the same identifiers
