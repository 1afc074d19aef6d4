"""Archives and page text: round trips, damage, and pages laid out by hand."""

from __future__ import annotations

import base64
import hashlib

import pytest

from packlens.llm import warc
from packlens.llm.q_warc import op1_warc_salvage
from packlens.llm.render import render, rendered
from packlens.session import staging_path


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_record(i: int, payload: bytes, check: bool = True) -> bytes:
    head = [b"WARC/1.0", b"WARC-Type: resource", b"WARC-Record-ID: <urn:page:%d>" % i, b"Content-Length: %d" % len(payload)]
    if check:
        head.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_query_against_plain_version(spark, small):
    pages = sorted((r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{small}/pages.parquet").collect())
    first = {}
    want = set()
    for i, data in pages:
        f = first.setdefault(data, i)
        want.add((i, len(data), digest(data), "response" if f == i else "revisit", None if f == i else f))
    assert {tuple(r) for r in op1_warc_salvage(spark, small).collect()} == want


@pytest.mark.parametrize("gzip", [True, False])
def test_round_trip_of_edge_rows(spark, gzip):
    long = "long é text " * 900_000  # a record of several members
    rows = [(3, "u\r\nWARC-Type: x", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (5, "u", "WARC/1.0\r\n\r\nWARC/1.1\r\n"), (6, "u", long), (None, "u", "same"), (1, "u", "same")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record int")
    path = staging_path(spark, "warc")
    warc.write(warc.records(pages), path, gzip=gzip)
    found = warc.read(spark, path, payload=True).collect()
    assert all(r["reason"] is None for r in found)
    assert sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in found) == sorted([
        ("<urn:page:3>", "revisit", "<urn:page:1>"), ("<urn:page:1>", "response", ""), ("<urn:page:1>", "response", ""), ("<urn:page:2>", "response", ""),
        ("<urn:page:4>", "revisit", "<urn:page:2>"), ("<urn:page:5>", "response", ""), ("<urn:page:6>", "response", ""), ("<urn:page:none>", "revisit", "<urn:page:1>"),
    ])
    by = {r["record_id"]: r for r in found}
    assert by["<urn:page:6>"]["payload"] == long.encode() and by["<urn:page:3>"]["payload_bytes"] == 4
    assert by["<urn:page:3>"]["payload_digest"] == digest(b"same")
    empty = staging_path(spark, "warc")
    warc.write(warc.records(pages.limit(0)), empty, gzip=gzip)
    assert warc.read(spark, empty).collect() == []


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = staging_path(spark, "warc")
    warc.write(warc.records(pages, least_bytes=3), path)
    assert sorted(r["record_type"] for r in warc.read(spark, path).collect()) == ["response", "response", "response", "revisit"]


def split(found):
    found = list(found)
    return [f.fields["warc-record-id"][10:-1] for f in found if isinstance(f, warc.Record)], [(f.start, f.end, f.reason) for f in found if isinstance(f, warc.Gap)]


def test_salvage_of_plain_files():
    parts = [plain_record(i, b"payload %d" % i * 5) for i in range(5)]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    assert split(warc.salvage(warc.Held(b"".join(parts)))) == (list("01234"), [])
    broken = bytearray(b"".join(parts))
    broken[at[2] - 10] ^= 1  # inside the payload of record 1
    assert split(warc.salvage(warc.Held(bytes(broken)))) == (["0", "2", "3", "4"], [(at[1], at[2], "payload digest differs")])
    data = b"junk\n" + parts[0] + b"noise\n" + parts[1] + parts[2][:-20]
    cut = len(data) - len(parts[2]) + 20
    assert split(warc.salvage(warc.Held(data))) == (["0", "1"], [(0, 5, "no version line"), (5 + at[1], 5 + at[1] + 6, "no version line"), (cut, len(data), "block is cut")])
    wrong = parts[0].replace(b"Content-Length: 45", b"Content-Length: 9999")
    ids, gaps = split(warc.salvage(warc.Held(wrong + parts[1])))
    assert ids == ["1"] and gaps == [(0, len(wrong), "block is cut")]
    bare = plain_record(7, b"x" * 10, check=False)
    ids, gaps = split(warc.salvage(warc.Held(bare[:-4] + b"\n" + plain_record(8, b"y"))))
    assert ids == ["8"] and gaps[0][2] == "record does not end"
    assert split(warc.salvage(warc.Held(b""))) == ([], [])


def test_salvage_of_member_files():
    parts = [warc.members(plain_record(i, b"payload %d " % i * 50)) for i in range(5)]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    assert split(warc.salvage(warc.Held(b"".join(parts)))) == (list("01234"), [])
    broken = bytearray(b"".join(parts))
    broken[at[1] + 30] ^= 255
    broken[at[3] + 4 : at[3] + 40] = b"\0" * 36
    ids, gaps = split(warc.salvage(warc.Held(bytes(broken))))
    assert ids == ["0", "2", "4"] and [g[:2] for g in gaps] == [(at[1], at[2]), (at[3], at[4])]
    ids, gaps = split(warc.salvage(warc.Held(b"head" + b"".join(parts[:2]) + parts[2][:20])))
    assert ids == ["0", "1"] and [g[:2] for g in gaps] == [(0, 4), (4 + at[2], 4 + at[2] + 20)]
    # A record over two members, then one whose second member is lost.
    a, b = plain_record(1, b"z" * 500), plain_record(2, b"q" * 500)
    whole = warc.members(a[:300]) + warc.members(a[300:])
    cut = warc.members(b[:300])
    ids, gaps = split(warc.salvage(warc.Held(whole + cut + parts[4])))
    assert ids == ["1", "4"] and [g[:2] for g in gaps] == [(len(whole), len(whole) + len(cut))]


def test_files_read_in_pieces_give_the_same(tmp_path):
    data = b"".join(warc.members(plain_record(i, bytes([i]) * 3000)) for i in range(30)) + b"tail"
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert split(warc.salvage(warc.Opened(str(tmp_path / "a.warc.gz")))) == split(warc.salvage(warc.Held(data)))


def test_damaged_plain_files_that_hold_gzip_payloads():
    import gzip

    parts = [plain_record(i, gzip.compress(b"page %d " % i * 40)) for i in range(4)]
    at = [sum(map(len, parts[:i])) for i in range(5)]
    data = b"XX" + b"".join(parts)[2:]
    assert split(warc.salvage(warc.Held(data))) == (["1", "2", "3"], [(0, at[1], "no version line")])
    # Members after plain records, and plain records after a damaged member.
    member = warc.members(plain_record(8, b"m" * 300))
    mixed = parts[0] + member + parts[1]
    assert split(warc.salvage(warc.Held(mixed)))[0] == ["0", "8", "1"]
    hurt = member[:20] + b"\0" * 9 + member[29:] + b"\n" + parts[1]
    assert split(warc.salvage(warc.Held(hurt)))[0] == ["1"]


def test_long_addresses_are_read_back(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 200_000, "one"), (2, "u", "two")], "page_id long, url string, html string")
    for gzip in (True, False):
        path = staging_path(spark, "warc")
        warc.write(warc.records(pages), path, gzip=gzip)
        found = {r["record_id"]: len(r["target_uri"]) for r in warc.read(spark, path).collect()}
        assert found == {"<urn:page:1>": 200_009, "<urn:page:2>": 1}


# ------------------------------------------------------------------ page text

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>": "a\nb",
    "one <b>bold</b>  two<br>three": "one bold two\nthree",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>": "- a\n- b\n\n  3. c\n  4. d",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td colspan=2>all</table>": "Name   Qty\napple  10\nall",
    "a<script>x<p>y</script>b<style>p{}</style><!-- <p>c -->d": "abd",
    "<div hidden>x</div><p style='DISPLAY : none'>y</p><span style=\"visibility:hidden\">z</span>seen": "seen",
    "<pre>\n x\n   y\n</pre>": " x\n   y",
    "<head><title>t</title></head>&lt;b&gt; &amp;c": "<b> &c",
    "<head><meta charset=x><p>in": "in",
    "<blockquote>q<p>r</blockquote>": "> q\n>\n> r",
    "<dl><dt>x<dd>y</dl>": "x\n    y",
    "<p>a</div>b</p>c": "ab\n\nc",
    "<img alt='a tree'> <input type=hidden value=x>": "a tree",
    "a < b & c": "a < b & c",
    "<div title='a>b'>c</div>": "c",
    "x<hr>y": "x\n\n---\n\ny",
    "<table>text<tr><td>1</table>": "text\n\n1",
    "a<table><tr>text<td>1<td>2</table>b": "atext\n\n1  2\n\nb",
    "<table><tr><td>1</td></tr>after <b>bold</b> more": "after bold more\n\n1",
    "<table><tr><td>1<tr><b>q<td>2</table>z": "q\n\n1\n2\n\nz",
    "x<svg width='1'/>y<div>z<math/>w</div>": "xy\nzw",
    "<div><svg><g/><title/></svg>z</div>": "z",
    "<svg width=10/>h</svg>s": "s",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_layout(page):
    assert render(page) == PAGES[page]


def test_deep_wide_and_null_pages(spark):
    deep = "<div><b>" * 20_000 + "x"
    wide = "<table><tr>" + "<td>" * 3000 + "<td>" + "y" * 200_000 + "</table>"
    pages = spark.createDataFrame([(1, deep, "t"), (2, wide, "t"), (3, None, "t"), (3, None, "t")], "page_id long, html string, text string")
    got = [r[0] for r in pages.orderBy("page_id").select(rendered(pages["html"])).collect()]
    assert got[0] == "x" and got[1].strip() == "y" * 200_000 and got[2:] == [None, None]
