"""Messages, HTML and names, with values that are known."""

from __future__ import annotations

import encodings.aliases
import random
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from missive.functions import display, html, mail

AT = datetime(2026, 7, 30, 12, tzinfo=UTC)


def parse(raw: bytes) -> dict:
    return mail.parse_message(raw, AT, AT)


def leaf(kind: str, body: bytes, *more: str) -> bytes:
    return "\r\n".join([f"Content-Type: {kind}", *more, "", ""]).encode("utf-8", "surrogateescape") + body


def multipart(*parts: bytes, head: str = "") -> bytes:
    lines = b"".join(b"\r\n--edge\r\n" + p for p in parts)
    return head.encode() + b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=edge\r\n" + lines + b"\r\n--edge--\r\n"


def test_which_body_is_taken():
    blank, first, second = leaf("text/plain", b" \r\n "), leaf("text/plain", b"  kept as it is  \n"), leaf("text/plain", b"later")
    page = leaf("text/html", b"<div>shown</div>")
    named = leaf("text/plain; name=notes.txt", b"not a body")
    kept = leaf("text/plain", b"nor this", "Content-Disposition: attachment")
    assert parse(multipart(named, kept, page, blank, first, second))["body_text"].strip("\r\n") == "  kept as it is  "
    # An HTML part that shows nothing does not hide the next one.
    assert parse(multipart(blank, leaf("text/html", b"<br><hr>"), leaf("text/html", b"<style>x</style>"), page))["body_text"] == "shown"
    assert parse(multipart(blank, named))["body_text"] == ""


def test_inline_parts_are_no_attachments():
    picture = leaf("image/gif", b"GIF", "Content-ID: <sun@sky>")
    row = parse(multipart(leaf("text/html", b"<img src='cid:sun@sky'>sky"), picture, head="Subject: s\r\n"))
    assert not row["has_attachment"] and [(a["content_type"], a["is_inline"]) for a in row["attachments"]] == [("image/gif", True)]
    row = parse(multipart(leaf("image/gif", b"GIF", "Content-ID: <sun@sky>", "Content-Disposition: attachment")))
    assert row["has_attachment"] and not row["attachments"][0]["is_inline"]
    got = mail.render_message(multipart(leaf("text/html", b"<b>sky</b>"), picture))
    assert got["html_body"] == "<b>sky</b>" and got["text_body"] is None and got["parts"][0]["content_id"] == "sun@sky" and got["parts"][0]["payload"].startswith(b"GIF")


def test_defects_are_named_and_fields_stay():
    row = parse(b"Subject: half\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=gone\r\n\r\njust text")
    assert row["subject"] == "half" and "StartBoundaryNotFoundDefect" in row["parse_error"].split("; ")
    row = parse(b"From: ann@x\r\nContent-Transfer-Encoding: base64\r\n\r\n%%%%")
    assert row["sender"] == "ann@x" and row["parse_error"].split("; ").count("InvalidBase64") == 1
    row = parse(b"")
    assert row["parse_error"] is None and [row[k] for k in ("subject", "sender", "recipient", "cc", "body_text")] == [""] * 5 and row["message_id"] is None
    assert parse(b"\xff\x00")["content_key"].startswith("sha256:")


@pytest.mark.parametrize("where,given,want", [
    ("Content-Type: image/png; filename=in-type.png", "", "in-type.png"),
    ("Content-Type: image/png", "Content-Disposition: attachment; name=in-disposition.png", "in-disposition.png"),
    ("Content-Type: image/png; name=type.png", "Content-Disposition: inline; filename=disposition.png; name=other.png", "disposition.png"),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename*1=second.png", None),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename*0=first; filename*2=third", "first"),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename*1=b; filename*0=a; filename*2*=%C3%A9", "abé"),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename=plain.png; filename*=iso-8859-1'fr'%E9t%E9.png", "été.png"),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename*=no-such-set''%C3%A9.png", "é.png"),
    ("Content-Type: image/png", 'Content-Disposition: attachment; filename="a;b \\"c\\".png"', 'a;b "c".png'),
    ("Content-Type: image/png", "Content-Disposition: attachment; filename=\"=?iso-8859-1?q?caf=E9.png?=\"", "café.png"),
    ("Content-Type: image/png", "Content-Disposition: attachment", None),
])
def test_names_of_parts(where, given, want):
    raw = "\r\n".join(filter(None, [where, given])).encode() + b"\r\n\r\nx"
    assert parse(raw)["attachments"][0]["filename"] == want


def test_no_message_fails_whatever_its_character_sets(spark):
    """Every codec that Python has, in bodies, headers and names, as rows of a job."""
    sets = sorted({*encodings.aliases.aliases.values(), "utf-7", "unicode_escape", "raw_unicode_escape", "punycode", "idna", "undefined", "hex", "rot13", "mbcs", "nope", "x y", "utf-16-be"})
    rng, raws = random.Random(6), []
    for name in sets:
        noise = bytes(rng.randrange(256) for _ in range(40))
        raws.append(leaf(f"text/plain; charset={name}", b"+2AA- \\ud800 xn--a " + noise, f"Subject: =?{name}?q?+2AA-_=5Cud800?=", f"From: =?{name}?b?gICAgA==?=", "Message-ID: <\udcff@x>"))
        raws.append(leaf("application/pdf", noise, f"Content-Disposition: attachment; filename*={name}''%D8%00%2B2AA-%5Cud800"))
        raws.append(leaf(f"text/html; charset={name}", b"<p>&#xD800; \xed\xa0\x80</p>"))
    raws += [bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))) for _ in range(100)] + [b"Content-Type: text/plain; charset=\x00\r\n\r\nx", b"Subject: \xed\xa0\x80\r\n\r\n"]
    rows = spark.createDataFrame([(i, r, rng.choice(["not a date", None, "2026-01-01T00:00:00Z", ""])) for i, r in enumerate(raws)], "i int, raw binary, at string")
    found = rows.select("i", mail.parsed(F.col("raw"), F.col("at"), AT).alias("m"), mail.rendered(F.col("raw")).alias("r"))
    assert found.where("m IS NOT NULL AND r IS NOT NULL").count() == len(raws)
    shown = rows.where(f"i = {3 * sets.index('utf_7')}").select(mail.parsed(F.col("raw"), F.col("at"), AT).alias("m")).first().m
    assert shown.subject.startswith("?") and not any("\ud800" <= c <= "\udfff" for c in shown.body_text + shown.message_id)


def test_dates():
    zone = datetime(2026, 7, 30, 1, 2, 3, tzinfo=timezone(timedelta(hours=9)))
    for text in ("yesterday", "", None, "Sat, 01 Aug 2026 12:00:01 +0000"):  # a day after, and a second
        assert mail.date_text(text, zone, AT) == "2026-07-29T16:02:03Z"
    assert mail.date_text("Fri, 31 Jul 2026 12:00:00 +0000", zone, AT) == "2026-07-31T12:00:00Z"
    assert mail.date_text("Wed, 1 Jan 2025 00:30:00 -0130", zone, AT) == "2025-01-01T02:00:00Z"
    assert mail.instant("no time") is None and mail.instant("2026-01-02T03:04:05").tzinfo is UTC


def test_keys(spark):
    assert mail.thread_key("<self>", "<reply>", "<root@x> <reply>") == "<root@x>"
    assert mail.thread_key("<self>", "<reply>", None) == "<reply>" and mail.thread_key(None, None, None) is None
    assert mail.content_key(" <m@x> ", "a" * 64) == "<m@x>" and mail.content_key(None, "a" * 64) == "sha256:" + "a" * 32
    rows = [("<s>", None, " <r@x> <q>"), ("<s>", "plain more", ""), (None, None, None), ("", " ", "")]
    df = spark.createDataFrame(rows, "m string, i string, r string")
    got = [r[0] for r in df.select(mail.thread_key_of(F.col("m"), F.col("i"), F.col("r"))).collect()]
    assert got == [mail.thread_key(*r) for r in rows] == ["<r@x>", "plain", None, None]


def test_charset_labels():
    assert {mail.charset_label(x) for x in ("MS932", "x-SJIS ", "Windows-31J", "shift-jis")} == {"cp932"}
    assert [mail.charset_label(x) for x in ("CP50220", "x-EUC-jp", "ISO - 8859 - 1")] == ["iso2022_jp_ext", "euc_jp", "iso-8859-1"]


def test_charsets():
    kana, circled = "カタカナと漢字の試験文", "№⑤㈲"
    assert mail.decode_text(kana.encode("euc_jp"), "x-euc-jp") == (kana, "euc_jp")
    assert mail.decode_text(kana.encode("iso-2022-jp")) == (kana, "iso-2022-jp")
    assert mail.decode_text(circled.encode("cp932"), "utf-8") == (circled, "cp932")
    assert mail.decode_text("naïve".encode(), "utf-8") == ("naïve", "utf-8")
    # A seven-bit text with one broken escape is read leniently, not as cp932.
    raw = (kana * 4).encode("iso-2022-jp") + b"\x1b$Bz"
    text, used = mail.decode_text(raw, "iso-2022-jp")
    assert text.startswith(kana * 4) and used == "iso2022_jp_ext (replace)"
    assert mail.decode_text(b"+2AA-", "utf-7")[0] == "?" and mail.decode_text(b"\\ud800x", "unicode_escape")[0] == "?x"


def test_safe_names():
    got = mail.safe_name("C:\\temp/what*is|this?.csv")
    assert got == {"name": "what_is_this_.csv", "warnings": ["path_component", "forbidden_character"], "is_executable": False}
    assert mail.safe_name("tab\tin\x7fname.md...  ") == {"name": "tab_in_name.md", "warnings": ["control_character", "trailing_character"], "is_executable": False}
    assert [mail.safe_name(n)["name"] for n in ("nul", "Com7.tar.gz", "lpt0.x")] == ["nul_", "Com7_.tar.gz", "lpt0.x"]
    assert mail.safe_name("a/..") == {"name": "attachment", "warnings": ["path_component", "trailing_character", "empty_name"], "is_executable": False}
    assert mail.safe_name("e\u0301.gif")["name"] == "é.gif"
    long = mail.safe_name("ß" * 140 + ".json")
    assert long["name"].endswith("ß.json") and 250 < len(long["name"].encode()) <= 255 and long["warnings"] == ["truncated"]
    assert [mail.safe_name(n)["is_executable"] for n in ("run.BAT", "link.Lnk", "page.vbs", "tool.jar", "exe", "a.exe.txt")] == [True, True, True, False, False, False]


def test_mailbox_lines():
    assert all(mail.decode_utf7(mail.encode_utf7(v)) == v for v in ("Drafts", "Größe & Maß", "日本", "", "a&-b"))
    assert mail.decode_utf7("&AAA") == "&AAA" and mail.decode_utf7("&A-") == "&A-"
    assert mail.folder_line('* LIST (\\Sent \\Marked) NIL "Gr&APYA3w-e"') == {"raw_name": "Gr&APYA3w-e", "display_name": "Größe", "delimiter": None, "special_use": ["\\Marked", "\\Sent"]}
    assert mail.folder_line('* LIST (\\HasChildren) "/" {9}\r\na "b" (c)')["raw_name"] == 'a "b" (c)'
    assert mail.folder_line("* lsub () / Work")["raw_name"] == "Work" and mail.folder_line("* BYE bye") is None and mail.folder_line("* LIST () /") is None
    got = mail.message_line('* 3 FETCH (FLAGS (\\Draft $Junk) BODY[HEADER.FIELDS (MESSAGE-ID)] {12}\r\nUID 5 (x) "a ENVELOPE ("d" ((NIL "l" {3}\r\n)"( "h"))) UID 900 MODSEQ (12345678901) RFC822.SIZE 77 INTERNALDATE " 1-Feb-2026 00:10:00 -0100")', "X: 1\r\nmessage-id:\t<q@h>\r\n")
    assert got == {"uid": 900, "size_bytes": 77, "modseq": 12345678901, "internal_date": "2026-02-01T01:10:00Z", "flags": ["\\Draft", "$Junk"], "message_id": "<q@h>"}
    assert mail.message_line('* 1 FETCH (UID x INTERNALDATE "soon" FLAGS')["internal_date"] is None
    assert mail.response('a (b "c\\"d" (NIL {2}\r\nöx') == ["a", ["b", 'c"d', [None, "ö", "x"]]]


def test_html_text():
    page = "<ul><li> one\t two</li>\n\n\n<li>three</li></ul><script>if (a < b) { c }</script><!-- d -->\n<p>4<hr><hr><hr>5 &amp;&nbsp;6</p><style>p { x: y }</style>"
    assert html.html_to_text(page) == "one two\n\nthree\n\n4\n5 & 6"
    assert html.html_to_text("<p>" + "many " * 60_000 + "<script>z").count("many") == 60_000 and html.html_to_text("&#xD800;x") in ("?x", "\ufffdx")


def test_sanitised_html():
    page = (
        "<head><meta HTTP-EQUIV=' Refresh ' content='1'><meta name=a content=b><title>t</title></head><object><p>gone</p></object><embed src=x><p onmouseover=f() id=1>"
        "<img src=' d\nata:x' alt=y><a href='JavaScript:z' title=k>l</a><a href='mailto:m'>n</a></p><frame src=q><script src=r></script>"
    )
    got = html.sanitise_html(page)
    assert got.endswith('<meta name="a" content="b"><title>t</title></head><body><p id="1"><img alt="y"><a title="k">l</a><a href="mailto:m">n</a></p></body></html>')
    assert got.count("http-equiv") == 1 and "img-src cid:;" in got and "img-src cid: https: http:" in html.sanitise_html("", True)


def test_remote_images():
    for page in ('<img src="HTTP://x/p.gif">', '<div style="background: url(https://x/b.png)"></div>', "<style>.x { background: url('https://x/b.png'); }</style>"):
        assert html.has_remote_image(page)
    assert not html.has_remote_image('<p>url(https://x)</p><img src="cid:a">')


def test_urls_and_accounts(spark):
    good = ["http://a.b", "HTTP://A.B:80/c?d#e", "https://xn--a.org/%41?q=@", "https://[fe80::1]:443", "https://h:/"]
    bad = ["ftp://a.b", "mailto:a@b", "https:/a.b", "http://u@a.b", "http://a.b:99999", "http://a.b:8o", "http:///p", "http://a b/", "http://a.b/\u200f", "http://a.b\t", "http://a.b/" + "p" * 4090, "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in df.select(display.allowed_url(F.col("u"))).collect()] == [True] * len(good) + [False] * len(bad)
    names = {"a@x.org": True, "": False, "..": False, "a/b": False, "con": False, "COM1.x": False, "a.": False, "é" * 128: False, "é" * 127: True}
    df = spark.createDataFrame([(n,) for n in names], "a string")
    assert [r[0] for r in df.select(display.valid_account(F.col("a"))).collect()] == list(names.values())


def test_shown_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(display.size_text(F.lit(n))) for n in (0, 1023, 1536, 5 << 20, 3 << 30)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert get(display.masked(F.lit("from person@example.org password=abc Token: x"))) == "from pe***@example.org password=*** Token: ***"
    assert get(display.utc_text(F.to_timestamp(F.lit("2026-07-30T01:02:03.999999+09:00")))) == "2026-07-29T16:02:03Z"
    assert get(display.local_text(F.lit("2026-07-29T16:02:03Z"), "Asia/Tokyo")) == "2026-07-30 01:02"
    assert get(display.seconds_left(F.lit(50.0), F.lit(100.0), F.lit(10.0))) == 10 and get(display.seconds_left(F.lit(0.0), F.lit(100.0), F.lit(10.0))) is None
    assert get(display.trigrams(F.lit("abcab"))) == ["abc", "bca", "cab"] and get(display.trigrams(F.lit("ab"))) == []
    assert 2.0 <= display.retry_delay(0.5, 2) <= 2.2


UNFINISHED = (
    "<img src=x onerror=alert(1)//", "a<!-- <img src=x onerror=alert(1)", "<![foo[bar]]>x", "<![CDATA[<b onclick=x>]]>y", "<!foo <img src=x onerror=1", "<?p <img src=x onerror=1>", "</p <img src=x onerror=1>",
    "<style><img src=x onerror=1>", "<svg><style><img src=x onerror=1></style>", "<textarea><img src=x onerror=1>", "<title><img src=x onerror=1>", "<xmp><img src=x onerror=1></xmp>", "<a\x00b onx=1>", "<" * 500, "&#x;&#99999999999;&bogus", "<!DOCTYPE [<!ENTITY x '<img onerror=1>'>]>",
)


@pytest.mark.parametrize("page", UNFINISHED)
def test_unfinished_pages_raise_nothing_and_pass_no_handler(page):
    """What the safe form holds of tags is read again, here with a plain reader, and has no handler."""
    from html.parser import HTMLParser

    from missive.functions import html

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            assert not any(k.startswith("on") for k, _ in attrs), (tag, attrs)

    safe = html.sanitise_html(page)
    for end in ("", ">", '">', "-->"):
        reader = Reader()
        reader.feed(safe + end)
        reader.close()
    body = safe.partition("<body>")[2].removesuffix("</body></html>")
    assert body.count("<") == body.count(">") or "style" in body or "&gt;" in body
    assert isinstance(html.html_to_text(page), str) and html.has_remote_image(page) in (True, False)


def test_images_from_elsewhere_however_they_are_written():
    from missive.functions.html import has_remote_image

    assert has_remote_image("<img src='ht\ntp:\t//a/b'>") and has_remote_image("<p style='x:url(\"HTTPS://a\")'>")
    assert not has_remote_image("<p style='x:url(http:a)'>") and not has_remote_image("<img src='cid:http://a'>")


def test_no_response_and_no_message_raises(spark):
    from missive.functions import mail

    lines = ["* 1 FETCH (UID 99999999999999999999)", f"* 1 FETCH (UID {'9' * 5000})", "* 1 FETCH (X {" + "9" * 5000 + "}\r\nabc UID 5)", "* 1 FETCH (UID 9223372036854775807)", "* 1 FETCH (UID 9223372036854775808)", "(" * 3000, "* LIST (" + "(" * 3000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r["m"]["uid"] for r in rows.select("i", mail.message_lines("line").alias("m"), mail.folder_lines("line")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 2**63 - 1, 4: None, 5: None, 6: None}
    deep = b"".join(b"Content-Type: multipart/mixed; boundary=b%d\r\n\r\n--b%d\r\n" % (i, i) for i in range(2000)) + b"x"
    rows = spark.createDataFrame([(bytearray(deep),), (bytearray(b"Subject: s\r\n\r\ntext"),)], "raw binary")
    got = [r["r"] for r in rows.select(mail.rendered("raw").alias("r")).collect()]
    assert sorted((r["text_body"] or "", r["parts"]) for r in got) == [("", []), ("text", [])]


def test_labels_that_senders_use():
    from missive.functions.mail import charset_label

    assert {charset_label(x) for x in ("xsjis", " X-SJIS", "sjis")} == {"cp932"} and {charset_label(x) for x in ("iso_2022_jp_ms", "iso2022jpms")} == {"iso2022_jp_ext"}
