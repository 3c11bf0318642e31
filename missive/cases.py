"""Queries of the functions of messages, the store and synchronisation runs: their inputs are built, by expressions that the SQL
repeats, from rows of the given tables, so their work grows with these."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions import display, html, mail
from missive.functions.normalise import normalised
from missive.operators import export, reparse, run, store, sync
from missive.operators import search as s
from missive.plans.filters import cursor_place, cursor_text
from missive.plans.query import planned
from missive.registry import over_tables, over_views
from missive.sources import files, log
from missive.views import EPOCH, _fold, _stamp

AT = "2026-08-01T00:00:00Z"
NOW = datetime(2026, 8, 1, tzinfo=UTC)
BREAK = "\r\n"
KEY = "coalesce(date_sent, internal_date, '')"


def doc() -> Column:
    return F.col("doc_id")


def ident() -> Column:
    return F.col("id")


def text(*parts) -> Column:
    """Columns, names of such being ``Column`` already, and literal texts joined."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def pick(n: Column, *values) -> Column:
    """The value at ``n`` modulo their number."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def message(raw: Column, internal: str | None = None) -> Column:
    return mail.parsed(raw.cast("binary"), F.lit(internal).cast("string"), NOW)


def multipart(*parts, head: str = "") -> Column:
    """A message of parts, each a text or a column."""
    out = [head + f"MIME-Version: 1.0{BREAK}Content-Type: multipart/mixed; boundary=e{BREAK}{BREAK}"]
    for p in parts:
        out += [f"--e{BREAK}", p, BREAK]
    return text(*out, f"--e--{BREAK}")


# Names, times, sizes and character sets.


@over_tables("n3_utc_text", "SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86399 - 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ordered FROM orders")
def n3_utc_text(t):
    # The table's times have no zone: what its clock shows is UTC.
    ordered = display.utc_text(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone()))
    return t("orders").select("o_orderkey", display.utc_text(F.timestamp_seconds(F.col("o_orderkey") * 86_399 - 100_000_000)).alias("at"), ordered.alias("ordered"))


_SENT = "make_timestamp(2026, 7, 1 + doc_id % 28, doc_id % 24, doc_id % 60, 0.0) + INTERVAL 90 MINUTE"


@over_tables("n4_date_headers", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strftime({_SENT}, '%Y-%m-%dT%H:%M:%SZ') ELSE '2026-07-30T00:00:00Z' END AS date_sent FROM documents")
def n4_date_headers(t):
    """Dates with a zone, ones that cannot be read and absent ones, which are the mailbox's."""
    date = text("Date: ", doc() % 28 + 1, " Jul 2026 ", two(doc() % 24), ":", two(doc() % 60), ":00 -0130")
    raw = text(pick(doc(), date, F.lit("Date: soon"), F.lit("X: 1")), BREAK * 2)
    return t("documents").select("doc_id", message(raw, "2026-07-30T00:00:00Z")["date_sent"].alias("date_sent"))


@over_tables("n5_internal_dates", f"SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN strftime({_SENT}, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM documents")
def n5_internal_dates(t):
    day = F.lpad((doc() % 28 + 1).cast("string"), 2, " ")
    line = text("* 1 FETCH (UID 1 INTERNALDATE \"", day, "-Jul-2026 ", two(doc() % 24), ":", two(doc() % 60), ":00 -0130\")")
    line = F.when(doc() % 4 == 3, '* 2 FETCH (UID 2 INTERNALDATE "soon")').otherwise(line)
    return t("documents").select("doc_id", mail.message_lines(line)["internal_date"].alias("at"))


@over_views("n8_item_keys", "SELECT id, concat_ws(':', uidvalidity, uid) AS key FROM messages")
def n8_item_keys(v):
    return v.messages.select("id", run.item_key(F.col("uidvalidity"), F.col("uid")).alias("key"))


@over_tables("n10_checksums", r"""WITH RECURSIVE shifts AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM shifts WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM shifts WHERE k = 8),
bytes AS (SELECT page_id, list_transform(range(0, length(hex(url)) // 2), lambda i: ('0x' || substr(hex(url), 2 * i + 1, 2))::BIGINT) AS b FROM pages)
SELECT page_id, lpad(lower(to_hex(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT))), 8, '0') AS crc FROM bytes, crc""")
def n10_checksums(t):
    return t("pages").select("page_id", log.checksum(F.col("url")).alias("crc"))


@over_tables("n12_header_texts", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Größe ' || doc_id WHEN 1 THEN 'Größe ' || doc_id || ' ' || source WHEN 2 THEN source || ' ' || doc_id ELSE lang || ' ' || source END AS shown FROM documents")
def n12_header_texts(t):
    """Base 64, quoted, folded and plain."""
    coded = text("=?utf-8?b?", F.base64(F.concat(F.lit("Größe "), doc().cast("string")).cast("binary")), "?=")
    quoted = text("=?iso-8859-1?q?Gr=F6=DFe_", doc(), "?= ", F.col("source"))
    head = pick(doc(), coded, quoted, text(F.col("source"), BREAK, " ", doc()), text(F.col("lang"), " ", F.col("source")))
    return t("documents").select("doc_id", mail.header_texts(head).alias("shown"))


@over_tables("n13_part_names", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '.png' WHEN 1 THEN 'd' || doc_id || '.png' WHEN 2 THEN 'é' || doc_id || '.png' WHEN 3 THEN 'a' || doc_id || '.png' END AS filename FROM documents")
def n13_part_names(t):
    """A type's name, a disposition's before it, a coded one, one in pieces, and pieces that lack the first."""
    place = f"{BREAK}Content-Disposition: attachment"
    head = pick(
        doc(), text("; name=", F.col("source"), ".png"), text("; name=t.png", place, "; filename=d", doc(), ".png"), text(place, "; filename*=iso-8859-1''%E9", doc(), ".png"),
        text(place, "; filename*0=a; filename*1=", doc(), ".png"), text(place, "; filename*1=b"),
    )
    raw = text("Content-Type: image/png", head, BREAK * 2, "x")
    return t("documents").select("doc_id", F.get(message(raw)["attachments"], 0)["filename"].alias("filename"))


@over_tables("n14_decoded", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN source ELSE '日本' END || doc_id AS shown FROM documents")
def n14_decoded(t):
    """Three character sets of Japanese without a label, and plain letters."""
    head = pick(doc(), *(F.unhex(F.lit("日本".encode(c).hex())) for c in ("iso-2022-jp", "cp932", "euc_jp")), F.col("source").cast("binary"))
    return t("documents").select("doc_id", mail.decoded(F.concat(head, doc().cast("string").cast("binary"))).alias("shown"))


@over_tables("n18_remote_images", "SELECT page_id, page_id % 4 <> 1 AND regexp_matches(url, '(?i)^https?://') AS remote FROM pages")
def n18_remote_images(t):
    url = F.col("url")
    page = pick(F.col("page_id"), text('<img src="', url, '">'), text("<img src=cid:x>", url), text("<p style='background:url( ", url, ")'>"), text("<style>p { x: url(", url, ") }</style>"))
    return t("pages").select("page_id", html.remote_images(page).alias("remote"))


@over_views("n20_confined_paths", "SELECT id, id % 5 IN (0, 4) AS inside FROM messages")
def n20_confined_paths(v):
    path = F.col("relative_path")
    shown = pick(ident(), path, text("/", path), text(path, "/../../../x"), text("C:\\", path), text("..", path))
    return v.messages.select("id", files.confined(shown).alias("inside"))


_UNIT = r"""CASE WHEN unicode(c) < 65536 THEN printf('%04x', unicode(c)) ELSE printf('%04x%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END"""
_RUN = rf"""CASE WHEN regexp_matches(r, '^[\x20-\x7e]') THEN r ELSE '&' || replace(rtrim(base64(unhex(array_to_string(list_transform(regexp_extract_all(r, '(?s).'), lambda c: {_UNIT}), ''))), '='), '/', ',') || '-' END"""


@over_tables("n21_mailbox_names", rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(text, '&', '&-'), '[^\x20-\x7e]+|[\x20-\x7e]+'), lambda r: {_RUN}), '') AS coded, text AS back, true AS plain FROM documents""")
def n21_mailbox_names(t):
    """Whole texts as names of folders: as they are written, in seven-bit letters alone, and the same when read back."""
    rows = t("documents").select("doc_id", mail.utf7_encoded(F.col("text")).alias("coded"))
    return rows.select("doc_id", "coded", mail.utf7_decoded(F.col("coded")).alias("back"), F.coalesce(F.col("coded").rlike(r"^[\x20-\x7e]*$"), F.lit(True)).alias("plain"))


@over_views("n24_local_times", "SELECT id, strftime(strptime(date_sent, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS at FROM messages")
def n24_local_times(v):
    return v.messages.select("id", display.local_text(F.col("date_sent"), "Asia/Tokyo").alias("at"))


@over_tables("n28_seconds_left", "SELECT doc_id, (n_chars::DOUBLE - doc_id % 5) / nullif((doc_id % 5)::DOUBLE / nullif((doc_id % 7)::DOUBLE, 0), 0) AS s FROM documents")
def n28_seconds_left(t):
    return t("documents").select("doc_id", display.seconds_left((doc() % 5).cast("double"), F.col("n_chars").cast("double"), (doc() % 7).cast("double")).alias("s"))


@over_tables("n29_attachment_names", "SELECT doc_id, concat_ws(chr(10), source || '.txt', CASE WHEN doc_id % 2 = 1 THEN lang || '.txt' END) AS names FROM documents")
def n29_attachment_names(t):
    part = lambda name, inline: F.struct(name.alias("filename"), inline.alias("is_inline"))
    parts = F.array(part(text(F.col("source"), ".txt"), F.lit(False)), part(F.lit(None).cast("string"), F.lit(False)), part(F.lit("logo.png"), F.lit(True)), part(text(F.col("lang"), ".txt"), doc() % 2 == 0))
    return t("documents").select("doc_id", display.attachment_names(parts).alias("names"))


@over_views("n30_flag_texts", "SELECT id, imap_flags AS flags, len(list_filter(string_split(imap_flags, ' '), lambda f: f <> ''))::INT AS n FROM messages")
def n30_flag_texts(v):
    flags = run.flags_of(F.concat(F.lit(" "), F.replace(F.col("imap_flags"), F.lit(" "), F.lit("  "))))
    return v.messages.select("id", run.flag_text(flags).alias("flags"), F.size(flags).alias("n"))


@over_tables("n32_free_names", "SELECT doc_id AS id, unnest(range(4))::INT AS part, unnest([source || '.txt', source || ' (1).txt', upper(source) || ' (2).TXT', 'attachment']) AS file_name FROM documents")
def n32_free_names(t):
    """The same name twice, the second time in a folder, then in capitals, and none."""
    source = F.col("source")
    of = lambda *name: text("Content-Type: application/x", BREAK, "Content-Disposition: attachment", *name, BREAK * 2, "x")
    raw = multipart(of("; filename=", source, ".txt"), of("; filename=b/", source, ".txt"), of("; filename=", F.upper("source"), ".TXT"), of())
    rows = t("documents").select(doc().alias("id"), raw.cast("binary").alias("content"))
    return export.attachments(rows).select("id", F.col("part_index").alias("part"), "file_name")


@over_tables("f14_valid_modseq", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(doc_id, 0) WHEN 3 THEN 9223372036854775807 - doc_id END AS n FROM documents")
def f14_valid_modseq(t):
    said = pick(doc(), doc().cast("string"), text("x", doc()), text("9223372036854775808"), (F.lit(9223372036854775807) - doc()).cast("string"))
    return t("documents").select("doc_id", sync.valid_modseq(said).alias("n"))


@over_views("f16_enabled_accounts", "SELECT id, is_enabled FROM (SELECT id || '-' || i AS id, CASE i WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'False' WHEN 3 THEN CASE WHEN is_enabled THEN '1' ELSE '0' END END AS is_enabled FROM accounts, range(5) r(i)) WHERE is_enabled IS NULL OR is_enabled NOT IN ('0', 'False')")
def f16_enabled_accounts(v):
    said = F.array(F.lit("0"), F.lit("1"), F.lit("False"), F.when(F.col("is_enabled"), "1").otherwise("0"), F.lit(None).cast("string"))
    rows = v.accounts.select("id", F.posexplode(said).alias("i", "is_enabled"))
    return reparse.enabled_accounts(rows.select(text(F.col("id"), "-", F.col("i")).alias("id"), "is_enabled"))


@over_tables("f22_valid_accounts", "SELECT doc_id, doc_id % 5 IN (0, 4) AS valid FROM documents")
def f22_valid_accounts(t):
    source = F.col("source")
    name = pick(doc(), text(source, "@example.org"), text(source, "/a"), text("com", doc() % 9 + 1), text(source, "."), F.repeat(F.lit("é"), 120))
    return t("documents").select("doc_id", display.valid_account(name).alias("valid"))


# Messages.


@over_tables("a9_bodies", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' plain ' || doc_id || ' ' WHEN 1 THEN 'real ' || doc_id ELSE '' END AS body_text FROM documents")
def a9_bodies(t):
    """The first plain part that is not blank, else the first page with text; named parts are none."""
    plain, page = f"Content-Type: text/plain{BREAK * 2}", f"Content-Type: text/html{BREAK * 2}"
    raw = pick(
        doc(), multipart(page + "<p>page</p>", plain + " ", text(plain, " plain ", doc(), " ")), multipart(page + "<br>", text(page, "<b>real ", doc(), "</b>")),
        multipart(text("Content-Type: text/plain; name=", F.col("source"), BREAK * 2, "named")),
    )
    return t("documents").select("doc_id", message(raw, "not a date")["body_text"].alias("body_text"))


@over_tables("u2_parts", "SELECT doc_id, unnest(range(3))::INT AS i, unnest([NULL, source || '.txt', NULL]) AS filename, unnest(['image/gif', 'text/plain', 'application/pdf']) AS content_type, unnest([true, false, false]) AS is_inline FROM documents")
def u2_parts(t):
    raw = multipart(
        f"Content-Type: image/gif{BREAK}Content-ID: <x>{BREAK * 2}G", text("Content-Type: text/plain; name=", F.col("source"), ".txt", BREAK * 2, "x"),
        f"Content-Type: application/pdf{BREAK}Content-ID: <y>{BREAK}Content-Disposition: attachment{BREAK * 2}P", f"Content-Type: text/plain{BREAK * 2}body",
    )
    rows = t("documents").select("doc_id", F.posexplode(message(raw)["attachments"]).alias("i", "a"))
    return rows.select("doc_id", "i", "a.filename", "a.content_type", "a.is_inline")


@over_tables("u4_rendered", "SELECT doc_id, '<b>' || source || '</b>' AS html_body, CAST(NULL AS VARCHAR) AS text_body, 'sun' || doc_id || '@sky' AS content_id, length(doc_id::VARCHAR)::INT + 3 AS size FROM documents")
def u4_rendered(t):
    raw = multipart(text(f"Content-Type: text/html{BREAK * 2}<b>", F.col("source"), "</b>"), text("Content-Type: image/gif", BREAK, "Content-ID: <sun", doc(), "@sky>", BREAK * 2, "GIF", doc()))
    rows = t("documents").select("doc_id", mail.rendered(raw.cast("binary")).alias("r"))
    part = export.inline_part(F.col("r.parts"), text("sun", doc(), "@sky"))
    return rows.select("doc_id", "r.html_body", "r.text_body", part["content_id"].alias("content_id"), F.length(part["payload"]).alias("size"))


@over_tables("u5_broken_base64", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'InvalidBase64CharactersDefect; InvalidBase64' END AS parse_error, CASE WHEN doc_id % 2 = 1 THEN text || '.' END AS body FROM documents")
def u5_broken_base64(t):
    """Whole texts in base 64, which come back as they were, and bodies that are none."""
    head = f"Content-Type: text/plain; charset=utf-8{BREAK}Content-Transfer-Encoding: base64{BREAK * 2}"
    body = F.when(doc() % 2 == 1, F.base64(text(F.col("text"), ".").cast("binary"))).otherwise(text("%%%%"))
    rows = t("documents").select("doc_id", message(text(head, body)).alias("m"))
    return rows.select("doc_id", "m.parse_error", F.when(doc() % 2 == 1, F.col("m.body_text")).alias("body"))


@over_views("s16_folder_lines", "SELECT raw_name, raw_name AS display_name, CASE id % 3 WHEN 0 THEN '/' WHEN 1 THEN '.' END AS delimiter, CASE id % 3 WHEN 0 THEN '\\Sent' WHEN 1 THEN '\\A,\\B' ELSE '' END AS use FROM folders")
def s16_folder_lines(v):
    """Quoted names, literals and plain ones; lines about something else go."""
    name = F.col("raw_name")
    line = pick(ident(), text('* LIST (\\Sent) "/" "', name, '"'), text("* LIST (\\B \\A) . {", F.length("raw_name"), "}", BREAK, name), text("* LSUB () NIL ", name))
    rows = v.folders.select(F.explode(F.array(line, F.lit("* OK done"))).alias("line")).select(mail.folder_lines("line").alias("f")).where("f IS NOT NULL")
    return rows.select("f.raw_name", "f.display_name", "f.delimiter", F.array_join("f.special_use", ",").alias("use"))


@over_views("s18_message_lines", "SELECT uid, CASE WHEN id % 3 <> 0 THEN size_bytes END AS size_bytes, CASE WHEN id % 3 = 1 THEN id * 1000003 END AS modseq, imap_flags AS flags FROM messages WHERE uid IS NOT NULL")
def s18_message_lines(v):
    """Responses with fields in any order, and lines that say nothing of a message."""
    flags, uid, size = text("FLAGS (", F.col("imap_flags"), ")"), text("UID ", F.coalesce("uid", F.lit(0))), text("RFC822.SIZE ", F.col("size_bytes"))
    envelope = f'ENVELOPE ("d" ((NIL "l" {{3}}{BREAK})"( "h")))'
    line = text("* ", ident(), " FETCH (", pick(ident(), text(flags, " ", uid), text(flags, f" {envelope} ", uid, " MODSEQ (", ident() * 1_000_003, ") ", size), text(size, " ", uid, " ", flags)), ")")
    line = F.when(F.col("uid").isNull(), text("* ", ident(), " EXPUNGE")).otherwise(line)
    return files.listed(v.messages.select(line.alias("line"))).select("uid", "size_bytes", "modseq", run.flag_text(F.col("flags")).alias("flags"))


@over_tables("s20_headers", "SELECT source AS raw_name, doc_id AS uid, n_chars AS size_bytes, CASE WHEN doc_id % 2 = 0 THEN '<' || doc_id || '@x>' END AS message_id, CASE WHEN doc_id % 2 = 0 THEN 'Message-ID: <' || doc_id || '@x>' || chr(13) || chr(10) ELSE '' END || 'Subject: ' || source AS head FROM documents")
def s20_headers(t):
    """The heads of whole messages; what a body says of ids is no header."""
    head = F.when(doc() % 2 == 0, text("Message-ID: <", doc(), "@x>", BREAK)).otherwise(text(""))
    raw = text(head, "Subject: ", F.col("source"), pick(doc(), BREAK * 2, "\n\n"), "message-id: no", "\n", F.coalesce("text", F.lit("")))
    rows = t("documents").select(F.col("source").alias("raw_name"), doc().alias("uid"), F.col("n_chars").alias("size_bytes"), raw.cast("binary").alias("content"))
    return files.headers(rows).select("raw_name", "uid", "size_bytes", "message_id", F.col("head").cast("string").alias("head"))


# Queries, cursors and look-ups.


@over_views("o9_cursors", f"""SELECT id, '{{"sort_key":"' || {KEY} || '","message_id":' || id || '}}' AS cursor, {KEY} AS sort_key, id AS message_id, true AS refused FROM messages""")
def o9_cursors(v):
    """The cursor after each message, and its place read from it again; what is no cursor has none."""
    rows = s.keyed(v.messages).select("id", cursor_text(F.col("sort_key"), ident()).alias("cursor"))
    place = cursor_place(F.col("cursor"))
    return rows.select("id", "cursor", place["sort_key"].alias("sort_key"), place["message_id"].alias("message_id"), cursor_place(F.concat(F.lit("x"), "cursor")).isNull().alias("refused"))


#: The first words of Latin letters of each text, as a saved search: one that is wanted, one that is not, a phrase and a short term.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"
_TERM = "CASE WHEN len(w) >= {0} THEN lower(w[{0}]) ELSE 'none' END"


def _searches(t) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    word = lambda i: F.coalesce(F.get(words, i), F.lit("none"))
    return t("documents").select("doc_id", text(word(0), " -", word(1), '　"', word(2), ' ""x"" ', word(3), '" 5%').alias("query"))


@over_tables("x10_escaped_terms", f"""WITH q AS (SELECT doc_id, {_TERM.format(1)} AS a, {_TERM.format(2)} AS b, {_TERM.format(3)} AS c, {_TERM.format(4)} AS d FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
SELECT doc_id, kind, term FROM (
  SELECT doc_id, CASE WHEN length(a) >= 3 THEN 'match' ELSE 'like' END AS kind, CASE WHEN length(a) >= 3 THEN '"' || a || '"' ELSE a END AS term FROM q
  UNION ALL SELECT doc_id, CASE WHEN length(b) >= 3 THEN 'not match' ELSE 'not like' END, CASE WHEN length(b) >= 3 THEN '"' || b || '"' ELSE b END FROM q
  UNION ALL SELECT doc_id, 'match', '"' || c || ' ""x"" ' || d || '"' FROM q
  UNION ALL SELECT doc_id, 'like', '5\\%' FROM q)""")
def x10_escaped_terms(t):
    rows = _searches(t).select("doc_id", planned(F.col("query")).alias("p"))
    kinds = (("match", "match"), ("like", "like"), ("not match", "not_match"), ("not like", "not_like"))

    def named(kind: str, column: str) -> Column:
        return F.transform(F.col(f"p.{column}"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))

    terms = F.flatten(F.array(*(named(*k) for k in kinds)))
    return rows.select("doc_id", F.explode(terms).alias("x")).select("doc_id", "x.kind", "x.term")


@over_tables("x11_slow_paths", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN length({_TERM.format(1)}) < 3 OR length({_TERM.format(2)}) < 3 ELSE false END AS slow, doc_id % 3 <> 0 AS error FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def x11_slow_paths(t):
    """Whether a saved search has a term that is too short for the index; unfinished and purely negative ones are errors."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    word = lambda i: F.coalesce(F.get(words, i), F.lit("none"))
    query = pick(doc(), text(word(0), " -", word(1)), text("-", word(0)), text('"', word(0)))
    rows = t("documents").select("doc_id", planned(query).alias("p"))
    return rows.select("doc_id", "p.slow", "p.error")


@over_views("f12_folder_ids", "SELECT id FROM folders WHERE id % 3 = 0 AND account_id IN ('account-a', 'account-b')")
def f12_folder_ids(v):
    names = v.folders.where("id % 3 = 0").select("raw_name").unionByName(v.folders.select(text(F.col("raw_name"), " none").alias("raw_name")))
    return reparse.folders_named(v.folders, names, v.accounts.where("id <> 'account-c'").select(F.col("id").alias("account_id")))


@over_views("n27_retry_delays", "SELECT uid, attempt_count, 0.5 * pow(2, attempt_count) AS least, true AS within FROM failures")
def n27_retry_delays(v):
    """The wait before the next try of each failure: doubled, and up to a tenth more."""
    n = F.col("attempt_count")
    rows = v.failures.select("uid", "attempt_count", display.retry_wait(0.5, n, F.lit(0.0)).alias("least"), display.retry_wait(0.5, n, F.rand(7)).alias("wait"))
    return rows.select("uid", "attempt_count", "least", F.col("wait").between(F.col("least"), F.col("least") * 1.1).alias("within"))


# Files and the log.


@over_tables("s13_verified", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'outside' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS state, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN strlen(coalesce(text, '')) END AS bytes FROM documents")
def s13_verified(t):
    """Whole texts as files: some of other content, some absent, some paths that leave the root."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    found = t("documents").where("doc_id % 5 <> 0").select(text("file:/r/eml/a/", doc(), ".eml").alias("path"), F.when(doc() % 7 == 0, F.concat(content, F.lit(b"x"))).otherwise(content).alias("content"))
    path = F.when(doc() % 11 == 0, text("../a/", doc(), ".eml")).otherwise(text("a//", doc(), ".eml"))
    wanted = t("documents").select("doc_id", path.alias("relative_path"), F.upper(F.sha2(content, 256)).alias("file_hash"))
    rows = files.verified(found, wanted.select("relative_path", "file_hash"), "/r//eml/")
    return rows.select(F.regexp_extract("relative_path", r"(\d+)\.eml$", 1).cast("long").alias("doc_id"), "state", F.length("content").cast("long").alias("bytes"))


@over_tables("s15_repaired_log", "SELECT 'f' || user_id AS file, event_id AS place FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE NOT (event_id = last AND user_id % 2 = 0)")
def s15_repaired_log(t):
    """A log of each user's events whose last line is torn for every second user."""
    line = log.line({"account_id": text("u", F.col("user_id")), "event": F.lit("fetch"), "uid": F.col("event_id")})
    ends = t("events").groupBy(F.col("user_id").alias("of")).agg(F.max("event_id").alias("end"))
    rows = t("events").join(ends, F.col("user_id") == F.col("of"))
    torn = (F.col("event_id") == F.col("end")) & (F.col("user_id") % 2 == 0)
    lines = rows.select(text("f", F.col("user_id")).alias("file"), F.col("event_id").alias("place"), F.when(torn, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line).alias("value"))
    return log.repaired(lines).select("file", "place")


@over_tables("i22_replay_zones", "SELECT user_id AS uid, arg_max(CASE event_id % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'moved' ELSE 'deleted' END, event_id) AS remote_state, max(event_id) FILTER (event_id % 3 = 1) AS moved_to_folder_id, count(*) AS n_events FROM events GROUP BY 1")
def i22_replay_zones(t):
    """Events in the order of their instants, whatever zone each time is written in."""
    n = F.col("event_id")
    at = F.lit(EPOCH) + n
    other = lambda hours: F.replace(display.utc_seconds(at + hours * 3600), F.lit("Z"), F.lit(f"{hours:+03d}:00"))
    rows = t("events").select(
        F.lit("a").alias("account_id"), F.lit(1).alias("folder_id"), F.lit(1).alias("uidvalidity"), F.col("user_id").alias("uid"), pick(n, "fetch", "moved", "delete_detected").alias("event"),
        pick(n, display.utc_seconds(at), other(9), other(-5), other(1)).alias("timestamp"), F.lit("p").alias("relative_path"), n.alias("moved_to_folder_id"),
    )
    return log.replay(rows).select("uid", "remote_state", "moved_to_folder_id", "n_events")


# The store.


@over_views("k1_accounts", "SELECT id, 'imap' AS provider_type, CASE WHEN id = 'account-b' THEN 995 ELSE 143 END AS port, is_enabled FROM accounts UNION ALL SELECT id || '-new', 'imap', 993, true FROM accounts")
def k1_accounts(v):
    """Known accounts take what a change says, new ones what nothing says by default."""
    table = v.accounts.withColumn("port", F.lit(143))
    known = table.where("id = 'account-b'").select("id", "provider_type", F.lit(995).alias("port"), "is_enabled")
    fresh = table.select(text(F.col("id"), "-new").alias("id"), "provider_type", F.lit(None).cast("int").alias("port"), F.lit(None).cast("boolean").alias("is_enabled"))
    return store.upsert_accounts(table, known.unionByName(fresh).withColumn("seq", F.lit(1)))


@over_views("k2_folders", "SELECT raw_name, CASE WHEN id % 2 = 0 THEN 'new ' || raw_name ELSE display_name END AS display_name, CASE WHEN id % 2 = 0 THEN 7 ELSE uidvalidity END AS uidvalidity, is_sync_target, id AS known_id FROM folders UNION ALL SELECT raw_name || '/sub', display_name, 1, true, NULL FROM folders")
def k2_folders(v):
    """Known folders keep their ids and whether they are synchronised; the ids of new ones go on from the largest."""
    known = v.folders.where("id % 2 = 0").select("account_id", "raw_name", text("new ", F.col("raw_name")).alias("display_name"), F.lit(7).cast("long").alias("uidvalidity"), F.lit(False).alias("is_sync_target"))
    silent = v.folders.where("id % 2 = 1").select("account_id", "raw_name", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("uidvalidity"), F.lit(False).alias("is_sync_target"))
    fresh = v.folders.select("account_id", text(F.col("raw_name"), "/sub").alias("raw_name"), "display_name", "uidvalidity", F.lit(None).cast("boolean").alias("is_sync_target"))
    out = store.upsert_folders(v.folders, known.unionByName(silent).unionByName(fresh).withColumn("seq", F.lit(1)))
    last = v.folders.agg(F.max("id").alias("last"))
    return out.join(F.broadcast(last)).select("raw_name", "display_name", "uidvalidity", "is_sync_target", F.when(ident() <= F.col("last"), ident()).alias("known_id"))


@over_views("k4_replaced_contents", "SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 'new' ELSE subject_norm END AS subject_norm, CASE WHEN message_id % 3 = 0 THEN 'text ' || message_id ELSE body_text END AS body_text FROM contents")
def k4_replaced_contents(v):
    i = F.col("message_id")
    results = v.contents.where("message_id % 3 <> 2").withColumns({"subject_norm": F.lit("new"), "body_text": text("text ", i), "state": F.when(i % 3 == 0, "ok").otherwise("parse")})
    return reparse.renewed(v.contents, results).select("message_id", "subject_norm", "body_text")


@over_tables("k5_normalised_contents", f"SELECT doc_id AS message_id, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE {_fold('source')} || ' tel' END AS subject_norm, {_fold('lang')} AS sender_norm, {_fold('text')} AS body_text FROM documents")
def k5_normalised_contents(t):
    rows = t("documents").select(
        doc().alias("message_id"), F.when(doc() % 2 == 0, " GIVEN").alias("subject_norm"), text(F.upper("source"), "　ＴＥＬ").alias("subject"), F.upper("lang").alias("sender"),
        F.col("text").alias("body_text"),
    )
    return store.normalised_contents(rows).select("message_id", "subject_norm", "sender_norm", "body_text")


@over_views("k6_sync_targets", "SELECT raw_name, is_sync_target AND raw_name <> 'src1' AS is_sync_target FROM folders")
def k6_sync_targets(v):
    return store.set_sync_target(v.folders, "account-b", "src1", False).select("raw_name", "is_sync_target")


_TOP = "SELECT folder_id, uidvalidity, coalesce(max(uid), 0) AS top FROM messages GROUP BY ALL"


def _tops(v) -> DataFrame:
    return v.messages.groupBy("folder_id", "uidvalidity").agg(F.max("uid").alias("max_uid"))


@over_views("k8_cursor_update", f"SELECT folder_id, uidvalidity, top + CASE WHEN folder_id % 2 = 0 THEN 9 ELSE 0 END AS last_seen_uid, top AS backfill_next_uid FROM ({_TOP})")
def k8_cursor_update(v):
    now = store.cursors(_tops(v))
    new = now.where("folder_id % 2 = 0").select("folder_id", "uidvalidity", (F.col("last_seen_uid") + 9).alias("last_seen_uid"), F.lit(None).cast("long").alias("backfill_next_uid"))
    return store.set_columns(now, new, ("folder_id", "uidvalidity")).select("folder_id", "uidvalidity", "last_seen_uid", "backfill_next_uid")


@over_views("k10_remote_states", "SELECT id, CASE id % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'moved' ELSE remote_state END AS remote_state, CASE id % 3 WHEN 1 THEN 4 WHEN 2 THEN moved_to_folder_id END AS moved_to_folder_id FROM messages")
def k10_remote_states(v):
    """A later state of the same message counts; one without a folder clears it."""
    late = v.messages.where("id % 3 <> 2").select("id", F.when(ident() % 3 == 0, "deleted").otherwise("moved").alias("remote_state"), F.when(ident() % 3 == 1, 4).cast("long").alias("moved_to_folder_id"), F.lit(2).alias("seq"))
    early = late.withColumns({"remote_state": F.lit("unknown"), "moved_to_folder_id": F.lit(1).cast("long"), "seq": F.lit(1)})
    return store.set_remote_state(v.messages, early.unionByName(late)).select("id", "remote_state", "moved_to_folder_id")


_LEGACY = "strftime(make_timestamp((o_orderkey * 7919) * 1000000), '{0}')"


@over_tables("k23_legacy_times", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {_LEGACY.format('%Y-%m-%dT%H:%M:%SZ')} WHEN 1 THEN {_LEGACY.format('%Y-%m-%dT%H:%M:%SZ')} WHEN 2 THEN {_LEGACY.format('%Y-%m-%dT00:00:00Z')}
 WHEN 3 THEN '2024-02-30 01:02:03' ELSE {_LEGACY.format('%Y-%m-%dT%H:%M:%S+09:00')} END AS at FROM orders""")
def k23_legacy_times(t):
    """With a fraction, with a zone, days alone, what is no time, and what is canonical already."""
    k = F.col("o_orderkey") * 7919
    plain = lambda c: F.replace(F.substring(display.utc_seconds(c), 1, 19), F.lit("T"), F.lit(" "))
    at = pick(F.col("o_orderkey"), text(plain(k), ".5"), text(plain(k + 32_400), "+09:00"), F.substring(plain(k), 1, 10), F.lit("2024-02-30 01:02:03"), text(F.substring(display.utc_seconds(k), 1, 19), "+09:00"))
    return t("orders").select("o_orderkey", store.canonical_time(at).alias("at"))


@over_views("k21_migrated", f"""SELECT 'folders' AS "table", id, CAST(NULL AS BIGINT) AS backfill_next_uid, false AS initial_sync_completed, CAST(NULL AS BIGINT) AS highest_modseq, CAST(NULL AS BIGINT) AS uidvalidity, {_stamp(f'{EPOCH} + id')} AS at FROM folders
 UNION ALL SELECT 'sync_failures', uid, NULL, NULL, NULL, 0, first_failed_at FROM failures
 UNION ALL SELECT 'messages', id, NULL, NULL, NULL, NULL, date_sent FROM messages""")
def k21_migrated(v):
    """Tables of the first version, with its times, as those of the newest."""
    old = lambda c: F.replace(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    tables = {
        "folders": v.folders.select("id", old(display.utc_seconds(F.lit(EPOCH) + ident())).alias("last_synced_at")),
        "sync_failures": v.failures.select(F.col("uid").alias("id"), old(F.col("first_failed_at")).alias("first_failed_at")),
        "messages": v.messages.select("id", old(F.col("date_sent")).alias("date_sent")),
    }
    new = export.migrate(tables, 1)
    folders = new["folders"].select(F.lit("folders").alias("table"), "id", "backfill_next_uid", "initial_sync_completed", "highest_modseq", F.lit(None).cast("long").alias("uidvalidity"), F.col("last_synced_at").alias("at"))
    failures = new["sync_failures"].select(F.lit("sync_failures").alias("table"), "id", "uidvalidity", F.col("first_failed_at").alias("at"))
    messages = new["messages"].select(F.lit("messages").alias("table"), "id", F.col("date_sent").alias("at"))
    return folders.unionByName(failures, allowMissingColumns=True).unionByName(messages, allowMissingColumns=True)


@over_tables("a3_totals", "SELECT sum(n_chars)::BIGINT AS fetched, sum(doc_id)::BIGINT AS transferred_bytes, sum(doc_id % 3)::BIGINT AS skipped, sum(doc_id % 2)::BIGINT AS failed, bool_or(doc_id = 5) AS cancelled FROM documents")
def a3_totals(t):
    return reparse.total_results(t("documents").select(F.col("n_chars").alias("fetched"), doc().alias("transferred_bytes"), (doc() % 3).alias("skipped"), (doc() % 2).alias("failed"), (doc() == 5).alias("cancelled")))


@over_tables("a5_reparse_counters", "SELECT count(*) AS processed, count(*) FILTER (doc_id % 7 < 3) AS updated, count(*) FILTER (doc_id % 7 >= 3) AS skipped, count(*) FILTER (doc_id % 7 = 3) AS missing, count(*) FILTER (doc_id % 7 = 4) AS mismatched, count(*) FILTER (doc_id % 7 = 5) AS parse_failed FROM documents")
def a5_reparse_counters(t):
    return reparse.counters(t("documents").select(pick(doc(), "ok", "ok", "ok", "missing", "mismatch", "parse", "outside").alias("state")))


# Synchronisation runs.

LARGE = 4000
_REMOTE = f"SELECT m.*, x.error_class, x.attempt_count FROM messages m LEFT JOIN failures x ON x.account_id = m.account_id AND x.folder_id = m.folder_id AND x.uidvalidity = m.uidvalidity AND x.uid = m.uid WHERE m.uid IS NOT NULL AND m.uidvalidity = 1"
_PART = f"""CASE WHEN attempt_count < 10 AND error_class = 'oversize' AND size_bytes > {LARGE} THEN NULL WHEN attempt_count < 10 THEN 'retry'
 WHEN uid > 600 THEN 'forward' WHEN uid <= 300 THEN 'backfill' END"""
_WORK = f"SELECT * FROM (SELECT *, {_PART} AS part FROM ({_REMOTE})) WHERE part IS NOT NULL"
#: Of even folders the run is stopped at uid 150.
_DONE = f"SELECT * FROM ({_WORK}) WHERE NOT (part = 'backfill' AND folder_id % 2 = 0 AND uid < 150)"
_OUTCOME = f"CASE WHEN size_bytes > {LARGE} THEN 'oversize' WHEN uid % 5 < 3 THEN 'ok' WHEN uid % 5 = 3 THEN 'parse' ELSE 'transient' END"
_SETTLED = f"""SELECT *, CASE WHEN outcome IN ('ok', 'parse') THEN EXISTS (SELECT 1 FROM messages o WHERE o.id % 10 = 0 AND o.account_id = d.account_id AND o.file_hash = d.file_hash)
  OR row_number() OVER (PARTITION BY outcome IN ('ok', 'parse'), account_id, file_hash ORDER BY folder_id, uidvalidity, uid) > 1 END AS deduplicated
 FROM (SELECT *, {_OUTCOME} AS outcome FROM ({_DONE})) d"""


def _cursors(v) -> DataFrame:
    return v.folders.select(
        ident().alias("folder_id"), "uidvalidity", F.lit(600).cast("long").alias("last_seen_uid"), F.lit(300).cast("long").alias("backfill_next_uid"), F.lit(False).alias("initial_sync_completed"),
        F.lit(None).cast("long").alias("highest_modseq"),
    )


def _work(v) -> DataFrame:
    """What a run fetches of a mailbox that lists all stored messages."""
    remote = v.messages.where("uid IS NOT NULL").select("account_id", "folder_id", text("src", F.col("folder_id")).alias("folder_raw_name"), "uidvalidity", "uid", "size_bytes")
    return run.work(remote, _cursors(v), v.failures, most_bytes=LARGE)


def _settled(v) -> run.Settled:
    stops = v.folders.where("id % 2 = 0").select(ident().alias("folder_id"), "uidvalidity", F.lit(150).cast("long").alias("stop_uid"))
    done = run.reached(_work(v), stops)
    outcome = pick(F.col("uid"), "ok", "ok", "ok", "parse", "transient")
    outcomes = v.messages.where("uid IS NOT NULL").select(*sync.PLACE, outcome.alias("outcome"), "message_id", "content_key", "file_hash", "relative_path")
    listing = v.messages.where("uidvalidity = 1").groupBy("folder_id", "uidvalidity").agg(F.max("uid").alias("max_uid"))
    return run.settle(done, outcomes, _cursors(v), listing, v.messages.where("id % 10 = 0"), AT, stops, LARGE)


@over_views("i1_first_and_new_generations", f"""SELECT folder_id, uidvalidity, CASE WHEN folder_id % 3 = 1 THEN 5 ELSE top END AS last_seen_uid, top AS backfill_next_uid, folder_id % 3 <> 1 AND top = 0 AS initial_sync_completed, CAST(NULL AS BIGINT) AS highest_modseq
 FROM (SELECT folder_id, 1::BIGINT AS uidvalidity, coalesce(max(uid), 0) AS top FROM messages GROUP BY 1)""")
def i1_first_and_new_generations(v):
    """Folders without a cursor, with one that lacks its backfill, and with one of an older generation."""
    listing = v.messages.groupBy("folder_id").agg(F.lit(1).cast("long").alias("uidvalidity"), F.max("uid").alias("max_uid"))
    n = F.col("folder_id")
    known = listing.where(n % 3 != 0).select(
        "folder_id", F.when(n % 3 == 1, 1).otherwise(0).cast("long").alias("uidvalidity"), F.lit(5).cast("long").alias("last_seen_uid"), F.lit(None).cast("long").alias("backfill_next_uid"),
        F.lit(False).alias("initial_sync_completed"), F.lit(None).cast("long").alias("highest_modseq"),
    )
    return run.started(listing, known)


@over_views("i2_i3_i8_work", f"SELECT folder_id, uid, part FROM ({_WORK})")
def i2_i3_i8_work(v):
    return _work(v).select("folder_id", "uid", "part")


@over_views("i19_broken_folders", f"SELECT account_id, folder_id, uid FROM ({_WORK}) WHERE account_id <> 'account-c' AND folder_id % 5 <> 0")
def i19_broken_folders(v):
    """Every fifth folder could not be read, and one account could not be signed in to."""
    broken = v.folders.where("id % 5 = 0").select("account_id", ident().alias("folder_id"), F.lit("fetch").alias("kind"))
    broken = broken.unionByName(v.accounts.where("id = 'account-c'").select(ident().alias("account_id"), F.lit(None).cast("long").alias("folder_id"), F.lit("auth").alias("kind")))
    remote = v.messages.where("uid IS NOT NULL").select("account_id", "folder_id", "uidvalidity", "uid", "size_bytes")
    return run.work(remote, _cursors(v), v.failures, broken, LARGE).select("account_id", "folder_id", "uid")


@over_views("i4_i18_cursors", """SELECT f.id AS folder_id, f.uidvalidity, greatest(600, coalesce(max(m.uid), 0)) AS last_seen_uid, CASE WHEN f.id % 2 = 0 THEN 149 ELSE 0 END AS backfill_next_uid, f.id % 2 <> 0 AS initial_sync_completed
 FROM folders f LEFT JOIN messages m ON m.folder_id = f.id AND m.uidvalidity = 1 GROUP BY f.id, f.uidvalidity""")
def i4_i18_cursors(v):
    """The cursors after a run that was stopped in every second folder."""
    return _settled(v).cursors.drop("highest_modseq")


@over_views("i7_attempts", f"SELECT folder_id, uid, outcome AS error_class FROM ({_SETTLED}) WHERE outcome <> 'ok'")
def i7_attempts(v):
    return _settled(v).attempts.select("folder_id", "uid", "error_class")


@over_views("i9_i17_events", f"""SELECT CASE WHEN outcome = 'oversize' THEN 'fetch_skipped' ELSE 'fetch' END AS event, uid, uidvalidity || ':' || uid AS source_item_key, CASE WHEN outcome <> 'oversize' THEN file_hash END AS file_hash,
 CASE WHEN outcome = 'oversize' THEN 'oversize' END AS reason, deduplicated FROM ({_SETTLED}) WHERE outcome <> 'transient'""")
def i9_i17_events(v):
    return _settled(v).events.select("event", "uid", "source_item_key", "file_hash", "reason", "deduplicated")


@over_views("i6_messages", f"SELECT uid, CASE WHEN outcome = 'oversize' THEN 'uid:1:' || uid ELSE content_key END AS content_key, CASE WHEN outcome <> 'oversize' THEN relative_path END AS relative_path FROM ({_SETTLED}) WHERE outcome <> 'transient'")
def i6_messages(v):
    return _settled(v).messages.select("uid", "content_key", "relative_path")


@over_views("i17_state_events", """SELECT CASE n WHEN 1 THEN 'moved' WHEN 0 THEN 'delete_detected' ELSE 'remote_state_unknown' END AS event, uid, CASE WHEN n = 1 THEN folder END AS moved_to_folder_id FROM (
 SELECT g.id, g.uid, count(c.id) AS n, min(c.folder_id) AS folder FROM messages g LEFT JOIN messages c ON c.account_id = g.account_id AND c.content_key = g.content_key AND c.file_hash = g.file_hash AND c.folder_id <> g.folder_id AND c.remote_state = 'present'
 WHERE g.uid IS NOT NULL AND g.uid % 5 = 0 GROUP BY g.id, g.uid)""")
def i17_state_events(v):
    gone = sync.missing(v.messages, v.messages.where("uid % 5 <> 0"))
    return run.state_events(sync.moves(gone, v.messages), v.messages, AT).select("event", "uid", "moved_to_folder_id")


_SAVED = "CASE id % 4 WHEN 1 THEN 5 WHEN 2 THEN 50 END"
_OLD = "EXISTS (SELECT 1 FROM messages m WHERE m.folder_id = f.id AND m.uidvalidity = f.uidvalidity AND m.uid IS NOT NULL AND m.internal_date >= '2026-07-01T00:00:00Z' AND m.id % 20 < 15 AND (m.flags_seen_at IS NULL OR m.flags_seen_at <= '2026-07-01T23:00:00Z'))"


@over_views("i10_i14_flag_paths", f"""SELECT folder_id, path, CASE WHEN path IN ('baseline', 'delta') THEN 9 WHEN path = 'wait' OR (path = 'none' AND NOT reset) THEN saved END AS highest_modseq FROM (
 SELECT f.id AS folder_id, {_SAVED} AS saved, {_SAVED} IS NOT NULL AND (NOT stores OR {_SAVED} > 9) AS reset,
  CASE WHEN f.id % 7 = 0 THEN 'wait' WHEN NOT {_OLD} THEN 'none' WHEN stores AND ({_SAVED} IS NULL OR {_SAVED} > 9) THEN 'baseline' WHEN stores THEN 'delta' ELSE 'ttl' END AS path
 FROM (SELECT *, id % 3 <> 0 AS stores FROM folders) f)""")
def i10_i14_flag_paths(v):
    folders = v.folders.select(
        ident().alias("folder_id"), "uidvalidity", (ident() % 7 != 0).alias("initial_sync_completed"), pick(ident(), F.lit(None).cast("string"), F.lit("5"), F.lit("50"), F.lit("x")).alias("highest_modseq"),
        F.lit(9).alias("server_modseq"), (ident() % 3 != 0).alias("condstore"),
    )
    window = sync.flag_window(v.messages, "2026-07-01T00:00:00Z").where("id % 20 < 15")
    return run.flag_paths(folders, window, "2026-07-02T00:00:00Z")


@over_tables("k18_exported_messages", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'message ' ELSE 'Re_ ' || lang || '_' || source || ' ' END || doc_id || '.eml' AS file_name, strlen(text) AS bytes FROM documents")
def k18_exported_messages(t):
    subject = F.when(doc() % 5 != 0, text("x/Re: ", F.col("lang"), "?", F.col("source"))).otherwise(" ")
    rows = t("documents").select(doc().alias("id"), subject.alias("subject"), F.col("text").cast("binary").alias("content"))
    return export.message_file(rows).select("file_name", F.length("content").cast("long").alias("bytes"))


def _stored_files(t) -> DataFrame:
    """Whole texts as files, some of other content and some absent."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return t("documents").where("doc_id % 5 <> 0").select(text("file:/r/eml/", doc(), ".eml").alias("path"), F.when(doc() % 7 == 0, F.concat(content, F.lit(b"x"))).otherwise(content).alias("content"))


@over_tables("k17_reused_files", "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, strlen(coalesce(text, '')) AS size_bytes FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0")
def k17_reused_files(t):
    """Files that are there with the hash that is asked for; hashes that are none and paths outside reuse nothing."""
    digest = F.upper(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    path = F.when(doc() % 11 == 0, text("../eml/", doc(), ".eml")).otherwise(text(doc(), ".eml"))
    wanted = t("documents").select(path.alias("relative_path"), F.when(doc() % 13 == 0, F.substring(digest, 1, 63)).otherwise(digest).alias("file_hash"))
    rows = files.reusable(_stored_files(t), wanted, "/r/eml")
    return rows.select(F.regexp_extract("relative_path", r"(\d+)\.eml$", 1).cast("long").alias("doc_id"), "file_hash", "size_bytes")


@over_tables("k18_verified_exports", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS state, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN source || ' ' || doc_id || '.eml' END AS file_name, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS digest FROM documents")
def k18_verified_exports(t):
    """Only what still has its hash is exported."""
    rows = t("documents").select(doc().alias("id"), F.col("source").alias("subject"), text(doc(), ".eml").alias("relative_path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"))
    found = export.verified_files(rows, _stored_files(t), "/r/eml")
    return found.select("id", "state", "file_name", F.sha2("content", 256).alias("digest"))


@over_tables("n1_normalised_forms", "SELECT doc_id, 'tel. 0' || doc_id || ' strasse ' || lower(source) AS shown FROM documents")
def n1_normalised_forms(t):
    """Full-width forms, other blanks and a capital sharp s."""
    return t("documents").select("doc_id", normalised(text("　Ｔｅｌ．\u2007０", doc(), " \t\n STRAẞE ", F.col("source"))).alias("shown"))
