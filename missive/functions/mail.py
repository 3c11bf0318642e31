"""Messages as rows: parsing, headers, character sets and attachment names.

The work on one message is small helper code on the standard library's e-mail package; the
columns around it are Arrow functions, so messages stay in their partitions.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from email import message_from_bytes
from email.errors import HeaderParseError
from email.header import Header, decode_header
from email.message import Message
from email.utils import parsedate_to_datetime
from itertools import count, takewhile
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from charset_normalizer import from_bytes
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missive.functions.html import html_to_text
from missive.functions.normalise import without_surrogates
from missive.plans.filters import utc_text

#: Names that senders use for character sets, and the order of guesses.
LABELS = {
    "x-sjis": "cp932", "xsjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932",
    "iso-2022-jp-ms": "iso2022_jp_ext", "iso_2022_jp_ms": "iso2022_jp_ext", "iso2022jpms": "iso2022_jp_ext",
}
#: Names that are taken beyond those.
LABELS |= {"windows-31j": "cp932", "ms932": "cp932", "cp50220": "iso2022_jp_ext", "x-euc-jp": "euc_jp"}
GUESSES = ("iso-2022-jp", "iso2022_jp_ext", "cp932", "euc_jp", "utf-8")
LENIENT = "iso2022_jp_ext"
#: Share of replaced characters up to which a lenient reading stands.
REPLACED = 0.05
#: Names that Windows keeps for devices, and endings of programs.
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
PROGRAMS = {"exe", "scr", "js", "vbs", "lnk", "bat", "cmd", "ps1"}
NAME_BYTES = 255

ATTACHMENT = T.StructType([T.StructField("filename", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("is_inline", T.BooleanType())])
_TEXTS = ("subject", "sender", "recipient", "cc", "date_sent", "message_id", "in_reply_to", "references_ids", "thread_key", "content_key", "body_text")
PARSED = T.StructType([*(T.StructField(c, T.StringType()) for c in _TEXTS), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("has_attachment", T.BooleanType()), T.StructField("parse_error", T.StringType())])
PART = T.StructType([T.StructField("content_id", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("is_inline", T.BooleanType())])
RENDERED = T.StructType([T.StructField("html_body", T.StringType()), T.StructField("text_body", T.StringType()), T.StructField("parts", T.ArrayType(PART)), T.StructField("error", T.StringType())])
SAFE_NAME = T.StructType([T.StructField("name", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("is_executable", T.BooleanType())])


def charset_label(label: str) -> str:
    plain = re.sub(r"\s+", "", label).casefold()
    return LABELS.get(plain, plain)


def _strict(raw: bytes, charset: str) -> str | None:
    try:
        return without_surrogates(raw.decode(charset))
    except (ValueError, LookupError):  # bytes that it has not, and names that are none
        return None


def decode_text(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """The text and the character set that gave it."""
    label = charset_label(declared) if declared else None
    order = [label] if label else []
    jis = label in ("iso-2022-jp", "iso2022_jp_ext")
    # Seven-bit escapes are valid in cp932 too, so a lenient reading comes before it.
    for guess in (*order, *GUESSES):
        if guess == "cp932" and jis:
            text = raw.decode(LENIENT, "replace")
            if text and text.count("\ufffd") / len(text) <= REPLACED:
                return text, f"{LENIENT} (replace)"
        if (text := _strict(raw, guess)) is not None:
            return text, guess
    best = from_bytes(raw).best()
    if best is not None:
        return str(best), best.encoding
    return raw.decode("utf-8", "replace"), "utf-8"


def header_text(value: str | Header | None) -> str | None:
    """A header with its encoded words, and bytes that it should not have, read; the header
    itself where that fails."""
    if value is None:
        return None
    try:
        found = decode_header(value)
        parts = [decode_text(p, None if c == "unknown-8bit" else c)[0] if isinstance(p, bytes) else p for p, c in found]
    except (ValueError, LookupError, HeaderParseError):
        return without_surrogates(str(value))
    return without_surrogates(re.sub(r"\r?\n[ \t]+", " ", "".join(parts)) or str(value))


_PARAMETER = re.compile(r';\s*([^\s=;]+)\s*=\s*("(?:\\.|[^"\\])*"|[^;]*)', re.S)


def parameters(part: Message, header: str) -> dict[str, str]:
    """The parameters of a header as they stand, without quotes; of one given twice the last."""
    raw = next((str(v) for k, v in part.raw_items() if k.lower() == header), "")
    if not raw.isascii():
        raw = decode_text(raw.encode("utf-8", "surrogateescape"))[0]
    found = _PARAMETER.findall(re.sub(r"\r?\n[ \t]*", " ", raw))
    return {k.lower(): re.sub(r"\\(.)", r"\1", v.strip()[1:-1]) if v.startswith('"') else v.strip() for k, v in found}


def _extended(value: str) -> str:
    """``charset'language'percent-encoded``; UTF-8 where that is not said or not right."""
    parts = value.split("'", 2)
    charset = parts[0] if len(parts) > 1 else ""
    raw = unquote_to_bytes(parts[2] if len(parts) == 3 else value)
    text = _strict(raw, charset or "utf-8")
    return raw.decode("utf-8", "replace") if text is None else text


def _named(given: dict[str, str], base: str) -> str | None:
    """A parameter's value: extended, or in pieces numbered from 0 up to the first gap, or plain."""
    if f"{base}*" in given:
        return _extended(given[f"{base}*"])
    pieces: dict[int, str] = {}
    for key, value in given.items():
        if m := re.fullmatch(rf"{re.escape(base)}\*([0-9]+)(\*?)", key):
            pieces.setdefault(int(m[1]), _extended(value) if m[2] else value)
    if not pieces:
        return header_text(given.get(base))
    known = takewhile(pieces.__contains__, count())
    return "".join(pieces[i] for i in known) or None


def file_name(part: Message) -> str | None:
    """The name of a part: of its disposition, else of its type; ``filename`` before ``name``."""
    for header in ("content-disposition", "content-type"):
        given = parameters(part, header)
        for base in ("filename", "name"):
            if (found := _named(given, base)) is not None:
                return without_surrogates(found)
    return None


def date_text(value: str | None, internal: datetime | None, now: datetime) -> str | None:
    """The date header in UTC; the mailbox's date where it is missing, unreadable or over a day
    ahead of ``now``."""
    try:
        sent = parsedate_to_datetime(str(value)) if value else None
    except (ValueError, TypeError, IndexError):
        sent = None
    if sent is not None:
        sent = sent.replace(tzinfo=UTC) if sent.tzinfo is None else sent
        if sent > now + timedelta(days=1):
            sent = None
    sent = sent or internal
    return utc_text(sent) if sent else None


def instant(text: str | None) -> datetime | None:
    """A time as text; null if it cannot be read, and UTC without a zone."""
    try:
        at = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return at.replace(tzinfo=UTC) if at and at.tzinfo is None else at


def first_id(value: str | None) -> str | None:
    if not value or not value.strip():
        return None
    found = re.search(r"<[^<>]+>", value)
    return found[0] if found else value.split()[0]


def thread_key(message_id: str | None, in_reply_to: str | None, references: str | None) -> str | None:
    return first_id(references) or first_id(in_reply_to) or first_id(message_id)


def content_key(message_id: str | None, sha256: str) -> str:
    return (message_id or "").strip() or f"sha256:{sha256[:32]}"


def _payload(part: Message) -> bytes:
    found = part.get_payload(decode=True)
    return found.encode("utf-8", "replace") if isinstance(found, str) else found or b""


def _broken(part: Message) -> bool:
    """Whether a leaf's base64 is not base64."""
    if str(part.get("content-transfer-encoding", "")).strip().lower() != "base64":
        return False
    raw = re.sub(r"\s+", "", part.get_payload() if isinstance(part.get_payload(), str) else "")
    try:
        base64.b64decode(raw, validate=True)
    except (binascii.Error, ValueError):
        return True
    return False


def leaves(message: Message) -> list[dict]:
    """The leaf parts in order, and what each is."""
    out = []
    for part in message.walk():
        if part.is_multipart() or part.get_content_maintype() == "multipart":
            continue
        name, kept = file_name(part), part.get_content_disposition()
        inline = part.get("content-id") is not None and kept != "attachment"
        attached = kept in ("attachment", "inline") or name is not None or inline or part.get_content_maintype() not in ("text", "message")
        body = part.get_content_maintype() == "text" and name is None and kept != "attachment"
        out.append({"part": part, "name": name, "inline": inline, "attached": attached, "body": body})
    return out


def texts(found: list[dict], kind: str) -> Iterator[str]:
    """The bodies of a text type in order."""
    for leaf in found:
        if leaf["body"] and leaf["part"].get_content_type() == kind:
            yield decode_text(_payload(leaf["part"]), leaf["part"].get_content_charset())[0]


def first_shown(bodies: Iterable[str]) -> str | None:
    return next((x for x in bodies if x.strip()), None)


def body_text(found: list[dict]) -> str:
    """The first plain body that is not blank, else the first HTML body whose text is not."""
    return first_shown(texts(found, "text/plain")) or first_shown(map(html_to_text, texts(found, "text/html"))) or ""


def parse_message(raw: bytes, internal: datetime | None, now: datetime) -> dict:
    """A row of ``PARSED``; never fails.  Defects are named in ``parse_error``, and what could be
    read is there all the same."""
    row: dict = dict.fromkeys(PARSED.names)
    errors: list[str] = []
    row |= {"attachments": [], "has_attachment": False, "body_text": "", "subject": "", "sender": "", "recipient": "", "cc": ""}
    digest = hashlib.sha256(raw).hexdigest()
    try:
        message = message_from_bytes(raw)
        row |= {k: header_text(message.get(h)) or "" for k, h in (("subject", "subject"), ("sender", "from"), ("recipient", "to"), ("cc", "cc"))}
        row["date_sent"] = date_text(message.get("date"), internal, now)
        row |= {k: without_surrogates(str(message[h])) if message.get(h) is not None else None for k, h in (("message_id", "message-id"), ("in_reply_to", "in-reply-to"), ("references_ids", "references"))}
        row["thread_key"] = thread_key(row["message_id"], row["in_reply_to"], row["references_ids"])
        found = leaves(message)
        row["body_text"] = without_surrogates(body_text(found))
        row["attachments"] = [
            {"filename": x["name"], "content_type": without_surrogates(x["part"].get_content_type()), "size_bytes": len(_payload(x["part"])), "is_inline": x["inline"]}
            for x in found if x["attached"]
        ]
        row["has_attachment"] = any(not a["is_inline"] for a in row["attachments"])
        for part in message.walk():
            errors += [type(d).__name__ for d in part.defects]
        errors += ["InvalidBase64" for x in found if _broken(x["part"])]
    except Exception as e:  # noqa: BLE001  whatever a message holds, its row is written
        errors.append(type(e).__name__)
    row["content_key"] = content_key(row["message_id"], digest)
    row["parse_error"] = "; ".join(dict.fromkeys(errors)) or None
    return row


def render_message(raw: bytes) -> dict:
    """A row of ``RENDERED``; a part's place in ``parts`` does not change.  A message that is nested too deeply
    or broken otherwise has no bodies and no parts, and its error's name."""
    try:
        return _rendered(raw)
    except Exception as e:
        return {"html_body": None, "text_body": None, "parts": [], "error": type(e).__name__}


def _rendered(raw: bytes) -> dict:
    found = leaves(message_from_bytes(raw))
    parts = [
        {"content_id": (without_surrogates(str(x["part"]["content-id"])).strip().strip("<>") if x["part"].get("content-id") else None), "content_type": without_surrogates(x["part"].get_content_type()),
         "filename": x["name"], "payload": _payload(x["part"]), "is_inline": x["inline"]}
        for x in found if x["attached"]
    ]
    return {"html_body": first_shown(texts(found, "text/html")), "text_body": first_shown(texts(found, "text/plain")), "parts": parts, "error": None}


def safe_name(name: str) -> dict:
    """A name that any file system takes, and what was changed, in order."""
    warnings: list[str] = []

    def note(warning: str, changed: bool) -> None:
        if changed:
            warnings.append(warning)

    name = unicodedata.normalize("NFC", name)
    last = re.split(r"[\\/]", name)[-1]
    note("path_component", last != name)
    new = re.sub(r'[<>:"/\\|?*]', "_", last)
    note("forbidden_character", new != last)
    last, new = new, "".join("_" if unicodedata.category(c) == "Cc" else c for c in new)
    note("control_character", new != last)
    last, new = new, new.rstrip(". ")
    note("trailing_character", new != last)
    note("empty_name", not new)
    new = new or "attachment"
    stem, dot, ending = new.partition(".")
    if stem.casefold() in RESERVED:
        note("reserved_name", True)
        new = f"{stem}_{dot}{ending}"
    if len(new.encode()) > NAME_BYTES:
        note("truncated", True)
        stem, dot, ending = new.rpartition(".")
        tail = f".{ending}" if dot and len(ending.encode()) < 32 else ""
        stem = stem if tail else new
        new = stem.encode()[: NAME_BYTES - len(tail.encode())].decode("utf-8", "ignore") + tail
    program = "." in new and new.rpartition(".")[2].casefold() in PROGRAMS
    note("executable_extension", program)
    return {"name": new, "warnings": warnings, "is_executable": program}


def encode_utf7(value: str) -> str:
    """Mailbox names as IMAP writes them."""
    def run(m: re.Match) -> str:
        return "&" + base64.b64encode(m[0].encode("utf-16-be")).decode().rstrip("=").replace("/", ",") + "-"

    return re.sub(r"[^\x20-\x7e]+", run, value.replace("&", "&-"))


def decode_utf7(value: str) -> str:
    def run(m: re.Match) -> str:
        if not m[1]:
            return "&"
        raw = m[1].replace(",", "/")
        try:
            return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-16-be")
        except ValueError:
            return m[0]

    return re.sub(r"&([A-Za-z0-9+,]*)-", run, value)


_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|"(?P<quoted>(?:\\.|[^"\\])*)"|\{(?P<size>[0-9]+)\+?\}\r?\n|(?P<atom>[^\s()"\[]+(?:\[[^\]]*\][^\s()]*)?))', re.S)


def response(raw: str) -> list:
    """A server's response as text, numbers and nested lists; a literal is the text of its length in
    bytes after its line end, and ``NIL`` is null.  What is no token ends it."""
    data = raw.encode("utf-8", "replace").decode("latin-1")  # a character for each byte
    plain = lambda x: x.encode("latin-1").decode("utf-8", "replace")
    stack: list[list] = [[]]
    at = 0
    while m := _TOKEN.match(data, at):
        at = m.end()
        if m["open"]:
            stack.append([])
        elif m["close"]:
            if len(stack) == 1:
                break
            done = stack.pop()
            stack[-1].append(done)
        elif m["quoted"] is not None:
            stack[-1].append(re.sub(r"\\(.)", r"\1", plain(m["quoted"])))
        elif m["size"]:
            size = int(m["size"]) if len(m["size"]) <= 18 else len(data)  # a literal has at most what is left
            stack[-1].append(plain(data[at : at + size]))
            at += size
        else:
            stack[-1].append(None if m["atom"].upper() == "NIL" else plain(m["atom"]))
    while len(stack) > 1:  # what a cut response left open
        done = stack.pop()
        stack[-1].append(done)
    return stack[0]


def folder_line(line: str) -> dict | None:
    """A response that lists a folder; None for another."""
    found = response(line)
    if len(found) < 5 or found[0] != "*" or str(found[1]).upper() not in ("LIST", "LSUB") or not isinstance(found[2], list) or not isinstance(found[4], str):
        return None
    use, delimiter, raw = found[2:5]
    return {"raw_name": raw, "display_name": without_surrogates(decode_utf7(raw)), "delimiter": delimiter if isinstance(delimiter, str) else None, "special_use": sorted(filter(None, map(str, use)))}


def internal_time(text: str | None) -> str | None:
    """``INTERNALDATE`` in UTC text; null if it cannot be read."""
    try:
        return utc_text(parsedate_to_datetime(text.strip().replace("-", " ", 2))) if text else None
    except (ValueError, TypeError, IndexError, OverflowError):
        return None


def message_line(line: str, header: str = "") -> dict:
    """What a response about a message says of it; null for what it does not say."""
    found = next((x for x in response(line) if isinstance(x, list)), [])
    said = {k.upper(): v for k, v in zip(found[::2], found[1::2], strict=False) if isinstance(k, str)}

    def number(name: str) -> int | None:
        value = said.get(name)
        value = value[0] if isinstance(value, list) and value else value
        if not isinstance(value, str) or not re.fullmatch(r"0*[0-9]{1,19}", value):
            return None
        n = int(value.lstrip("0") or "0")
        return n if n < 1 << 63 else None

    mid = re.search(r"(?im)^message-id:\s*(\S+)", header)
    flags = said.get("FLAGS")
    return {
        "uid": number("UID"), "size_bytes": number("RFC822.SIZE"), "modseq": number("MODSEQ"), "internal_date": internal_time(said.get("INTERNALDATE")),
        "flags": [f for f in flags if isinstance(f, str)] if isinstance(flags, list) else [], "message_id": mid and mid[1],
    }


def _rows(function, kind: T.DataType):
    """An Arrow column function from a function of one value; null gives null."""
    from pyspark.sql.pandas.types import to_arrow_type

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else function(v) for v in values.to_pylist()], to_arrow_type(kind))

    return run


rendered = _rows(render_message, RENDERED)
safe_names = _rows(safe_name, SAFE_NAME)
utf7_encoded = _rows(encode_utf7, T.StringType())
utf7_decoded = _rows(decode_utf7, T.StringType())
header_texts = _rows(header_text, T.StringType())
FOLDER_LINE = T.StructType([T.StructField("raw_name", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("delimiter", T.StringType()), T.StructField("special_use", T.ArrayType(T.StringType()))])
folder_lines = _rows(folder_line, FOLDER_LINE)
MESSAGE_LINE = T.StructType([T.StructField("uid", T.LongType()), T.StructField("size_bytes", T.LongType()), T.StructField("modseq", T.LongType()), T.StructField("internal_date", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("message_id", T.StringType())])
message_lines = _rows(message_line, MESSAGE_LINE)
decoded = _rows(lambda raw: decode_text(raw)[0], T.StringType())


def parsed(content: Column, internal_date: Column, now: datetime) -> Column:
    """``PARSED`` of messages in bytes and their mailbox dates in UTC text."""
    from pyspark.sql.pandas.types import to_arrow_type

    @F.arrow_udf(PARSED)
    def run(raw: pa.Array, internal: pa.Array) -> pa.Array:
        dates = list(map(instant, internal.to_pylist()))
        rows = [None if r is None else parse_message(r, d, now) for r, d in zip(raw.to_pylist(), dates, strict=True)]
        return pa.array(rows, to_arrow_type(PARSED))

    return run(content, internal_date)


def thread_key_of(message_id: Column, in_reply_to: Column, references: Column) -> Column:
    """``thread_key`` in the JVM."""
    def first(c: Column) -> Column:
        bracketed = F.nullif(F.regexp_extract(c, r"<[^<>]+>", 0), F.lit(""))
        return F.coalesce(bracketed, F.nullif(F.regexp_extract(c, r"(?U)\S+", 0), F.lit("")))

    return F.coalesce(first(references), first(in_reply_to), first(message_id))


def content_key_of(message_id: Column, content: Column) -> Column:
    """``content_key`` in the JVM, from the message's bytes."""
    return F.coalesce(F.nullif(F.trim(message_id), F.lit("")), F.concat(F.lit("sha256:"), F.substring(F.sha2(content, 256), 1, 32)))
