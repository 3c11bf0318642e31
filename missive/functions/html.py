"""HTML of messages: its text, a safe form of it, and whether it loads images from elsewhere."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from missive.functions.normalise import without_surrogates

#: Elements that go with what they hold, elements that never close, and the policy.
REMOVED = {"script", "iframe", "frame", "object", "embed", "form", "link", "base"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame"}
POLICY = "default-src 'none'; img-src {images}; style-src 'unsafe-inline'; form-action 'none'; frame-src 'none'"
_REMOTE_CSS = re.compile(r"url\(\s*['\"]?\s*https?://", re.I)
_PLAIN = {ord("<"): "&lt;", ord(">"): "&gt;"}


class _Reader(HTMLParser):
    """Reads any page: a declaration that the parser does not know is a comment."""

    def parse_marked_section(self, i, report=1):
        return self._as_comment(i)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self._as_comment(i)

    def _as_comment(self, i):
        end = self.rawdata.find(">", i)
        if end < 0:
            return -1
        self.handle_comment(self.rawdata[i + 2 : end])
        return end + 1

    def unknown_decl(self, data):
        self.handle_comment(data)


class _Text(_Reader):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hidden = 0
        self.open = False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.open = False

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        self.open = False

    def handle_comment(self, data):
        self.open = False

    def handle_data(self, data):
        if self.hidden:
            return
        if self.open:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
        self.open = True


def html_to_text(html: str) -> str:
    """The text nodes, each on lines of its own; blanks collapse, and so do blank lines."""
    reader = _Text()
    reader.feed(html)
    reader.close()
    lines = [re.sub(r"[^\S\n]+", " ", x).strip() for x in "\n".join(reader.nodes).split("\n")]
    return without_surrogates(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n"))


def _unsafe(name: str, value: str | None) -> bool:
    if name.startswith("on"):
        return True
    plain = "".join(c for c in value or "" if c > " ").lower()
    return name in ("href", "src") and plain.startswith(("javascript:", "data:"))


class _Safe(_Reader):
    """Writes what is let through into the head or the body."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.head: list[str] = []
        self.body: list[str] = []
        self.place = "body"
        self.skipped: list[str] = []

    def write(self, text: str) -> None:
        if not self.skipped:
            (self.head if self.place == "head" else self.body).append(text)

    def handle_starttag(self, tag, attrs):
        if tag in REMOVED:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in ("html", "head", "body"):
            self.place = "head" if tag == "head" else "body"
            return
        given = {k: v for k, v in attrs}
        if tag == "meta" and (given.get("http-equiv") or "").strip().lower() in ("content-security-policy", "refresh"):
            return
        kept = "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in attrs if not _unsafe(k, v))
        self.write(f"<{tag}{kept}>")

    def handle_startendtag(self, tag, attrs):
        if tag not in REMOVED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped.pop() != tag:
                pass
        elif tag in ("html", "head", "body"):
            self.place = "body"
        elif tag not in VOID and tag not in REMOVED:
            self.write(f"</{tag}>")

    def handle_data(self, data):
        """Text is data, never a tag: what was left unfinished stays so in a reader of the result too.  A style's
        text has no entities, so what could end it goes."""
        self.write(data.replace("<", "") if self.cdata_elem == "style" else data.translate(_PLAIN))

    def handle_entityref(self, name):
        self.write(f"&{name};")

    def handle_charref(self, name):
        self.write(f"&#{name};")


def sanitise_html(html: str, remote_images: bool = False) -> str:
    """A whole document without active content, under a policy that forbids it."""
    reader = _Safe()
    reader.feed(html)
    reader.close()
    policy = POLICY.format(images="cid: https: http:" if remote_images else "cid:")
    meta = f'<meta http-equiv="Content-Security-Policy" content="{policy}">'
    return f"<html><head>{meta}{''.join(reader.head)}</head><body>{''.join(reader.body)}</body></html>"


class _Images(_Reader):
    def __init__(self):
        super().__init__()
        self.found = self.style = False

    def handle_starttag(self, tag, attrs):
        self.style = tag == "style"
        for k, v in attrs:
            v = v or ""
            plain = "".join(c for c in v if c > " ").lower()
            self.found |= tag == "img" and k == "src" and plain.startswith(("http://", "https://"))
            self.found |= k == "style" and bool(_REMOTE_CSS.search(v))

    def handle_endtag(self, tag):
        self.style = False

    def handle_data(self, data):
        self.found |= self.style and bool(_REMOTE_CSS.search(data))


def has_remote_image(html: str) -> bool:
    reader = _Images()
    reader.feed(html)
    reader.close()
    return reader.found


@F.arrow_udf(T.StringType())
def html_texts(html: pa.Array) -> pa.Array:
    return pa.array([None if h is None else html_to_text(h) for h in html.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def sanitised(html: pa.Array) -> pa.Array:
    return pa.array([None if h is None else sanitise_html(h) for h in html.to_pylist()], pa.string())


@F.arrow_udf(T.BooleanType())
def remote_images(html: pa.Array) -> pa.Array:
    return pa.array([None if h is None else has_remote_image(h) for h in html.to_pylist()], pa.bool_())
