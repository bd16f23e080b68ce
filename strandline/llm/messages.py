"""Text parts, words and paragraphs of raw mail messages.

A small reader for what operators on text need: leaf parts of type ``text/*`` (of any nesting),
their transfer encoding and character set undone, and whether they are attachments. It never
fails: what cannot be decoded as declared is decoded as UTF-8 or else as a Latin code page, and a
text without headers is one plain part.
"""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple

_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_FOLD = re.compile(r"\n[ \t]+")
_FIELDS = re.compile(r"^content-(type|transfer-encoding|disposition)[ \t]*:[ \t]*(.*)$", re.I | re.M)
_PARAMETER = {n: re.compile(rf';[ \t]*{n}[ \t]*=[ \t]*(?:"([^"]*)"|([^\s;"]+))', re.I) for n in ("boundary", "charset", "name")}


class Part(NamedTuple):
    is_html: bool
    attached: bool
    text: str


def _parameter(value: str, name: str) -> str:
    m = _PARAMETER[name].search(value)
    return (m[1] if m[1] is not None else m[2]) if m else ""


def _bytes_of(text: str) -> bytes:
    try:
        return text.encode("ascii")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def _unbase64(text: str) -> bytes:
    raw = re.sub(rb"[^A-Za-z0-9+/]", b"", _bytes_of(text))
    if len(raw) % 4 == 1:
        raw = raw[:-1]
    return binascii.a2b_base64(raw + b"=" * (-len(raw) % 4))


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        raw = _unbase64(body)
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(_bytes_of(body))
    else:
        return body
    for name in (charset or "utf-8", "utf-8", "cp1252"):
        try:
            text = raw.decode(name)
            if name != "utf-8":  # some character sets can spell half a pair
                text = text.encode("utf-8", "replace").decode("utf-8")
            break
        except (UnicodeDecodeError, LookupError, ValueError):
            continue
    else:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


class _Entity(NamedTuple):
    """An entity still to be read: a text with headers."""

    text: str


def _entity(text: str) -> Part | list[_Entity] | None:
    """The text part an entity is, or the entities in it, or None."""
    if not _HEADER.match(text):
        # a part may start with the blank line that ends its (empty) headers
        return _body("", "", "", text[1:] if text.startswith("\n") else text)
    head, _, body = text.partition("\n\n")
    fields: dict[str, str] = {}
    if "ontent-" in head or "ONTENT-" in head:
        for name, value in _FIELDS.findall(_FOLD.sub(" ", head)):
            fields.setdefault(name.lower(), value)
    return _body(fields.get("type", ""), fields.get("transfer-encoding", "").split(";")[0].strip().lower(), fields.get("disposition", ""), body)


def _body(ctype: str, encoding: str, disposition: str, body: str) -> Part | list[_Entity] | None:
    kind = ctype.split(";", 1)[0].strip().lower() or "text/plain"
    if kind.startswith("multipart/"):
        boundary = _parameter(ctype, "boundary")
        if boundary:
            inner = []
            for piece in ("\n" + body).split("\n--" + boundary)[1:]:
                if piece.startswith("--"):
                    break
                _, newline, rest = piece.partition("\n")  # what follows the boundary on its line
                if newline:
                    inner.append(_Entity(rest))
            return inner
        kind = "text/plain"
    if kind == "message/rfc822":
        return [_Entity(_decoded(body, encoding, "").lstrip("\n"))]
    if kind.startswith("text/"):
        attached = disposition.lstrip().lower().startswith("attachment") or (bool(disposition) and "filename" in disposition.lower())
        return Part(kind == "text/html", attached, _decoded(body, encoding, _parameter(ctype, "charset").lower()))
    return None


def text_parts(message: str | None) -> list[Part]:
    """The text parts of a message in order; none for NULL or an empty text."""
    if not message:
        return []
    if "\r" in message:
        message = message.replace("\r\n", "\n").replace("\r", "\n")
    if message.startswith("From ") or message.startswith(">From "):
        message = message.partition("\n")[2]
    parts: list[Part] = []
    open_ = [_Entity(message)]  # a stack, so that nesting may be of any depth
    while open_:
        found = _entity(open_.pop().text)
        if isinstance(found, Part):
            parts.append(found)
        elif found:
            open_.extend(reversed(found))
    return parts


_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|title)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|blockquote|pre|ul|ol|li|dl|dt|dd|table|tr|td|th|h[1-6]|hr|body|html|section|article|header|footer|form|address)\b[^<>]*>", re.I)
_BREAK = re.compile(r"<br\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>")


def html_text(source: str) -> str:
    """Rendered text of HTML: blocks parted by blank lines, ``<br>`` a line break, references resolved."""
    s = source
    if "<!--" in s or "<s" in s or "<S" in s or "<h" in s or "<H" in s or "<t" in s or "<T" in s:
        s = _HIDDEN.sub(" ", s)
    s = _BREAK.sub("\x01", _BLOCK.sub("\x02", s.replace("\n", " ")))
    s = _TAG.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    return s.replace("\x02", "\n\n").replace("\x01", "\n")


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def part_words(message: str | None) -> list[list[str]]:
    """The words of every text part, attachments included."""
    return [words(html_text(p.text) if p.is_html else p.text) for p in text_parts(message)]


_QUOTE = re.compile(r"^(?:[ \t]*[>|])+[ \t]?", re.M)
_PARTED = re.compile(r"\n[ \t\xa0]*\n\s*")
_SIGNATURE = re.compile(r"^-- ?$")
_FORWARD = re.compile(r"^(?:-{2,}.*-{2,}|_{5,})$")
_FIELD_LINE = re.compile(r"^\*?[^\W\d_][\w -]{0,24}\*?[ \xa0]?:\s")


def _running(lines: list[str]) -> list[str]:
    """The lines of a paragraph without signature, forwarded header fields and separators."""
    out: list[str] = []
    in_head = False
    for line in lines:
        s = line.strip()
        if _SIGNATURE.match(s) or s == "--":
            break
        if _FORWARD.match(s):
            in_head = True
            continue
        if in_head:
            if _FIELD_LINE.match(s):
                continue
            in_head = False
        out.append(s)
    return out


def paragraphs(message: str | None, least: int = 12) -> list[list[str]]:
    """Words of the paragraphs of running text with ``least`` words or more.

    Attachments do not count. Quoted paragraphs do, without their marks. Signatures, header lines,
    separators, logs and tables are no running text: most words of a paragraph, and most of
    its visible characters, must be letters.
    """
    found: list[list[str]] = []
    for p in text_parts(message):
        if p.attached:
            continue
        text = html_text(p.text) if p.is_html else p.text
        if ">" in text or "|" in text:
            text = _QUOTE.sub("", text)
        for para in _PARTED.split(text):
            if len(para) < 2 * least - 1:
                continue
            lines = para.split("\n")
            if "--" in para or "__" in para:
                lines = _running(lines)
                para = "\n".join(lines)
            ws = _WORD.findall(para.lower())
            if len(ws) < least:
                continue
            letters = [w for w in ws if w.isalpha()]
            solid = sum(map(len, letters))
            visible = sum(map(len, para.split()))
            if len(letters) * 3 < len(ws) * 2 or solid * 3 < visible * 2:
                continue
            found.append(ws)
    return found


def all_passages(message: str | None) -> list[list[str]]:
    """Words of all paragraphs of running text, however short; of a message without any, the words of its whole text (attachments apart), if one of them is of letters."""
    found = paragraphs(message, 1)
    if found:
        return found
    ws = [w for p in text_parts(message) if not p.attached for w in words(html_text(p.text) if p.is_html else p.text)]
    return [ws] if any(map(str.isalpha, ws)) else []
