"""Texts of PDF files without a library: pages, their content streams, strings by the fonts' Unicode tables, and the document's properties.

Read are files whose streams are plain or deflated, with objects in the body or in object streams.  Encrypted files and
other stream filters are errors; scans without a text layer have empty pages.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?:^|[\r\n \x00])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/{}%]*|[+-]?\d*\.?\d+|%[^\r\n]*|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\(?:([nrtbf()\\])|([0-7]{1,3})|(\r\n|\r|\n))")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
GAP = -200.0  # thousandths of the font size between two strings that stand for a space
PROPERTIES = {"Title": "title", "Author": "author", "Subject": "subject", "Creator": "creator"}


def unescaped(raw: bytes) -> bytes:
    """Bytes of a string in brackets."""
    return ESCAPE.sub(lambda m: ESCAPES[m.group(1)] if m.group(1) else bytes([int(m.group(2), 8) & 255]) if m.group(2) else b"", raw)


def string_bytes(token: bytes) -> bytes:
    if token.startswith(b"("):
        return unescaped(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def plain_text(raw: bytes) -> str:
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


class Pdf:
    """Objects of a file by number; ``streams`` are decoded when asked for."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF header")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, bytes] = {int(n): body for n, body in OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                inner = self.stream(body)
                first = int(re.search(rb"/First\s+(\d+)", body).group(1))
                heads = [int(x) for x in inner[:first].split()]
                places = list(zip(heads[::2], heads[1::2]))
                for (number, at), end in zip(places, [p for _, p in places[1:]] + [len(inner) - first]):
                    self.objects.setdefault(number, inner[first + at : first + end])
        self.trailer = b" ".join([*re.findall(rb"trailer(.*?)startxref", data, re.S), *(b for b in self.objects.values() if re.search(rb"/Type\s*/XRef\b", b))])
        if not self.objects:
            raise ValueError("no objects")

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        head, raw = body[: m.start()], body[m.end() :]
        raw = raw[: raw.rfind(b"endstream")].rstrip(b"\r\n") if b"endstream" in raw else raw
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if filters in ([], [b"FlateDecode"]):
            return zlib.decompressobj().decompress(raw) if filters else raw
        raise ValueError(f"unknown stream filter {filters[0].decode()}")

    def value(self, body: bytes, name: bytes) -> bytes:
        """What stands behind a name in a dictionary, references followed."""
        m = re.search(rb"/" + name + rb"\b\s*(\d+\s+\d+\s+R|<<.*|\[.*?\]|\(.*|<[0-9A-Fa-f\s]*>|/?[^\s/<>\[\]()]+)", body, re.S)
        if not m:
            return b""
        ref = REFERENCE.fullmatch(m.group(1))
        return self.objects.get(int(ref.group(1)), b"") if ref else m.group(1)

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree, each with what it inherits behind it."""
        root = self.value(self.trailer, b"Root") or next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []

        def walk(body: bytes, above: bytes, depth: int) -> None:
            if depth > 50:
                return
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                for n in REFERENCE.findall(kids.group(1)):
                    walk(self.objects.get(int(n), b""), body + above, depth + 1)
            elif body:
                out.append(body + above)

        walk(self.value(root, b"Pages"), b"", 0)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Unicode tables of a page's fonts by their names."""
        resources = self.value(page, b"Resources")
        table = self.value(resources, b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", table.split(b">>")[0]):
            mapped = self.value(self.objects.get(int(number), b""), b"ToUnicode")
            if mapped:
                out[name] = unicode_table(self.stream(mapped))
        return out

    def page_text(self, page: bytes) -> str:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        if not m:
            return ""
        parts = [self.objects.get(int(n), b"") for n in REFERENCE.findall(m.group(1))]
        if len(parts) == 1 and not STREAM.search(parts[0]):  # a reference to an array
            parts = [self.objects.get(int(n), b"") for n in REFERENCE.findall(parts[0])]
        return shown(b"\n".join(self.stream(p) for p in parts), self.fonts(page))

    def properties(self) -> dict[str, str]:
        info = self.value(self.trailer, b"Info")
        out = {}
        for name, key in PROPERTIES.items():
            m = re.search(rb"/" + name.encode() + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", info, re.S)
            if m:
                out[key] = plain_text(string_bytes(m.group(1)))
        return out


def unicode_table(cmap: bytes) -> dict[bytes, str]:
    """Codes of a font and the characters that they stand for."""
    out: dict[bytes, str] = {}

    def text(digits: bytes) -> str:
        plain = re.sub(rb"\s", b"", digits).decode()
        return bytes.fromhex(plain.zfill(-(-len(plain) // 4) * 4)).decode("utf-16-be", "replace")

    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            low, high, width = int(a, 16), int(b, 16), len(a) // 2
            each = re.findall(rb"<([0-9A-Fa-f\s]+)>", many)
            for i in range(high - low + 1):
                if many and i < len(each):
                    out[(low + i).to_bytes(width, "big")] = text(each[i])
                elif c:
                    first = text(c)
                    out[(low + i).to_bytes(width, "big")] = first[:-1] + chr(ord(first[-1]) + i)
    return out


def shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Text that a content stream shows; moves to another line are line feeds."""
    out: list[str] = []
    held: list[bytes] = []
    table: dict[bytes, str] = {}

    def read(token: bytes) -> str:
        raw = string_bytes(token)
        if not table:
            return plain_text(raw)
        width = max(map(len, table))
        return "".join(table.get(raw[i : i + width], "") for i in range(0, len(raw), width))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/+-.0123456789" and token not in (b"<<", b">>"):
            held.append(token)
            continue
        if token == b"Tf" and len(held) >= 2:
            table = fonts.get(held[-2][1:], {})
        elif token in (b"Tj", b"'", b'"') and held:
            if token != b"Tj":
                line()
            out.append(read(held[-1]))
        elif token == b"TJ":
            for t in held:
                if t[:1] in b"(<":
                    out.append(read(t))
                elif t[:1] not in b"[]/" and float(t) < GAP and out and not out[-1].endswith(" "):
                    out.append(" ")
        elif token in (b"T*", b"Tm", b"BT") or token in (b"Td", b"TD") and len(held) >= 2 and float(held[-1]) != 0:
            line()
        held.clear()
    return "\n".join(x.rstrip() for x in "".join(out).split("\n")).strip()
