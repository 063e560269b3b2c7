"""The text of a PDF's pages as far as it stands there as text, with the standard library alone: plain and Flate streams, object
streams, simple fonts and fonts with a ToUnicode table. Encrypted files are refused."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>()\[\]]+|[^\s/<>()\[\]]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _data(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]


def _objects(content: bytes) -> dict[int, bytes]:
    if b"/Encrypt" in content:
        raise ValueError("encrypted PDF")
    out = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            inner, first = _data(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, inner[:first].split()))
            places = numbers[1::2] + [len(inner) - first]
            for i, n in enumerate(numbers[::2]):
                out.setdefault(n, inner[first + places[i] : first + places[i + 1]])
    return out


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _dictionary(objects: dict[int, bytes], body: bytes, key: bytes) -> bytes:
    """What stands behind a key: a reference's object, or the dictionary itself."""
    m = re.search(rb"/" + key + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", body)
    if not m:
        return b""
    if m[1]:
        return objects.get(int(m[1]), b"")
    depth, at = 1, m.end()
    for t in re.finditer(rb"<<|>>", body[m.end() :]):
        depth += 1 if t[0] == b"<<" else -1
        if not depth:
            at = m.end() + t.start()
            break
    return body[m.end() : at]


def _unicode_table(cmap: bytes) -> dict[bytes, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(code.decode())] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for lo, hi, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            start, width = int(to, 16), len(lo) // 2
            for i in range(int(lo, 16), min(int(hi, 16), int(lo, 16) + 65535) + 1):
                out[i.to_bytes(width, "big")] = chr(start + i - int(lo, 16)) if len(to) <= 4 else text(to)
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)


def _shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    table: dict[bytes, str] = {}
    stack: list[bytes] = []

    def say(raw: bytes) -> None:
        if not table:
            out.append(raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace"))
            return
        width = max(map(len, table))
        out.append("".join(table.get(raw[i : i + width], "") for i in range(0, len(raw), width)))

    for token in _TOKEN.findall(content):
        if token in (b"Tj", b"'", b'"') and stack:
            if token != b"Tj":
                out.append("\n")
            say(_string(stack[-1]))
        elif token == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    say(_string(x))
                elif re.fullmatch(rb"-\d{3,}(\.\d+)?", x):  # a wide gap is a blank
                    out.append(" ")
        elif token == b"Tf" and len(stack) > 1:
            table = fonts.get(stack[-2][1:], {})
        elif token in (b"T*", b"ET", b"Tm") or token in (b"Td", b"TD") and stack and stack[-1] not in (b"0", b"0.0"):
            out.append("\n")
        if token[:1] in b"(<[/-+.0123456789":
            stack = [] if token == b"[" else stack + [token]
        elif token != b"]":
            stack = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def pages(content: bytes) -> list[tuple[str, int]]:
    """(text, number of images) of each page, in order."""
    objects = _objects(content)
    out: list[tuple[str, int]] = []
    tables: dict[int, dict[bytes, str]] = {}

    def visit(n: int, resources: bytes, seen: frozenset[int]) -> None:
        body = objects.get(n, b"")
        if n in seen:
            return
        resources = _dictionary(objects, body, b"Resources") or resources
        if _refs(body, b"Kids"):
            for kid in _refs(body, b"Kids"):
                visit(kid, resources, seen | {n})
            return
        fonts = {}
        for name, at in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", _dictionary(objects, resources, b"Font")):
            tounicode = _refs(objects.get(int(at), b""), b"ToUnicode")
            if tounicode and int(at) not in tables:
                tables[int(at)] = _unicode_table(_data(objects.get(tounicode[0], b"")))
            fonts[name] = tables.get(int(at), {})
        images = sum(b"/Image" in objects.get(int(at), b"")[:2000] for _, at in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", _dictionary(objects, resources, b"XObject")))
        out.append((_shown(b"\n".join(_data(objects.get(c, b"")) for c in _refs(body, b"Contents")), fonts), images))

    for body in objects.values():
        if re.search(rb"/Type\s*/Catalog\b", body):
            for n in _refs(body, b"Pages"):
                visit(n, b"", frozenset())
            break
    return out
