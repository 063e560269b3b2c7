"""The sheets of an old binary workbook (compound file, BIFF8), with the standard library alone: texts, numbers, booleans and the stored
results of formulas."""

from __future__ import annotations

import struct

_FREE = 0xFFFFFFFA


def _workbook_stream(content: bytes) -> bytes:
    if content[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("no compound file")
    size, small = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    directory, _, cutoff, mini_fat, _, more, _ = struct.unpack_from("<IIIIIII", content, 48)
    sector = lambda i: content[(i + 1) * size : (i + 2) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    places = [x for x in numbers(content[76:512]) if x < _FREE]
    while more < _FREE:
        own = numbers(sector(more))
        places += [x for x in own[:-1] if x < _FREE]
        more = own[-1]
    fat = [x for p in places for x in numbers(sector(p))]

    def chain(at: int, table: list[int], piece) -> bytes:
        out, seen = [], set()
        while at < _FREE and at not in seen:
            seen.add(at)
            out.append(piece(at))
            at = table[at]
        return b"".join(out)

    entries = chain(directory, fat, sector)
    named = {}
    for i in range(0, len(entries), 128):
        n = struct.unpack_from("<H", entries, i + 64)[0]
        named[entries[i : i + max(n - 2, 0)].decode("utf-16-le")] = struct.unpack_from("<IQ", entries, i + 116)
    start, length = next(named[x] for x in ("Workbook", "Book") if x in named)
    length &= 0xFFFFFFFF
    if length >= cutoff:
        return chain(start, fat, sector)[:length]
    ministream = chain(named["Root Entry"][0], fat, sector)
    return chain(start, numbers(chain(mini_fat, fat, sector)), lambda i: ministream[i * small : (i + 1) * small])[:length]


def _records(stream: bytes, at: int = 0):
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


def _shared(parts: list[bytes]) -> list[str]:
    """The shared strings; a string may go on in the next record, which begins with a new flag byte."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    out, part, at = [], 0, 8
    for _ in range(total):
        while at >= len(parts[part]):
            part, at = part + 1, 0
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs = struct.unpack_from("<H", parts[part], at)[0] if flags & 8 else 0
        at += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", parts[part], at)[0] if flags & 4 else 0
        at += 4 if flags & 4 else 0
        text = ""
        while len(text) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                flags = parts[part][0]
            wide = 2 if flags & 1 else 1
            take = min(n - len(text), (len(parts[part]) - at) // wide)
            text += parts[part][at : at + take * wide].decode("utf-16-le" if wide == 2 else "latin-1")
            at += take * wide
        out.append(text)
        skip = runs * 4 + extra
        while skip > len(parts[part]) - at and part + 1 < len(parts):
            skip -= len(parts[part]) - at
            part, at = part + 1, 0
        at += skip
    return out


def _text(b: bytes, wide: int) -> str:
    return b.decode("utf-16-le" if wide & 1 else "latin-1")


def _rk(v: int) -> float:
    x = float((v if v < 1 << 31 else v - (1 << 32)) >> 2) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells as text) of each sheet; empty sheets have no rows."""
    stream = _workbook_stream(content)
    bounds, strings, sst = [], [], []
    for _, kind, body in _records(stream):
        if kind == 0x0085:
            at, _, n, wide = struct.unpack_from("<IHBB", body)
            bounds.append((at, _text(body[8 : 8 + n * (2 if wide & 1 else 1)], wide)))
        elif kind == 0x00FC:
            sst = [body]
        elif kind == 0x003C and sst and not strings:
            sst.append(body)
        elif sst and not strings:
            strings = _shared(sst)
        if kind == 0x000A:
            break
    strings = strings or (_shared(sst) if sst else [])
    out = []
    for start, title in bounds:
        cells: dict[tuple[int, int], str] = {}
        waiting = None
        for at, kind, body in _records(stream, start):
            if kind == 0x000A:
                break
            if kind == 0x00FD:
                r, c, _, i = struct.unpack_from("<HHHI", body)
                cells[r, c] = strings[i]
            elif kind == 0x0203:
                r, c, _, x = struct.unpack_from("<HHHd", body)
                cells[r, c] = _number(x)
            elif kind == 0x027E:
                r, c, _, v = struct.unpack_from("<HHHI", body)
                cells[r, c] = _number(_rk(v))
            elif kind == 0x00BD:
                r, c = struct.unpack_from("<HH", body)
                for i in range((len(body) - 6) // 6):
                    cells[r, c + i] = _number(_rk(struct.unpack_from("<I", body, 6 + 6 * i)[0]))
            elif kind == 0x0204:
                r, c, _, n, wide = struct.unpack_from("<HHHHB", body)
                cells[r, c] = _text(body[9 : 9 + n * (2 if wide & 1 else 1)], wide)
            elif kind == 0x0205 and body[7] == 0:
                r, c = struct.unpack_from("<HH", body)
                cells[r, c] = "True" if body[6] else "False"
            elif kind == 0x0006:
                r, c = struct.unpack_from("<HH", body)
                if body[12:14] != b"\xff\xff":
                    cells[r, c] = _number(struct.unpack_from("<d", body, 6)[0])
                elif body[6] == 0:
                    waiting = r, c
                elif body[6] == 1:
                    cells[r, c] = "True" if body[8] else "False"
            elif kind == 0x0207 and waiting:
                n, wide = struct.unpack_from("<HB", body)
                cells[waiting] = _text(body[3 : 3 + n * (2 if wide & 1 else 1)], wide)
                waiting = None
        rows = [[cells.get((r, c), "") for c in range(max(x for y, x in cells if y == r) + 1)] for r in sorted({r for r, _ in cells})]
        out.append((title, rows))
    return out
