"""ZIP archives of stored members: a writer, and a reader that parses the directories and reads ranges.

Layouts follow the public ZIP application note; ZIP64 fields are written where sizes, offsets or counts need them (or
when forced) and are read wherever they occur.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from typing import BinaryIO

# Fixed values of the format: signatures, header layouts, limits of 16- and 32-bit fields, the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_FORM, CENTRAL_FORM, END_FORM, END64_FORM, LOCATOR_FORM = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 0x0001
UTF8_NAMES, STORED, NO_TIME, NO_DATE = 0x0800, 0, 0, 0x21


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def build(members: Iterable[tuple[str, bytes]], zip64: bool = False) -> list[bytes]:
    """The pieces of an archive, in order."""
    out: list[bytes] = []
    directory: list[bytes] = []
    at = 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, n, n) if wide else b""
        short = FULL32 if wide else n
        head = struct.pack(LOCAL_FORM, LOCAL, 45 if wide else 20, UTF8_NAMES, STORED, NO_TIME, NO_DATE, crc, short, short, len(raw), len(extra)) + raw + extra
        far = zip64 or at >= FULL32
        fields = ([n, n] if wide else []) + ([at] if far else [])
        extra = struct.pack(f"<HH{len(fields)}Q", EXTRA64, 8 * len(fields), *fields) if fields else b""
        directory.append(
            struct.pack(CENTRAL_FORM, CENTRAL, 45, 45 if fields else 20, UTF8_NAMES, STORED, NO_TIME, NO_DATE, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, FULL32 if far else at) + raw + extra
        )
        out += [head, data]
        at += len(head) + n
    central = b"".join(directory)
    out.append(central)
    count = len(directory)
    if zip64 or count >= FULL16 or at >= FULL32 or len(central) >= FULL32:
        out.append(struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, count, count, len(central), at))
        out.append(struct.pack(LOCATOR_FORM, LOCATOR, 0, at + len(central), 1))
        out.append(struct.pack(END_FORM, END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
    else:
        out.append(struct.pack(END_FORM, END, 0, 0, count, count, len(central), at, 0))
    return out


def _at(f: BinaryIO, offset: int, n: int) -> bytes:
    f.seek(offset)
    data = f.read(n)
    if len(data) != n:
        raise ValueError("archive ends early")
    return data


def directory(f: BinaryIO, size: int) -> dict[str, Member]:
    """Members by name, from the central directory of a seekable file of the given size."""
    n = min(size, struct.calcsize(END_FORM) + FULL16)
    tail = _at(f, size - n, n)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0:  # a comment may hold the signature: the record must reach to the end
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    end = size - n + at
    _, _, _, _, count, length, start, _ = struct.unpack_from(END_FORM, tail, at)
    if (count == FULL16 or length == FULL32 or start == FULL32) and end >= 20:
        mark, _, where, _ = struct.unpack(LOCATOR_FORM, _at(f, end - 20, 20))
        if mark == LOCATOR:
            wide = struct.unpack(END64_FORM, _at(f, where, 56))
            if wide[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = wide[7], wide[8], wide[9]
    data = _at(f, start, length)
    out: dict[str, Member] = {}
    at = 0
    for _ in range(count):
        h = struct.unpack_from(CENTRAL_FORM, data, at)
        if h[0] != CENTRAL:
            raise ValueError("bad central directory entry")
        method, crc, packed, full, n_name, n_extra, n_comment, header = h[4], h[7], h[8], h[9], h[10], h[11], h[12], h[16]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == EXTRA64:  # holds, in this order, just the fields that are full
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            e += 4 + n
        out[name] = Member(name, method, crc, packed, full, header)
    return out


def data_start(f: BinaryIO, m: Member) -> int:
    """Where a stored member's bytes begin; its local header may differ in length from the directory's entry."""
    if m.method != STORED:
        raise ValueError(f"{m.name} is not stored")
    h = struct.unpack(LOCAL_FORM, _at(f, m.header, 30))
    if h[0] != LOCAL:
        raise ValueError("bad local header")
    return m.header + 30 + h[9] + h[10]


def read_range(f: BinaryIO, start: int, offset: int, n: int) -> bytes:
    """n bytes from offset of the member whose bytes begin at start."""
    return _at(f, start + offset, n)
