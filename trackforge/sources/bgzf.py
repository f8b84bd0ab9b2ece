"""Files of gzip blocks of at most 64 KB, which can be read from any block on: alignments (BAM) and indexed lines (tabix).

A place in such a file is a virtual offset: that of the block in the file, times 2^16, plus that within the block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Fixed value of the format: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a block before compression at most.
FULL = 65280


def pack(data: bytes) -> bytes:
    """One block of at most FULL bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(data: bytes) -> Iterator[bytes]:
    for i in range(0, len(data), FULL):
        yield pack(data[i : i + FULL])


def block_size(f, at: int) -> int:
    """Bytes of the block at a place, 0 at the end of the file."""
    f.seek(at)
    head = f.read(12)
    if not head:
        return 0
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a file of gzip blocks")
    extra = f.read(struct.unpack("<H", head[10:12])[0])
    i = 0
    while i < len(extra):
        a, b, n = struct.unpack_from("<BBH", extra, i)
        if (a, b) == (66, 67):
            return struct.unpack_from("<H", extra, i + 4)[0] + 1
        i += 4 + n
    raise ValueError("not a file of gzip blocks")


def blocks(f) -> list[tuple[int, int]]:
    """(place, size) of all blocks, from their heads alone."""
    out, at = [], 0
    while n := block_size(f, at):
        out.append((at, n))
        at += n
    return out


def inflate(f, at: int, size: int | None = None) -> tuple[bytes, int]:
    """What the block at a place holds, and where the next one begins."""
    size = size or block_size(f, at)
    if not size:
        return b"", at
    f.seek(at)
    return zlib.decompress(f.read(size), 31), at + size


class Reader:
    """Bytes in order from a virtual offset on."""

    def __init__(self, f, offset: int = 0):
        self.f, self.at, self.i = f, offset >> 16, offset & 0xFFFF
        self.data, self.next = inflate(f, self.at)

    @property
    def offset(self) -> int:
        return self.next << 16 if self.i >= len(self.data) else self.at << 16 | self.i

    def more(self) -> bool:
        """Goes on to the next block that holds something, once this one is read."""
        while self.i >= len(self.data):
            at = self.next
            self.data, self.next = inflate(self.f, at)
            if self.next == at:
                return False
            self.at, self.i = at, 0
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n and self.more():
            part = self.data[self.i : self.i + n]
            self.i += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def line(self) -> bytes | None:
        """The next line without its end; None after the last."""
        parts = []
        while self.more():
            j = self.data.find(b"\n", self.i)
            if j >= 0:
                parts.append(self.data[self.i : j])
                self.i = j + 1
                return b"".join(parts)
            parts.append(self.data[self.i :])
            self.i = len(self.data)
        return b"".join(parts) if parts else None
