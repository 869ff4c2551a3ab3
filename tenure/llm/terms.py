"""Words of UTF-8 texts between given ASCII separators, A-Z in lower case, in segments of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut into words at a time.
SEGMENT = 1 << 20


def word_table(separators: bytes) -> bytes:
    """Translation table: separators become spaces, A-Z lower case; bytes of other characters stay.

    ``separators`` are meant after lower-casing."""
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    for b in range(256):
        if table[b] in separators:
            table[b] = 32
    return bytes(table)


def segments(text: bytes | None, table: bytes, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """Lists of the words of ``text``, in order; a word is never divided."""
    at, n = 0, len(text or b"")
    carry = b""
    while at < n:
        part = carry + text[at:at + size].translate(table)
        at += size
        cut = part.rfind(b" ") if at < n else len(part)
        if cut < 0:
            carry = part  # one long word so far
            continue
        carry = part[cut:]
        if words := part[:cut].split():
            yield words
