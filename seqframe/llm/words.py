"""Words of letters and digits: A-Z lower-cased, every character beyond ASCII a letter."""

from __future__ import annotations

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _WORD else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside ``[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` in UTF-8, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
