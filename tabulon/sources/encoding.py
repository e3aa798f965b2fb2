"""Text encodings: detection on a head sample, and incremental decoding."""

from __future__ import annotations

import codecs

SAMPLE = 256 << 10
BOMS = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
PYTHON = {"utf-8": "utf-8", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be", "latin-1": "latin-1", "windows-1252": "cp1252"}


def bom_length(sample: bytes, encoding: str) -> int:
    mark = BOMS.get(encoding, b"")
    return len(mark) if mark and sample.startswith(mark) else 0


def _utf16_by_nuls(sample: bytes) -> str | None:
    """UTF-16 without a mark: zeros in at least 0.7 of one parity and at most 0.1 of the other."""
    if len(sample) < 8:
        return None
    even, odd = (sample[k::2].count(0) / len(sample[k::2]) for k in (0, 1))
    if odd >= 0.7 and even <= 0.1:
        return "utf-16-le"
    return "utf-16-be" if even >= 0.7 and odd <= 0.1 else None


def _is_utf8(sample: bytes) -> bool:
    """Valid, but for a last character that the sample cuts."""
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(sample, final=False)
    except UnicodeDecodeError:
        return False
    return True


def resolve(sample: bytes, forced: str | None = None) -> tuple[str, int]:
    """(encoding, bytes of the byte order mark); a forced encoding only drops a mark of its own."""
    if forced:
        return forced, bom_length(sample, forced)
    for encoding in BOMS:
        if n := bom_length(sample, encoding):
            return encoding, n
    return _utf16_by_nuls(sample) or ("utf-8" if _is_utf8(sample) else "latin-1"), 0


def decoder(encoding: str):
    """Incremental; what can't be decoded becomes U+FFFD, so every cell is valid text."""
    return codecs.getincrementaldecoder(PYTHON[encoding])("replace")


def single_byte_marks(encoding: str) -> bool:
    """Whether ASCII bytes stand for themselves wherever they occur, so that the bytes can be split at line ends."""
    return not encoding.startswith("utf-16")
