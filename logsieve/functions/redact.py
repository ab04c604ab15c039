"""What may be said about a record in a log of our own."""

from __future__ import annotations

import re

_CONTENT = re.compile(r'[{\["]')


def log_safe(message: str, most: int = 80) -> str:
    """The message up to where a record's content could begin, ``most`` bytes at the utmost."""
    cut = _CONTENT.split(message, maxsplit=1)[0]
    return cut.encode()[:most].decode("utf-8", "ignore")
