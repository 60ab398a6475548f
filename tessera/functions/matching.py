"""Patterns tried only where they can match."""

import re
from collections.abc import Iterator


def matches_in(pattern: re.Pattern, text: str, words: tuple[str, ...] = (), end: str = "") -> Iterator[re.Match]:
    """``pattern.finditer(text)`` for a pattern whose every match holds one of ``words`` and ends with the string ``end``: none is
    tried in a text without the words, or behind the last ``end``."""
    if words and not any(w in text for w in words):
        return iter(())
    stop = text.rfind(end) + len(end) if end else len(text)
    return pattern.finditer(text, 0, stop) if stop >= len(end) else iter(())
