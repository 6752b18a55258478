"""Exact patterns of personal data: leftmost, non-overlapping for each kind, in one pass over the text."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the local part, an at sign and a dotted domain, found from each at sign outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def is_card(match: str) -> bool:
    digits = _DIGITS.sub("", match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(match: str) -> bool:
    return 9 <= len(_DIGITS.sub("", match)) <= 15


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind; matches that fail their test are dropped, without another try inside them."""
    return {
        "email": emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if is_ip(m[0])] if "." in text else [],
        "card": [m.span() for m in _CARD.finditer(text) if is_card(m[0])],
        "phone": [m.span() for m in _PHONE.finditer(text) if is_phone(m[0])] if "+" in text else [],
    }
