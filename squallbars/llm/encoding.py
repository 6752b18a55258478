"""Exact token ids of whole texts, through a worker's cache of word pieces.

A byte-level vocabulary never lets a token cross the start of a blank that follows a word, and a vocabulary that drops
white space lets none cross any blank, so a text can be cut at blanks and each piece encoded once per worker. Texts where
that does not hold (several blanks in a row, special strings) go whole through the tokenizer.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from squallbars.llm.common import CACHES, release

LONGEST_CACHED = 64
LONGEST_MERGED = 512
CACHED_PIECES = 600_000
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[int, "PieceEncoder"] = {}
CACHES.append(_LOADED)
_MARKS = frozenset("\0\x01\x02")
_AMBIGUOUS = re.compile(r"\s (?:\s|\Z)")
_LETTERS = "\xdf-\xf6\xf8-\xff"  # Latin-1's small letters; its capitals fold to them, and composing changes none
_PLAIN_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{_LETTERS}]+|[0-9]|[^ \t\n\v\f\ra-z0-9{_LETTERS}]+")
_ODD = re.compile(rf"[^\x00-\x7f\xc0-\xd6\xd8-\xde{_LETTERS}]")


def encoder(spec: bytes) -> "PieceEncoder":
    """One encoder per worker process and vocabulary, so that its cache lives over tasks."""
    key = hash(spec)
    if key not in _LOADED:
        release()
        parts = json.loads(spec)
        before = parts["pre_tokenizer"] or {}
        kind = PieceEncoder
        if parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            kind = BlankLeads
        elif before.get("type") == "Sequence" and any(p.get("behavior") == "Removed" and p.get("invert") for p in before["pretokenizers"]):
            kind = BlankDropped
        _LOADED[key] = kind(spec, parts)
    return _LOADED[key]


def grouped(texts: list[str | None], characters: int = 2_000_000):
    """Runs of texts of a bounded length together (one text at least)."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= characters:
            yield run
            run, size = [], 0
    if run:
        yield run


class PieceEncoder:
    """Any tokenizer: every text goes whole through the library."""

    def __init__(self, spec: bytes, parts: dict):
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t["content"] for t in parts["added_tokens"]]

    def whole(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_texts(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """Ids of each text (null: empty) and the end id, as bytes."""
        return [self.whole(t or "") + end for t in texts]

    def encode_flat(self, texts: list[str | None], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        ids = self.encode_texts(texts, end)
        return np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], np.int64)


def shown_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes (fixed values of that format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def merged_in_order(model: dict, first: int) -> bool:
    """Whether every merge's id is its rank, from `first` on."""
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return all(model["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(pairs))


class BlankLeads(PieceEncoder):
    """Byte-level vocabularies, where a blank belongs to the word after it.

    Where every id is the rank of its merge, pieces that the cache lacks are merged by tiktoken, which gives the same ids
    at less than half the time.
    """

    def __init__(self, spec: bytes, parts: dict):
        super().__init__(spec, parts)
        byte = shown_bytes()
        ranks = {bytes(byte[c] for c in token): i for token, i in parts["model"]["vocab"].items() if token not in self.specials}
        in_order = merged_in_order(parts["model"], len(ranks) - len(parts["model"]["merges"]))
        self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.ids = _Pieces(self)

    def pieces(self, text: str) -> list[str] | None:
        """The text cut before each blank; None where a token might cross a cut."""
        if any(s in text for s in self.specials):
            return None
        if not text.isascii() or "  " in text or "\n " in text or "\t " in text or "\r " in text or text.endswith(" "):
            if _AMBIGUOUS.search(text):
                return None
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def piece(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes() if self.fast else self.whole(text)

    def encode_texts(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        out = []
        for t in texts:
            cut = self.pieces(t or "")
            out.append((self.whole(t) if cut is None else b"".join(map(self.ids.__getitem__, cut))) + end)
        return out


class _Pieces(dict):
    """Ids of pieces met so far; starts anew when full, long pieces are not kept."""

    def __init__(self, owner: BlankLeads):
        super().__init__()
        self.owner = owner

    def __missing__(self, text: str) -> bytes:
        ids = self.owner.piece(text)
        if len(text) <= LONGEST_CACHED:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[text] = ids
        return ids


class BlankDropped(PieceEncoder):
    """Lower-casing vocabularies that drop white space: pieces between blanks, made of words, digits and marks.

    Such a vocabulary marks the end of a word on its last token. Where ids are the ranks of merges, pieces of ASCII and
    Latin-1's letters of many texts are merged by tiktoken in one call, with the zero byte as that mark behind every part;
    nothing is cached for them. Two control characters stand between texts and in place of the other pieces, whose ids come
    from the library and a cache.
    """

    def __init__(self, spec: bytes, parts: dict):
        super().__init__(spec, parts)
        self.ids: dict[str, bytes] = {}
        self.fast = None
        model, byte = parts["model"], shown_bytes()
        suffix = model.get("end_of_word_suffix")
        if suffix:
            ranks = {}
            for token, i in model["vocab"].items():
                plain = token.removesuffix(suffix)
                marked = bytes(byte[c] for c in plain) + b"\0" * (plain != token) if token not in self.specials else b""
                if marked == b"\0" or marked and b"\0" not in marked[:-1]:
                    ranks[marked] = i
            if merged_in_order(model, 512) and all(bytes([b, 0]) in ranks for b in range(1, 256)):
                self.fast = tiktoken.Encoding("marked", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
                self.odd, self.between = ranks[b"\x01\0"], ranks[b"\x02\0"]

    def _merged(self, pieces: str) -> np.ndarray:
        """Ids of plain pieces in lower case between blanks."""
        parts = _PLAIN_PARTS.findall(pieces)
        return np.array(self.fast.encode_ordinary("\0".join([*parts, ""])), "<u4")

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the library, through the cache."""
        if len(self.ids) > CACHED_PIECES:
            self.ids = {}
        missing = sorted(set(pieces).difference(self.ids))
        fresh: dict[str, bytes] = {}
        for at in range(0, len(missing), 8192):
            some = missing[at:at + 8192]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(got.ids, "<u4")
            ends = np.searchsorted(np.asarray([-1 if w is None else w for w in got.word_ids]), np.arange(len(some) + 1)).tolist()
            fresh.update((p, ids[a:b].tobytes()) for p, a, b in zip(some, ends[:-1], ends[1:], strict=True))
        self.ids.update((p, i) for p, i in fresh.items() if len(p) <= LONGEST_CACHED)
        return [fresh[p] if p in fresh else self.ids[p] for p in pieces]

    def encode_flat(self, texts: list[str | None], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for some in grouped(texts):
            ids, n = self._encode_group(some, end)
            flat.append(ids), counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode_group(self, texts: list[str], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one string; what stands for odd pieces and ends of texts is replaced by their ids."""
        given, odd = [], []
        for t in texts:
            if any(s in t for s in self.specials):
                odd.append(self.whole(t))
                given.append("\x01")
                continue
            pieces = t.replace("\n", " ").split(" ")
            if self.fast and "\0" not in t and "\x01" not in t and "\x02" not in t and max(map(len, pieces)) <= LONGEST_MERGED:
                at = () if t.isascii() or not _ODD.search(t) else [k for k, p in enumerate(pieces) if not p.isascii() and _ODD.search(p)]
            else:
                at = [k for k, p in enumerate(pieces) if not self.fast or _ODD.search(p) or len(p) > LONGEST_MERGED or not _MARKS.isdisjoint(p)]
            for k in at:
                odd.append(pieces[k])
                pieces[k] = "\x01"
            given.append(" ".join(pieces).lower())
        wanted = [p for p in odd if isinstance(p, str)]
        found = iter(self._look_up(wanted)) if wanted else iter(())
        spliced = [p if isinstance(p, bytes) else next(found) for p in odd]
        if self.fast:
            ids = self._merged(" \x02 ".join([*given, ""]))
            is_odd, is_end = ids == self.odd, ids == self.between
        else:  # every piece is odd
            codes = np.frombuffer(" \x02 ".join([*given, ""]).replace(" ", "").encode(), np.uint8)
            ids, is_odd, is_end = codes.astype("<u4"), codes == 1, codes == 2
        wide = np.ones(len(ids), np.int64)
        wide[is_odd] = np.fromiter((len(p) // 4 for p in spliced), np.int64, len(spliced))
        wide[is_end] = len(end) // 4
        place = np.cumsum(wide) - wide
        out = np.zeros(int(wide.sum()), "<u4")
        usual = ~(is_odd | is_end)
        out[place[usual]] = ids[usual]
        for mask, values in ((is_odd, b"".join(spliced)), (is_end, end * int(is_end.sum()))):
            sizes = wide[mask]
            out[np.repeat(place[mask] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = np.frombuffer(values, "<u4")
        ends = (place + wide)[is_end]
        return out, np.diff(ends, prepend=0)

    def encode_texts(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        flat, counts = self.encode_flat(texts, end)
        ends = np.cumsum(counts)
        return [flat[b - n:b].tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
