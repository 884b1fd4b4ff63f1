"""Vectorised pre-tokenisation for the two tokenizer files, and caches of what pre-tokens become.

Texts are taken as code points. Classes (white space, letter, number, other) and lower-case forms of code
points are asked from the tokenizer's own pre-tokeniser and normaliser when first seen, so the split
agrees with the library for whatever Unicode version it has. Texts that need more than
code-point-wise normalisation, or hold special strings, are left to the caller (``plain`` is False).
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import blocks, mix64, ragged, range_sums

SPACE, LETTER, NUMBER, OTHER, COMPLEX, UNKNOWN = 0, 1, 2, 3, 4, 255
BLOCK_CHARS = 1 << 20


class Splitter:
    """Splits texts as tokenizer does; words: lower-casing, white space dropped; otherwise byte-level."""

    def __init__(self, tokenizer, words: bool, specials: list[str]):
        self.words, self.specials = words, specials
        self.pre = tokenizer.pre_tokenizer
        self.norm = tokenizer.normalizer if words else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.low = np.arange(0x110000, dtype=np.uint32)
        self.symbol = mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def _learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            char = form = chr(c)
            if self.norm is not None:
                form = self.norm.normalize_str(char)
                if len(form) != 1:
                    self.kind[c] = COMPLEX
                    continue
                self.low[c] = ord(form)
            pieces = lambda s: len(self.pre.pre_tokenize_str(s))
            if pieces("a" + form) == 1:
                self.kind[c] = LETTER if pieces(form) else SPACE
            elif pieces("!" + form) == 1:
                self.kind[c] = OTHER if pieces(form) else SPACE
            elif self.words:
                self.kind[c] = NUMBER if pieces(form) else SPACE
            else:
                self.kind[c] = NUMBER if pieces("1" + form) == 1 else SPACE

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.specials) and (self.norm is None or text.isascii() or unicodedata.is_normalized("NFC", text))

    def split(self, texts: list[str]) -> Split:
        """The pre-tokens of texts; a text with code points of no simple form gets complex = True and none."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        kind = self.kind[codes]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(codes[kind == UNKNOWN]))
            kind = self.kind[codes]
        hard = np.zeros(len(texts), bool)
        if (kind == COMPLEX).any():
            hard[np.unique(np.searchsorted(at, np.flatnonzero(kind == COMPLEX), "right") - 1)] = True
        low = self.low[codes] if self.words else codes
        starts, ends = self._bounds(kind, low, at)
        out = Split()
        out.low, out.starts, out.ends, out.complex = low, starts, ends, hard
        out.text_of = np.searchsorted(at, starts, "right") - 1
        if hard.any():
            keep = ~hard[out.text_of]
            out.starts, out.ends, out.text_of = starts[keep], ends[keep], out.text_of[keep]
        out.hashes = range_sums(self.symbol[low], out.starts, out.ends)
        return out

    def _bounds(self, kind: np.ndarray, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(kind)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.zeros(n + 1, bool)  # a text starts here
        first[at] = True
        solid = kind != SPACE
        change = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= first[:n]
        start = solid & change
        if self.words:
            start |= kind == NUMBER
        else:
            before = np.flatnonzero(start[1:] & ~solid[:-1] & ~first[1:n])  # white space that a solid character follows
            start |= ~solid & change
            start[before[low[before] == 32] + 1] = False
            start[before] = True
        # an apostrophe alone, then letters: 's 't 'm 'd 're 've 'll
        p = np.flatnonzero((low[:-1] == 39) & start[:-1] & start[1:] & (kind[1:] == LETTER) & ~first[1:n])
        if len(p):
            a = low[p + 1]
            b = np.where(p + 2 < n, low[np.minimum(p + 2, n - 1)], 0)
            b[(p + 2 < n) & first[np.minimum(p + 2, n)]] = 0
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for some, width in ((one, 1), (two, 2)):
                q = p[some] + 1
                start[q] = False
                r = q + width
                r = r[r < n]
                r = r[~first[r] & (kind[r] == LETTER)]
                start[r] = True
        stop = np.ones(n, bool)
        np.logical_or(start[1:], first[1:n], out=stop[:-1])
        if self.words:
            stop[:-1] |= ~solid[1:]
            stop &= solid
        return np.flatnonzero(start), np.flatnonzero(stop) + 1


class Split:
    """starts, ends, hashes and text_of of each pre-token; complex by text; low: code points after lower-casing."""

    def pieces(self, which: np.ndarray) -> list[str]:
        """The pre-tokens' strings."""
        text = self.low.tobytes().decode("utf-32-le")
        return [text[s:e] for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(a pre-token of each different string, the class of each pre-token). Hashes group, the strings decide."""
        _, first, back = np.unique(self.hashes, return_index=True, return_inverse=True)
        n = self.ends - self.starts
        other = np.flatnonzero(first[back] != np.arange(len(back)))
        like = first[back[other]]
        differs = n[other] != n[like]
        some = np.flatnonzero(~differs)
        if len(some):
            differs[some] = ~_equal_strings(self.low, self.starts[other[some]], self.low, self.starts[like[some]], n[like[some]])
        if differs.any():  # strings whose hashes meet get classes of their own
            odd = other[differs]
            own: dict[str, int] = {}
            numbers = [own.setdefault(x, len(own)) for x in self.pieces(odd)]
            back[odd] = len(first) + np.array(numbers)
            first = np.append(first, odd[np.unique(numbers, return_index=True)[1]])
        return first, back


def _equal_strings(left: np.ndarray, left_at: np.ndarray, right: np.ndarray, right_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the code points at both places agree, n of them each."""
    same = left[ragged(left_at, n)] == right[ragged(right_at, n)]
    return np.logical_and.reduceat(same, np.cumsum(n) - n)


def cut(text: str, limit: int = BLOCK_CHARS) -> list[str]:
    """Parts of at most about limit characters, cut only before a blank that a non-blank precedes: no pre-token spans that."""
    parts, at = [], 0
    while len(text) - at > limit:
        here = at + limit
        while here < len(text) and not (text[here] == " " and not text[here - 1].isspace()):
            here += 1
        parts.append(text[at:here])
        at = here
    parts.append(text[at:])
    return parts


class Lexicon:
    """Ids of the pre-tokens seen so far in this Python worker; forgotten as a whole beyond limit entries. Hashes find, strings decide."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.string_at, self.string_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.strings, self.strings_used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _put(pool: np.ndarray, used: int, flat: np.ndarray) -> np.ndarray:
        while used + len(flat) > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        pool[used : used + len(flat)] = flat
        return pool

    def look_up(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """(position in the pool, number of ids) of each pre-token of split."""
        first, back = split.classes()
        if len(self.keys) + len(first) > self.limit:
            self.clear()
        hashes, length, begin = split.hashes[first], (split.ends - split.starts)[first], split.starts[first]
        slot = np.searchsorted(self.keys, hashes)
        met = np.zeros(len(first), bool)
        inside = slot < len(self.keys)
        met[inside] = self.keys[slot[inside]] == hashes[inside]
        known = met.copy()
        known[met] = self.string_n[slot[met]] == length[met]
        some = np.flatnonzero(known)
        if len(some):
            known[some] = _equal_strings(split.low, begin[some], self.strings, self.string_at[slot[some]], length[some])
        at, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int32)
        at[known], n[known] = self.at[slot[known]], self.n[slot[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            ids = self.encode(split.pieces(first[new]))
            n[new] = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n[new].sum()))
            self.pool = self._put(self.pool, self.used, flat)
            at[new] = self.used + np.cumsum(n[new], dtype=np.int64) - n[new]
            self.used += len(flat)
            # a string whose hash another has is encoded each time
            put = new[~met[new]]
            put = put[np.unique(hashes[put], return_index=True)[1]]
            flat = split.low[ragged(begin[put], length[put])]
            self.strings = self._put(self.strings, self.strings_used, flat)
            string_at = self.strings_used + np.cumsum(length[put]) - length[put]
            self.strings_used += len(flat)
            where = slot[put]
            self.keys, self.at, self.n = np.insert(self.keys, where, hashes[put]), np.insert(self.at, where, at[put]), np.insert(self.n, where, n[put])
            self.string_at, self.string_n = np.insert(self.string_at, where, string_at), np.insert(self.string_n, where, length[put])
        return at[back], n[back]


def library_encoder(tokenizer):
    """Ids of single pre-tokens, from a copy of the library's tokenizer without normaliser and regex."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    bare = Tokenizer.from_str(tokenizer.to_str())
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bare.encode_special_tokens = True
    return lambda pieces: [x.ids for x in bare.encode_batch_fast(pieces, add_special_tokens=False)]


def text_blocks(texts: list[str]):
    """Row ranges of about BLOCK_CHARS characters."""
    return blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK_CHARS)
