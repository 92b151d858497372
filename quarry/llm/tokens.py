"""Tokenizing with public vocabularies inside tasks: each distinct word is encoded once."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np

from . import blocks, work

#: Entries of a worker's cache of encoded words; it is emptied when full.
CACHE_WORDS = 500_000

#: A blank among other white space, where the byte-level pattern groups runs.
_RUN = re.compile(rb"(?:^|[\s\x80-\xff]) (?:$|[\s\xc2\xe1\xe2\xe3])")
MARK = b"\xff"
_CUT = re.compile(rb"(?<=[!-~])(?= )")
#: Letters up to U+024F, then signs but the apostrophe, which begins contractions.
_CORE = re.compile(rb"((?:[A-Za-z]|[\xc3-\xc9][\x80-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts with the tokenizers library, one call for each distinct piece.

    A text is cut only where the vocabulary's own pattern always breaks: at
    white space (``spaced=False``, for vocabularies that drop it), or before a
    blank next to another character (``spaced=True``, byte-level vocabularies,
    where the blank belongs to the following word).  A text that holds the
    string of an added token (a special one) is encoded whole.
    """

    _of: dict[tuple[str, bool], WordEncoder] = {}

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.model = self.tokenizer.model
        self.known = Known(self)
        self.parts: dict[bytes, bytes] = {}
        self.words = Words()

    @classmethod
    def of(cls, path: str, spaced: bool) -> WordEncoder:
        key = (path, spaced)
        if key not in cls._of:
            cls._of[key] = cls(path, spaced)
        return cls._of[key]

    def release(self) -> None:
        """Forget the words met so far and give their memory back: a worker that waits for another stage holds none of it."""
        self.known, self.parts = Known(self), {}
        self.words.clear()
        work.give_back()

    def pieces(self, text: bytes) -> list[bytes]:
        """Pieces whose ids, one after the other, are the ids of the text."""
        if not self.spaced:
            return text.split()
        if not text:
            return []
        if self.special(text):
            return [MARK + text]
        # a byte that no text holds marks a piece without a blank before it
        if _RUN.search(text):
            first, *rest = _CUT.split(text)
            return [MARK + first] + [x[1:] for x in rest]
        first, *rest = text.split(b" ")
        return ([MARK + first] if first else []) + rest

    def special(self, text: bytes) -> bool:
        """Whether a text holds the string of an added token."""
        return any(t in text for t in self.added)

    def _special_rows(self, data: bytes, off: np.ndarray) -> set[int]:
        rows = set()
        for t in self.added:
            at = data.find(t)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                if at + len(t) <= off[i + 1]:
                    rows.add(i)
                at = data.find(t, at + 1)
        return rows

    def _whole(self, piece: bytes) -> str:
        """The text that a piece stands for."""
        if self.spaced:
            piece = piece[1:] if piece[:1] == MARK else b" " + piece
        return piece.decode("utf-8", "replace")

    def _plain(self, core: bytes, tail: bytes) -> bytes | None:
        """Ids of Latin letters and the signs after them: each is one pre-token, given to the library's model.

        None if the letters are not letters after all.
        """
        parts = self.parts
        if (a := parts.get(core)) is None:
            word = core.decode("utf-8", "replace")
            if not word.isalpha():
                return None
            if not self.spaced and not (word := word.lower()).isalpha():
                return None
            raw = b" " + core if self.spaced else word.encode()
            if len(parts) > CACHE_WORDS:
                parts.clear()
            a = parts[core] = self._model(raw)
        if not tail:
            return a
        if (b := parts.get(tail)) is None:
            b = parts[tail] = self._model(tail)
        return a + b

    def _model(self, raw: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(raw.decode("latin1").translate(_BYTE_CHARS))]).tobytes()

    def ids_of_piece(self, piece: bytes) -> bytes:
        """The ids of a piece that is not known yet."""
        if self.spaced and piece.isalpha():  # letters of ASCII are one pre-token
            return array("I", [t.id for t in self.model.tokenize(_BYTE_CHARS[32] + piece.decode())]).tobytes()
        if (m := _CORE.fullmatch(piece)) and (ids := self._plain(*m.groups())) is not None:
            return ids
        return array("I", self.tokenizer.encode(self._whole(piece), add_special_tokens=False).ids).tobytes()

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        return list(map(self.known.__getitem__, pieces))

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit integers."""
        get, tail = self.known.__getitem__, int(end).to_bytes(4, "little")
        return [b"".join(map(get, self.pieces(t))) + tail for t in texts]

    def encode_rows(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` after each, and how many each text has.

        Words that repeat in the slice are looked up once; ids of words, of
        white space that is more than a blank (byte-level vocabularies) and end
        ids are then laid out by place.
        """
        data = buf.tobytes()
        if not self.spaced:
            parts = self.encode([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], end)
            return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)
        start, stop, first = blocks.words(buf, off)
        rows = len(off) - 1
        n = np.diff(first)
        row = np.repeat(np.arange(rows), n)
        h = blocks.spans_hash(blocks.prefix_hashes(buf), start, stop) + (stop - start).astype(np.uint64) if len(start) else np.zeros(0, np.uint64)
        blank = (buf[start - 1] == 32) & (start > off[row]) if len(start) else np.zeros(0, bool)
        h = blocks.mix(h * np.uint64(2) + blank)
        names, where, of = np.unique(h, return_index=True, return_inverse=True)
        known = self.words
        if len(known.name) > CACHE_WORDS:
            known.clear()
        if len(new := where[known.find(names) < 0]):
            get = self.ids_of_piece
            known.add(h[new], [get(data[x:y] if z else MARK + data[x:y]) for x, y, z in zip(start[new].tolist(), stop[new].tolist(), blank[new].tolist(), strict=True)])
        of = known.find(names)[of]
        first_own, pool = len(known.name), []
        items = [(start, of)]
        at, which, slow = self._gaps(data, buf, off, start, stop, first, row, pool)
        which = which + first_own
        slow = sorted(self._special_rows(data, off) | slow)
        if slow:  # a text where other white space meets the cuts is encoded whole
            fine = ~np.isin(row, slow)
            items = [(start[fine], of[fine])]
            keep = ~np.isin(np.searchsorted(off, at, "right") - 1, slow)
            at, which = at[keep], which[keep]
            items.append((off[slow], first_own + len(pool) + np.arange(len(slow))))
            pool += [array("I", self.tokenizer.encode(data[off[i] : off[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() for i in slow]
        items.append((at, which))
        # ends come after all else of their row
        last = first_own + len(pool)
        items.append((off[1:], np.full(rows, last)))
        pool.append(int(end).to_bytes(4, "little"))
        place = np.concatenate([2 * x for x, _ in items[:-1]] + [2 * off[1:] - 1])
        order = np.argsort(place, kind="stable")
        which = np.concatenate([w for _, w in items])[order]
        size = np.array([len(x) // 4 for x in pool], np.int64)
        begin = np.r_[known.begin, len(known.flat) + np.cumsum(size) - size]
        size = np.r_[known.size, size]
        flat = np.r_[known.flat, np.frombuffer(b"".join(pool), "<u4")]
        length = size[which]
        done = np.cumsum(length)
        ids = flat[np.repeat(begin[which] - (done - length), length) + np.arange(int(done[-1]) if len(done) else 0)]
        ends = done[which == last]
        return ids, np.diff(np.r_[0, ends])

    def _gaps(self, data, buf, off, start, stop, first, row, pool):
        """Where white space has ids of its own, the place of those in ``pool``, and the rows to encode whole."""
        before = np.where(np.r_[True, row[1:] != row[:-1]], off[row], np.r_[0, stop[:-1]]) if len(start) else start
        odd = np.flatnonzero((start > before) & ~((start - before == 1) & (buf[start - 1] == 32))) if len(start) else start
        last = np.where(np.diff(first) > 0, np.r_[stop, 0][np.maximum(first[1:] - 1, 0)], off[:-1])
        tail = np.flatnonzero(last < off[1:])
        at, which, slow, seen = [], [], set(), {}
        exotic = self._exotic
        for x, y, i, final in [*zip(before[odd].tolist(), start[odd].tolist(), row[odd].tolist(), [False] * len(odd), strict=True), *zip(last[tail].tolist(), off[1:][tail].tolist(), tail.tolist(), [True] * len(tail), strict=True)]:
            g = data[x:y]
            if exotic(data[max(int(off[i]), x - 3) : x]) or not final and data[y] in (0xC2, 0xE1, 0xE2, 0xE3):
                slow.add(i)
            key = (g, final)
            if key not in seen:
                parts = [g] if final else [g[:-1], b"" if g[-1:] == b" " else g[-1:]]
                ids = b"".join(array("I", self.tokenizer.encode(p.decode(), add_special_tokens=False).ids).tobytes() for p in parts if p)
                seen[key] = len(pool)
                pool.append(ids)
            at.append(x)
            which.append(seen[key])
        return np.array(at, np.int64), np.array(which, np.int64), slow

    @staticmethod
    def _exotic(edge: bytes) -> bool:
        """Whether a text may end in white space beyond ASCII."""
        return len(edge) >= 2 and edge[-2] == 0xC2 or len(edge) >= 3 and edge[-3] in (0xE1, 0xE2, 0xE3)


class Words:
    """Ids of the words met so far, by a 64-bit hash of word and blank, in the order of hashes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.name = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def find(self, name: np.ndarray) -> np.ndarray:
        """Places of these names; -1 for those that are new."""
        at = np.searchsorted(self.name, name)
        at[at == len(self.name)] = -1
        return np.where(self.name[at] == name, at, -1) if len(self.name) else at

    def add(self, name: np.ndarray, ids: list[bytes]) -> None:
        order = np.argsort(name)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        at = np.searchsorted(self.name, name[order])
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, size[order])
        self.name = np.insert(self.name, at, name[order])
        self.flat = np.r_[self.flat, np.frombuffer(b"".join(ids), "<u4")]


class Known(dict):
    """Ids of the pieces met so far; when full, frequent ones come back from the older half."""

    def __init__(self, encoder: WordEncoder):
        self.encoder, self.older = encoder, {}
        # a vocabulary without a table of word hashes keeps all pieces here, in two halves
        self.most = CACHE_WORDS if encoder.spaced else CACHE_WORDS // 4

    def __missing__(self, piece: bytes) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = self.encoder.ids_of_piece(piece)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
