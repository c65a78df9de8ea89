"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text goes in by chunks, token ids come out as soon as no further text can
change them. Two machines follow each other:

* StreamEncoder cuts the text into the pieces of the tokenizer's pattern and
  holds back only the few characters whose piece is still open. A run that
  goes on (letters, digits, signs or white space without end) is handed on
  while it grows.
* PieceTransducer encodes one piece. The encoding of a piece is the one
  sequence of tokens in which every two neighbours are compatible, i.e. merging
  their joined bytes gives these two again. So the last token of each prefix
  follows from the last tokens of shorter prefixes, no further back than the
  longest token: the merge list's sufficient lookahead. Tokens on which all
  prefixes within the lookahead agree are stable and leave.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable
from itertools import chain

import regex

#: The pre-tokenising pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a text that are fed at once.
CHUNK_CHARS = 1 << 16
#: Held-back characters from which a piece is handed on while it grows.
HOLD_CHARS = 512
#: Entries of the piece and pair caches, which are emptied when full; pieces longer than CACHED_CHARS aren't kept.
CACHE_ENTRIES = 1 << 19
CACHED_CHARS = 64

_RUNS = {"letter": regex.compile(r"\p{L}*"), "number": regex.compile(r"\p{N}*"), "sign": regex.compile(r"[^\s\p{L}\p{N}]*"), "space": regex.compile(r"\s*")}


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes to id, where a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lookahead = sufficient_lookahead(ranks)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, list[int]] = {}
        self._single: dict[int, bool] = {}

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the lines `base64 id` of a ranks file."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging of a short piece, lowest rank first and leftmost at ties."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b can be neighbours."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def reachable(self, a: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        got = self._single.get(a)
        if got is None:
            got = self._single[a] = self.merge(self.tokens[a]) == [a]
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pattern, remembered when short."""
        got = self._pieces.get(piece)
        if got is None:
            data = piece.encode("utf-8", "replace")
            t = PieceTransducer(self)
            got = t.feed(data) + t.finish()
            if len(piece) <= CACHED_CHARS:
                if len(self._pieces) >= CACHE_ENTRIES:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        """Ids of pieces in a row; those seen before cost a look-up each."""
        try:
            return list(chain.from_iterable(map(self._pieces.__getitem__, pieces)))
        except KeyError:
            return list(chain.from_iterable(map(self.encode_piece, pieces)))


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes that a token can reach back: beyond them no prefix can be a later token's start."""
    return max(map(len, ranks), default=1)


class PieceTransducer:
    """Incremental encoding of one piece; memory is bounded by the stretch on which the open prefixes differ."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.data = bytearray()
        #: For each prefix of the held bytes its last token; at 0 the token emitted last, if any.
        self.last: list[int] = [-1]

    def feed(self, data: bytes) -> list[int]:
        v, ranks, out = self.v, self.v.ranks, []
        for byte in data:
            self.data.append(byte)
            i = len(self.data)
            for n in range(min(v.lookahead, i), 0, -1):
                t = ranks.get(bytes(self.data[i - n :]))
                if t is None:
                    continue
                before = self.last[i - n]
                if (v.compatible(before, t) if before >= 0 else v.reachable(t)):
                    self.last.append(t)
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks single bytes")
            if i >= 4 * v.lookahead and i % v.lookahead == 0:
                out += self._stable()
        return out

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end])
            end -= len(self.v.tokens[self.last[end]])
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens on which all prefixes agree that a later token can start from."""
        end = len(self.data)
        open_ = set(range(end - self.v.lookahead + 1, end + 1))
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(top - len(self.v.tokens[self.last[top]]))
        (common,) = open_
        if common <= 0:
            return []
        out = self._path(common)
        del self.data[:common]
        self.last = self.last[common:]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.data))
        self.data, self.last = bytearray(), [-1]
        return out


class StreamEncoder:
    """Ids of a text that arrives in chunks; special tokens' strings are ordinary text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.buf = ""
        self.run: tuple[str, PieceTransducer] | None = None

    def feed(self, chunk: str) -> list[int]:
        self.buf += chunk
        out: list[int] = []
        while True:
            if self.run:
                out += self._go_on()
                if self.run:
                    return out
            # A piece is decided by its end and two characters: the next one, and the longest contraction.
            pieces, at = self.pattern.findall(self.buf), len(self.buf)
            sure = at - 2
            # The pieces are the whole buffer, one behind the other.
            while pieces and at > sure:
                at -= len(pieces.pop())
            out += self.v.encode_pieces(pieces)
            self.buf = self.buf[at:]
            if len(self.buf) <= HOLD_CHARS:
                return out
            m = self.pattern.match(self.buf)
            kind = next(k for k in _RUNS if _RUNS[k].fullmatch(m.group()[-1]))
            self.run = (kind, PieceTransducer(self.v))
            if kind != "space":
                out += self.run[1].feed(m.group().encode("utf-8", "replace"))
                self.buf = self.buf[m.end() :]

    def _go_on(self) -> list[int]:
        kind, t = self.run
        n = _RUNS[kind].match(self.buf).end()
        ended = n < len(self.buf)
        # The last white space before other text belongs to what follows.
        take = max(0, n - 1) if kind == "space" else n
        out = t.feed(self.buf[:take].encode("utf-8", "replace"))
        self.buf = self.buf[take:]
        if ended:
            out += t.finish()
            self.run = None
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.run:
            out += self.run[1].feed(self.buf.encode("utf-8", "replace")) + self.run[1].finish()
            self.buf, self.run = "", None
        out += self.v.encode_pieces(self.pattern.findall(self.buf))
        self.buf = ""
        return out


class StreamDecoder:
    """Text of token ids that arrive one by one: bytes wait until they make a character."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.v.tokens[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(vocabulary: Vocabulary, text: str | None) -> list[int]:
    """Ids of a whole text; none for an empty or null one."""
    if not text:
        return []
    e = StreamEncoder(vocabulary)
    out: list[int] = []
    for i in range(0, len(text), CHUNK_CHARS):
        out += e.feed(text[i : i + CHUNK_CHARS])
    return out + e.finish()


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    d = StreamDecoder(vocabulary)
    return d.feed(ids) + d.finish()
