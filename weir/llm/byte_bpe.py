"""Byte-level BPE: encoding in linear time by backtracking, and decoding.

Each piece that the pattern cuts from a text is encoded on its own. One pass of an
Aho-Corasick automaton (bytes mapped to Latin-1 characters) tells the longest token that
starts at each byte. Encoding takes the longest token, or a shorter one, as long as the
token *fits* after the one before it: merging by rank would leave the border between the two
in place. Where nothing fits, the position is marked as dead and the last token is taken
back. Whether two tokens fit is worked out once per pair from their merges. A position dies
at most once, so the work is linear in the length of the piece, and the result is the one
that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from weir.llm.common import map_rows

RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = public_tokenizers.PATTERN
# Encoded pieces that a task keeps, and the longest piece among them; bounds memory only.
KEPT_PIECES, KEPT_CHARS = 600_000, 48
KEPT_PAIRS = 500_000


class ByteBpe:
    """A vocabulary of byte strings with ranks; the rank is the token id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.four_bytes = {i: i.to_bytes(4, "little") for i in self.token}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefixes: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            if self.reachable(i):
                self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(t): int(i) for t, i in pairs}, pattern)

    def merged(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """Merging by rank with ranks under ``below``, the slow way; used on single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(a + b, float("inf")), i)
                for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or an unreachable token."""
        if token not in self.halves:
            parts = self.merged(self.token[token], below=token) if self.size[token] > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        return self.size[token] == 1 or self.split(token) is not None

    def fit(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two neighbouring tokens.

        Undo the merges next to the border, the latest first. The border falls if at some
        time the two tokens beside it could merge earlier than what was undone last.
        """
        key = (left, right)
        found = self.fits.get(key)
        if found is not None:
            return found
        until, result = float("inf"), True
        while True:
            joined = self.ranks.get(self.token[left] + self.token[right])
            if joined is not None and joined < until:
                result = False
                break
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                break
            # Of equal ranks the one on the left merges first.
            if b is None or (a is not None and left > right):
                until, left = left, a[1]
            else:
                until, right = right + 1, b[0]
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        self.fits[key] = result
        return result

    def longest(self, piece: bytes) -> list[int]:
        """For each byte the longest token that starts there; a later end is a longer token."""
        best = [0] * len(piece)
        for end, (token, before) in self.automaton.iter(piece.decode("latin-1")):
            best[end - before] = token
        return best

    def shorter(self, token: int) -> int | None:
        """The longest reachable token that is a proper prefix of this one."""
        if token not in self.prefixes:
            text = self.token[token]
            starts = (self.ranks.get(text[:n]) for n in range(len(text) - 1, 0, -1))
            self.prefixes[token] = next(
                (t for t in starts if t is not None and self.reachable(t)), None
            )
        return self.prefixes[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        best, n = self.longest(piece), len(piece)
        dead = bytearray(n + 1)
        taken: list[int] = []
        at, token = 0, best[0]
        while at < n:
            while token is not None:
                end = at + self.size[token]
                if not dead[end] and (not taken or self.fit(taken[-1], token)):
                    break
                token = self.shorter(token)
            if token is not None:
                taken.append(token)
                at = end
                token = best[at] if at < n else None
            else:
                dead[at] = 1
                last = taken.pop()
                at -= self.size[last]
                token = self.shorter(last)
        return taken

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of encoded ids."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Ids of short pieces seen before, as bytes; a missing piece is encoded when asked for."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        bpe = self.bpe
        ids = b"".join(map(bpe.four_bytes.__getitem__, bpe.encode_piece(piece.encode())))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[tuple[str, str], ByteBpe] = {}


def vocabulary(path: str, pattern: str = PATTERN) -> ByteBpe:
    """The vocabulary of a file, read once per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.load(path, pattern)
    return _loaded[path, pattern]


def _each_text(
    df: DataFrame, id_col: str, value_col: str, schema: str, path: str | None,
    row: Callable[[ByteBpe, object], tuple],
) -> DataFrame:
    path = path or public_tokenizers.path(RANKS)

    def start():
        bpe = vocabulary(path)
        return lambda rows: [(i, *row(bpe, value)) for i, value in rows]

    kind = df.select(id_col).dtypes[0][1]
    return map_rows(df.select(id_col, value_col), f"{id_col} {kind}, {schema}", start)


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """(id, ids array<bigint>) for every row; a null or empty text has no ids.

    Repeated rows and null ids are kept as they are. Other columns are ignored.
    """
    return _each_text(
        df, id_col, text_col, "ids array<bigint>", path,
        lambda bpe, text: (np.frombuffer(bpe.encode(text or ""), "<u4").tolist(),),
    )


def decode_ids(
    df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None
) -> DataFrame:
    """(id, bytes binary) for every row of ids; null ids decode to nothing."""
    return _each_text(
        df, id_col, ids_col, "bytes binary", path,
        lambda bpe, ids: (bpe.decode(np.array(ids or [], "<u4").tobytes()),),
    )


def encode_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): a round trip without keeping the ids.

    Same rules as :func:`encode_texts`.
    """

    def row(bpe: ByteBpe, text: str | None) -> tuple:
        ids = bpe.encode(text or "")
        sums = [hashlib.sha256(x).hexdigest() for x in (ids, bpe.decode(ids))]
        return len(ids) // 4, *sums

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _each_text(df, id_col, text_col, schema, path, row)
