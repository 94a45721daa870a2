"""Byte-level BPE (operator 9): exact encoding by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds, in one pass, the longest
token at every position. The encoder takes the longest token, and steps back to shorter ones whenever two neighbours
could not stand side by side in the merge result; whether they can is decided by undoing merges across the border and
is memoised. A position from which no completion was found is never tried again, so a piece takes linear time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import extended, release

#: White space as Unicode's White_Space property has it (Python's own \s has four control characters more).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space with other white space beside it.
_SPACED = re.compile(f" [{WS}]|[{WS}] ")
#: A single space between two characters that aren't white space.
_LONE = re.compile(f"(?<=[^{WS}]) (?=[^{WS}])")
_LONG = 1 << 20
#: The pattern of which it is known that a lone space begins a match, that a word and the space before it are one match,
#: and that a sign behind it is a match of its own. (Fixed value.)
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes pieces of text by a rank table as merging by rank would.

    ``cache_size`` bounds the memoised pieces, the memoised words and the memoised pairs, each of which starts anew
    when full.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 100_000):
        self.ranks, self.cache_size, self.by_words = ranks, cache_size, pattern == WORDS_PATTERN
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.tokens = {r: t for t, r in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, int] = {}
        live: dict[bytes, int] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) == 1:
                self.split[rank], live[token] = (rank, rank), rank
                continue
            # The merge that makes this token: the longest head first, among tokens of lower rank that can stand together.
            for cut in range(len(token) - 1, 0, -1):
                a, b = live.get(token[:cut]), live.get(token[cut:])
                if a is not None and b is not None and self._can_follow(a, b):
                    self.pairs[a, b], self.split[rank], live[token] = rank, (a, b), rank
                    break
        self.live = live  # the others come out of no merge; they stand only for a whole piece
        n = 1 + max(self.tokens, default=0)
        self.shorter, self.sizes = [-1] * n, [0] * n
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in live.items():
            self.shorter[rank] = next((head for cut in range(len(token) - 1, 0, -1) if (head := live.get(token[:cut])) is not None), -1)
            self.sizes[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.back = [size - 1 for size in self.sizes]
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave ``a`` and ``b`` side by side: undo merges on both sides of the border, the
        latest first, and look for a merge across the border that would have come before them."""
        limit = 1 << 62
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def _fit(self, last: int, token: int) -> int:
        """The longest of ``token`` and the tokens that begin it which can follow ``last``, or -1; memoised."""
        found = token
        while found >= 0 and not self._can_follow(last, found):
            found = self.shorter[found]
        if len(self.fits) >= 2 * self.cache_size:
            self.fits.clear()
        self.fits[last << 32 | token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern. A piece that is a token is that token, as in the tiktoken library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, back, sizes, shorter, fits = len(piece), self.back, self.sizes, self.shorter, self.fits
        longest = [-1] * size
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back[rank]] = rank  # ends ascend: the last match kept for a start is its longest
        closed: set[int] = set()
        ids: list[int] = []
        pos, token, asked, last = 0, longest[0], longest[0], -1
        while pos < size:
            while token >= 0:
                if last >= 0 and (token := fits.get(last << 32 | token, -2)) < 0:
                    if token == -1:
                        break
                    token = self._fit(last, asked)
                    if token < 0:
                        break
                end = pos + sizes[token]
                if end not in closed:
                    break
                token = asked = shorter[token]
            if token >= 0:
                ids.append(token)
                last, pos = token, end
                if pos < size:
                    token = asked = longest[pos]
            else:  # no token here: give up this position and try the token before it shorter
                closed.add(pos)
                token = asked = ids.pop()
                pos -= sizes[token]
                last = ids[-1] if ids else -1
        return ids

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.cache_size:
                self.pieces.clear()
            found = array("I", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def _pieces(self, text: str) -> bytes:
        if len(text) < _LONG:
            return b"".join(map(self._piece, self.pattern.findall(text)))
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := list(islice(found, 100_000)):
            out.append(b"".join(map(self._piece, part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        Under ``WORDS_PATTERN`` a single space between two characters that aren't white space always begins a match, so a
        text is cut there first and the results of the parts are memoised. Any other pattern is matched over whole texts.
        """
        if not self.by_words or not text or text[0] == " " or text[-1] == " ":
            return self._pieces(text)
        parts = _LONE.split(text) if _SPACED.search(text) else text.split(" ")
        words, out = self.words, [self._pieces(parts[0])]
        for part in islice(parts, 1, None):
            found = words.get(part)
            if found is None:
                if len(words) >= self.cache_size:
                    words.clear()
                if part.isalpha():
                    found = self._piece(" " + part)
                elif part[:-1].isalpha() and part[-1] in ".,!?;:":
                    found = self._piece(" " + part[:-1]) + self._piece(part[-1])
                else:
                    found = self._pieces(" " + part)
                if len(part) <= 64:
                    words[part] = found
            out.append(found)
        return b"".join(out)

    def forget(self) -> None:
        """Empties what is memoised: a worker that goes on to other tasks keeps the tables only."""
        for memo in (self.pieces, self.words, self.fits):
            memo.clear()

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes that ids (as ``encode`` gives them) stand for. An unknown id is a ValueError."""
        tokens = self.tokens
        try:
            return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])
        except KeyError as e:
            raise ValueError(f"no such token id: {e}") from None


_encoders: dict[tuple[str, str], Encoder] = {}
#: Where the rank file is, or a function that says so on whichever machine it is called.
Place = str | Callable[[], str]


def encoder(path: Place, pattern: str) -> Encoder:
    """The encoder of a rank file; a Python worker builds it once. A function is asked there, so that each machine opens
    the file where it has it."""
    path = path() if callable(path) else path
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def _lists(codes: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) // 4 for x in codes])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), "<i4")))


def encode(docs: DataFrame, path: Place, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``n_tokens`` (long) of the whole ``text``; a null text is the empty one.

    Columns of these names in ``docs`` are replaced; all other columns, nulls and repeated rows stay as they are, and an
    empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    source = docs.select(*keep)
    schema = extended(source.schema, token_ids="array<int>", n_tokens="long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            ids = _lists([bpe.encode(t or "") for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, ids.value_lengths().cast(pa.int64())], [*batch.schema.names, "token_ids", "n_tokens"])
        bpe.forget()
        release()

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: Place, pattern: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out``: the string its ``ids`` stand for (null for null; bytes that aren't UTF-8 become U+FFFD)."""
    source = encoded.select(*[c for c in encoded.columns if c != out or c == ids])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()).decode(errors="replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return source.mapInArrow(run, extended(source.schema, **{out: "string"}))


def round_trip(docs: DataFrame, path: Place, pattern: str, columns: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and give ``columns``, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes) and, if ``ids``, token_ids (array of int),
    one row for each row of ``docs``.

    A null text counts as empty; repeated rows and null doc_ids are kept; an empty table gives no rows.
    """
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    schema = extended(docs.select(*columns).schema, n_tokens="long", ids_sha256="string", decoded_sha256="string")
    if ids:
        schema = extended(schema, token_ids="array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            n, sha, back, codes = [], [], [], []
            for t in batch.column("__text"):
                code = bpe.encode(t.as_py() or "")
                n.append(len(code) // 4)
                sha.append(hashlib.sha256(code).hexdigest())
                if ids:
                    codes.append(code)
                back.append(hashlib.sha256(bpe.decode(code)).hexdigest())
            found = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if ids:
                found.append(_lists(codes))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], schema.names)
        bpe.forget()
        release()

    return source.mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens under the multilingual rank file, and what they decode to."""
    import public_tokenizers as P

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
