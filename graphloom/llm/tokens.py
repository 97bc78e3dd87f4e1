"""Token ids of whole texts, with a cache of the pieces between single spaces.

Byte-level BPE vocabularies split a text by a pattern and merge inside each match. A single space with
non-space characters on both sides always starts a new match, so the pieces between such spaces can be
encoded apart and joined. Corpora repeat most pieces, so a bounded cache of pieces saves most of the work.
Texts in which a piece starts or ends with white space are encoded whole.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import only

#: Texts are handled in blocks of about so many characters.
BLOCK_CHARS = 2_000_000
#: Bytes of texts that are Python strings at once, about.
SLICE_BYTES = 4 << 20


def blocks(texts: Sequence[str], chars: int = BLOCK_CHARS) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters each."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a string column of about ``most`` bytes each (a longer text is a range of its own)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def texts_of(column: pa.Array, begin: int, end: int) -> list[str]:
    """Some texts of a string column; a null is an empty text."""
    return [t or "" for t in column.slice(begin, end - begin).to_pylist()]


def trim(kept: dict, limit: int) -> None:
    """Drops the older half of a cache that has more than ``limit`` entries."""
    if len(kept) > limit:
        for key in list(itertools.islice(kept, len(kept) - limit // 2)):
            del kept[key]


class Pieces(dict):
    """The ids of pieces with a space before them; None where a piece begins or ends with white space, as its ids
    depend on its neighbours."""

    def __init__(self, encode_piece: Callable[[str], bytes]):
        super().__init__()
        self.encode_piece = encode_piece
        self.encode_word: Callable[[str], bytes] = getattr(encode_piece, "word", lambda piece: encode_piece(" " + piece))

    def __missing__(self, piece: str) -> bytes | None:
        if piece.isalpha():
            value = self[piece] = self.encode_word(piece)
        else:
            value = self[piece] = None if not piece or piece[0].isspace() or piece[-1].isspace() else self.encode_piece(" " + piece)
        return value


class PieceCache:
    """``encode(texts)``: the ids of each text as bytes of little-endian unsigned 32-bit integers.

    ``encode_piece`` gives the ids of one piece or text in that form. About ``limit`` pieces are kept between blocks.
    Texts for which ``encode_piece.apart``, if there is one, gives ids are not cut into pieces. If ``encode_piece`` has
    a method ``begin``, it is called before each block with the pieces kept; if it has a method ``word``, that gives the
    ids of a piece of letters alone.
    """

    def __init__(self, encode_piece: Callable[[str], bytes], limit: int = 700_000):
        self.encode_piece, self.limit = encode_piece, limit
        self.apart: Callable[[str], bytes | None] = getattr(encode_piece, "apart", lambda text: None)
        self.begin: Callable[[Pieces], None] = getattr(encode_piece, "begin", lambda kept: None)
        self.kept = Pieces(encode_piece)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        find, encode_piece = self.kept.__getitem__, self.encode_piece
        for begin, end in blocks(texts):
            trim(self.kept, self.limit)
            self.begin(self.kept)
            for text in texts[begin:end]:
                if (ids := self.apart(text)) is not None:
                    out.append(ids)
                    continue
                pieces = text.split(" ")
                try:
                    first = pieces[0]
                    if first and first[-1].isspace():
                        raise TypeError
                    pieces[0] = ""
                    rest = b"".join(map(find, pieces[1:]))
                    out.append((encode_piece(first) if first else b"") + rest)
                except TypeError:
                    out.append(encode_piece(text))
        return out


PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: Sequence[int]) -> bytes:
    return PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class LibraryEncoder(dict):
    """Ids by the tokenizers library, for a byte-level BPE vocabulary file.

    ``apart`` encodes texts that hold an added token of the vocabulary, such as an end mark; calls are for texts and
    pieces without one. A text that is one match of the pattern goes to the library's BPE model directly, in the byte alphabet of
    the vocabulary; other texts are split by the library's own pre-tokenizer first. The ids of matches are kept here, up
    to about ``limit``: by the match, or by a zero character (which no match holds here) and its form in the byte alphabet.
    """

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.tokenizer, self.limit = tokenizer, limit
        self.tokenize, self.split = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        self.table = {b: self._letter(b) for b in range(256)}
        self.space = self.table[ord(" ")]
        self.kept: Pieces | None = None

    @staticmethod
    def _letter(byte: int) -> str:
        """The character that stands for a byte: itself if it is printable, else one from 256 on, in order."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        if byte in plain:
            return chr(byte)
        return chr(256 + [b for b in range(256) if b not in plain].index(byte))

    def begin(self, kept: Pieces) -> None:
        trim(self, self.limit)
        self.kept = kept

    def apart(self, text: str) -> bytes | None:
        """The library's ids of a text that holds an added token, None for other texts."""
        for content in self.added:
            if content in text:
                return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return None

    def _ids(self, mapped: str) -> bytes:
        return packed([t.id for t in self.tokenize(mapped)])

    def __missing__(self, key: str) -> bytes:
        mapped = key[1:] if key[0] == "\0" else key.encode().decode("latin-1").translate(self.table)
        ids = self[key] = self._ids(mapped)
        return ids

    def word(self, piece: str) -> bytes:
        """The ids of a piece of letters with a space before it. They are kept with the pieces."""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return self._ids(self.space + mapped)

    def __call__(self, text: str) -> bytes:
        if text[:1] == " ":
            body = text[1:]
            if self.kept is not None and body[-1:] in ".,;:!?" and body[:-1].isalpha():
                return self.kept[body[:-1]] + self[body[-1]]
        elif text.isalpha():
            return self[text]
        if len(text) > 200:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # a line break between other characters is a match of its own
        head, line, tail = text.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self(head) + self["\n"] + self(tail)
        # a match in ASCII letters alone is the same in both alphabets
        return b"".join([self[mapped if mapped.isascii() else "\0" + mapped] for mapped, _ in self.split(text)])


_ENCODERS: dict[tuple, PieceCache] = {}


#: Pieces and matches that a Python process keeps, and the fewer ones of an operator that runs among others: workers
#: that wait for their next task hold their caches too.
KEPT, KEPT_FEW = (700_000, 200_000), (250_000, 100_000)


def library_cache(path: str, kept: tuple[int, int] = KEPT) -> PieceCache:
    """One cache for each vocabulary file and Python process; it serves the tasks that the process runs."""
    only("library encoder", _ENCODERS)
    if (path, kept) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kept] = PieceCache(LibraryEncoder(path, kept[1]), kept[0])
    return _ENCODERS[path, kept]


def crc32_of(ids: bytes) -> int:
    """Unsigned CRC-32 of ids given as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)


def pattern(text: str) -> regex.Pattern:
    return regex.compile(text)
