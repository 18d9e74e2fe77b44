"""Whole-text BPE encoding with the tokenizers library, one model call per distinct chunk.

A text may be cut around a lone line break, before a lone space, and before a punctuation mark that follows
a letter: no pre-token of either vocabulary reaches across such a place. Arrow cuts there and finds the
distinct chunks of a batch; the library's BPE model sees each distinct chunk once per worker and cache fill.
Texts with two white-space characters in a row go through the pattern as a whole, with the same result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import gather, held, offsets_of

#: Bytes of distinct chunks, their ids and the table's own cells that a worker remembers (checked before each batch);
#: only speed depends on it.
CACHE, CELL = 64 << 20, 160
#: The pattern of the word-end vocabulary's Split step, as its JSON file has it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Two characters of white space (as the pattern languages see it, for RE2), or the mark that cuts use.
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARK = "\x00"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Encoder:
    """Ids of whole texts, equal to the library's encode_batch(texts, add_special_tokens=False).

    The file's added tokens are cut out of a text first, as the library does: what stands between them is encoded by itself.
    """

    cache = CACHE
    #: Tokens that are matched in the text as it comes, if any: their ids, a pattern of them, and what splits at them.
    added: dict[str, int] = {}
    literal, parts = "", None

    def __init__(self, path: str, pattern: str, unsafe: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.normalizer = self.tokenizer.model.tokenize, self.tokenizer.normalizer
        self.unsafe = unsafe
        self.find = regex.compile(pattern, regex.V0).findall
        self.latin = dict(enumerate(byte_alphabet()))
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.literal, self.parts = "|".join(map(re.escape, self.added)), regex.compile(f"({names})", regex.V0).split if names else None
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.flat, self.ends, self.held = array("I"), array("q", [0]), 0

    def pretoken(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.latin))]

    def ids(self, chunk: str) -> list[int]:
        text = self.normalizer.normalize_str(chunk) if self.normalizer else chunk
        return [i for piece in self.find(text) for i in self.pretoken(piece)]

    def whole(self, text: str) -> list[int]:
        """Ids of a text as it came, added tokens included."""
        if not self.parts:
            return self.ids(text)
        return [i for k, part in enumerate(self.parts(text)) for i in ([self.added[part]] if k % 2 else self.ids(part))]

    def word(self, piece: str) -> list[int]:
        """A chunk that follows a space, or a mark for none."""
        if piece.isalpha():
            if piece.isascii():
                return [t.id for t in self.tokenize(self.latin[32] + piece)]
            return self.pretoken(" " + piece)
        return self.ids(piece[1:] if piece[:1] == MARK else " " + piece)

    def add(self, every: list[list[int]]) -> range:
        """Append lists of ids to the table of chunks; their rows."""
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        begin, end = len(self.ends) - 1, self.ends[-1]
        self.flat.extend(chain.from_iterable(every))
        self.ends.frombytes((np.cumsum(sizes) + end).tobytes())
        return range(begin, begin + len(every))

    def rows(self, keys: list[str], make: Callable[[str], list[int]]) -> list[int]:
        """Rows of chunks in the table; `make` gives the ids of those that aren't there yet."""
        rows = list(map(self.chunks.get, keys))
        new = [i for i, row in enumerate(rows) if row is None]
        if new:
            names, known = [keys[i] for i in new], len(self.flat)
            for i, row in zip(new, self.add([make(x) for x in names]), strict=True):
                rows[i] = row
            self.chunks.update(zip(names, [rows[i] for i in new], strict=True))
            self.held += CELL * len(new) + sum(map(len, names)) + 4 * (len(self.flat) - known)
        return rows

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, offsets of the texts)."""
        if self.held > self.cache:
            self.clear()
        raw, texts = texts, self.prepared(texts)
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        if self.literal:
            unsafe = pc.or_(unsafe, pc.match_substring_regex(raw, self.literal))
        whole = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        lines = pc.split_pattern(pc.if_else(unsafe, pa.scalar("", texts.type), texts) if len(whole) else texts, "\n")
        of_text = lines.offsets.to_numpy().astype(np.int64)
        of_text -= of_text[0]
        marked = pc.replace_substring_regex(lines.flatten(), r"(\pL)([,.;:!?])", "\\1 " + MARK + "\\2")
        pieces = pc.split_pattern(marked, " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        encoded = pieces.flatten().dictionary_encode()
        names = encoded.dictionary.to_pylist()
        index = encoded.indices.to_numpy(zero_copy_only=False)
        # chunks that stand elsewhere than at the front of a line
        inner = np.bincount(index, minlength=len(names)) > np.bincount(index[offsets[:-1]], minlength=len(names))
        rows, wanted = np.zeros(len(names), np.int64), np.flatnonzero(inner)
        rows[wanted] = self.rows([names[i] for i in wanted.tolist()], self.word)
        codes = rows[index]
        # the first chunk of a line follows a line break, or nothing at the start of a text
        at_start = np.zeros(len(offsets) - 1, bool)
        at_start[of_text[:-1]] = True
        heads, which = np.unique(index[offsets[:-1]].astype(np.int64) * 2 + at_start, return_inverse=True)
        # two line breaks mark the start of a text, which is no part of the chunk
        keys = [("\n\n" if head & 1 else "\n") + names[head >> 1] for head in heads.tolist()]
        head_rows = self.rows(keys, lambda key: self.ids(key[2:] if key[:2] == "\n\n" else key))
        codes[offsets[:-1]] = np.array(head_rows, np.int64)[which]
        kept_flat, kept_rows = len(self.flat), len(self.ends)
        codes[offsets[of_text[whole]]] = self.add([self.whole(raw[i].as_py()) for i in whole.tolist()])
        table, ends = np.frombuffer(self.flat, np.uint32) if self.flat else np.empty(0, np.uint32), np.array(self.ends, np.int64)
        lengths = np.diff(ends)[codes]
        ids = table[gather(ends[codes], lengths)]
        del table
        if len(whole):
            del self.flat[kept_flat:], self.ends[kept_rows:]
        return ids, offsets_of(lengths)[offsets[of_text]]

    def prepared(self, texts: pa.Array) -> pa.Array:
        return texts


class WordEncoder(Encoder):
    """For the vocabulary that lowers case and drops white space."""

    def prepared(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_lower(texts)

    def word(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isalpha():
            return [t.id for t in self.tokenize(piece)]
        return self.ids(piece[1:] if piece[:1] == MARK else piece)


def byte_level(path: str) -> Encoder:
    """The worker's encoder for a byte-level vocabulary."""
    from public_tokenizers import PATTERN

    return held(Encoder, path, PATTERN, SPACE + SPACE + "|" + MARK)


def word_level(path: str) -> Encoder:
    return held(WordEncoder, path, WORD_PATTERN, MARK)
