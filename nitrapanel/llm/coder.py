"""Whole texts to token ids with a public tokenizer, at the speed of a dictionary.

``word_bpe_49k`` drops white space before it splits a text, so the ids of a text are
the ids of its blank-separated chunks one after the other.  Arrow splits the texts,
finds the distinct chunks of a part and their lower-case words; a worker keeps the ids of
the words it has met and asks the tokenizers library only for new ones; numpy lays the
ids out.  What is kept is bounded: there are two generations, a full young one becomes
the old one, and a word that is met again moves to the young one.  What is forgotten is encoded anew, so a result
never depends on it.

Strings of special tokens in a text are what the library makes of them by default: their
ids.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 250_000  # distinct words of a generation, exceeded by those of one part at most
PART_BYTES = 4 << 20  # of texts that are encoded together; a longer text is a part of its own
LONGEST_KEPT = 48  # code points; longer words are encoded but not kept
MARKS = ".,!?;:*$%&#|"  # a run of these after a letter is split off by the tokenizer too
# Letters that keep their number of code points in lower case; U+0130 does not.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def chunks_of(column: pa.Array) -> pa.Array:
    """Blank-separated chunks of each text; a text has one at least, if an empty one."""
    return pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")


def parts_of(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``PART_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > PART_BYTES:
            yield column.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(column):
        yield column.slice(start)


class TextCoder:
    """Token ids of whole texts.  ``None`` counts as the empty text.

    Only for tokenizers that treat white space as a mere separator, lower-case letters
    and part letters from other signs (checked at the start).
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        trial = ["Where", "Él", "straße", "x", "le", "***", "b.,"]
        if self._plain([" ".join(trial) + "\n"])[0] != b"".join(self._plain(trial)):
            raise ValueError("this tokenizer does not drop white space")
        if b"".join(self.encode_bytes(trial[:5])) != b"".join(self._plain(trial[:5])):
            raise ValueError("this tokenizer does not split words as expected")

    def _plain(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case Latin word: the pre-tokenizer would pass it on whole."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _kept(self, pieces: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct pieces; what neither generation has is made."""
        out = list(map(self.young.get, pieces))
        missing = []
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = self.old.get(pieces[i])
                if ids is None:
                    missing.append(i)
                else:
                    self.young[pieces[i]] = ids
        for i, ids in zip(missing, make([pieces[i] for i in missing])):
            out[i] = ids
            if len(pieces[i]) <= LONGEST_KEPT:
                self.young[pieces[i]] = ids
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        return out

    def _pieces(self, chunks: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """(ids of words, odd chunks and marks, their sizes one after the other, two of their places for each distinct chunk).

        A chunk of Latin letters and marks is the lower-case word and the marks; few words
        and fewer marks stand behind many chunks.  All others go to the tokenizer whole.
        """
        word = pc.utf8_rtrim(chunks, MARKS)
        latin = pc.match_substring_regex(word, LATIN)
        first = pc.if_else(latin, pc.utf8_lower(word), chunks)
        parts = [first.filter(latin), first.filter(pc.invert(latin)), chunks.filter(latin)]
        low, odd = parts[0].dictionary_encode(), parts[1]
        # What follows the word: as long as the difference in code points.
        cut = pc.subtract(pc.utf8_length(chunks), pc.utf8_length(word)).filter(latin).to_numpy()
        there = np.flatnonzero(cut)
        tails = [c[-k:] for c, k in zip(parts[2].take(pa.array(there)).to_pylist(), cut[there].tolist())]
        marks = sorted(set(tails))
        number = {m: i for i, m in enumerate(marks)}
        each = [
            self._kept(low.dictionary.to_pylist(), lambda words: list(map(self._word, words))),
            self._kept(odd.to_pylist(), self._plain),
            [b"", *self._kept(marks, self._plain)],
        ]
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in each]
        # Two pieces a chunk: the word or the odd chunk, and the marks (or none).
        piece = np.zeros((len(chunks), 2), np.int64)
        plain = latin.to_numpy(zero_copy_only=False)
        piece[plain, 0] = low.indices.to_numpy()
        piece[~plain, 0] = len(each[0]) + np.arange(len(odd))
        tail = np.zeros(len(cut), np.int64)
        tail[there] = [1 + number[t] for t in tails]
        piece[:, 1] = len(each[0]) + len(odd)
        piece[plain, 1] += tail
        return each, np.concatenate(sizes), piece

    def chunk_sizes(self, chunks: pa.Array) -> np.ndarray:
        """Number of ids of distinct chunks."""
        _, sizes, piece = self._pieces(chunks)
        return sizes[piece].sum(axis=1)

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids one after the other) of distinct chunks."""
        each, sizes, piece = self._pieces(chunks)
        flat = np.frombuffer(b"".join(b"".join(x) for x in each), "<u4")
        n, starts = sizes[piece], np.cumsum(sizes) - sizes
        return n.sum(axis=1), flat[runs(starts[piece].ravel(), n.ravel())]

    def _part(self, column: pa.Array) -> list[bytes]:
        split = chunks_of(column)
        coded = split.flatten().dictionary_encode()
        sizes, flat = self.chunk_ids(coded.dictionary)
        index = coded.indices.to_numpy()
        n = sizes[index]
        raw = flat[runs((np.cumsum(sizes) - sizes)[index], n)].tobytes()
        # Every text has a chunk at least, if an empty one.
        cuts = [0, *(4 * np.cumsum(n)[np.cumsum(pc.list_value_length(split).to_numpy()) - 1]).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_column(self, column: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, a part of the column at a time."""
        return map(self._part, parts_of(column))

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        return [raw for part in self.encode_column(pa.array(texts, pa.string())) for raw in part]


@lru_cache(maxsize=2)
def coder(path: str) -> TextCoder:
    """One coder for each worker process."""
    return TextCoder(path)
