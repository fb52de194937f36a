"""Token counts by overlap resynchronisation.

A text longer than ``CHUNK`` bytes is encoded by the library in chunks that overlap; every chunk's tokens come with offsets
and with the pre-token that they belong to. Two neighbours are spliced at the first place in their overlap where

1. a pre-token begins in both encodings, at a character of which no token before shows a part (one character may become a
   letter and a mark). The pre-tokenizer scans from left to right and decides by what follows alone, so from such a place
   on both encodings must go on alike; and
2. they do: all tokens behind it that both chunks show are equal, ids and offsets.

Tokens near a chunk's end, which the text behind it may change, are never used. While there is no such place, the overlap
is doubled; when it has reached the last splice, as in a long text without any break, all from there to the next white space is
encoded in one call, and what follows begins anew. So no part is encoded more than a few times.

Other texts are encoded word by word, words split at ASCII white space, which no pre-token crosses: known words come from a
bounded memory, new ones are encoded by the library. Many words of letters alone, each one pre-token, go in one call.
What counts as a letter is asked of the library's own normalizer and pre-tokenizer, once for each character.

Cases: null and empty texts have 0 tokens; repeated ids and texts are counted once per row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate
from string import ascii_letters
from unicodedata import combining

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch, byte_values, table, utf8

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Bytes that a worker's memory of words may take, and what a word takes beside its letters; when full, it starts anew.
MEMORY, EACH = 160_000_000, 350
_WHITE = re.compile(r"[ \t\n\r\f\v]")
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of texts under a tokenizer whose tokens don't cross ASCII white space, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # does an id end a pre-token?
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = tuple(t.content.encode() for t in self.library.get_added_tokens_decoder().values())
        self.margin = max(map(len, self.special), default=0) + 2
        self.known: dict[bytes, bytes] = {}
        self.size = 0
        self.letters, self.others = set(ascii_letters), set()  # characters asked about, by what the library takes them for

    def ids(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _is_letter(self, c: str) -> bool:
        """Does the library read a character, in its normal form, as a part of the word before it?"""
        form = self.library.normalizer.normalize_str(c)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(f"\u4e2d{form}.")
        return combining(c) == 0 and [at for _, at in pieces] == [(0, 1 + len(form)), (1 + len(form), 2 + len(form))]

    def one_unit(self, word: bytes) -> bool:
        """Is a word of letters alone, so that it is one pre-token whatever marks or white space follow?"""
        if word.isascii():
            return word.isalpha()
        found = set(word.decode())
        for c in found - self.letters - self.others:
            (self.letters if self._is_letter(c) else self.others).add(c)
        return found <= self.letters

    def forget(self) -> None:
        self.known.clear()
        self.size = 0

    def learn(self, new: set[bytes]) -> None:
        """Add lower-case words to the memory."""
        more = 3 * sum(map(len, new)) + EACH * len(new)
        if self.size + more > MEMORY:
            self.forget()
        self.size += more
        units = set(filter(bytes.isalpha, new))
        marked, plain = {}, set()
        for w in new.difference(units):
            body = w.rstrip(_PUNCTUATION)
            if body and self.one_unit(body):
                units.add(body)
                if len(body) < len(w):  # a word of letters and the marks behind it are two pre-tokens
                    marked[w] = (body, w[len(body) :])
                    plain.add(w[len(body) :])
            else:
                plain.add(w)
        known = self.known
        self._encode_words(list(units.difference(known)), list(plain.difference(known)))
        known.update((w, known[body] + known[mark]) for w, (body, mark) in marked.items())

    def _encode_words(self, units: list[bytes], words: list[bytes]) -> None:
        """A word that is one pre-token has one id that tells its end: many are encoded in one call. Others are encoded one by one."""
        for start in range(0, len(units), 5000):
            part = units[start : start + 5000]
            ids = np.asarray(self.library.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):
                words += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a * 4 : b * 4] for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)), strict=True))
        for start in range(0, len(words), 2000):
            part = words[start : start + 2000]
            for w, e in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of whole texts, of any length; new words of all of them are learnt in few library calls."""
        laid: list[tuple] = []
        new: set[bytes] = set()
        for text in texts:
            low = text.lower()
            if len(text) > CHUNK or any(s in low for s in self.special):
                laid.append((text,))
                continue
            words = low.split()
            ids = list(map(self.known.get, words))
            holes, k = [], -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                holes.append(k)
            new.update(map(words.__getitem__, holes))
            laid.append((ids, holes, words))
        if new:
            self.learn(new)
        for one in laid:
            if len(one) == 1:
                text = one[0].decode()
                yield b"".join(resynchronised(text, self.chunk, margin=self.margin)) if len(one[0]) > CHUNK else self.ids(text)
                continue
            ids, holes, words = one
            for k in holes:
                ids[k] = self.known[words[k]]
            yield b"".join(ids)

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk: ids, begin and end of each token in it, and whether a pre-token begins there."""
        e = self.library.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        unit = np.array([-1 if u is None else u for u in e.word_ids], np.int64)
        begins = np.ones(len(unit), bool)
        begins[1:] = (unit[1:] != unit[:-1]) | (unit[1:] < 0) | (unit[:-1] < 0)
        return np.asarray(e.ids, "<u4"), at[:, 0], at[:, 1], begins


def resynchronised(text: str, encode: Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = 2) -> Iterator[bytes]:
    """The ids of a huge text in pieces, from overlapping chunks.

    ``encode`` gives ids, begins, ends, and where pre-tokens begin, of a chunk. ``margin``: how many
    characters behind a token may still change it.
    """

    def laid(begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and stable begins of text[begin:end], without the tokens that what follows could change."""
        ids, starts, ends, units = encode(text[begin:end])
        n = len(ids)
        if end < len(text):
            heads = np.flatnonzero(units)
            stops = np.append(ends[heads[1:] - 1], end)  # the last pre-token may go on, whatever its end
            late = np.flatnonzero(stops > end - begin - margin)
            n = int(heads[late[0]]) if len(late) else n
        stable = units.copy()
        stable[1:] &= ends[:-1] <= starts[1:]
        return ids[:n], starts[:n] + begin, stable[:n]

    end = min(len(text), chunk)
    ids, starts, stable = laid(0, end)
    done = 0  # the last splice: ids before it have been given, ``ids`` begin there
    while end < len(text):
        back = overlap
        while True:
            begin = end - back
            following = min(len(text), end + chunk)
            if begin <= done:  # as wide as the whole chunk: all up to the next white space, which ends a pre-token, in one call
                gap = _WHITE.search(text, end)
                start, done = done, gap.start() if gap else len(text)
                yield encode(text[start:done])[0].tobytes()
                following = min(len(text), done + chunk)
                ids, starts, stable = laid(done, following)
                break
            new_ids, new_starts, new_stable = laid(begin, following)
            place = _splice(text, (ids, starts, stable), (new_ids, new_starts, new_stable))
            if place:
                yield ids[: place[0]].tobytes()
                ids, starts, stable = new_ids[place[1] :], new_starts[place[1] :], new_stable[place[1] :]
                done = int(starts[0])
                break
            back *= 2
        end = following
    yield ids.tobytes()


def _splice(text: str, left: tuple, right: tuple) -> tuple[int, int] | None:
    """Where (token of the left chunk, token of the right one) both have a stable begin behind which they agree."""
    ids, starts, stable = left
    new_ids, new_starts, new_stable = right
    heads, new_heads = np.flatnonzero(stable), np.flatnonzero(new_stable)
    _, a, b = np.intersect1d(starts[heads], new_starts[new_heads], return_indices=True)
    for i, j in zip(heads[a].tolist(), new_heads[b].tolist(), strict=True):
        n = len(ids) - i
        if combining(text[starts[i]]) == 0 and len(new_ids) - j >= n and np.array_equal(ids[i:], new_ids[j : j + n]) and np.array_equal(starts[i:], new_starts[j : j + n]):
            return i, j
    return None


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder, with its memory, for each worker and vocabulary."""
    return WordEncoder(path)


def encoded(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text."""
    for held in _portions(texts):
        yield from encoder(path).encode(held)


def _portions(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts, some ``size`` bytes at a time."""
    begin = total = 0
    for k, n in enumerate(accumulate(map(len, texts))):
        if n - total > size:
            yield texts[begin : k + 1]
            begin, total = k + 1, n
    yield texts[begin:]


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(byte_values(b.column(1)))
            n = [len(x) // 4 for x in encoded(texts, path)]
            yield pa.RecordBatch.from_arrays([b.column(0), *batch("n_bytes long, n_tokens long, over_limit boolean", [list(map(len, texts)), n, [x > limit for x in n]]).columns], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents", "doc_id", "text"))
