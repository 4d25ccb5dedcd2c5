"""Whole texts to token ids with a ``tokenizers`` vocabulary, encoding every distinct word once.

Both public vocabularies begin a new pre-token where white space follows a word, and part a letter run from
the mark behind it, so a text's ids are the ids of its words in a row. Words are dictionary-encoded and looked up in
Arrow, and only words that an encoder's memo, bounded in bytes, does not hold go through the library. Texts in which the
split could differ (runs of white space, special tokens) are encoded whole. A worker keeps one encoder, whose memo stays
within ``MEMO_BYTES``.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Bytes of the memo (words, their ids and places); beyond that it starts anew with the words of the batch at hand.
MEMO_BYTES = 32 << 20
#: Bytes of text and rows for which :meth:`Encoder.encode` is best called: large, as words are looked up once a call.
CALL_BYTES, CALL_ROWS = 8 << 20, 10_000
#: Marks behind a letter or digit are a pre-token of their own (but for apostrophes, which may belong to an ending), and so is
#: a line end; GLUED in front of what follows stands for "no space before".
MARKED, GLUED = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)( |\n|$)", "\x01"
#: Runs of Latin letters of which normalisation changes nothing but their case, and how a byte-level vocabulary spells
#: them: the bytes 0 to 32 and 127 to 160 (and 173) as characters from 256 on, other bytes as themselves.
LATIN = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_SHOWN = [b for b in range(256) if 32 < b < 127 or b > 160 and b != 173]
_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
BYTE_LEVEL = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(256)}
ODD = ("  ", "\n\n", " \n", "\n ", GLUED)


class Encoder:
    """Ids of batches of texts. ``spaced``: a word's ids depend on the space before it (byte-level BPE)."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(map(re.escape, (*ODD, *special)))
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = self._whole([" a"])[0] != self._whole(["a"])[0]
        self.memo_bytes = memo_bytes
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> list[list[int]]:
        """The ids of words. A run of Latin letters is one pre-token, which the library's model can take as it is; the others
        go through all of the library."""
        plain = pc.match_substring_regex(words, LATIN).to_numpy(zero_copy_only=False)
        both, tokenize = words.to_pylist(), self.tokenizer.model.tokenize
        out: list = [None] * len(both)
        for i in np.flatnonzero(plain).tolist():
            w = both[i] if self.spaced else both[i].lower()
            out[i] = [t.id for t in tokenize(w if w.isascii() and w[0] != " " else w.translate(BYTE_LEVEL))]
        rest = np.flatnonzero(~plain).tolist()
        for i, ids in zip(rest, self._whole([both[i] for i in rest])):
            out[i] = ids
        return out

    def _learn(self, words: pa.Array) -> None:
        """Add words (distinct, none of them known) with their ids to the memo."""
        flats, sizes = [self.flat], [self.size]
        for i in range(0, len(words), 20_000):
            ids = self._words(words.slice(i, 20_000))
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flats.append(np.fromiter((x for y in ids for x in y), np.int32, int(sizes[-1].sum())))
        self.words = pa.concat_arrays([self.words, words])
        self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        self.start = (np.cumsum(self.size, dtype=np.int64) - self.size).astype(np.int32)

    def _look(self, words: pa.Array) -> np.ndarray:
        """The words' places in the memo; words may repeat."""
        if self.words.nbytes + self.flat.nbytes + 2 * self.size.nbytes > self.memo_bytes:
            self._clear()
        at, known = pc.index_in(words, value_set=self.words), len(self.words)
        if not at.null_count:
            return at.to_numpy()
        unknown = at.is_null()
        missing = words.filter(unknown).dictionary_encode()
        self._learn(missing.dictionary)
        at = pc.fill_null(at, 0).to_numpy().copy()
        at[unknown.to_numpy(zero_copy_only=False)] = known + missing.indices.to_numpy()
        return at

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (int32) and each text's first position; null counts as empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, self.odd)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", texts) if len(whole) else texts
        parted = pc.replace_substring_regex(plain, MARKED, rf"\1 {GLUED}\2\3")
        lists = pc.split_pattern(pc.replace_substring(parted, "\n", f" \n {GLUED}"), " ")
        at = lists.offsets.to_numpy()
        at = at - at[0]
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        if self.spaced:
            first = at[:-1]  # a text's first word has no space before it
            own, place = np.unique(index[first], return_inverse=True)
            index = index.copy()
            index[first] = len(words) + place
            after = pc.or_(pc.starts_with(words, "\n"), pc.starts_with(words, GLUED))
            words = pa.concat_arrays([pc.if_else(after, words, pc.binary_join_element_wise("", words, " ")), words.take(pa.array(own))])
        places = self._look(pc.utf8_ltrim(words, GLUED))
        # What the library made of odd texts, and the end of each text, go behind the words.
        more = [*map(np.int32, self._whole(texts.take(pa.array(whole)).to_pylist())), np.array([] if end_id is None else [end_id], np.int32)]
        sizes = np.fromiter(map(len, more), np.int32, len(more))
        starts = np.concatenate([self.start[places], (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
        sizes = np.concatenate([self.size[places], sizes])
        if len(whole):
            index = index.copy()
            index[at[:-1][whole]] = len(places) + np.arange(len(whole))  # the one empty word of an emptied text
        ends = at[1:] + np.arange(n)
        parts = np.insert(index, at[1:], len(sizes) - 1)
        took = sizes[parts]
        total = np.cumsum(took, dtype=np.int64)
        ids = np.concatenate([self.flat, *more])[np.repeat(starts[parts] - (total - took), took) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total[ends]])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker; one for another vocabulary takes its place."""
    return Encoder(path)


@functools.lru_cache(maxsize=8)
def vocab_size(path: str) -> int:
    """The ids of a vocabulary, special tokens included; nothing else of it is kept."""
    return Encoder(path).vocab_size


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
