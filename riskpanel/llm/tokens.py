"""Batch encoding with the tokenizers library, each distinct chunk of text once.

Both vocabularies pre-tokenize at white space: no token spans a single blank or line break
between other characters. Texts are therefore cut into chunks there (by Arrow, a batch at a
time), every distinct chunk is encoded by the library once (a bounded cache per Python
worker), and a text's ids are the concatenation. Texts with other white space (runs of blanks,
tabs, no-break spaces, ...), the separator character itself or a special token's string are encoded
whole, so ids never depend on the cutting.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

from .common import held, ranges

#: White space other than a blank and a line break, the separator, and blanks and line breaks that
#: aren't single ones between other characters.
ODD = r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]" \
      r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Letters of Latin-1, and the ASCII marks that may follow them. An apostrophe is none: 's and the like are pre-tokens.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A chunk of a word: perhaps a line break or the sign of a text's first word, then letters, then perhaps marks.
WORD = rf"\A[\n\x00]?[{LETTERS}]+[{re.escape(MARKS)}]*\z"
#: What the cache holds of such a chunk.
KEY = rf"\A\x00?[{LETTERS}]+\z"


class ChunkEncoder:
    """``encode`` gives the ids of many texts. ``blanks``: the vocabulary keeps white space
    (a blank belongs to the word after it, a line break is a token of its own); else it drops it."""

    def __init__(self, path: str, blanks: bool, cache: int = 300_000, plain_specials: bool = False):
        import pyarrow as pa
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pa.set_memory_pool(pa.system_memory_pool())  # gives a batch's memory back, unlike Arrow's default pool
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # a special token's string in a text is that token, as the library's encode has it, or ordinary text if asked for
        self.tokenizer.encode_special_tokens = plain_specials
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.blanks, self.cache, self.model = blanks, cache, self.tokenizer.model
        # how the library writes the letters of Latin-1 for its model, and a blank before them
        self.spelt = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS})
        self.blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1] if blanks else ""
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() < 65536 else np.uint32), 0
        self.starts, self.lengths, self.again = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        """Drop the keys that no batch has asked for again since the last time: most words of a large corpus occur once."""
        kept = np.flatnonzero(self.again[:len(self.index)])
        names, flat = list(self.index), self.flat[ranges(self.starts[kept], self.lengths[kept])]
        self.index = {names[i]: j for j, i in enumerate(kept.tolist())}
        self.flat[:len(flat)], self.used = flat, len(flat)
        n = self.lengths[kept]
        self.lengths[:len(kept)], self.starts[:len(kept)], self.again[:] = n, np.cumsum(n) - n, False

    def _text_of(self, key: str) -> str:
        """Keys of the cache: a word stands for itself after a blank, ``\\n`` + word for a line's first
        word with the break before it, ``\\0`` + word for one with nothing before it."""
        return key[1:] if key[:1] == "\x00" else " " + key if self.blanks and key[:1] != "\n" else key

    def _model_ids(self, words: list[str], before: str) -> list[list[int]]:
        """Ids of words of letters by the library's model. They are spelt as the library spells them for it, all in one string."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(before + w)] for w in "\n".join(words).translate(self.spelt).split("\n")] if words else []

    def _learn(self, keys) -> np.ndarray:
        """Add an Arrow array of keys to the cache; their places in it. Words of Latin-1 letters are always one pre-token, so the
        library's model gives their ids directly; those of ASCII alone are kept apart, since they are spelt faster."""
        import pyarrow.compute as pc
        plain, bare, ascii_ = (x.to_numpy(zero_copy_only=False) for x in (
            pc.match_substring_regex(keys, KEY), pc.starts_with(keys, "\x00"), pc.string_is_ascii(keys)))
        kinds = [np.flatnonzero(k) for k in (plain & ~bare & ascii_, plain & ~bare & ~ascii_, plain & bare, ~plain)]
        words = [_strings(keys.take(k)) for k in kinds]
        got = self._model_ids(words[0], self.blank) + self._model_ids(words[1], self.blank) + self._model_ids([w[1:] for w in words[2]], "")
        got += [e.ids for e in self.tokenizer.encode_batch_fast([self._text_of(k) for k in words[3]], add_special_tokens=False)]
        names = list(chain.from_iterable(words))
        n = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), self.flat.dtype, int(n.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        first, last = len(self.index), len(self.index) + len(names)
        while last > len(self.starts):
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[first:last] = self.used + np.cumsum(n) - n
        self.lengths[first:last] = n
        self.used += len(ids)
        self.index.update(zip(names, range(first, last)))
        places = np.empty(len(names), np.int64)
        places[np.concatenate(kinds)] = np.arange(first, last)
        return places

    def _ids_of(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of an Arrow array of distinct chunks. A line break before a word of letters and marks after it are pre-tokens
        of their own, so the cache has the word once, in lower case where the vocabulary folds case, and the marks once."""
        import pyarrow as pa
        import pyarrow.compute as pc
        plain = pc.match_substring_regex(words, WORD)
        bare = pc.utf8_rtrim(words, characters=MARKS)
        marked = np.flatnonzero(pc.and_(plain, pc.not_equal(pc.binary_length(bare), pc.binary_length(words))).to_numpy(zero_copy_only=False))
        marks = pc.binary_join_element_wise("\x00", pc.utf8_ltrim(words.take(pa.array(marked)), characters="\n\x00" + LETTERS), "")
        if self.blanks:
            broken = pc.and_(plain, pc.starts_with(words, "\n"))
            bare = pc.if_else(broken, pc.replace_substring(bare, "\n", "\x00", max_replacements=1), bare)
            broken = np.flatnonzero(broken.to_numpy(zero_copy_only=False))
        else:
            bare, broken = pc.utf8_lower(bare), marked[:0]
        parts = [pc.if_else(plain, bare, words), marks, *[pa.array(["\n"])] * bool(len(broken))]
        keys = pa.concat_arrays(parts).dictionary_encode()
        if len(self.index) > self.cache:
            self._forget()
        found = np.fromiter(map(self.index.get, _strings(keys.dictionary), repeat(-1)), np.int64, len(keys.dictionary))
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new):
            found[new] = self._learn(keys.dictionary.take(pa.array(new)))
        at = found[keys.indices.to_numpy(zero_copy_only=False)]
        # up to three pieces of a chunk, side by side: the line break, the word, the marks
        place, n = np.zeros((len(words), 3), np.int64), np.zeros((len(words), 3), np.int64)
        place[:, 1], place[marked, 2] = at[:len(words)], at[len(words):len(words) + len(marked)]
        n[:, 1], n[marked, 2] = self.lengths[place[:, 1]], self.lengths[place[marked, 2]]
        if len(broken):
            place[broken, 0], n[broken, 0] = at[-1], self.lengths[at[-1]]
        whole = n.sum(axis=1)
        ids = self.flat[ranges(self.starts[place.ravel()], n.ravel())]
        return ids, np.cumsum(whole) - whole, whole

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text). ``texts``: list
        or Arrow array of strings; null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        if self.special:  # lower case too: a vocabulary may fold it first
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.special, ignore_case=True))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            texts, kept = pc.if_else(odd, "", texts), texts
        if self.blanks:
            cut = pc.replace_substring(pc.binary_join_element_wise("\x00", texts, ""), "\n", " \n")
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(cut, " ")
        chunks = parts.flatten().dictionary_encode()
        flat, first, size = self._ids_of(chunks.dictionary)
        which = chunks.indices.to_numpy(zero_copy_only=False)
        lengths = size[which]
        ids = flat[ranges(first[which], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        edge = parts.offsets.to_numpy().astype(np.int64)
        n = ends[edge[1:] - edge[0]] - ends[edge[:-1] - edge[0]]
        if len(whole):
            encoded = self.tokenizer.encode_batch_fast(pc.take(kept, pa.array(whole)).to_pylist(), add_special_tokens=False)
            pieces = np.split(ids, np.cumsum(n)[:-1])
            for i, e in zip(whole.tolist(), encoded):
                pieces[i], n[i] = np.array(e.ids, ids.dtype), len(e.ids)
            ids = np.concatenate(pieces)
        return ids, n


def _strings(array) -> list[str]:
    """The strings of an Arrow array, several times faster than its own to_pylist."""
    return array.to_numpy(zero_copy_only=False).tolist()


def encoder(path: str, blanks: bool, cache: int = 300_000) -> ChunkEncoder:
    """The worker's own encoder: its cache serves all tasks that this worker runs."""
    return held(f"encoder {path}", lambda: ChunkEncoder(path, blanks, cache))


def slices(texts, most: int = 4_000_000):
    """(first, last) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(size):
        before = int(size[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + most, side="right")))
        yield first, last
        first = last
