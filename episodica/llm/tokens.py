"""Token ids of whole texts, remembering the ids of words that come again."""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

#: Two runs of white space that meet, or the mark that is used here: such texts are encoded in one piece.
_UNSAFE = r"[\s\x0b\x{85}\p{Z}]{2}|\x00"
#: Latin letters that each have one lower-case form, and are composed already.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_MARKS = string.punctuation
_CODERS: dict[tuple[str, bool, int], WordCoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


class WordCoder:
    """Ids of texts by a file of the ``tokenizers`` library, each as little-endian unsigned 32-bit bytes.

    Both kinds of file split a text before they merge bytes, and never merge across a space
    between words. So a text's ids are those of its words, laid end to end:

    * byte-level files put a space in front of the word that follows it, hence a cut before a
      single space, and around a single line feed, changes nothing;
    * word-end files (``spaced=False``) drop white space, hence a cut at any space or line feed changes nothing.

    Words that were met before are looked up. Two generations of at most ``keep`` words bound the memory. A
    letter and the marks at a word's end are never merged, so the marks are looked up by themselves.

    Added tokens (such as an end mark) are found in the text by the library before it splits it; a text that has one is given to the
    library whole.
    """

    def __init__(self, path: str, spaced: bool, keep: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that aren't cut into words: with two runs of white space that meet, or with an added token anywhere, in any case.
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([*([_UNSAFE] if spaced else []), *(f"(?i:{x})" for x in added)])
        self.spaced, self.keep = spaced, keep
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _new(self, texts: list[str]) -> list[bytes]:
        """Ids of new words. One of plain letters is a single piece for the model, which then needs no normaliser or splitter."""
        found: list[bytes] = [b""] * len(texts)
        other = []
        merge = self.tokenizer.model.tokenize
        for i, w in enumerate(texts):
            if _PLAIN.fullmatch(w, w[0] == " " and self.spaced):
                w = w if self.spaced else w.lower()
                piece = w.replace(" ", _BYTES[32]) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
                found[i] = array("I", [x.id for x in merge(piece)]).tobytes()
            else:
                other.append(i)
        for i, x in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = array("I", x.ids).tobytes()
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        late, unknown = [], {}
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            stem = w.rstrip(_MARKS)
            parts = (stem, w[len(stem) :]) if stem != w and stem[-1:] in _LETTERS and stem else (w,)
            for part in parts:
                if part not in young:
                    if (ids := old.get(part)) is not None:
                        young[part] = ids
                    else:
                        unknown[part] = None
            late.append((i, parts))
        if unknown:
            fresh = list(unknown)
            young.update(zip(fresh, self._new(fresh), strict=True))
        for i, parts in late:
            found[i] = b"".join([young[x] for x in parts])
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """A binary array: the ids of each text; of a null, none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = None
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)) if self.whole else np.empty(0, np.int64)
        if len(unsafe):
            whole = dict(zip(unsafe.tolist(), self._new(texts.take(pa.array(unsafe)).to_pylist()), strict=True))
            mask = np.zeros(len(texts), bool)
            mask[unsafe] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts)
        if self.spaced:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
            words = pc.split_pattern(texts, "\0")
        else:
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        values = pa.array(self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids = pa.LargeListArray.from_arrays(words.offsets.cast(pa.int64()), values.take(coded.indices))
        joined = pc.binary_join(ids, pa.scalar(b"", pa.large_binary()))
        if whole:
            joined = pa.array([whole.get(i, x) for i, x in enumerate(joined.to_pylist())], pa.large_binary())
        return joined


def coder(file: str, spaced: bool, keep: int = 300_000) -> WordCoder:
    """This worker's coder for one of the public vocabulary files."""
    key = (file, spaced, keep)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(file if os.path.isabs(file) else public_tokenizers.path(file), spaced, keep)
    return _CODERS[key]


def ids_of(joined: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary array laid end to end, the end id after each text's; and where each text begins."""
    n = len(joined)
    bounds = np.frombuffer(joined.buffers()[1], np.int64, n + 1, joined.offset * 8)
    flat = np.frombuffer(joined.buffers()[2] or b"", "<u4", (bounds[-1] - bounds[0]) // 4, bounds[0])
    bounds = (bounds - bounds[0]) // 4
    out = np.full(len(flat) + n, end_id, "<u4")
    mask = np.ones(len(out), bool)
    mask[bounds[1:] + np.arange(n)] = False
    out[mask] = flat
    return out, bounds + np.arange(n + 1)
