"""Whole-text tokenization with a word cache: each distinct word is encoded once by the tokenizers library.

The word-end BPE vocabulary drops white space before it splits, so a text's ids are those of its words
(cut at ASCII white space) in order; tests compare this with encoding the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Splits letters and the ASCII marks that close a word, if any: the vocabulary's splitting pattern takes each run as one.
_TAIL = r"^(?P<stem>[a-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"
#: A run of letters is one word for that pattern.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def strings(words: pa.Array) -> list[str]:
    """A column of words without spaces as Python strings, cut from one string at once."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class WordEncoder:
    """Encodes columns of text; at most ``most`` words stay cached between calls."""

    def __init__(self, path: str, most: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # of an id: it ends a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _learn(self, words: list[str]) -> None:
        """Add words to the cache: runs of letters are encoded many in one call and told apart by word-end ids."""
        flat, sizes = [self.flat], [self.size]
        kind = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32

        def each(part: list[str]) -> None:
            got = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), kind, int(sizes[-1].sum())))

        plain = [w for w in words if _LETTERS.fullmatch(w)]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            got = np.fromiter(ids, kind, len(ids))
            stop = np.flatnonzero(self.last[got]) + 1
            if len(stop) != len(part):
                each(part)
            else:
                flat.append(got)
                sizes.append(np.diff(stop, prepend=0))
        known = set(plain)
        rest = [w for w in words if w not in known]
        each(rest)
        self.at.update(zip(plain + rest, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.flat, self.size = np.concatenate(flat), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array, sentences: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Ids of all texts, each text's offsets, and with ``sentences`` where the sentences end (in ids).

        Null and empty texts have no ids.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        wo = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        enc = split.flatten().dictionary_encode()
        code, words = np.asarray(enc.indices, np.int64), pc.ascii_lower(enc.dictionary)
        cut = pc.extract_regex(words, _TAIL)
        stems = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "stem")), words).dictionary_encode()
        marks = pc.coalesce(pc.struct_field(cut, "mark"), pa.scalar("")).dictionary_encode()
        keys = strings(stems.dictionary)
        both = keys + strings(marks.dictionary)
        if len(self.at) > self.most:
            self._clear()
        if new := list(dict.fromkeys(w for w in both if w not in self.at)):
            self._learn(new)
        place = np.fromiter(map(self.at.__getitem__, both), np.int64, len(both))
        a, b = place[np.asarray(stems.indices, np.int64)], place[len(keys) + np.asarray(marks.indices, np.int64)]
        pair = np.stack([a, b], 1)[code].ravel()  # a word is its stem and its mark
        n = self.size[pair]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.arange(total) - np.repeat(end - n - self.start[pair], n)].astype(np.uint32)
        ends = np.concatenate([[0], end[1::2]])
        stops = None
        if sentences:
            full = np.asarray(pc.match_substring_regex(words, r"[.!?]['\")\]]*$"), bool) if len(words) else np.zeros(0, bool)
            stops = ends[1:][full[code]] if len(code) else np.zeros(0, np.int64)
            stops = stops[np.diff(stops, prepend=-1) > 0]  # ascending already
        return ids, ends[wo], stops


_held: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
