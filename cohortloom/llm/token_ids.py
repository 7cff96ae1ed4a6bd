"""Token ids of whole texts, exactly as the ``tokenizers`` library gives them, at the speed of a cache.

The vocabulary lower-cases a text and cuts it into words, which its merges then turn into ids one by one.
Texts of Latin letters, digits and marks are cut here by the same rule; the merges see each distinct word
once per worker, and its ids are copied to all of its places. All other texts go through the library's
own normaliser and cutter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

# Words known at once in one Python worker; the cache starts anew beyond this many.
CACHE_WORDS = 200_000

# Characters whose class is the same in every Unicode version. Of these, only the ones that the vocabulary's
# normaliser lower-cases to a character of a class below are cut here.
_CANDIDATES = [*"\t\n\r", *map(chr, [*range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028)])]

# How the vocabulary file cuts lower-cased text, with letters and digits spelled out for
# the characters above.
_LETTERS, _DIGITS = "a-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_CUTTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+"


def default_vocabulary() -> str:
    """The word-level vocabulary among the installed public files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_cut = re.compile(_WORDS).findall


class TokenIds:
    """Encoder of one vocabulary file; one instance per Python worker."""

    _known: dict[str, TokenIds] = {}

    @classmethod
    def of(cls, path: str) -> TokenIds:
        """The worker's encoder for ``path``."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.full.model)  # no normaliser, no cutting: words in, ids out
        self.special = [str(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        vocabulary, suffix = self.merges.get_vocab(), getattr(self.merges.model, "end_of_word_suffix", None) or ""
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # letters each id stands for
        self.widths[list(vocabulary.values())] = [len(token.removesuffix(suffix)) for token in vocabulary]
        self.plain = self._plain_text()
        self.forget()

    def _plain_text(self):
        """Tells texts that are cut here; none are, unless the file lower-cases and cuts as stated above."""
        given = json.loads(self.full.to_str())
        steps = (given.get("normalizer") or {}).get("normalizers", [])
        cutters = (given.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        known = [s.get("type") for s in steps] == _NORMALISERS and cutters[0].get("pattern") == {"Regex": _CUTTER}
        if not known or cutters[0].get("behavior") != "Removed" or not cutters[0].get("invert"):
            return lambda text: False
        classes = {"L": re.compile(f"[{_LETTERS}]"), "N": re.compile(f"[{_DIGITS}]")}
        kept = []
        for char in _CANDIDATES:
            low = char.lower()
            kind = unicodedata.category(low)[0] if len(low) == 1 else ""
            same = all(bool(c.fullmatch(low)) == (kind == name) for name, c in classes.items())
            if kind and same and (low.isspace() or self.full.normalizer.normalize_str(char) == low):
                kept.append(char)
        return re.compile(f"[{re.escape(''.join(kept))}]*").fullmatch

    def forget(self) -> None:
        """Empty the cache, also at the end of a task: a worker goes on to other stages, which need its memory."""
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)  # ids of all words, one after the other
        self.starts = np.zeros(1, np.int32)  # word number to its place in flat; one more at the end

    def _keep(self, words: set[str]) -> None:
        """Make room in a full cache: of the words known so far, only those of the present texts stay."""
        kept = [w for w in words if w in self.numbers]
        number = np.fromiter(map(self.numbers.__getitem__, kept), np.int32, len(kept))
        begin, count = self.starts[number], self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(count, dtype=np.int32)
        self.flat = self.flat[np.repeat(begin - (ends - count), count) + np.arange(int(count.sum()))]
        self.starts = np.concatenate([np.zeros(1, np.int32), ends])
        self.numbers = dict(zip(kept, range(len(kept))))

    def _learn(self, words: list[str]) -> None:
        """Take words not seen before through the merges and append them to the tables."""
        letters = self.letters
        shown = [w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in words]
        ids, counts = self._merged(shown)
        first = len(self.numbers)
        self.numbers.update(zip(words, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts, dtype=np.int32)])

    def _merged(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has, told by the letters that the ids stand for.

        The quick call of the library does not say which id is of which word. Should the letters of the ids not
        end where each word ends, its other call says so.
        """
        done = self.merges.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(done.ids, np.uint32)
        reached = np.cumsum(self.widths[ids])
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
        upto = np.searchsorted(reached, ends, "right")
        if len(ids) and upto[-1] == len(ids) and upto[0] > 0 and np.array_equal(reached[upto - 1], ends):
            return ids, np.diff(upto, prepend=0)
        done = self.merges.encode(shown, is_pretokenized=True, add_special_tokens=False)
        return np.array(done.ids, np.uint32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(shown))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has; null counts as empty."""
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.plain(text) and not ("<|" in text and any(s in text for s in self.special)):
                cut = _cut(text.lower())
                sizes[i] = len(cut)
                words += cut
            else:
                odd.append(i)
        distinct = set(words)
        fresh = list(distinct.difference(self.numbers))
        if len(self.numbers) + len(fresh) > CACHE_WORDS:
            self._keep(distinct)
        if fresh:
            self._learn(fresh)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        begin = self.starts[number]
        count = self.starts[number + 1] - begin
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(count, dtype=np.int32)])
        ids = self.flat[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1], dtype=np.int32)]
        lengths = np.diff(ends[np.cumsum(sizes)], prepend=0).astype(np.int64)
        return self._with_odd(texts, odd, ids, lengths) if odd else (ids, lengths)

    def _with_odd(self, texts, odd: list[int], ids: np.ndarray, lengths: np.ndarray):
        """Insert the texts that only the library's full path can cut."""
        found = self.full.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i, encoded in zip(odd, found):
            parts[i] = np.array(encoded.ids, np.uint32)
            lengths[i] = len(parts[i])
        return np.concatenate(parts), lengths


def batches(texts: Sequence[str | None], limit: int = 2_000_000):
    """Ranges of consecutive texts with about ``limit`` characters, one longer text being alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text) if text else 0
        if i > first and size + length > limit:
            yield first, i
            first, size = i, 0
        size += length
    if first < len(texts):
        yield first, len(texts)
