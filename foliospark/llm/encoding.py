"""Exact, quick use of the tokenizers library: memoised on white-space chunks, or by ranks (below).

Both public vocabularies split a text into words before merging, and no word crosses the chunk borders used
here, so the ids of a text are the ids of its chunks in order. A chunk is encoded by the library once per
worker and then looked up; a text for which chunks are not provably independent goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Chunks in a worker's memo; a full memo becomes the old one, from which used chunks come back (both some 250 MB).
MEMO_SIZE = 600_000
#: Texts encoded together hold about so many characters.
GROUP_CHARS = 400_000
#: Where lower-casing and NFC are not plainly the ones of str.lower, or str.split differs from ``\s``.
_ODD = re.compile("[\x1c-\x1fİ̀-\U0010ffff]")

#: In the memo, for a chunk whose text must go to the library whole; no ids are these bytes, as each has four.
WHOLE = b"whole"
#: Stops, and a chunk of at most a line break, a space, a word and stops, which are words of their own.
_STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile("(\n?)( ?)([A-Za-zÀ-ÖØ-öø-ɏ]{1,64})([,.!?;:]{0,4})")


def vocabulary(name: str) -> str:
    """The content of a public tokenizer file; small (under 2 MB), so tasks may carry it."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def load(content: str) -> Tokenizer:
    """The tokenizer as in its file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_str(content)
    tok.no_truncation()
    tok.no_padding()
    return tok


class ChunkEncoder:
    """Texts to little-endian unsigned 32-bit ids, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, content: str):
        self.tok = load(content)
        self.drops_space = self.tok.normalizer is not None  # the word-level vocabulary; the other is byte-level
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.four = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.letters = byte_letters()

    def chunks(self, text: str) -> list[str] | None:
        """Independent chunks of a text, or None if the whole text must go to the library.

        Byte-level: a chunk keeps its leading space, since a space belongs to the word after it; a line break
        opens a chunk of its own. Wherever white space meets white space, the text goes to the library.
        """
        if any(s in text for s in self.special):
            return None
        if self.drops_space:
            return None if _ODD.search(text) else text.lower().split()
        parts = text.replace("\n", " \n").split(" ")
        out = [x if x[:1] == "\n" else f" {x}" for x in parts]
        out[0] = parts[0]
        return out

    def _fill(self, missing: list[str]) -> None:
        """Encode chunks that the memo lacks; a word and the stops after it apart."""
        (self._fill_words if self.drops_space else self._fill_spaced)(missing)

    def _fill_words(self, missing: list[str]) -> None:
        """Here letters are a word and a run of stops is another, whatever stands beside them. Words of plain letters
        need no normalizing or splitting, so the library's model gets them at once."""
        memo, parts, four, tokenize, other = self.memo, self.parts, self.four, self.tok.model.tokenize, []
        for c in missing:
            word = c.rstrip(_STOPS)
            if not word.isalpha() or len(word) > 64:
                other.append(c)
                continue
            ids = memo.get(word)
            if ids is None:
                letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                ids = memo[word] = b"".join([four[t.id] for t in tokenize(letters)])
            if len(c) > len(word):
                stop = c[len(word) :]
                if stop not in parts:
                    self._part(stop)
                memo[c] = ids + parts[stop]
        for c, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[c] = np.asarray(e.ids, "<u4").tobytes()

    def _part(self, stop: str) -> None:
        if len(self.parts) > MEMO_SIZE:
            self.parts.clear()
        self.parts[stop] = np.asarray(self.tok.encode(stop, add_special_tokens=False).ids, "<u4").tobytes()

    def _fill_spaced(self, missing: list[str]) -> None:
        memo, other, plain = self.memo, [], []
        for c in missing:
            if m := _WORD.fullmatch(c):
                plain.append((c, *m.groups()))
            else:
                other.append(c)
        for spaced in (False, True):
            fresh = list({word for _, _, space, word, _ in plain if bool(space) == spaced and f"{space}{word}" not in memo})
            gap = " " if spaced else "\n"
            e = self.tok.encode((gap if spaced else "") + gap.join(fresh), add_special_tokens=False)
            ids, of = np.asarray(e.ids, "<u4"), np.asarray(e.word_ids, np.int64)
            if gap == "\n":  # the line breaks between are words too
                of = np.where(of % 2 == 0, of // 2, -1)
                ids, of = ids[of >= 0], of[of >= 0]
            ends = np.searchsorted(of, np.arange(len(fresh)), "right").tolist()
            at, raw = 0, ids.tobytes()
            for word, end in zip(fresh, ends, strict=True):
                memo[f" {word}" if spaced else word] = raw[4 * at : 4 * end]
                at = end
        for x in {x for _, line, _, _, stop in plain for x in ("", line, stop)} - self.parts.keys():
            self._part(x)
        for c, line, space, word, stop in plain:
            memo[c] = self.parts[line] + memo[f"{space}{word}"] + self.parts[stop]
        for c, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[c] = np.asarray(e.ids, "<u4").tobytes()
        for c in other:  # a chunk that ends with white space, or has it twice in front, depends on its neighbours
            if c[-1:].isspace() or c[:2].isspace() and len(c) > 1 or c == "":
                memo[c] = WHOLE

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        self._know(set().union(*(c for c in cut if c is not None)))
        out = []
        for text, c in zip(texts, cut, strict=True):
            ids = None
            if not text:
                ids = b""
            elif c is not None:
                got = list(map(self.memo.__getitem__, c))
                if self.drops_space or WHOLE not in got:
                    ids = b"".join(got)
            if ids is None:
                ids = np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            out.append(ids)
        return out

    def _know(self, chunks: set[str]) -> None:
        """Afterwards the memo holds all these chunks."""
        missing = chunks.difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_SIZE and self.memo:
            self.old, self.memo, missing = self.memo, {}, chunks
        known = self.old.keys() & missing
        self.memo.update((c, self.old[c]) for c in known)
        if fresh := missing - known:
            self._fill(list(fresh))


def byte_letters() -> list[str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones are themselves, the others follow
    from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


#: What a byte-level vocabulary splits at, as its kind does by default.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts that go to the library itself: letters whose class depends on the version of Unicode, and very long words.
_RARE = re.compile("[Ͱ-\U0010ffff]|[^\\s]{4000}|\\s{4000}")


class RankEncoder:
    """As ChunkEncoder for byte-level vocabularies whose ids follow the order of their merges: tiktoken merges the same
    pairs, by rank, in a quarter of the time. A text with a special token or rare letters goes to the tokenizers
    library."""

    def __init__(self, content: str):
        self.tok = load(content)
        bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in json.loads(content)["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def fits(content: str) -> bool:
        spec = json.loads(content)
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            return False
        model = spec["model"]
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        return made == sorted(made) and not model.get("ignore_merges") and not model.get("end_of_word_suffix")

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if _RARE.search(text) or any(s in text for s in self.special):
                ids = self.tok.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(array("I", ids).tobytes())
        return out


Encoder = ChunkEncoder | RankEncoder
_encoders: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """This worker's encoder for a vocabulary; its memo lives as long as the worker."""
    if content not in _encoders:
        _encoders[content] = RankEncoder(content) if RankEncoder.fits(content) else ChunkEncoder(content)
    return _encoders[content]


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded total length, with the index of the first; null becomes empty."""
    start, total, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        run.append(t)
        total += len(t)
        if total >= GROUP_CHARS:
            yield start, run
            start, total, run = i + 1, 0, []
    if run:
        yield start, run
