"""Whole texts to token ids, exactly as the tokenizers library gives them.

Most pre-tokens of a corpus come again and again, so each worker keeps the ids of
the pre-tokens that it has met and merges only new ones. The split into pre-tokens
is done here for texts whose characters have settled Unicode classes; any other
text goes to the library whole.

New pre-tokens are merged by rank (tiktoken) instead of by the list of pairs. That
is exact for a table that holds only tokens whose own symbols, merged alone, end as
that one token: as long as no merge has crossed the borders of a stretch, what
happened inside is what happens to the stretch alone, so the two parts that meet
there are the listed pair. A token that fails this proof never arises and is left
out of the table.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import unicodedata

import numpy as np

#: Pre-tokens that a worker remembers; when there are so many, those met since the time before stay and the others go.
REMEMBERED = 100_000
LONGEST = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> tuple[str, str, str, str]:
    """Character classes for letters, numbers and all safe characters below U+0250, and safe punctuation."""
    letters, numbers, safe = [], [], []
    for c in [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        x = chr(c)
        if c == 0x130 or unicodedata.normalize("NFC", x) != x or len(x.lower()) != 1:
            continue
        safe.append(x)
        kind = unicodedata.category(x)[0]
        if kind == "L":
            letters.append(x)
        elif kind == "N":
            numbers.append(x)
    pack = lambda xs: "".join(re.escape(x) for x in xs)
    return pack(letters), pack(numbers), pack(safe)


_L, _N, _SAFE = _classes()
_SPACE = " \\t\\n\\r"
_SAFE_TEXT = re.compile(f"[{_SAFE}{_SPACE}]*")
_BYTE_SPLIT = re.compile(f" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BYTE_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \t\n\rA-Za-z0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_WORD_SPLIT = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_L}{_N}]+")
_WORD_ASCII = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\ra-z0-9]+")
_ASCII_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def proven_tokens(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Byte strings to merge ranks, and the vocabulary id of each rank, of a BPE model's proven tokens.

    With an end-of-word suffix, byte 0, which no safe text holds, marks the end of a word.
    """
    end = model.get("end_of_word_suffix") or ""
    vocab, byte_of = model["vocab"], {c: b for b, c in _byte_letters().items()}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    order = {pair: k for k, pair in enumerate(merges)}

    def raw(token: str) -> bytes:
        stem, mark = (token[: -len(end)], b"\0") if end and token.endswith(end) else (token, b"")
        return bytes(byte_of[c] for c in stem) + mark

    def alone(token: str) -> bool:
        stem = token[: -len(end)] if end and token.endswith(end) else token
        parts = [*stem]
        if stem != token:
            parts[-1] += end
        while len(parts) > 1:
            k, at = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if k == len(order):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    for b, c in sorted(_byte_letters().items()):
        ranks[bytes([b])] = len(ids)
        ids.append(vocab[c])
    if end:
        for b, c in sorted(_byte_letters().items()):
            if b:
                ranks[bytes([b, 0])] = len(ids)
                ids.append(vocab[c + end])
    for x, y in merges:
        if (x + y) in vocab and alone(x + y) and raw(x + y) not in ranks:
            ranks[raw(x + y)] = len(ids)
            ids.append(vocab[x + y])
    return ranks, np.array(ids, "<u4")


def _without_gc(method):
    """Let the collector of cycles rest: the lists of words that are made here have none, and it would walk them all."""

    @functools.wraps(method)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return method(*args)
        finally:
            if on:
                gc.enable()

    return run


class Bpe:
    """A tokenizer file of the tokenizers library with the shortcuts above."""

    def __init__(self, path: str, remembered: int | None = None):
        self.remembered = remembered or REMEMBERED
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        import tiktoken

        self.tokenizer = Tokenizer.from_file(path)
        self.word_ends = bool(self.tokenizer.normalizer)
        with open(path, encoding="utf-8") as f:
            self._ranks, ids = proven_tokens(json.load(f)["model"])
        self._id_of = ids
        split = r"[^\x00\x01]+\x00|\x01" if self.word_ends else r"[^\x00\x01]+|\x01"
        self._merge = tiktoken.Encoding("proven", pat_str=split, mergeable_ranks=self._ranks, special_tokens={}).encode_ordinary
        self._ids: dict[str, bytes] = {}
        self._ids_before: dict[str, bytes] = {}
        self._counts_before: dict[str, int] = {}

    def _merged(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of the pre-tokens of all groups, one after the other, and where each group ends."""
        end = "\0\1" if self.word_ends else "\1"
        ranks = np.array(self._merge(end.join(["\0".join(g) for g in groups]) + end), "<u4")
        ends = np.flatnonzero(ranks == 1)
        return np.delete(ranks, ends), ends - np.arange(len(ends))

    def chunks(self, text: str) -> list[str] | None:
        """The text cut at places where pre-tokens end for certain; None: the library must split it."""
        if "<|" in text:
            return None
        if text.isascii():
            if _ASCII_ODD.search(text):
                return None
        elif not _SAFE_TEXT.fullmatch(text):
            return None
        if self.word_ends:
            return text.lower().split()
        if "\t" in text or "\r" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return _split(text, False)
        return text.replace("\n", " \n ").replace(" ", "\0 ").replace("\0 \n\0 ", "\0\n\0").split("\0")

    def _learn(self, known: dict, fixed: dict, before: dict, cut: list[list[str] | None], make) -> None:
        """See that ``known`` has every chunk of a few texts; what is in ``before`` need not be made again."""
        met = set().union(*(x for x in cut if x))
        new = met.difference(known)
        if len(known) + len(new) > self.remembered + len(fixed):
            before.clear()
            before.update(known)
            known.clear()
            known.update(fixed)
            new = met.difference(known)
        if new and before:
            back = [x for x in new if x in before]
            known.update(zip(back, map(before.__getitem__, back), strict=True))
            new.difference_update(back)
        if new:
            known.update(zip(new, make([_split(x, self.word_ends) for x in new]), strict=True))

    def _ids_of(self, groups: list[list[str]]) -> list[bytes]:
        ranks, ends = self._merged(groups)
        raw, at = self._id_of[ranks].tobytes(), [0, *(4 * ends).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]

    def _counts_of(self, groups: list[list[str]]) -> list[int]:
        """Whole tokens count as one each; only the other pre-tokens are merged."""
        whole = self.whole_tokens
        rest = [[x for x in g if x not in whole] for g in groups]
        _, ends = self._merged(rest)
        merged = np.diff(ends, prepend=0).tolist()
        return [len(g) - len(r) + n for g, r, n in zip(groups, rest, merged, strict=True)]

    @_without_gc
    def encode_all(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as little-endian unsigned 32-bit bytes."""
        cut = [self.chunks(x) for x in texts]
        self._learn(self._ids, {}, self._ids_before, cut, self._ids_of)
        of = self._ids.__getitem__
        return [self._whole(x) if c is None else b"".join(map(of, c)) for x, c in zip(texts, cut, strict=True)]

    @_without_gc
    def count_all(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        cut = [self.chunks(x) for x in texts]
        self._learn(self._counts, self._ones, self._counts_before, cut, self._counts_of)
        of = self._counts.__getitem__
        return [len(self._whole(x)) // 4 if c is None else sum(map(of, c)) for x, c in zip(texts, cut, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @functools.cached_property
    def whole_tokens(self) -> frozenset[str]:
        """The strings that, as one pre-token, prove to be one token."""
        mark = b"\0" if self.word_ends else b""
        found = set()
        for raw in self._ranks:
            if raw.endswith(mark) and len(raw) > len(mark):
                try:
                    text = raw[: len(raw) - len(mark)].decode()
                except UnicodeDecodeError:
                    continue
                if _split(text, self.word_ends) == [text] and self.chunks(text) is not None:
                    found.add(text)
        return frozenset(found)

    @functools.cached_property
    def _ones(self) -> dict[str, int]:
        return dict.fromkeys(self.whole_tokens, 1)

    @functools.cached_property
    def _counts(self) -> dict[str, int]:
        return dict(self._ones)


def _split(text: str, word_ends: bool) -> list[str]:
    """The pre-tokens of a text of safe characters."""
    if text.isascii():
        # most chunks are one word, which the patterns would return as it is
        if (text if word_ends or text[:1] != " " else text[1:]).isalpha() and (not word_ends or text.islower()):
            return [text]
        return (_WORD_ASCII if word_ends else _BYTE_ASCII).findall(text)
    return (_WORD_SPLIT if word_ends else _BYTE_SPLIT).findall(text)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def load(path: str, remembered: int | None = None) -> Bpe:
    """The tokenizer at ``path``, once for each worker process; ``remembered`` pre-tokens instead of ``REMEMBERED``."""
    return Bpe(path, remembered)
