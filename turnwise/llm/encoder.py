"""Encoding in executors' Python workers by the tokenizers library, with each piece encoded once.

A byte-level tokenizer cuts a text by its pattern and merges within the pieces only, so a text's ids are
those of its pieces, one after the other. ``PieceEncoder`` keeps the ids of pieces in a bounded memo of
the worker and hands only new ones to the library, most of them joined to one long text whose ids are
cut up again by the lengths of their bytes. Plain texts (Latin-1, single white space, no apostrophe) are
cut into pieces by numpy over many texts at once. Pieces are told apart by their bytes, in the memo and
within a slice of texts; hashes only sort them. Texts that hold a special token or a character beyond
Latin-1 (where Unicode tables of two libraries might differ) go to the library as a whole, as do all
texts if the tokenizer is built in another way. ``tests/llm`` compare both ways on whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

END_ID = 2
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, "PieceEncoder | SentencePieces"] = {}


_ODD = re.compile(r"\s\s|'").search
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


_KINDS = [regex.compile(x).match for x in (r"\s", r"\p{L}", r"\p{N}")]
_KIND = np.array([next((k for k, m in enumerate(_KINDS) if m(chr(i))), _OTHER) for i in range(256)], np.uint8)


def latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def is_plain(text: str) -> bool:
    """Not empty, without white space at the ends, two of it in a row, or an apostrophe."""
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not _ODD(text)


def plain_pieces(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The pattern's pieces of plain texts in Latin-1: the texts joined, where pieces begin and end, and
    where texts begin."""
    raw = b"".join(texts)
    b = np.frombuffer(raw, np.uint8)
    size = np.array([len(t) for t in texts])
    opens = np.cumsum(size) - size
    kind = _KIND[b]
    start = np.ones(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[1:] &= b[:-1] != 0x20  # a space goes with what follows
    start |= kind == _SPACE
    start[opens] = True
    s = np.flatnonzero(start)
    ends = np.append(s[1:], len(b))
    return raw, s, ends, opens


class PieceEncoder:
    MEMO = 1_000_000  # pieces
    LONG = 64  # characters; longer pieces are encoded but not kept

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        cut = made.get("pre_tokenizer") or {}
        self.by_piece = (
            made.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and made["model"]["type"] == "BPE"
            and not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        self.find = regex.compile(PATTERN).findall
        self.joins = regex.compile(r" \p{L}+").fullmatch
        self.n_bytes = np.zeros(size, np.int64)  # each character of a byte-level token is a byte
        for token, i in made["model"]["vocab"].items() if self.by_piece else ():
            self.n_bytes[i] = len(token)
        self.memo: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """The memo of plain texts: short pieces as two integers each, in the order of a hash, long ones by
        their bytes; and where their ids stand in the pool, and how many."""
        self.hashes, self.low, self.high = (np.empty(0, np.uint64) for _ in range(3))
        self.spans = np.empty((0, 2), np.int64)
        self.longer: dict[bytes, tuple[int, int]] = {}
        self.pool = np.empty(0, self.dtype)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        raw, s, ends, opens = plain_pieces(texts)
        low, high = piece_keys(raw, s, ends)
        first, which = distinct(low, high)
        begin, end, low, high = s[first], ends[first], low[first], high[first]
        if len(self.hashes) + len(self.longer) > self.MEMO or len(self.pool) > 8 * self.MEMO:
            self._forget()
        short = end - begin <= SHORT
        h = mixed_bits(low + mixed_bits(high))
        at = np.searchsorted(self.hashes, h)
        met = at < len(self.hashes)
        met[met] = self.hashes[at[met]] == h[met]
        known = met & short
        known[known] = (self.low[at[known]] == low[known]) & (self.high[at[known]] == high[known])
        spans = np.full((len(first), 2), -1, np.int64)
        spans[known] = self.spans[at[known]]
        keys: dict[int, bytes] = {}
        for i in np.flatnonzero(~known).tolist():
            key = raw[begin[i] : end[i]]
            if not short[i] and key in self.longer:
                spans[i] = self.longer[key]
            else:
                keys[i] = key
        if keys:
            ids = self._learn([k.decode("latin-1") for k in keys.values()])
            parts = [ids[k.decode("latin-1")] for k in keys.values()]
            n = np.array([len(p) for p in parts]) // self.dtype.itemsize
            spans[list(keys), 0], spans[list(keys), 1] = len(self.pool) + np.cumsum(n) - n, n
            pool = np.concatenate([self.pool, np.frombuffer(b"".join(parts), self.dtype)])
            # only short pieces, and long ones up to LONG bytes, are kept; none whose hash is another's
            fresh = np.flatnonzero(short & ~met)
            fresh = fresh[np.unique(h[fresh], return_index=True)[1]]
            for name, of in (("low", low), ("high", high), ("spans", spans), ("hashes", h)):
                setattr(self, name, np.insert(getattr(self, name), at[fresh], of[fresh], axis=0))
            self.longer.update((k, tuple(spans[i].tolist())) for i, k in keys.items() if SHORT < len(k) <= self.LONG)
            self.pool = pool
        else:
            pool = self.pool
        each = spans[which, 1]
        upto = np.cumsum(each)
        at = np.repeat(spans[which, 0] - (upto - each), each)
        at += np.arange(len(at))
        out, width = pool[at].tobytes(), self.dtype.itemsize
        cuts = (np.append((upto - each)[np.searchsorted(s, opens)], len(at)) * width).tolist()
        return [out[x:y] for x, y in zip(cuts, cuts[1:])]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.lib.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain, other = [], []
        for p in pieces:
            (plain if self.joins(p) else other).append(p)
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.lib.encode("".join(part), add_special_tokens=False).ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            raw, width, begin = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(part, (ends * width).tolist()):
                out[p] = raw[begin:end]
                begin = end
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            out.update(zip(part, self._whole(part)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in bytes of self.dtype."""
        out: list = [None] * len(texts)
        plain: dict[int, bytes] = {}
        easy, hard = [], []
        for i, t in enumerate(texts):
            raw = None if not self.by_piece or any(x in t for x in self.special) else latin(t)
            if raw is None:
                hard.append(i)
            elif is_plain(t):
                plain[i] = raw
            else:
                easy.append(i)
        for i, ids in zip(hard, self._whole([texts[i] for i in hard])):
            out[i] = ids
        if plain:
            for i, ids in zip(plain, self._plain(list(plain.values()))):
                out[i] = ids
        pieces = [self.find(texts[i]) for i in easy]
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        new = self._learn(list(set().union(*pieces).difference(memo)))
        if new:
            longer = {p: ids for p, ids in new.items() if len(p) > self.LONG}
            for p in longer:
                del new[p]
            memo.update(new)
            if longer:
                memo = {**memo, **longer}
        get = memo.__getitem__
        for i, p in zip(easy, pieces):
            out[i] = b"".join(map(get, p))
        return out


#: What keeps the first bytes of a word of eight, for each length.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SHORT = 15  # bytes that, with their number, fit two integers


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_keys(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves for each piece of raw, alike only for pieces of the same bytes: up to 15 bytes and
    the length; of longer ones a number among the distinct ones here."""
    at = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(24), strides=(1,))  # eight bytes from each place
    size = ends - starts
    low = at[starts] & _KEEP[np.minimum(size, 8)]
    more = np.clip(size - 8, 0, 7)
    high = at[np.minimum(starts + 8, len(raw))] & _KEEP[more] | size.astype(np.uint64) << np.uint64(56)
    longer = np.flatnonzero(size > SHORT)
    if len(longer):
        names: dict[bytes, int] = {}
        low[longer] = [names.setdefault(raw[x:y], len(names)) for x, y in zip(starts[longer].tolist(), ends[longer].tolist())]
        high[longer] = np.uint64(255 << 56)
    return low, high


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these keys: a place of each distinct one, and which of these each key is."""
    _, first, which = np.unique(mixed_bits(low + mixed_bits(high)), return_index=True, return_inverse=True)
    if (low[first][which] != low).any() or (high[first][which] != high).any():  # a hash of two keys
        _, first, which = np.unique(np.stack([low, high], 1), axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


class SentencePieces:
    """The same for models of the sentencepiece library, which joins words, so whole texts are encoded."""

    dtype = np.dtype("<u4")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self.lib.encode(texts, num_threads=1)]


def encoder(path: str) -> PieceEncoder | SentencePieces:
    """The worker's own, kept over tasks: by tokenizers for .json, by sentencepiece for .model."""
    if path not in _encoders:
        _encoders[path] = SentencePieces(path) if path.endswith(".model") else PieceEncoder(path)
    return _encoders[path]


def id_type(path: str) -> str:
    """The numpy type of ids in bytes, by the size of the vocabulary."""
    return encoder(path).dtype.str


def slices(texts: list[str], most: int = 2_000_000):
    """Index ranges of about that many characters, so that working memory stays bounded."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
