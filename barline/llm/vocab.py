"""Byte-pair vocabularies read from the tokenizers library's JSON, and exact merging.

Texts are cut into chunks that no token crosses; a chunk is encoded once per worker and
cached. What encodes a new chunk is the caller's choice (see ``bpe`` and ``counts``).
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import regex
from tokenizers import Tokenizer

from barline.llm.common import cached

BIG = 1 << 30
LONG = 400
CACHE, KEEP = 120_000, 100_000
CHARS = 8 << 20  # most characters of cached chunks, for long ones


class PairTable:
    """Open-addressing map from symbol pairs (a << 16 | b) to merge ranks, looked up in bulk."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.val = np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[todo[free]]
            placed = free & (self.key[slot] == keys[todo])
            self.val[slot[placed]] = todo[placed]
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, BIG where the pair has no merge."""
        keys = (left << 16) | right
        slot = self._slot(keys)
        got = self.key[slot]
        out = np.where(got == keys, self.val[slot], BIG)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.key[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.val[slot[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


def byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocab:
    """Tokens and merges of one file. ``end`` marks the last symbol of a word, if not empty."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.pairs = PairTable(np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64))
        self.out = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.first = np.array([ids[c] for c in chars], np.int64)
        self.last = np.array([ids[c + self.end] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(chars)}
        size = max(*ids.values(), *self.special.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            body = token.removesuffix(self.end) if self.end else token
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in body) + (b" " if self.end and token != body else b"")
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.ids = {b: i for i, b in enumerate(self.bytes) if b and i not in self.special.values()}

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all words, end to end, and the words' lengths."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        if self.end and len(raw):
            stop = np.cumsum(lens)[lens > 0] - 1
            sym[stop] = self.last[raw[stop]]
        return sym, lens

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging: in every word at once, the leftmost pair of lowest rank is merged,
        until no word has a pair left. Returns ids end to end and their number per word."""
        sym, lens = self.symbols(words)
        todo, total = np.flatnonzero((lens > 0) & (lens <= LONG)), lens.copy()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts_all = np.cumsum(lens) - lens
        for w in np.flatnonzero(lens > LONG):
            ids = self._merge_long(sym[starts_all[w] : starts_all[w] + lens[w]])
            parts.append((np.array([w]), np.array([len(ids)]), ids))
        if len(todo) < len(lens):
            sym = sym[np.repeat((lens > 0) & (lens <= LONG), lens)]
        word, lens = todo, lens[todo]
        starts = np.cumsum(lens) - lens
        rank = np.full(len(sym), BIG, np.int64)
        if len(sym) > 1:
            rank[:-1] = self.pairs.find(sym[:-1], sym[1:])
            rank[starts + lens - 1] = BIG
        while len(word):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            at, done = best & 0xFFFFFFFF, (best >> 32) >= BIG
            if done.any():
                gone = np.repeat(done, lens)
                parts.append((word[done], lens[done], sym[gone]))
                new = np.cumsum(~gone) - 1
                at, word, lens, sym, rank = new[at[~done]], word[~done], lens[~done], sym[~gone], rank[~gone]
                if not len(word):
                    break
            sym[at] = self.out[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, lens = sym[keep], rank[keep], lens - 1
            at = at - np.arange(len(at))
            starts = np.cumsum(lens) - lens
            rank[at] = BIG
            inner, after = at[at < starts + lens - 1], at[at > starts]
            rank[inner] = self.pairs.find(sym[inner], sym[inner + 1])
            rank[after - 1] = self.pairs.find(sym[after - 1], sym[after])
        for w, n, _ in parts:
            total[w] = n
        ids, ends = np.empty(int(total.sum()), np.int64), np.cumsum(total)
        for w, n, flat in parts:
            ids[spread(ends[w] - n, n)] = flat
        return ids, total

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word: a heap of pairs over a linked list."""
        n, s = len(sym), sym.tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs.find(sym[:-1], sym[1:])
        heap = [(int(r), i, s[i], s[i + 1]) for i, r in enumerate(ranks) if r < BIG]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n:
                r = int(self.pairs.find(np.array([s[i]]), np.array([s[nxt[i]]]))[0])
                if r < BIG:
                    heapq.heappush(heap, (r, i, s[i], s[nxt[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or s[i] != a or nxt[i] >= n or s[nxt[i]] != b:
                continue
            j = nxt[i]
            s[i], alive[j], nxt[i] = int(self.out[r]), False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(prv[i])
            push(i)
        return np.array([x for x, ok in zip(s, alive) if ok], np.int64)


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of the runs [start, start + len), run after run."""
    before = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - before, lens)


# The patterns by which the vocabularies split a text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PATTERN_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ODD_SPACE = re.compile("[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LIB_ONLY = re.compile(r"[\x00\x1c-\x1f]")
CHUNK = re.compile(r"\s?\S+|\s+(?!\S)")
SIMPLE_END = frozenset(".,;:!?|)")
# Of the characters below U+0100: 1 for letters, 2 for digits, and their lower case.
LETTER, DIGIT = 1, 2
KIND = np.array([LETTER if regex.match(r"\p{L}", chr(c)) else DIGIT if regex.match(r"\p{N}", chr(c)) else 0 for c in range(256)], np.uint8)
LOWER = np.array([ord(chr(c).lower()) for c in range(256)], np.uint8)


class Encoder:
    """Whole texts to ids, through a bounded cache of chunks.

    ``encode`` maps a list of words (bytes, one per pre-token) to ids end to end and their
    number per word; it must give what exact merging gives. ``pieces`` gives a chunk's slot, the
    next one if it is new; the last chunks wait for their ids. The cache is ``times`` the usual one.
    """

    def __init__(self, vocab: Vocab, encode, times: int = 1):
        self.vocab, self.encode, self.times = vocab, encode, times
        self.library = Tokenizer.from_file(vocab.path)
        self.split = self._split_end if vocab.end else self._split_byte
        self.special = re.compile("|".join(map(re.escape, vocab.special)) or r"(?!)")
        self._reset()

    def _reset(self) -> None:
        self.pieces: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.start, self.len = np.empty(1 << 16, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = self.held = 0

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _chunks_byte(self, text: str) -> list[str] | None:
        """Chunks start at the last white-space character before a word. Keys leave out a
        leading space; \\x00 marks a chunk that has none. None: the library takes the text."""
        if self.special.search(text):
            return None
        cut, odd = text.replace("\n", " \n"), ODD_SPACE.search(text)
        if odd and LIB_ONLY.search(text):
            return None
        if odd or "  " in cut or " \n \n" in cut or cut.endswith(" "):
            return [p[1:] if p[0] == " " and not p[1:2].isspace() and len(p) > 1 else p if p[0] == "\n" and len(p) > 1 and not p[1].isspace() else "\x00" + p for p in CHUNK.findall(text)]
        out = cut.split(" ")
        if out[0]:
            out[0] = "\x00" + out[0]
        else:
            del out[0]
        return out

    def _chunks_end(self, text: str) -> list[str] | None:
        return None if LIB_ONLY.search(text) else text.split()

    def _words_byte(self, chunk: str) -> list[bytes]:
        text = chunk[1:] if chunk[0] == "\x00" else chunk if chunk[0] == "\n" else " " + chunk
        if text.isascii() or max(text) < "Ͱ":
            body = text[1:] if text[0] == " " else text
            if body.isalpha():
                return [text.encode()]
            if len(body) > 1 and body[-1] in SIMPLE_END and body[:-1].isalpha():
                return [text[:-1].encode(), text[-1].encode()]
            return [p.encode() for p in PATTERN.findall(text)]
        back = self._back()
        return [bytes(back[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _words_end(self, chunk: str) -> list[bytes]:
        if chunk.isascii() or max(chunk) < "Ā":  # composed already, and lower-cased one by one
            low = chunk.lower()
            if low.isalpha():
                return [low.encode()]
            if low[-1] in SIMPLE_END and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1].encode()]
            return [p.encode() for p in PATTERN_END.findall(low)]
        back, lib = self._back(), self.library
        return [bytes(back[c] for c in p) for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(chunk))]

    def _split_byte(self, fresh: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Words of all chunks, and their number per chunk."""
        split = list(map(self._words_byte, fresh))
        return list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))

    def _split_end(self, fresh: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The same; chunks without apostrophes and characters from U+0100 on are split all at once."""
        code = np.frombuffer("\n".join([*fresh, ""]).encode("utf-32-le"), "<u4")
        stop = np.flatnonzero(code == 10)
        easy = np.ones(len(fresh), bool)
        easy[np.searchsorted(stop, np.flatnonzero((code >= 256) | (code == 39)))] = False
        hard = [self._words_end(fresh[i]) for i in np.flatnonzero(~easy).tolist()]
        taken = np.zeros(len(fresh), np.int64)
        taken[~easy] = np.fromiter(map(len, hard), np.int64, len(hard))
        if not easy.any():
            return list(chain.from_iterable(hard)), taken
        lens = np.diff(stop, prepend=-1) - 1
        use = np.repeat(easy, lens + 1)
        use[stop] = False
        low = LOWER[code[use]]
        kind, first = KIND[low], np.cumsum(lens[easy]) - lens[easy]
        new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        new[first] = True
        taken[easy] = np.add.reduceat(new.astype(np.int64), first)
        raw = low.tobytes().decode("latin-1").encode()
        ends = np.cumsum(np.add.reduceat(1 + (low >> 7).astype(np.int64), np.flatnonzero(new))).tolist()
        plain = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if not hard:
            return plain, taken
        plain, hard = iter(plain), iter(hard)
        return list(chain.from_iterable(islice(plain, n) if ok else next(hard) for n, ok in zip(taken.tolist(), easy.tolist()))), taken

    @lru_cache(maxsize=1)
    def _back(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(byte_chars())}

    def _fill(self) -> None:
        """Encode the chunks that are new."""
        fresh = list(islice(reversed(self.pieces), len(self.pieces) - len(self.len)))[::-1]
        if not fresh:
            return
        self.held += sum(map(len, fresh))
        whole: dict[int, np.ndarray] = {}
        if self.vocab.end and self.special.search("\n".join(fresh)):
            whole = {i: np.array(self._whole(c), np.int64) for i, c in enumerate(fresh) if self.special.search(c)}
        split, number = self.split([c for i, c in enumerate(fresh) if i not in whole] if whole else fresh)
        taken = np.zeros(len(fresh), np.int64)
        taken[np.delete(np.arange(len(fresh)), list(whole))] = number
        words = list(dict.fromkeys(split))
        place = dict(zip(words, range(len(words))))
        owner = np.fromiter(map(place.__getitem__, split), np.int64, len(split))
        ids, lens = self.encode(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        word_start = np.cumsum(lens) - lens
        flat = ids[spread(word_start[owner], lens[owner])]
        per_chunk = np.bincount(np.repeat(np.arange(len(fresh)), taken), weights=lens[owner], minlength=len(fresh)).astype(np.int64)
        for i, got in whole.items():
            at = int(per_chunk[:i].sum())
            flat, per_chunk[i] = np.concatenate([flat[:at], got, flat[at:]]), len(got)
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(need, 1 << 16), np.uint32)])
        self.flat[self.used : need] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(per_chunk) - per_chunk])
        self.len = np.concatenate([self.len, per_chunk])
        self.used = need

    def _shrink(self) -> None:
        """Keep the chunks that were met first: those are the frequent ones."""
        keep = min(KEEP * self.times, len(self.pieces))
        if self.held > CHARS:
            chars = np.cumsum(np.fromiter(map(len, self.pieces), np.int64, len(self.pieces)))
            keep = min(keep, int(np.searchsorted(chars, CHARS // 2, side="right")))
        for _ in range(len(self.pieces) - keep):
            self.held -= len(self.pieces.popitem()[0])
        self.pieces.default_factory = count(keep).__next__
        self.used = int(self.start[keep])
        self.start, self.len, self.flat = self.start[:keep].copy(), self.len[:keep].copy(), self.flat[: self.used].copy()

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        if len(self.pieces) > CACHE * self.times or self.held > CHARS:
            self._shrink()
        cut = self._chunks_end if self.vocab.end else self._chunks_byte
        here: dict[str, int] = defaultdict(count().__next__)
        lookup, slots, counts, whole = here.__getitem__, [], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            chunks = cut(text)
            if chunks is None:
                whole[i] = np.array(self._whole(text), np.uint32)
            else:
                counts[i] = len(chunks)
                slots.append(np.fromiter(map(lookup, chunks), np.int64, len(chunks)))
        known = np.fromiter(map(self.pieces.__getitem__, here), np.int64, len(here))
        self._fill()
        return known[np.concatenate(slots)] if slots else known, counts, whole

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32) and their number per text."""
        slots, counts, whole = self._slots(texts)
        per, lens = self.len[slots], self._sums(self.len[slots], counts)
        flat = self.flat[spread(self.start[slots], per)]
        for i in sorted(whole):
            at = int(lens[:i].sum())
            flat, lens[i] = np.concatenate([flat[:at], whole[i], flat[at:]]), len(whole[i])
        return flat, lens

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids per text, without laying the ids out."""
        slots, counts, whole = self._slots(texts)
        lens = self._sums(self.len[slots], counts)
        for i, got in whole.items():
            lens[i] = len(got)
        return lens

    @staticmethod
    def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


@lru_cache(maxsize=4)
def load(path: str) -> Vocab:
    return Vocab(path)


@lru_cache(maxsize=4)
def merging(path: str, times: int = 1) -> Encoder:
    """Encoder whose new words are all merged exactly."""
    vocab = load(path)
    return Encoder(vocab, vocab.merge, times)


def _forget() -> None:
    merging.cache_clear()
    load.cache_clear()


cached("vocab", _forget)
