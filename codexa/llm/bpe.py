"""Byte-pair encoding by batched numpy merge rounds.

Texts are cut into pretokens by class changes over a flat code-point array. Every distinct
pretoken that a worker has not met yet joins one flat array of symbols; a round finds the rank of
every adjacent pair by binary search over the sorted pair keys, takes the lowest rank in each
word and merges all its places at once. Rounds go on until no word has a known pair.

Two pretokenisers are known: ``byte`` (a leading space belongs to the word) and ``word`` (white
space vanishes, text is NFC-normalised and lower-cased, the last symbol carries a word-end mark).
The vocabulary file's own fields say which one applies. Empty and null texts give no ids;
strings of special tokens inside a text become their ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from codexa.llm.text import LETTER, NUMBER, SPACE, U, HashIndex, classes, code_points, gather, span_hashes

#: Pretokens that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
NO_RANK = np.iinfo(np.int64).max
APOSTROPHE = 39
CONTRACTION_1 = [ord(c) for c in "stmd"]
CONTRACTION_2 = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Bpe:
    """An encoder and decoder for one vocabulary file in the JSON form of public tokenizers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.words = bool(self.end)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(size, "", object)
        for token, at in [*vocab.items(), *self.special.items()]:
            self.tokens[at] = token
        self.digits = np.array([str(i) for i in range(size)], object)
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], np.int64)
        self.last = np.array([vocab[c + self.end] for c in alphabet], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b if not self.end else a.removesuffix(self.end) + b if a.endswith(self.end) else a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.bytes = {c: b for b, c in enumerate(alphabet)}
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(1 << 17)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    # -- pretokens -------------------------------------------------------------------------

    def pretokens(self, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pretokens of flat code points; none crosses a text's bounds."""
        n = len(cps)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = classes()[cps]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = np.ones(n + 1, bool)
        start[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
        if self.words:
            start[:n] |= kind == NUMBER
        self._contractions(cps, kind, edge, start)
        if not self.words:
            self._spaces(cps, kind, edge, start)
        bounds = np.flatnonzero(start)
        starts, ends = bounds[:-1], bounds[1:]
        if self.words:
            real = kind[starts] != SPACE
            starts, ends = starts[real], ends[real]
        return starts, ends

    def _contractions(self, cps: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd are pretokens of their own where a lone apostrophe begins one."""
        n = len(cps)
        at = np.flatnonzero(cps == APOSTROPHE)
        at = at[(at + 1 < n) & start[at]]
        at = at[~edge[at + 1] & (kind[np.minimum(at + 1, n - 1)] == LETTER)]
        if not self.words:
            attached = (at > 0) & ~edge[at] & (cps[at - 1] == 32)
            at = at[~attached]
        if not at.size:
            return
        one = np.isin(cps[at + 1], CONTRACTION_1)
        start[at[one] + 1] = False
        start[at[one] + 2] = True
        at = at[~one]
        at = at[at + 2 < n]
        at = at[~edge[at + 2]]
        two = np.zeros(len(at), bool)
        for a, b in CONTRACTION_2:
            two |= (cps[at + 1] == a) & (cps[at + 2] == b)
        start[at[two] + 1] = False
        start[at[two] + 3] = True

    def _spaces(self, cps: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
        """The last of a run of white space goes with the word that follows, if it is a space."""
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1 : len(cps)]) + 1
        start[after - 1] = True
        start[after[cps[after - 1] == 32]] = False

    # -- merge rounds ----------------------------------------------------------------------

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word; ``symbols`` holds the words one after another."""
        word = np.repeat(np.arange(len(counts)), counts)
        done_ids, done_words = [], []
        while symbols.size:
            key = (symbols[:-1] << 20) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank = np.append(np.where(known, self.ranks[at], NO_RANK), NO_RANK)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(heads, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            over = best == NO_RANK
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
            hit = np.flatnonzero((rank == best) & ~over)
            if hit.size:
                # equal neighbours overlap: within a chain of hits every second one merges
                chain = np.concatenate([[True], np.diff(hit) != 1])
                since = np.arange(len(hit)) - np.flatnonzero(chain)[np.cumsum(chain) - 1]
                hit = hit[since % 2 == 0]
                symbols = symbols.copy()
                symbols[hit] = self.made[at[hit]]
                over[hit + 1] = True
            symbols, word = symbols[~over], word[~over]
        if not done_ids:
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(counts))

    def _learn(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode pretokens not met before and remember their ids."""
        lengths = ends - starts
        own = cps[gather(starts, lengths)]
        data = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        width = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
        heads = np.cumsum(lengths) - lengths
        counts = np.add.reduceat(width, heads).astype(np.int64)
        symbols = self.first[data]
        tails = np.cumsum(counts) - 1
        symbols[tails] = self.last[data[tails]]
        ids, counts = self.merge(symbols, counts)
        n, more = self.index.n, len(starts)
        while len(self.starts) < n:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[n - more : n] = self.used + np.cumsum(counts) - counts
        self.lengths[n - more : n] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    # -- whole texts -----------------------------------------------------------------------

    def normal(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points after the vocabulary's normaliser."""
        if not self.words:
            return code_points(flat, offsets)
        whole = flat.tobytes()
        if whole.isascii():
            return np.frombuffer(whole.lower(), np.uint8).astype(np.uint32), offsets
        own = [lowered(whole[a:b].decode("utf-8")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.frombuffer("".join(own).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)

    def _plain(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cps, offsets = self.normal(flat, offsets)
        starts, ends = self.pretokens(cps, offsets)
        if self.index.n > REMEMBERED:
            self._forget()
        number, new = self.index.number(span_hashes(cps, starts, ends))
        if new.size:
            self._learn(cps, starts[new], ends[new])
        lengths = self.lengths[number].astype(np.int64)
        ids = self.ids[gather(self.starts[number], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, offsets)]

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and n+1 offsets into them."""
        whole = flat.tobytes()
        if not any(s.encode() in whole for s in self.special):
            return self._plain(flat, offsets)
        # texts with a special token's string are cut there; the cuts become that token's id
        pieces, owner = [], []
        for at, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for piece in self.split_special.split(whole[a:b].decode("utf-8")):
                pieces.append(piece)
                owner.append(at)
        plain = [b"" if p in self.special else p.encode() for p in pieces]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
        ids, at = self._plain(np.frombuffer(b"".join(plain), np.uint8), bounds)
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else ids[at[k] : at[k + 1]] for k, p in enumerate(pieces)]
        lengths = np.bincount(owner, [len(p) for p in parts], len(offsets) - 1).astype(np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included."""
        tokens = self.tokens[ids].tolist()
        if not self.byte_decoder:
            return " ".join(tokens)
        out = b"".join(t.encode() if t in self.special else bytes(self.bytes[c] for c in t) for t in tokens)
        return out.decode("utf-8", "replace")


def lowered(text: str) -> str:
    """NFC, then the lower case of each character by itself (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(4)
def bpe(path: str) -> Bpe:
    """One encoder for each vocabulary and worker."""
    return Bpe(path)
