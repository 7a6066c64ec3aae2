"""Token ids of whole texts, by a public tokenizer, one call for each new word.

The vocabulary lower-cases, drops white space and splits texts into runs of
letters, single digits and runs of other signs, each merged on its own. So ids
of a text are those of its words, joined; words repeat, so each worker keeps
the ids of words it has met, in a table of fixed size.
"""

from __future__ import annotations

import os
import re
import sys
import types

import numpy as np

from .kernels import U, byte_values, running, span_hash, word_spans

#: Words a worker remembers, and ids of one that the table holds.
SLOTS, INLINE = 1 << 20, 8
#: Words that are one unit for the tokenizer: letters only, or signs only, without the apostrophe.
ONE_UNIT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")


class WordTokens:
    """Ids of texts by ``tokenizers``, equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, json: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(json)
        self.key = np.zeros(SLOTS, U)
        self.size = np.zeros(SLOTS, np.int16)
        self.ids = np.zeros((SLOTS, INLINE), np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.values, self.breaks = byte_values(), np.zeros(256, bool)
        self.breaks[[0x20, 9, 10, 13]] = True
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        sign = np.zeros(256, bool)
        sign[33:127] = True
        sign &= ~letter
        sign[48:58] = False
        self.letter, self.sign = letter, sign

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, joined; how many each has), each word taken alone."""
        one = ONE_UNIT.fullmatch
        plain = np.array([one(w) is not None for w in words], bool)
        parts, size = [], np.zeros(len(words), np.int64)
        if plain.any():
            joined = " ".join([w for w, p in zip(words, plain, strict=True) if p])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == plain.sum() and last[-1] == len(ids):
                size[plain] = np.diff(last, prepend=0)
                parts.append((np.flatnonzero(plain), ids))
            else:
                plain[:] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
            size[rest] = [len(x) for x in got]
            parts.append((rest, np.array([i for x in got for i in x], np.uint32)))
        at = np.cumsum(size) - size
        flat = np.zeros(size.sum(), np.uint32)
        for which, ids in parts:
            k = size[which]
            flat[np.repeat(at[which], k) + _counts(k)] = ids
        return flat, size

    def texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, joined; how many each text has) of a chunk of texts."""
        cuts = np.zeros(len(data), bool)
        cuts[1:] = self.letter[data[:-1]] & self.sign[data[1:]]
        for s in self.special:  # a special token in a text is matched before words are
            raw = s.encode()
            if bytes(data).find(raw) >= 0:
                return self._whole(data, starts, ends)
        first, last, doc = word_spans(data, starts, ends, self.breaks, cuts)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        h = span_hash(running(data, self.values), first, last)
        unique, where, back = np.unique(h, return_index=True, return_inverse=True)
        slot = (unique >> U(20)).astype(np.int64) & (SLOTS - 1)
        hit = (self.key[slot] == unique) & (self.size[slot] > 0)
        size = np.zeros(len(unique), np.int64)
        size[hit] = self.size[slot[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            raw = bytes(data)
            flat, size[new] = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(first[where[new]].tolist(), last[where[new]].tolist(), strict=True)])
        at = np.concatenate(([0], np.cumsum(size)))
        pool = np.zeros(at[-1], np.uint32)
        old = np.flatnonzero(hit)
        if len(old):
            k = size[old]
            pool[np.repeat(at[old], k) + _counts(k)] = self.ids[np.repeat(slot[old], k), _counts(k)]
        if len(new):
            k = size[new]
            pool[np.repeat(at[new], k) + _counts(k)] = flat
            keep = (k > 0) & (k <= INLINE)
            kept = new[keep]
            _, one = np.unique(slot[kept], return_index=True)
            kept, k = kept[one], k[keep][one]
            self.key[slot[kept]], self.size[slot[kept]] = unique[kept], k
            self.ids[np.repeat(slot[kept], k), _counts(k)] = pool[np.repeat(at[kept], k) + _counts(k)]
        k = size[back]
        return pool[np.repeat(at[back], k) + _counts(k)], np.bincount(doc, weights=k, minlength=len(starts)).astype(np.int64)

    def _whole(self, data, starts, ends):
        raw = bytes(data)
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)


def _counts(k: np.ndarray) -> np.ndarray:
    """0, 1, ... k_i - 1 for each i, joined."""
    return np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)


def worker_tokens(key: str, held) -> WordTokens:
    """The worker's own ``WordTokens`` of the broadcast file ``held``, kept from task to task under ``key``."""
    state = sys.modules.setdefault("silvaframe_worker_state", types.ModuleType("silvaframe_worker_state"))
    kept = state.__dict__.setdefault("tokens", {})
    if key not in kept:
        kept[key] = WordTokens(held.value)
    return kept[key]
