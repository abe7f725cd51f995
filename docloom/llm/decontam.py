"""Passages of held-out test items that stand, whole or in part, in a corpus.

Spaced-seed hashing. Texts become token ids (a letter of a script without spaces is a token, otherwise a word; case,
character forms, accents, punctuation, spacing and markup are gone by then). Fixed masks of weight 8 over up to ten
tokens, each blind to other positions, are hashed at every place of the test passages and of the documents, so that a
changed word is seen by some mask. Documents are joined with the test hashes where they are read: the test side is
collected in blocks of bounded size and broadcast. Where enough places of a passage are hit, the diagonals of the hits
are aligned token by token, stretches that tolerate substitutions are grown, and those that stand in the passage's
order are chained. A document holds a passage if the stretches cover enough of it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 1 = the token counts, 0 = it is ignored.
MASKS = ("11111111", "1111011110", "1101111011", "1011110111", "1110110111")
#: Share of the passage that must be covered, and of its places that must be hit before it is aligned token by token.
COVER, LOOK = 0.5, 0.12
#: Shortest stretch in matching tokens that is no chance: words, and letters of scripts without spaces.
LEAST_WORDS, LEAST_LETTERS = 9, 13
#: Items in one broadcast block of the test side; more items take more passes over the documents.
BLOCK_ITEMS = 20_000

_DROP = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]+")
_TAG = re.compile(r"<[^<>\n]{1,80}>")
_ACCENT = re.compile("[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011]\s*\n\s*(?=[^\W\d_])")
_LETTERS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_TOKEN = re.compile(rf"[{_LETTERS}]|[^\W_{_LETTERS}]+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_OFFSETS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
_SPAN = max(len(m) for m in MASKS)


def _bare(m: re.Match) -> str:
    return unicodedata.normalize("NFD", m[0])[0]


def tokens(text: str) -> list[str]:
    """Words, and single letters of scripts without spaces, without what may differ between copies of a text."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _ACCENT.sub(_bare, _DROP.sub("", text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _TOKEN.findall(text.casefold())


def _hashes(ids: np.ndarray, mask: int, spots: np.ndarray) -> np.ndarray:
    """Hash of the mask at each of the places; 0 where a token it sees is unknown (id 0)."""
    h = np.full(len(spots), mask + 1, dtype=np.uint64)
    known = np.ones(len(spots), dtype=bool)
    for j, o in enumerate(_OFFSETS[mask]):
        part = ids[spots + o]
        known &= part != 0
        h ^= (part + np.uint64(j * 131 + 7)) * _MULT[j]
        h = (h << np.uint64(13)) | (h >> np.uint64(51))
    h[~known] = 0
    return h


def _whole(ids: np.ndarray, n: int, spots: np.ndarray) -> np.ndarray:
    """Hash of the ``n`` tokens at each of the places."""
    h = np.full(len(spots), n, dtype=np.uint64)
    for j in range(n):
        h = (h ^ ids[spots + j]) * _MULT[j]
    return h


def _places(ids: np.ndarray, mask: int) -> np.ndarray:
    """Places with enough known tokens under the mask to have a hash."""
    span = len(MASKS[mask])
    known = np.concatenate([[0], np.cumsum(ids != 0)])
    return np.flatnonzero(known[span:] - known[:-span] >= len(_OFFSETS[mask])) if len(ids) >= span else np.zeros(0, dtype=np.int64)


class Index:
    """The seeds of one block of passages."""

    def __init__(self, passages: list[tuple[list[str], list]], cover: float = COVER, look: float = LOOK):
        self.cover, self.look = cover, look
        self.vocabulary: dict[str, int] = {}
        self.items = [items for _, items in passages]
        self.ids = [np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in toks], dtype=np.uint64) for toks, _ in passages]
        self.letters = [sum(len(t) == 1 and t > "\u0e00" for t in toks) * 2 > len(toks) for toks, _ in passages]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(x) for x in self.ids if len(x) < len(MASKS[0])}:
            who = np.array([p for p, x in enumerate(self.ids) if len(x) == n])
            codes = np.array([_whole(self.ids[p], n, np.zeros(1, dtype=np.int64))[0] for p in who])
            order = np.argsort(codes)
            self.short[n] = codes[order], who[order]
        keys, owner, place = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for p, ids in enumerate(self.ids):
            for m in range(len(MASKS)):
                h = _hashes(ids, m, np.arange(max(0, len(ids) - len(MASKS[m]) + 1)))
                keys.append(h)
                owner.append(np.full(len(h), p))
                place.append(np.arange(len(h)))
        keys, owner, place = (np.concatenate(x) for x in (keys, owner, place))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        self.unique, self.first, self.many = np.unique(self.keys, return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.unique >> np.uint64(42)).astype(np.int64)] = True
        self.lengths = np.array([len(x) for x in self.ids])

    def find(self, docs: list[str]) -> Iterator[tuple[int, int]]:
        """(document, passage) pairs: every passage of the block that a document holds."""
        get = self.vocabulary.get
        arrays, starts, at = [], [], 0
        gap = [0] * _SPAN
        for text in docs:
            ids = [get(t, 0) for t in tokens(text)]
            starts.append(at)
            at += len(ids) + _SPAN
            arrays.append(np.array(ids + gap, dtype=np.uint64))
        if not arrays:
            return
        ids = np.concatenate(arrays)
        starts = np.array(starts)
        yield from self._short(ids, starts)
        where, owner, place = [], [], []
        for m in range(len(MASKS)) if len(self.unique) else ():
            spots = _places(ids, m)
            h = _hashes(ids, m, spots)
            near = (h != 0) & self.bits[(h >> np.uint64(42)).astype(np.int64)]
            spots, h = spots[near], h[near]
            k = np.searchsorted(self.unique, h)
            k[k == len(self.unique)] = 0
            hit = self.unique[k] == h
            spots, k = spots[hit], k[hit]
            many = self.many[k]
            rows = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(k) else np.zeros(0, dtype=np.int64)
            where.append(np.repeat(spots, many))
            owner.append(self.owner[rows])
            place.append(self.place[rows])
        where, owner, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (where, owner, place))
        if not len(where):
            return
        doc = np.searchsorted(starts, where, side="right") - 1
        pair = doc.astype(np.int64) * len(self.ids) + owner
        # places of each passage that are hit in each document: with enough of them it is looked at more closely
        spot = np.unique(pair * (1 << 20) + np.minimum(place, (1 << 20) - 1))
        pairs, hits = np.unique(spot >> 20, return_counts=True)
        likely = pairs[hits >= self.look * self.lengths[pairs % len(self.ids)]]
        if not len(likely):
            return
        order = np.argsort(pair, kind="stable")
        pair, where, place = pair[order], where[order], place[order]
        lo, hi = np.searchsorted(pair, likely), np.searchsorted(pair, likely, side="right")
        for key, a, b in zip(likely, lo, hi):
            d, p = divmod(int(key), len(self.ids))
            if self.covered(arrays[d], p, np.unique(where[a:b] - starts[d] - place[a:b])):
                yield d, p

    def _short(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Passages of fewer tokens than a mask sees stand in a document only as they are."""
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for n, (codes, who) in self.short.items():
            spots = np.flatnonzero(known[n:] - known[:-n] == n)
            code = _whole(ids, n, spots)
            lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, side="right")
            seen = {(int(np.searchsorted(starts, spots[i], side="right")) - 1, int(p)) for i in np.flatnonzero(hi > lo) for p in who[lo[i] : hi[i]] if (ids[spots[i] : spots[i] + n] == self.ids[p]).all()}
            yield from sorted(seen)

    def covered(self, doc: np.ndarray, p: int, diagonals: np.ndarray) -> bool:
        """Whether stretches on these diagonals (place in document less place in passage), in order, cover enough."""
        passage = self.ids[p]
        n, least = len(passage), LEAST_LETTERS if self.letters[p] else LEAST_WORDS
        least = min(least, n)
        found: list[tuple[int, int, int]] = []  # from, to (passage), from (document)
        for d in diagonals.tolist():
            a, b = max(0, -d), min(n, len(doc) - d)
            if b - a < least:
                continue
            same = doc[a + d : b + d] == passage[a:b]
            # grow: +1 for a match, -2 for a substitution; a stretch ends where it has lost more than 7
            score = best = matched = best_matched = 0
            begin = end = a
            for j, eq in enumerate(same.tolist(), a):
                if score <= 0:
                    if best_matched >= least:
                        found.append((begin, end, begin + d))
                    score = best = matched = best_matched = 0
                    begin = end = j
                    if not eq:
                        continue
                score += 1 if eq else -2
                matched += eq
                if score >= best and eq:
                    best, end, best_matched = score, j + 1, matched
                elif best - score > 7:
                    if best_matched >= least:
                        found.append((begin, end, begin + d))
                    score = best = matched = best_matched = 0
                    begin = end = j + 1
            if best_matched >= least:
                found.append((begin, end, begin + d))
        if not found:
            return False
        found = sorted(set(found))
        total = [0] * len(found)
        for i, (a, b, x) in enumerate(found):
            total[i] = b - a
            for j in range(i):
                a2, b2, x2 = found[j]
                if x2 < x and x2 + (b2 - a2) <= x + 3 and b2 > a2 and a2 < a:
                    over = max(0, b2 - a)
                    if b - a > over:
                        total[i] = max(total[i], total[j] + b - a - over)
        return max(total) >= self.cover * n


def passages_of(items: list[tuple[object, str]]) -> list[tuple[list[str], list]]:
    """Distinct passages as tokens, with the items that share each."""
    groups: dict[tuple[str, ...], list] = {}
    for item, text in items:
        groups.setdefault(tuple(tokens(text)), []).append(item)
    return [(list(toks), sorted(set(ids))) for toks, ids in sorted(groups.items()) if toks]


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, *, block_items: int = BLOCK_ITEMS, cover: float = COVER, look: float = LOOK) -> DataFrame:
    """(doc_key, item_key): documents that hold at least ``cover`` (half) of an item's passage.

    ``items`` is the held-out set. It is read in ``ceil(items / block_items)`` blocks; each is collected (so at most
    ``block_items`` passages at a time), indexed and broadcast, and the documents are scanned once per block without a
    shuffle. Null or blank texts and passages take no part; a passage of fewer than eight tokens must stand in the document
    whole, token by token. A passage is aligned only where ``look`` of its places are hit by a seed, which one changed word
    in five leaves and one in four does not; all items that share a passage are reported; rows are distinct for distinct documents.
    Only the named columns are read. Long texts are read whole.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item_key).alias("item"), F.col(passage).alias("passage")).filter("item is not null and passage is not null").distinct()
    count = held.count()
    blocks = max(1, -(-count // block_items))
    schema = T.StructType([T.StructField("doc", docs.schema[doc_key].dataType), T.StructField("item", items.schema[item_key].dataType)])
    source = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    out = None
    for b in range(blocks):
        part = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index(passages_of([(r["item"], r["passage"]) for r in part.toLocalIterator()]), cover, look))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            built = index.value
            for pdf in batches:
                keys, texts = pdf["doc"].tolist(), pdf["text"].tolist()
                at = 0
                while at < len(texts):  # about a million characters at a time
                    end, size = at, 0
                    while end < len(texts) and (size == 0 or size + len(texts[end]) < 1_000_000):
                        size += len(texts[end]) + 1
                        end += 1
                    rows = [(keys[at + d], item) for d, p in built.find(texts[at:end]) for item in built.items[p]]
                    yield pd.DataFrame(rows, columns=["doc", "item"])
                    at = end

        found = source.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))
