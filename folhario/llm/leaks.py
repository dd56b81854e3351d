"""Passages of evaluation items inside a training corpus, by spaced-seed hashing.

Words are folded (case, accents, punctuation, look-alike digits). Every mask of `MASKS`
picks some positions of a short window and ignores the others; windows of passages and
of documents that agree on the picked words are hits, so a replaced or misread word in
an ignored position does no harm. Hits are joined on their hash and the text around
them is compared with the passage word by word, tolerating a replaced, dropped, added
or misread word here and there. What counts is how many running words of the passage
the document holds, in one piece or in two pieces that follow each other in the passage.

The index of a block of items (at most `block` items and `block_words` words, or one
longer passage) is sent to every worker and joined there, so the corpus is never
shuffled: hits on stock phrases would be many times its size. One block is a single map
over the corpus. With more, a bitmap of fixed size holds the hashes of all items and one
pass over the corpus keeps the documents that can hold a passage of any; the blocks are
then matched one after another against those, each let go before the next is sent.

Defined cases: null, empty and blank texts or passages hold and leak nothing; passages
shorter than `min_words` can't leak; repeated documents and repeated items each get
their rows; texts are read to their end; extra columns play no part; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.runtime import cut

MIN_WORDS = 20
#: Fixed masks: positions of a window whose words must agree.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: What a replaced, dropped or added word costs against the 1 of an agreeing word, and the
#: least part of a stretch's words that must be left after that.
MISMATCH, AGREE = 2.6, 0.6
_LOOKALIKE = str.maketrans("0158", "olsb")
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Of a passage held, at least this part of the least number of words stands in windows that agree (three words of
#: at most five, so words stepped over leave three of five), within a tenth more running words.
DENSE, REACH = 0.6, 1.1
BITS = 1 << 27
_DROP = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))


def pieces(text: str) -> list[str]:
    """The words of a text, without case, accents and punctuation; all in C, whatever the text's length."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.encode("ascii", "ignore").lower().translate(None, _DROP).decode("ascii").split()


def unmixed(word: str) -> str:
    """A word with digits that stand for letters put back."""
    return word.translate(_LOOKALIKE) if word[0].isalpha() and not word.isalpha() else word


def fold(text: str) -> list[str]:
    """`pieces` with look-alike digits put back."""
    return [unmixed(w) for w in pieces(text)]


@lru_cache(maxsize=100_000)
def near(a: str, b: str) -> bool:
    """Whether two words may be one, misread: an edit or, in long words, two."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit():
        return False
    la, lb = len(a), len(b)
    most = 2 if max(la, lb) >= 7 else 1
    if abs(la - lb) > most or min(la, lb) < 3:
        return False
    row = list(range(lb + 1))
    for i in range(1, la + 1):
        last, row[0] = row[0], i
        best = i
        for j in range(1, lb + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a[i - 1] != b[j - 1]))
            best = min(best, row[j])
        if best > most:
            return False
    return row[lb] <= most


_KNOWN: dict[str, int] = {}


def word_ids(words: list[str]) -> np.ndarray:
    """A stable 64-bit number for each word, look-alike digits put back; words met before are looked up."""
    get = _KNOWN.get
    out = [get(w) for w in words]
    if None in out:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        for i, n in enumerate(out):
            if n is None:
                w = words[i]
                out[i] = _KNOWN[w] = int.from_bytes(blake2b(unmixed(w).encode(), digest_size=8).digest(), "little") or 1
    return np.array(out, dtype=np.uint64)


def hashes(ids: np.ndarray, mask: tuple[int, ...], m: int) -> np.ndarray:
    """A hash for each window of `ids` under a mask; a window over the end of a text (word 0) has 0."""
    size = len(ids) - mask[-1]
    if size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(size, m + 1, np.uint64)
    with np.errstate(over="ignore"):
        for p in mask:
            h = (h ^ ids[p : p + size]) * _MIX
            h ^= h >> np.uint64(29)
    h[(ids[:size] == 0) | (ids[mask[-1] :] == 0)] = 0
    return h


def dense(n_words: int) -> tuple[int, int]:
    """(how many different words must agree, within how many running words) for a passage of `n_words` to be held."""
    return max(3, int(DENSE * n_words)), int(REACH * n_words)


class Batch:
    """Documents as one row of word numbers, with zeros between them so that no window reaches over an end."""

    def __init__(self, words: list[list[str]]):
        gap = max(m[-1] for m in MASKS)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + gap)))[:-1].astype(np.int64)
        self.row = np.zeros(int((sizes + gap).sum()), np.uint64)
        flat = word_ids([w for part in words for w in part])
        self.row[np.repeat(self.starts - np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64), sizes) + np.arange(len(flat))] = flat

    def windows(self, bitmap: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
        """(mask, places, hashes) of the windows whose hash the bitmap may hold."""
        for m, mask in enumerate(MASKS):
            h = hashes(self.row, mask, m)
            at = np.flatnonzero(maybe(bitmap, h) & (h != 0))
            yield mask, at, h[at]


def maybe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h >> np.uint64(7)) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def set_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of the bits of a bitmap of `bits` that the hashes set."""
    bit = (h >> np.uint64(7)) & np.uint64(bits - 1)
    return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


class Index:
    """Hashes of all masked windows of some passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(key, fold(passage or "")) for key, passage in items]
        row = Batch([words for _, words in self.items])
        parts = [(h[at := np.flatnonzero(h)], at) for h in (hashes(row.row, mask, m) for m, mask in enumerate(MASKS))]
        h, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        self.n = np.searchsorted(row.starts, at, side="right") - 1
        self.q = at - row.starts[self.n] if len(at) else at
        self.keys, self.first = np.unique(h, return_index=True)
        self.end = np.append(self.first[1:], len(h))
        # sixteen bits an entry: one in sixteen windows that no passage has is looked for in vain
        self.bitmap = np.zeros(1 << max(4, (len(self.keys) * 16).bit_length() - 6), np.uint64)
        np.bitwise_or.at(self.bitmap, *set_bits(self.keys, len(self.bitmap) * 64))

    def hits(self, batch: list[list[str]], least: int = 1, within: int = 1 << 30) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """document -> item -> (document position, passage position) pairs of agreeing words, in order.

        Items of which fewer than `least` different words agree among any `within` running
        words are left out.
        """
        out: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)
        if not len(self.keys) or not len(batch):
            return out
        row = Batch(batch)
        parts = []
        for mask, at, h in row.windows(self.bitmap):
            where = np.searchsorted(self.keys, h)
            where[where == len(self.keys)] = 0
            good = self.keys[where] == h
            at, where = at[good], where[good]
            if not len(at):
                continue
            # every place of the hash in the index, as one flat list
            many = self.end[where] - self.first[where]
            flat = np.repeat(self.first[where] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            k, n, q = np.repeat(at, many), self.n[flat], self.q[flat]
            parts += [(k + p, n, q + p) for p in mask]
        if not parts:
            return out
        k, n, q = (np.concatenate(x) for x in zip(*parts))
        d = np.searchsorted(row.starts, k, side="right") - 1
        k -= row.starts[d]
        # document and item, then the place in the passage, as one number
        wide = int(q.max()) + 1
        pair = d * len(self.items) + n
        place = np.unique(pair * wide + q)
        group, word = place // wide, place % wide
        if len(place) < least:
            return out
        far = least - 1
        full = (group[far:] == group[: len(group) - far]) & (word[far:] - word[: len(word) - far] < within)
        live = np.zeros(len(batch) * len(self.items), bool)
        live[group[far:][full]] = True
        kept = live[pair]
        pair, k, q = pair[kept], k[kept], q[kept]
        order = np.lexsort((q, k, pair))
        pair, k, q = pair[order], k[order], q[order]
        new = np.ones(len(k), bool)
        new[1:] = (np.diff(k) != 0) | (np.diff(q) != 0) | (np.diff(pair) != 0)
        pair, k, q = pair[new], k[new], q[new]
        first = np.flatnonzero(np.concatenate(([True], np.diff(pair) != 0))) if len(pair) else np.empty(0, np.int64)
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(k)]):
            d, n = divmod(int(pair[i]), len(self.items))
            out[d][n] = list(zip(k[i:j].tolist(), q[i:j].tolist()))
        return out


#: Steps back from an agreeing word over one or two words that don't agree: in the document, in the passage, at most skipped.
STEPS = tuple((dk, dq, max(dk, dq) - 1) for dk in (1, 2, 3) for dq in (1, 2, 3) if (dk, dq) != (1, 1))


def _widen(doc: list[str], passage: list[str], k: int, q: int, way: int, score: float, other: int) -> tuple[int, int, float]:
    """An end of a stretch taken as far as words go on agreeing; over one odd word too, if words agree behind it
    and the whole still passes."""

    def agreeing(k: int, q: int) -> int:
        n = 0
        while 0 <= k + way * (n + 1) < len(doc) and 0 <= q + way * (n + 1) < len(passage) and near(doc[k + way * (n + 1)], passage[q + way * (n + 1)]):
            n += 1
        return n

    n = agreeing(k, q)
    k, q, score = k + way * n, q + way * n, score + 0.8 * n
    best = (0, k, q)
    for dk, dq in ((1, 1), (0, 1), (1, 0)):  # replaced, dropped, added
        n = agreeing(k + way * dk, q + way * dq)
        end = q + way * (dq + n)
        telling = n > 1 or n == 1 and len(passage[end]) > 3
        if telling and n > best[0] and score + n - MISMATCH >= AGREE * (abs(end - other) + 1):
            best = n, k + way * (dk + n), end
    return (best[1], best[2], score + best[0] - MISMATCH) if best[0] else (k, q, score)


def stretches(pairs: list[tuple[int, int]], doc: list[str], passage: list[str]) -> list[tuple[int, int, int, int]]:
    """Aligned stretches (doc start, doc end, passage start, passage end), ends included.

    A stretch is a chain of agreeing words; between two of them at most two words may be
    replaced, dropped or added, each at a cost, so shared stock phrases with other words
    in their slots don't chain.
    """
    wide = len(passage) + 4  # a place in both texts as one number
    steps = [(dk * wide + dq, dk, dq, skipped) for dk, dq, skipped in STEPS]
    best: dict[int, tuple[float, tuple[int, int]]] = {}
    get = best.get
    for k, q in pairs:
        here = k * wide + q
        score, start = 1.0, (k, q)
        prev = get(here - wide - 1)
        if prev is not None:
            score, start = prev[0] + 1.0, prev[1]
        for back, dk, dq, skipped in steps:
            prev = get(here - back)
            if prev is None or prev[0] + 0.8 * skipped + 1.0 <= score:
                continue
            gain = prev[0] + 1.0
            if dk == dq:
                for x in range(1, dk):
                    gain += 0.8 if near(doc[k - x], passage[q - x]) else -MISMATCH
            else:
                gain -= MISMATCH * skipped
            if gain > score:
                score, start = gain, prev[1]
        best[here] = score, start
    by_start: dict[tuple[int, int], tuple[float, tuple[int, int]]] = {}
    for here, (score, start) in best.items():
        if start not in by_start or score > by_start[start][0]:
            by_start[start] = score, divmod(here, wide)
    out = []
    for (k0, q0), (score, (k1, q1)) in by_start.items():
        if score < max(4.0, AGREE * (q1 - q0 + 1)):
            continue
        k0, q0, score = _widen(doc, passage, k0, q0, -1, score, q1)
        k1, q1, score = _widen(doc, passage, k1, q1, 1, score, q0)
        out.append((k0, k1, q0, q1))
    return out


def held_words(found: list[tuple[int, int, int, int]]) -> int:
    """Running words of the passage that the document holds in one stretch, or in two that follow each other."""
    most = max((q1 - q0 + 1 for _, _, q0, q1 in found), default=0)
    for a in found:
        for b in found:
            if a is not b and -2 <= b[2] - a[3] - 1 <= 1 and b[3] > a[3] and (b[0] > a[1] - 2 or b[1] < a[0] + 2):
                most = max(most, b[3] - a[2] + 1)
    return most


def leaked(index: Index, texts: list[str | None], min_words: int = MIN_WORDS) -> list[list[tuple[int, int]]]:
    """(item, running words held) of each text."""
    batch = [pieces(t) if t else [] for t in texts]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, found in index.hits(batch, *dense(min_words)).items():
        doc = [unmixed(w) for w in batch[d]]
        for n, pairs in found.items():
            key, passage = index.items[n]
            held = held_words(stretches(pairs, doc, passage))
            if held >= min_words:
                out[d].append((key, held))
    return out


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS, block: int = 20_000, block_words: int = 2_000_000, bits: int = BITS
) -> DataFrame:
    """(doc_id, item_id, words) of every document and item of which it holds at least `min_words` running words.

    No shuffle of the corpus, whatever source or copy group is large, and one pass over
    it for any number of items. The driver holds one block of items at a time.
    """
    ranked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(passage).cast("string").alias("passage")).where("passage is not null")
    corpus = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    schema = f"doc_id {corpus.schema['doc_id'].dataType.simpleString()}, item_id long, words int"
    sc = corpus.sparkSession.sparkContext

    def matched(on: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(held.value)
            for batch in batches:
                for a in range(0, len(batch), 1000):
                    part = batch.iloc[a : a + 1000]
                    out = [(d, i, n) for d, got in zip(part["doc_id"], leaked(index, list(part["text"]), min_words)) for i, n in got]
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "words"])

        return on.mapInPandas(run, schema)

    blocks = _blocks(ranked, block, block_words)
    rows, following = next(blocks, []), next(blocks, None)
    if following is None:
        return matched(corpus, sc.broadcast(rows))
    near_some = cut(possible(corpus, ranked, min_words, bits))
    done = []
    while rows:
        held = sc.broadcast(rows)
        done.append(cut(matched(near_some, held)))
        held.destroy()
        rows, following = following, next(blocks, None)
    return reduce(DataFrame.unionByName, done)


def possible(corpus: DataFrame, items: DataFrame, min_words: int, bits: int = BITS) -> DataFrame:
    """The documents with enough words in windows that any item may have.

    All items' hashes are set in one bitmap of `bits` bits, put together by the executors;
    its bytes, `bits` / 8 at most, are all that is sent.
    """

    def to_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["passage"]:
                ids = word_ids(fold(t))
                at, mask = set_bits(np.unique(np.concatenate([hashes(ids, m, i) for i, m in enumerate(MASKS)])), bits)
                yield pd.DataFrame({"at": at, "mask": mask.view(np.int64)})

    set_words = items.select("passage").mapInPandas(to_bits, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[set_words["at"].to_numpy(np.int64)] = set_words["mask"].to_numpy(np.int64).view(np.uint64)
    held = corpus.sparkSession.sparkContext.broadcast(bitmap)
    least = dense(min_words)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a : a + 1000]
                row = Batch([pieces(t) for t in part["text"]])
                met = np.zeros(len(row.row), bool)
                for mask, at, _ in row.windows(held.value):
                    for p in mask:
                        met[at + p] = True
                # a passage in two pieces may lie in two places of a document, so its words are counted over the whole of it
                counts = np.bincount(np.searchsorted(row.starts, np.flatnonzero(met), side="right") - 1, minlength=len(part))
                yield part[counts >= least]

    return corpus.mapInPandas(run, corpus.schema)


def _blocks(items: DataFrame, block: int, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The item table in blocks of at most `block` rows and `block_words` words (more only for one longer passage), one at a time on the driver."""
    rows: list[tuple[int, str]] = []
    size = 0
    for row in items.toLocalIterator():
        n = len(row.passage.split())
        if rows and (len(rows) == block or size + n > block_words):
            yield rows
            rows, size = [], 0
        rows.append((row.item_id, row.passage))
        size += n
    if rows:
        yield rows
