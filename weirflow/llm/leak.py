"""Evaluation texts in training text: which documents reproduce which held-out passages, in full or in large part.

Words of every document and passage become ids of the passages' vocabulary. Windows of WINDOW words are embedded by a CGK random
walk, which turns a small edit distance into a small Hamming distance, and hashed by bit sampling: REPEATS independent walks,
SAMPLED coordinates each. EVIDENCE meetings of a document's and a passage's windows make (document, item) a candidate;
candidates are verified on the words themselves: stretches longer than a phrase, of a banded edit distance of at most a third of
their words, must reproduce the wanted share of the passage. A window with too few words of the vocabulary cannot be within the
edit radius of any passage window and is not hashed. Short passages have an index of their own, of shorter windows, where one
meeting makes a candidate and a local alignment verifies it.

The items are broadcast in blocks of at most ITEM_WORDS words; documents are scanned where they are read, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import col

WINDOW = 8
#: Passages of fewer words than LONG are short, with windows of SHORT_WINDOW words and SHORT_SAMPLED coordinates.
LONG = 12
SHORT_WINDOW = 4
SHORT_SAMPLED = 2
REPEATS = 8
SAMPLED = 5
#: Meetings (of any windows, in any repetition) that make a pair a candidate. One window reproduced word for word gives REPEATS.
EVIDENCE = 6
#: Share of the passage's words that must be reproduced unchanged: half of them, of which one in six may be changed.
SHARE = 5 / 12
#: Share of a stretch's words that may be edited.
EDITED = 1 / 3
#: A stretch has at least so many reproduced words.
STRETCH = 6
#: Words of the items of one broadcast block.
ITEM_WORDS = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without case, punctuation, markup, accents, hidden characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


class Index:
    """Passages of a block of items, and the hashes of their windows."""

    def __init__(self, items: Sequence[tuple[int, str]], window: int = WINDOW, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 7):
        self.window, self.repeats = window, repeats
        #: Edits a window may have to be worth hashing.
        self.radius = 3 * window // 8
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.passages = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(p)], np.int32) for _, p in items]
        rng = np.random.default_rng(seed)
        steps = 2 * window
        self.picks = [np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(repeats)]
        size = len(self.vocabulary) + 2  # 0: a word outside the vocabulary; the last: beyond the end of the window
        self.walk = rng.integers(0, 2, (repeats, steps, size), dtype=np.int8)
        self.mix = rng.integers(1, 2**63, (repeats, sampled), dtype=np.uint64) | np.uint64(1)
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.grams: list[dict[tuple[int, int, int], list[int]]] = []
        starts, owner = [], []
        base = 0
        for n, p in enumerate(self.passages):
            if 0 < len(p) < window:
                self.short.setdefault(len(p), {}).setdefault(tuple(p.tolist()), []).append(n)
            else:
                starts.append(np.arange(base, base + max(0, len(p) - window + 1)))
                owner.append(np.full(len(starts[-1]), n))
            base += len(p)
            grams: dict[tuple[int, int, int], list[int]] = {}
            q = p.tolist()
            for i in range(len(q) - 2):
                grams.setdefault((q[i], q[i + 1], q[i + 2]), []).append(i)
            self.grams.append(grams)
        flat = np.concatenate([*self.passages, np.zeros(0, np.int32)])
        starts, owner = np.concatenate([*starts, np.zeros(0, int)]).astype(np.int64), np.concatenate([*owner, np.zeros(0, int)]).astype(np.int64)
        self.tables = []
        for h in self.hashes(flat, starts):
            pairs = np.unique(np.stack([h.astype(np.int64), owner]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
            keys, first = np.unique(pairs[0], return_index=True)
            self.tables.append((keys, np.append(first, pairs.shape[1]), pairs[1]))

    def hashes(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Of each repetition, the sampled-coordinate hash of the embedded windows that begin at ``starts``."""
        end = len(self.vocabulary) + 1
        padded = np.append(flat, np.full(self.window, end, np.int32))
        for r in range(self.repeats):
            at = np.zeros(len(starts), np.int64)
            h = np.zeros(len(starts), np.uint64)
            picks = self.picks[r]
            for j in range(int(picks[-1]) + 1):
                s = np.where(at < self.window, padded[np.minimum(starts + at, len(padded) - 1)], end)
                k = np.searchsorted(picks, j)
                if k < len(picks) and picks[k] == j:
                    h += (s.astype(np.uint64) + np.uint64(1)) * self.mix[r, k]
                    h ^= h >> np.uint64(29)
                at += self.walk[r, j][s]
            yield h

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, passage) of all windows that meet a window of the passage in some repetition."""
        found_at, found = [], []
        for (keys, first, owner), h in zip(self.tables, self.hashes(flat, starts)):
            if not len(keys):
                continue
            h = h.astype(np.int64)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == h)
            lo, n = first[k[hit]], first[k[hit] + 1] - first[k[hit]]
            found_at.append(np.repeat(starts[hit], n))
            found.append(owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(hit) else np.zeros(0, np.int64))
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stretches(grams: dict, doc: list[int], positions: Sequence[int], stretch: int = STRETCH) -> list[tuple[int, int, int, int]]:
    """Where ``doc`` may reproduce the passage: (from, to) in the passage, (from, to) in the document, of chains of exact runs of three
    words or more over at most two edited words, with at least ``stretch`` words in runs. ``positions``: where to look."""
    runs: dict[int, list[list[int]]] = {}
    for j in positions:
        for i in grams.get((doc[j], doc[j + 1], doc[j + 2]), ()):
            on = runs.setdefault(i - j, [])
            if on and i <= on[-1][1] - 1:
                on[-1][1] = i + 3
            else:
                on.append([i, i + 3])
    open_: list[list[int]] = []  # chains being built: end and diagonal, words in runs, end in the document, where it began
    done: list[list[int]] = []
    for a, b, d in sorted((a, b, d) for d, on in runs.items() for a, b in on):
        best = None
        for c in open_:
            if -1 <= a - c[0] <= 3 and abs(d - c[1]) <= 2 and a - d >= c[3] - 1 and (best is None or c[2] > best[2]):
                best = c
        if best is None:
            open_.append([b, d, b - a, b - d, a, a - d])
        else:
            best[2] += max(0, b - max(a, best[0]))
            best[0], best[1], best[3] = max(b, best[0]), d, b - d
        # chains that nothing can go on from any more
        if len(open_) > 64:
            done += [c for c in open_ if c[0] < a - 3]
            open_ = [c for c in open_ if c[0] >= a - 3]
    return [(c[4], c[0], c[5], c[3]) for c in done + open_ if c[2] >= stretch]


def aligned(x: Sequence[int], y: Sequence[int]) -> tuple[int, list[int]]:
    """Banded edit distance of two stretches of words, and the places in ``x`` of the words that an alignment of least edits keeps."""
    n, m = len(x), len(y)
    band = abs(n - m) + max(3, n // 6)
    far = n + m
    rows = [[j if j <= band else far for j in range(m + 1)]]
    for i in range(1, n + 1):
        row, last = [far] * (m + 1), rows[-1]
        lo, hi = max(0, i - band), min(m, i + band)
        if lo == 0:
            row[0] = i
        for j in range(max(1, lo), hi + 1):
            best = last[j - 1] + (x[i - 1] != y[j - 1])
            up, back = last[j] + 1, row[j - 1] + 1
            row[j] = min(best, up, back)
        rows.append(row)
    kept, i, j = [], n, m
    while i and j:
        here = rows[i][j]
        if here == rows[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            if x[i - 1] == y[j - 1]:
                kept.append(i - 1)
            i, j = i - 1, j - 1
        elif here == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return rows[n][m], kept


def covered(passage: list[int], grams: dict, doc: list[int], positions: Sequence[int], stretch: int = STRETCH) -> int:
    """How many words of the passage are reproduced in stretches of ``doc`` with at most a third of their words edited."""
    mark: set[int] = set()
    for a, b, c, d in stretches(grams, doc, positions, stretch):
        edits, kept = aligned(passage[a:b], doc[c:d])
        if edits <= EDITED * (b - a) and len(kept) >= stretch:
            mark.update(a + i for i in kept)
    return len(mark)


def local(passage: Sequence[int], doc: Sequence[int]) -> int:
    """Words of a short passage that a running stretch of ``doc`` keeps. Up to seven words: all less the least edits of the whole
    passage. More: local alignment, a kept word for 1, an edit for -2."""
    if len(passage) < 2 * SHORT_WINDOW:
        last = [0] * (len(doc) + 1)
        for i, w in enumerate(passage, 1):
            row = [i]
            for j, v in enumerate(doc):
                row.append(min(last[j] + (w != v), last[j + 1] + 1, row[j] + 1))
            last = row
        return len(passage) - min(last)
    zero = best = (0, 0)
    last = [zero] * (len(doc) + 1)
    for w in passage:
        row = [zero]
        for j, v in enumerate(doc):
            s, k = last[j]
            here = (s + 1, k + 1) if w == v else (s - 2, k)
            here = max(here, (last[j + 1][0] - 2, last[j + 1][1]), (row[j][0] - 2, row[j][1]), zero)
            row.append(here)
            best = max(best, here)
        last = row
    return best[1]


def wanted(n: int) -> int:
    """Kept words that make a case of a short passage of n words: all but one, from eight words on a stretch; under five all."""
    return n if n < 5 else min(STRETCH, n - 1)


def _search(index: Index, share: float, short: bool = False):
    w = index.window
    evidence = 1 if short else EVIDENCE

    passages = [p.tolist() for p in index.passages]

    def leaks(texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text's number, item, share) of the verified pairs of some texts."""
        get = index.vocabulary.get
        parts, lengths = [], []
        for t in texts:
            ws = words(t) if t else []
            parts.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
            parts.append(np.zeros(w, np.int32))
            lengths.append(len(ws) + w)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        ends = np.cumsum(lengths)
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        in_window = known[w:] - known[:-w] if len(flat) >= w else np.zeros(0, int)
        starts = np.flatnonzero(in_window >= w - index.radius)
        at, passage = index.candidates(flat, starts)
        pairs: list[tuple[int, int, list[int]]] = []
        if len(at):
            key = np.searchsorted(ends, at, "right") * len(index.ids) + passage
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            for f, n in zip(first[size >= evidence].tolist(), size[size >= evidence].tolist()):
                d, p = divmod(int(key[f]), len(index.ids))
                pairs.append((d, p, np.unique(at[f : f + n]).tolist()))
        out = []
        lists: dict[int, tuple[list[int], int]] = {}
        for d, p, where in pairs:
            if d not in lists:
                begin = int(ends[d - 1]) if d else 0
                lists[d] = (flat[begin : ends[d]].tolist(), begin)
            doc, begin = lists[d]
            size = len(index.passages[p])
            # around the hits, everywhere the passage could go on
            look: list[int] = []
            upto = 0
            for s in where:
                a, b = max(upto, s - begin - size - 2 * w), min(len(doc) - 2, s - begin + size + 2 * w)
                look.extend(range(a, b))
                upto = max(upto, b)
            if short:
                n = max(local(passages[p], doc[max(0, s - begin - size - 2) : s - begin + size + w + 2]) for s in where)
                good = n >= max(wanted(size), share * size)
            else:
                n = covered(passages[p], index.grams[p], doc, look)
                good = n >= share * size
            if good:
                out.append((d, index.ids[p], n / size))
        for size, table in index.short.items():
            for s in np.flatnonzero(known[size:] - known[:-size] == size).tolist() if len(flat) >= size else ():
                for p in table.get(tuple(flat[s : s + size].tolist()), ()):
                    out.append((int(np.searchsorted(ends, s, "right")), index.ids[p], 1.0))
        return out

    return leaks


def searches(items: Sequence[tuple[int, str]], share: float) -> list:
    """A search for the long passages and one for the short ones, if there are any."""
    n = [len(words(p)) for _, p in items]
    long, short = [x for x, k in zip(items, n) if k >= LONG], [x for x, k in zip(items, n) if k < LONG]
    return ([_search(Index(long), share)] if long else []) + ([_search(Index(short, SHORT_WINDOW, REPEATS, SHORT_SAMPLED), share, True)] if short else [])


_OUT = "doc_id bigint, item_id bigint, share double"


def _scan(broadcast, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = searches(broadcast.value, share)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                rows = [r for leaks in each for r in leaks(texts)]
                cols = list(zip(*[(ids[d], i, s) for d, i, s in rows])) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "share"])

    return run


def item_blocks(items: DataFrame, item_id: str, passage: str, block_words: int = ITEM_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Items with a passage, streamed to the driver in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, p in items.select(col(item_id).cast("bigint"), col(passage)).where(F.length(F.trim(col(passage))) > 0).toLocalIterator():
        n = len(p) // 4 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((i, p))
        size += n
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", share: float = SHARE, block_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, share): documents that reproduce at least ``share`` of the words of an item's passage in running stretches.

    Defined cases: null or blank texts and passages - no result; a passage of fewer than five words - must occur in full, word for word,
    one of five to seven with one word edited at most; repeated documents - one row each; items with equal passages - one row each; empty tables - no rows; further columns are ignored.
    """
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).where("text is not null")
    out = None
    for block in item_blocks(items, item_id, passage, block_words):
        one = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), share), _OUT)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], _OUT)
