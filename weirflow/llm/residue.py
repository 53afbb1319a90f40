"""Template residue and error-page text: trusted labels spread over near-duplicates and over what residue shares.

1. One pass reads every document as masked segments (``residue_text``), whose hashes, with a key and a 64-bit SimHash of the masked
   word five-shingles, go on; equal masked texts are one node.
2. Trusted labels: segments that begin with one of SEEDS or with a notice or filler by what it is about (``residue_notices``), and the
   families of mock Latin, mashed keys and repeated words.
3. Labels spread over the graph of documents and the segments they share, until a round adds none: a segment joins that stands in
   the company of labelled ones in at least two different texts and in a quarter of all texts that have it. So the notices of a
   site lead to each other and to its menus and footers, and no list of them is needed.
4. A document all but a few words of which are labelled is residue. Documents that run segments together without a mark are
   covered by the labelled segments' words instead.
5. Partitioned SimHash tables: the signature is cut into 8 blocks of neighbouring bits, and twice more after its bits have been put
   in another order; each pair of blocks of a cut is the key of a table (84 tables). Nodes without label meet residue nodes that share a
   key, in any table; pairs too far in Hamming distance or size are dropped within the join. At likeness 0.8 about 15 % of the bits
   differ and more than nine pairs in ten meet, at 0.9 practically all. The texts of the pairs left are compared: Jaccard likeness of their
   masked five-shingles of at least 0.8 makes a link. Labels spread over links, round by round from the newly labelled nodes, until
   a round adds none: the connected components of the near-duplicate graph that hold residue.

Unfilled slots are found by ``residue_rules``: a slot is one mark in text of its own, and its nearest near-duplicate is the same
text filled, so likeness cannot tell them apart.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.skew import join_to_unique
from weirflow.session import col, cut

from .residue_notices import LONGEST, is_notice, may_be_notices
from .residue_rules import has_slot
from .residue_text import END, HEADING, NUMBER, QUOTE, Memo, family_of, kinds, masked, masks, read, size, tokens_of

#: Beginnings of segments that are trusted to be residue, masked (``0``: a number, ``js``: any word for scripts); fixed values.
SEEDS = (
    "page not found", "0 not found", "internal server error", "access denied", "please enable js", "your browser does not support js", "this is sample text",
    "seite nicht gefunden", "zugriff verweigert", "bitte aktivieren sie js", "dies ist ein blindtext",
    "page introuvable", "accès refusé", "veuillez activer js", "ceci est un faux texte",
    "página no encontrada", "acceso denegado", "por favor active js", "este es un texto de relleno",
)
#: Words a segment may have beside the trusted ones.
BESIDE = 14
FAMILIES = ("lat", "key", "rep")
#: A segment joins if it keeps labelled company in so many texts, and in this share of the texts that have it; company is kept where
#: at least COMPANY of a text's other words are labelled, and the segment is no more than LONGER times as long as they are.
SUPPORT = 2
PURITY = 0.25
COMPANY = 0.25
LONGER = 4
#: Words without label that a residue text may have: so many, or this share of the labelled ones.
FREE = 5
FREE_SHARE = 0.3
SHINGLE = 5
SIMILARITY = 0.8
#: Texts further apart than this in their 64 bits are not compared. At likeness 0.8 about 9 bits differ.
HAMMING = 18
BLOCKS = 8
#: Ids or hashes (8 bytes each) up to which a side is broadcast; beyond, the join is a shuffle.
BROADCAST_IDS = 1_000_000
#: Words of labelled segments that are looked for in one pass over the texts; more take more passes.
DICTIONARY_WORDS = 2_000_000
#: Segments that are remembered, and looked at together for notices.
SEGMENTS = 200_000
#: Words after which the signatures of the texts so far are made.
GROUP = 30_000
#: Candidates of a node that are compared first, the nearest in Hamming distance; the others only if none of these is a link.
NEAREST = 16
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes() -> Memo:
    """Hashes of words; that of None, which fills up short texts, is 0."""
    import xxhash

    return Memo(lambda w: 0 if w is None else xxhash.xxh64_intdigest(w))


def shingle_hashes(words: list[str | None], memo: Memo) -> np.ndarray:
    """64-bit hashes of the shingles of five words; a shorter text is one shingle."""
    if len(words) < SHINGLE:
        words = [*words, *[None] * (SHINGLE - len(words))]
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    hashes ^= hashes >> np.uint64(31)
    n = len(hashes) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out += hashes[j : j + n] * _MULTIPLIERS[j]
        out ^= out >> np.uint64(29)
    return out * _MULTIPLIERS[0]


def shingle_sets(words: list[str | None], lengths: list[int], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``shingle_hashes`` of many texts at once, one text after the other, and how many each has. ``words``: those of all
    texts, of each at least as many as a shingle has; ``lengths``: how many of them each text has."""
    shingles = shingle_hashes(words, memo)
    end = np.cumsum(lengths)
    begin = end - lengths
    for a, b in zip(begin.tolist(), (end - SHINGLE + 1).tolist()):
        shingles[a:b].sort()
    keep = np.append(True, shingles[1:] != shingles[:-1])
    keep[begin] = True
    # what spans two texts is no shingle
    keep[(end[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    return shingles[keep], np.add.reduceat(keep, begin, dtype=np.int64)


#: The signature's bits as they stand, with those side by side that are eight apart, and in the order of 29 times their place.
CUTS = ("sig", "turned", "mixed")
_ORDERS = (np.arange(64), np.arange(64).reshape(8, 8).T.ravel(), np.arange(64) * 29 % 64)


def simhash(shingles: np.ndarray) -> tuple[int, int, int]:
    """The majority of each bit over the shingles (distinct ones), as a signed 64-bit number, in the orders of the cuts."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    most = np.add.reduce(bits, 0, np.int32) * 2 > len(bits)
    return tuple(int(np.packbits(most[o]).view(np.int64)[0]) for o in _ORDERS)


def simhashes(sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """``simhash`` of many texts at once."""
    if not sets:
        return []
    return _majorities(np.concatenate(sets), np.array([len(x) for x in sets]))


def _majorities(shingles: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    # eight bits are counted in one number, a byte each, so up to 255 shingles at a time
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counts = np.add.reduceat(bits.view(np.uint64), at, 0).view(np.uint8)
    most = np.add.reduceat(counts, first, 0, np.int32) * 2 > sizes[:, None]
    return list(zip(*(np.ascontiguousarray(np.packbits(most[:, o], axis=1)).view(np.int64)[:, 0].tolist() for o in _ORDERS)))


def _signatures(words: list[str | None], lengths: list[int], memo: Memo) -> list[tuple[int, int, int, int]]:
    """``simhash`` and the number of distinct shingles of each text."""
    shingles, sizes = shingle_sets(words, lengths, memo)
    return [(*signs, n) for signs, n in zip(_majorities(shingles, sizes), sizes.tolist())]


_SIGNED = "doc_id bigint, key string, sig bigint, turned bigint, mixed bigint, shingles int, slot boolean, same bigint, words int, segs array<bigint>, ns array<int>, trusted array<bigint>"


_HALF = 1 << 63


def hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - _HALF


def is_seed(segment: str) -> bool:
    if segment in FAMILIES or is_notice(segment.split(" "), segment):
        return True
    return segment.startswith(SEEDS) and any(segment == s or (segment.startswith(s + " ") and segment.count(" ") - s.count(" ") <= BESIDE) for s in SEEDS)


def seeds(segments: list[str]) -> list[str]:
    """Those of the segments that are trusted."""
    return [s for s, may in zip(segments, may_be_notices(segments)) if (may or s.startswith(SEEDS) or s in FAMILIES) and is_seed(s)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    memo, suspect, hashes = masks(), kinds(), word_hashes()
    of, whole = xxhash.xxh64_intdigest, xxhash.xxh128_hexdigest
    # segments not looked at yet that are short enough for a notice (and so for SEEDS with BESIDE), and the hashes of trusted ones
    fresh: list[str] = []
    trusted: set[int] = set()

    def segment(s: str) -> tuple[str, int, int, bool, bool]:
        f = family_of(s, suspect)
        t, quoted = f or s, not f and QUOTE in s
        if not quoted and t.count(" ") < LONGEST:
            fresh.append(t)
        return t, size(s), of(t) - _HALF, quoted, t in FAMILIES

    def look() -> None:
        trusted.update([of(t) - _HALF for t in seeds(fresh)])
        fresh.clear()

    segments = Memo(segment, SEGMENTS)
    for b in batches:
        rows, signs, words, lengths = [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text.strip():
                continue
            if len(words) > GROUP:
                signs += _signatures(words, lengths, hashes)
                words, lengths = [], []
            if len(fresh) > SEGMENTS:
                look()
            mine: dict[int, int] = {}
            shown: list[str] = []
            order: list[int] = []
            others = 0
            for t, n, h, quoted, of_family in map(segments.__getitem__, masked(text, memo)):
                shown.append(t)
                order.append(h)
                if quoted:
                    others += n
                elif n:
                    # a line over and over counts once, but a family's lines differ
                    mine[h] = mine.get(h, 0) + n if of_family else n
            # a text of nothing but marks is told by its characters
            flat = " ".join(shown).split(" ") if shown else [text]
            flat += [None] * (SHINGLE - len(flat))
            words += flat
            lengths.append(len(flat))
            key = whole(np.array(order, np.int64).tobytes() if order else text)
            rows.append((doc, key, has_slot(text), of(" ".join(text.lower().split())) - _HALF, others + sum(mine.values()), list(mine), list(mine.values())))
        if lengths:
            signs += _signatures(words, lengths, hashes)
        look()
        rows = [(*r[:2], *g, *r[2:], [] if trusted.isdisjoint(r[5]) else [h for h in r[5] if h in trusted]) for r, g in zip(rows, signs)]
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        cols = list(zip(*rows)) or [[]] * 12
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _SIGNED.split(", ")])


def signed(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, text) that are not blank: key and signature of the masked text, distinct shingles, whether a slot is
    unfilled, words, and the hashes, words and trusted ones of the segments."""
    return docs.where("text is not null").mapInArrow(_sign, _SIGNED)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows as the side of a join: broadcast if that is little."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def spread_segments(all_: DataFrame) -> DataFrame:
    """(h, trusted): the labelled segments, from the trusted ones on."""
    exploded = all_.select("key", "words", F.explode(F.arrays_zip("segs", "ns")).alias("s")).select("key", "words", F.col("s.segs").alias("h"), F.col("s.ns").alias("n"))
    labelled = cut(all_.select(F.explode("trusted").alias("h")).distinct().withColumn("trusted", F.lit(True)))
    while known := labelled.count():
        touched = cut(exploded.join(small(labelled.select("h"), known), "h", "left_semi").select("key").distinct())
        # the touched texts with all their segments, equal texts once
        inside = exploded.join(small(touched, touched.count()), "key", "left_semi").distinct().join(small(labelled, known), "h", "left")
        inside = cut(inside.select("key", "words", "h", "n", F.col("trusted").isNotNull().alias("has")))
        got = inside.groupBy("key").agg(F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)).alias("got"))
        company = inside.where("not has").join(got, "key").where(f"got >= {COMPANY} * (words - n) and n <= {LONGER} * got").groupBy("h").agg(F.count(F.lit(1)).alias("kept")).where(f"kept >= {SUPPORT}")
        company = cut(company)
        found = company.count()
        if not found:
            break
        of = exploded.join(small(company, found), "h").select("h", "key", "kept").distinct().groupBy("h", "kept").agg(F.count(F.lit(1)).alias("of"))
        new = cut(of.where(f"kept >= {PURITY} * of").select("h", F.lit(False).alias("trusted")))
        if new.isEmpty():
            break
        labelled = cut(labelled.unionByName(new))
    return labelled


#: Words for scripts that are masked together with a neighbour, and the marks around a word.
SCRIPTS = {"js", "java", "javascript", "script", "scripts", "scripting", "client-side", "browser"}
PUNCTUATION = ".,:;!?|()[]-–—•*'’"


def said(labelled: Column, words: Column) -> Column:
    """Whether all that a text says is residue."""
    return (labelled > 0) & (words - labelled <= F.greatest(F.lit(FREE), FREE_SHARE * labelled))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, suspect = masks(), kinds()
    for b in batches:
        found = {t: " ".join(tokens) for text in b.column(0).to_pylist() for t, n, tokens in read(text, memo, suspect) if t and n}
        yield pa.RecordBatch.from_arrays([pa.array([hashed(t) for t in found], pa.int64()), pa.array(list(found.values()), pa.string())], ["h", "tokens"])


def dictionary(all_: DataFrame, rows: DataFrame, labelled: DataFrame) -> Iterator[list[str]]:
    """The labelled segments' tokens, in blocks of bounded size."""
    with_them = all_.select("doc_id", F.explode("segs").alias("h")).join(small(labelled.select("h"), labelled.count()), "h", "left_semi").select("doc_id").distinct()
    ids = cut(with_them.withColumnRenamed("doc_id", "id"))
    texts = rows.join(small(ids, ids.count()), F.col("doc_id") == F.col("id"), "left_semi").select("text")
    block: list[str] = []
    words = 0
    for (t,) in texts.mapInArrow(_texts, "h bigint, tokens string").join(labelled.select("h"), "h", "left_semi").dropDuplicates(["h"]).select("tokens").toLocalIterator():
        n = t.count(" ") + 1
        if block and words + n > DICTIONARY_WORDS:
            yield block
            block, words = [], 0
        block.append(t)
        words += n
    if block:
        yield block


class Cover:
    """Where the segments of a dictionary stand in masked tokens, the longest first."""

    def __init__(self, segments: list[str]):
        self.whole = {tuple(s.split(" ")) for s in segments}
        self.lengths: dict[str, list[int]] = {}
        for s in self.whole:
            self.lengths.setdefault(s[0], []).append(len(s))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}
        #: Whether a word as it stands in a text may be one of the dictionary's.
        words = {w for s in self.whole for w in s} | {NUMBER} | SCRIPTS
        self.known = Memo(lambda w: all(t in words or t == END for t in tokens_of(w.strip(PUNCTUATION))))

    def may(self, text: str) -> bool:
        """Cheap test that refuses no text that the dictionary covers but for a few words."""
        if "<" in text or "&lt;" in text:
            return True
        raw = (HEADING.sub("", text) if "#" in text else text).lower().split()
        free = len(raw) - sum(map(self.known.__getitem__, raw))
        return free <= max(2 * FREE, FREE_SHARE * len(raw))

    def positions(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        i = 0
        while i < len(tokens):
            for n in self.lengths.get(tokens[i], ()):
                if i + n <= len(tokens) and tuple(tokens[i : i + n]) in self.whole:
                    out += range(i, i + n)
                    i += n
                    break
            else:
                i += 1
        return out


def _cover(broadcast, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(broadcast.value)
        memo, suspect = masks(), kinds()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if whole and not cover.may(text):
                    continue
                segments = read(text, memo, suspect)
                at, base, words = [], 0, 0
                for t, n, tokens in segments:
                    words += n
                    if t:
                        at += [base + i for i in cover.positions(tokens) if tokens[i] != NUMBER]
                    base += len(tokens)
                if at:
                    rows.append((doc, hashed(text), words, at))
            cols = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "h", "words", "at"])

    return run


def covered(rows: DataFrame, blocks: Iterator[list[str]]) -> DataFrame | None:
    """(doc_id): documents whose words, in running text, are those of labelled segments but for a few. The rows of several blocks
    of the dictionary are united by document."""
    out = None
    first, more = next(blocks, None), next(blocks, None)
    for block in itertools.chain([b for b in (first, more) if b], blocks):
        one = rows.mapInArrow(_cover(rows.sparkSession.sparkContext.broadcast(block), more is None), "doc_id bigint, h bigint, words int, at array<int>")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    each = out.groupBy("doc_id", "h", "words").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"))
    return each.where(said(F.col("n"), F.col("words"))).select("doc_id").distinct()


def tables(nodes: DataFrame) -> DataFrame:
    """Each node once per table: ``bucket`` is the table and the two blocks that are its key."""
    size, keys = 64 // BLOCKS, []
    for sig in CUTS:
        block = [F.call_function("shiftrightunsigned", F.col(sig), F.lit(size * i)).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")) for i in range(BLOCKS)]
        keys += [F.lit((len(keys) + t) << (2 * size)).cast("bigint") + block[i] * (1 << size) + block[j] for t, (i, j) in enumerate(itertools.combinations(range(BLOCKS), 2))]
    return nodes.select("*", F.explode(F.array(*keys)).alias("bucket"))


def _band(n: str) -> Column:
    """Sizes within SIMILARITY of each other lie in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(1 / SIMILARITY))).cast("int")


def near_pairs(left: DataFrame, right: DataFrame, rights: int | None = None) -> DataFrame:
    """Pairs (a, b, far) of nodes (rep, sig, turned, mixed, shingles) of either side that share a bucket and are close in Hamming distance
    (``far``) and size. The size is part of the bucket's key. If ``right`` has few nodes (``rights``), its buckets are broadcast."""
    l = tables(left).select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("shingles").alias("na"), "bucket", _band("shingles").alias("band"))
    r = tables(right).select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("shingles").alias("nb"), F.col("bucket").alias("bucket_"), F.explode(F.array(*[_band("shingles") + d for d in (-1, 0, 1)])).alias("band_"))
    if rights is not None:
        r = small(r, rights * 3 * len(CUTS) * math.comb(BLOCKS, 2))
    far = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    near = (far <= HAMMING) & (F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    return l.join(r, (F.col("bucket") == F.col("bucket_")) & (F.col("band") == F.col("band_")) & near).select("a", "b", far.alias("far")).distinct()


def reached(rest: DataFrame, grown: DataFrame, rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """The nodes of ``rest`` in the near-duplicate components of the nodes ``grown``, and those that are in none."""
    near = None
    while n := grown.count():
        # at most a hundred bands
        bands = grown.select(F.explode(F.array(*[_band("shingles") + d for d in (-1, 0, 1)])).alias("band")).distinct()
        pairs = cut(near_pairs(rest.join(F.broadcast(bands), _band("shingles") == F.col("band"), "left_semi"), grown, n))
        if pairs.isEmpty():
            break
        hit = linked(pairs, rows)
        grown = cut(rest.join(hit, F.col("rep") == F.col("hit"), "left_semi"))
        if grown.isEmpty():
            break
        near = grown if near is None else near.unionByName(grown)
        rest = cut(rest.join(grown.select(F.col("rep").alias("gone")), F.col("rep") == F.col("gone"), "left_anti"))
    return near, rest


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, suspect, hashes = masks(), kinds(), word_hashes()
    for b in batches:
        sets = [np.unique(shingle_hashes([w for _, _, tokens in read(t, memo, suspect) for w in tokens] or [t], hashes)).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "set"])


def alike(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of candidate pairs (a, b), those whose texts have at least that Jaccard likeness of five-shingles. Only the texts of the pairs are read on."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.where("text is not null").join(small(ids, ids.count()), F.col("doc_id") == F.col("id")).select("doc_id", "text")
    sets = texts.mapInArrow(_shingled, "doc_id bigint, set array<bigint>").dropDuplicates(["doc_id"])
    j = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return j.where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def linked(pairs: DataFrame, docs: DataFrame, nearest: int | None = None) -> DataFrame:
    """(hit): the nodes a of candidate pairs (a, b, far) that have a link. One link is enough, so the nearest candidates are
    compared first; nodes without one among them are compared with all others, so none is missed."""
    nearest = NEAREST if nearest is None else nearest
    rank = F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))
    first = cut(alike(pairs.withColumn("r", rank).where(f"r <= {nearest}").select("a", "b"), docs).select(F.col("a").alias("hit")).distinct())
    more = cut(pairs.withColumn("r", rank).where(f"r > {nearest}").join(first, F.col("a") == F.col("hit"), "left_anti").select("a", "b"))
    return first if more.isEmpty() else first.unionByName(alike(more, docs).select(F.col("a").alias("hit")).distinct())


def residue(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reason) of the documents that are residue: ``slot`` - running text with an unfilled slot or a bare stand-in; else a
    body that is filler, an error or block page or a notice about scripts: ``seed`` - by trusted segments alone, ``near`` -
    near-duplicate of such a text, directly or by way of others, ``spread`` - by segments that labels spread to.

    Defined cases: null or blank text - no residue; repeated documents - one row each; very long texts - read whole; empty
    table - no rows; further columns are ignored. Several documents of one id: the texts that decide on likeness are those of the id.
    """
    rows = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).where("text is not null")
    all_ = cut(signed(rows))
    labelled = spread_segments(all_)
    known = labelled.count()
    segs = all_.where("not slot").select("doc_id", "key", "words", F.explode(F.arrays_zip("segs", "ns")).alias("s")).select("doc_id", "key", "words", F.col("s.segs").alias("h"), F.col("s.ns").alias("n"))
    nodes = all_.where("not slot").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in (*CUTS, "shingles")])
    told = segs.distinct().join(small(labelled, known), "h").groupBy("doc_id", "key", "words")
    told = told.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("trusted"), F.col("n")).otherwise(0)).alias("own"))
    told = told.where(said(F.col("n"), F.col("words"))).groupBy("key").agg(F.max(said(F.col("own"), F.col("words"))).alias("own"))
    told = cut(told)
    bodies = told.select("key", F.when(F.col("own"), "seed").otherwise("spread").alias("reason"))
    run_on = covered(rows, dictionary(all_, rows, labelled)) if known else None
    if run_on is not None:
        bodies = bodies.unionByName(all_.where("not slot").join(run_on, "doc_id", "left_semi").select("key", F.lit("spread").alias("reason")))
    bodies = cut(bodies.groupBy("key").agg(F.min("reason").alias("reason")))
    nodes = cut(nodes.join(bodies, "key", "left"))
    near, _ = reached(nodes.where("reason is null").drop("reason"), nodes.where("reason is not null").drop("reason"), rows)
    reasons = bodies if near is None else bodies.unionByName(near.select("key", F.lit("near").alias("reason")))
    # the label of a slot stays with texts of the same words in other lines
    slots = cut(all_.where("slot").select("same").distinct())
    slots = small(slots, slots.count())
    body = all_.join(slots, "same", "left_anti").select("doc_id", "key")
    body = join_to_unique(body, reasons.select(F.col("key").alias("of"), "reason"), "key", "of").where("of is not null").select("doc_id", "reason")
    return all_.join(slots, "same", "left_semi").select("doc_id", F.lit("slot").alias("reason")).unionByName(body)
