"""Filling containers of fixed capacity with documents, sizes in tokens of a public tokenizer.

1. Documents are tokenised where they are read; only (id, hash of the text, tokens) goes on.
2. A hash of these deals the documents into pools of about POOL documents. The pool of a document does not depend on how the
   input is partitioned, nor do the containers made from it.
3. Karmarkar-Karp multiway differencing fills a pool's windows: partial partitions of opposing imbalance are merged until one
   partition into k parts of nearly equal load is left. k starts at a lower bound. Parts within the capacity and nearly full are
   closed; the items of all others are differenced again, and k rises by what exceeds the capacity. Every item is placed by
   differencing.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import col, cut

#: Where the public tokenizers lie, and the one that is used.
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents of a pool (on average), and containers a pool fills at least: a pool leaves one container partly filled.
POOL = 1024
WINDOWS = 50
#: Share of the capacity that a window may leave empty when it is closed before the last round.
SLACK = 0.05
#: Budgets that are packed in one pass over the sizes.
BUDGETS = 256
#: How the tokenizer splits text before merging bytes (a fixed value of this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    """A byte-level BPE encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """Containers needed at least: for each threshold a, items over capacity - a need one each, the rest of the items of at
    least a must fit into what those over half leave (sizes in falling order)."""
    n = len(sizes)
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    falling = [-s for s in sizes]
    half = bisect_left(falling, -capacity / 2)  # items over half the capacity
    best = -(-prefix[-1] // capacity)
    for a in {s for s in sizes if 2 * s <= capacity}:
        big = bisect_left(falling, -(capacity - a))  # over capacity - a
        end = n - bisect_left([*map(int.__neg__, falling[::-1])], a)  # at least a
        mid = half - big
        room = mid * capacity - (prefix[half] - prefix[big])
        small = prefix[end] - prefix[half]
        best = max(best, half + max(0, -(-(small - room) // capacity)))
    return max(best, half)


def difference(sizes: Sequence[int], k: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: ``sizes`` (falling) in at most k parts of nearly equal sums: (sum, indexes) of each part that is not empty.

    A partial partition is a list of parts in falling order, padded with empty ones to k. The two with the largest spread are
    merged, largest part with smallest, until one is left.
    """
    tick = count()
    heap = [(-s, next(tick), [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            if b[0][0] <= a[-1][0]:
                a.extend(b)
            else:
                a = sorted(a + b, key=_load)
        else:
            # the last `over` of a meet the last of b, smallest of a with largest of b
            n = len(b)
            met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(b[n - over :]))]
            a = sorted(a[: len(a) - over] + b[: n - over] + met, key=_load)
        spread = a[0][0] - (a[-1][0] if len(a) >= k else 0)
        heapq.heappush(heap, (-spread, next(tick), a))
    return heap[0][2] if heap else []


def _load(part: tuple[int, list[int]]) -> int:
    return -part[0]


def pack(sizes: Sequence[int], capacity: int, separator: int) -> list[list[int]]:
    """Indexes of ``sizes`` (each at most ``capacity``, in falling order) per container; between two items of a container lie
    ``separator`` tokens."""
    room = capacity + separator
    loads = [s + separator for s in sizes]
    done: list[list[int]] = []
    rest, more = list(range(len(loads))), 0
    while rest:
        mine = [loads[i] for i in rest]
        parts = difference(mine, lower_bound(mine, room) + more)
        over = sum(s - room for s, _ in parts if s > room)
        closed = [items for s, items in parts if s <= room and (not over or s >= room * (1 - SLACK))]
        if not closed:
            more += max(1, -(-over // room))
        done += [[rest[i] for i in items] for items in closed]
        gone = {i for items in closed for i in items}
        rest = [x for i, x in enumerate(rest) if i not in gone]
    return done


_SIZED = "doc_id bigint, h bigint, n bigint"


def _measure(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        enc = tokenizer(tokenizer_path)
        for b in batches:
            rows = []
            texts = b.column(1)
            for i, doc in enumerate(b.column(0).to_pylist()):
                text = texts[i].as_py()
                if text is not None and text.strip():
                    rows.append((doc, xxhash.xxh64_intdigest(text) - (1 << 63), len(enc.encode_ordinary(text))))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "h", "n"])

    return run


def document_sizes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """(doc_id, h, n): the hash of the text and its tokens, of documents that are not blank."""
    return docs.select(col(doc_id).cast("bigint"), col(text)).where(col(text).isNotNull()).mapInArrow(_measure(tokenizer_path), _SIZED)


_OUT = "budget_id int, container_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint, container_tokens bigint"


def _fill(budgets: dict[int, tuple[int, int]]):
    def run(pool: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        budget, number = pool.column("budget")[0].as_py(), pool.column("pool")[0].as_py()
        capacity, separator = budgets[budget]
        docs = zip(*(pool.column(c).to_pylist() for c in ("n", "doc_id", "h", "copy")))
        name = (f"{budget}-{number}-{c}" for c in count())
        items: list[tuple] = []
        # an order that follows from the contents alone; null ids first
        for n, doc, *_ in sorted(docs, key=lambda d: (-d[0], d[1] is not None, d[1], *d[2:])):
            full, rest = divmod(n, capacity) if n > capacity else (0, n)
            rows += [(budget, next(name), doc, p, p * capacity, capacity, capacity) for p in range(full)]
            if rest:
                items.append((doc, full, full * capacity, rest))
        items.sort(key=lambda x: -x[3])
        for members in pack([x[3] for x in items], capacity, separator):
            used = sum(items[i][3] for i in members) + separator * (len(members) - 1)
            c = next(name)
            rows += [(budget, c, *items[i], used) for i in members]
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def pack_sizes(sizes: DataFrame, budgets: Sequence[tuple[int, int, int]], pool: int = POOL) -> DataFrame:
    """``pack_documents`` over documents whose sizes are known (doc_id, h, n)."""
    for b, capacity, separator in budgets:
        if capacity < 1 or separator < 0:
            raise ValueError(f"budget {b}: the capacity must be at least 1 and the separator at least 0")
    spark = sizes.sparkSession
    # equal rows are told apart by a number, so that many of them do not meet in one pool
    each = cut(sizes.groupBy("doc_id", "h", "n").agg(F.count(F.lit(1)).alias("copies")))
    total = each.agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("n")).alias("tokens")).first()
    out = None
    for at in range(0, len(budgets), BUDGETS):
        some = budgets[at : at + BUDGETS]
        pools = [max(1, min((total["rows"] or 0) // pool, (total["tokens"] or 0) // (c * WINDOWS))) for _, c, _ in some]
        per = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget"), F.lit(p).cast("bigint").alias("pools")) for (b, _, _), p in zip(some, pools)])).alias("b")
        dealt = each.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select("*", per)
        dealt = dealt.select("b.budget", F.pmod(F.xxhash64("doc_id", "h", "copy"), F.col("b.pools")).alias("pool"), "doc_id", "h", "n", "copy")
        # a number of partitions of its own: the rows are few bytes, but filling them takes time
        tasks = max(1, min(sum(pools), 4 * spark.sparkContext.defaultParallelism))
        one = dealt.repartition(tasks, "budget", "pool").groupBy("budget", "pool").applyInArrow(_fill({b: (c, s) for b, c, s in some}), _OUT)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], _OUT)


def pack_documents(docs: DataFrame, budgets: Sequence[tuple[int, int, int]], *, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str = f"{TOKENIZERS}/{TOKENIZER}", pool: int = POOL) -> DataFrame:
    """Every document's place in the containers of every budget (id, capacity, separator):
    (budget_id, container_id, doc_id, piece, start_token, n_tokens, container_tokens).

    A document is split only if it alone exceeds the capacity: into full containers and a rest that is packed like a document.
    The result follows from the documents alone, however the input is partitioned or ordered.
    Defined cases: null or blank text - in no container; repeated rows - packed each by itself; a null id - kept as it is;
    empty table - no rows; a capacity under 1 or a negative separator - an error; further columns are ignored.
    """
    return pack_sizes(document_sizes(docs, doc_id=doc_id, text=text, tokenizer_path=tokenizer_path), budgets, pool)
