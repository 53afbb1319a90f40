"""Parent-child rows to full hierarchies: path, depth, top, descendants, cycles.

Level-wise frontier joins from the roots: a level joins the nodes reached last to the edges by parent, which extends root, depth
and path; only the frontier meets the edges, never all that has been reached. Once levels are thin beside what is open - what
is left are chains far deeper than wide, or leads into cycles - one join a level would be one round for a few nodes; the rest then
goes on in bands: each open node's link jumps over 1, 2, 4, ... levels, so a chain of depth D takes log2(D) further rounds. Nodes
that no round reaches lead into a cycle; those that a long enough jump lands on are the cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import join_to_unique

#: A level that reaches less than this share of the open nodes is thin: from there on, bands.
THIN = 0.125
#: Nodes of a frontier up to which it is broadcast to the edges (an id and a root each, without paths); beyond, the join is a shuffle.
BROADCAST_FRONTIER = 100_000


def links(df: DataFrame, node: str, parent: str, order: list | None = None) -> DataFrame:
    """(node, parent) with one row per node; of several rows the one with a parent and the least parent counts."""
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where("node is not null")
    return rows.groupBy("node").agg(F.min("parent").alias("parent"))


def hierarchy(edges: DataFrame, *, with_paths: bool = True, hot_rows: int = 200_000, thin: float = THIN) -> DataFrame:
    """One row per node of ``edges`` (node string, parent string; one row per node, null parent = a top):

    ``node``, ``parent``, ``state``, ``root``, ``depth`` (a top has 0), ``path`` (array from the top to the node, if
    ``with_paths``). ``state`` is ``rooted``, ``missing_parent`` (its own parent is no node; it is then taken as a top),
    ``on_cycle`` or ``below_cycle`` (both without root, depth and path). A node that names itself is a cycle of one.
    ``thin`` of 0 goes level by level to the end. Empty table - no rows.
    """
    known = edges.select(F.col("node").alias("known"))
    e = join_to_unique(edges.select("node", "parent"), known, "parent", "known", hot_rows=hot_rows)
    e = cut(e.select("node", "parent", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("missing"), F.col("known").alias("up")))
    none = F.lit(None).cast("array<string>")
    seg = (lambda *parts: F.concat(*parts)) if with_paths else (lambda *parts: none)
    tops = e.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), seg(F.array("node")).alias("path"))
    frontier = cut(tops)
    done = [frontier]
    open_ = e.where("up is not null").select("node", "up")
    left = open_.count()
    n, depth = frontier.count(), 0
    while left and n and (depth == 0 or n >= thin * left):
        depth += 1
        above = frontier.select(F.col("node").alias("at"), "root", "path")
        # each frontier node has one row here, so a parent of very many children is on the edges' side
        joined = open_.join(F.broadcast(above), F.col("up") == F.col("at")) if n <= BROADCAST_FRONTIER and not with_paths else join_to_unique(open_, above, "up", "at", hot_rows=hot_rows, rows=left).where("at is not null")
        frontier = cut(joined.select("node", "root", F.lit(depth).cast("bigint").alias("depth"), seg(F.col("path"), F.array("node")).alias("path")))
        n = frontier.count()
        left -= n
        done.append(frontier)
    if left and n:
        done, lost = _bands(open_, done, frontier, depth, left, seg, none, hot_rows)
    elif left:
        # levels have no gaps: an empty one shows that all nodes left lead into cycles
        reached = reduce(DataFrame.unionByName, done).select(F.col("node").alias("gone"))
        lost = _cycles(open_.join(reached, F.col("node") == F.col("gone"), "left_anti"), left, hot_rows)
    else:
        lost = open_.where("false").select("node", F.lit("").alias("lost"))
    tree = reduce(DataFrame.unionByName, done)
    out = e.select("node", "parent", "missing").join(tree, "node", "left").join(lost, "node", "left")
    state = F.coalesce(F.col("lost"), F.when(F.col("missing"), "missing_parent").otherwise("rooted"))
    return out.select("node", "parent", state.alias("state"), "root", "depth", *(["path"] if with_paths else []))


def _bands(open_: DataFrame, done: list[DataFrame], frontier: DataFrame, depth: int, left: int, seg, none, hot_rows: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes below the frontier, in bands of 1, 2, 4, ... levels, and those that lead into cycles. Each open node carries its jump
    and the path between; only open nodes and those of this part are joined."""
    before = reduce(DataFrame.unionByName, done).select(F.col("node").alias("gone"))
    todo = cut(open_.join(before, F.col("node") == F.col("gone"), "left_anti").select("node", F.col("up").alias("jump"), seg(F.array("node")).alias("seg")))
    mine = [frontier]
    span, progress = 1, True
    while left and progress:
        links_ = todo.select(F.col("node").alias("at"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("depth"), none.alias("path"), F.col("jump").alias("next"), F.col("seg").alias("next_seg"))
        tops = reduce(DataFrame.unionByName, mine).select(F.col("node").alias("at"), "root", "depth", "path", F.lit(None).cast("string").alias("next"), none.alias("next_seg"))
        step = cut(join_to_unique(todo, tops.unionByName(links_), "jump", "at", hot_rows=hot_rows, rows=left))
        mine.append(step.where("root is not null").select("node", "root", (F.col("depth") + span).alias("depth"), seg(F.col("path"), F.col("seg")).alias("path")))
        todo = step.where("root is null").select("node", F.col("next").alias("jump"), seg(F.col("next_seg"), F.col("seg")).alias("seg"))
        was, left, span = left, todo.count(), span * 2
        progress = left < was
    done = done[:-1] + mine
    return done, _cycles(todo.select("node", F.col("jump").alias("up")), left, hot_rows, span)


def _cycles(todo: DataFrame, left: int, hot_rows: int, span: int = 1) -> DataFrame:
    """(node, lost) of nodes (node, up) that all lead into cycles: jumps are doubled until they are longer than there are nodes, and
    then land on cycles only, on each node of them."""
    jump = todo
    while span < left:
        on = jump.select(F.col("node").alias("at"), F.col("up").alias("next"))
        jump = cut(join_to_unique(jump, on, "up", "at", hot_rows=hot_rows, rows=left).select("node", F.col("next").alias("up")))
        span *= 2
    ring = jump.select(F.col("up").alias("ring")).distinct()
    return todo.select("node").join(ring, F.col("node") == F.col("ring"), "left").select("node", F.when(F.col("ring").isNotNull(), "on_cycle").otherwise("below_cycle").alias("lost"))


def ancestor_pairs(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): each node with each of its ancestors, from the paths."""
    hop = nodes.where("path is not null").select(F.col("node").alias("descendant"), F.col("depth"), F.posexplode("path").alias("pos", "ancestor"))
    return hop.where("pos < depth").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(node, n_descendants, n_children, height) of every rooted node that has descendants."""
    return ancestor_pairs(nodes).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"), F.sum(F.when(F.col("distance") == 1, 1).otherwise(0)).alias("n_children"), F.max("distance").alias("height"))


def findings(nodes: DataFrame, named_roots: DataFrame) -> DataFrame:
    """(node, finding), at most one each, the first that holds: ``on_cycle``, ``below_cycle``, ``missing_parent``, ``wrong_root`` -
    the top reached is not the one that ``named_roots`` (node, named_root; null = none named) has for the node, and the top has no parent."""
    j = nodes.select("node", "state", "root").join(named_roots, "node", "left")
    # only nodes that would be wrong ask after their top, of which one may have very many
    at_odds = (F.col("state") == "rooted") & F.col("named_root").isNotNull() & (F.col("named_root") != F.col("root"))
    missing_above = nodes.where("state = 'missing_parent'").select(F.col("node").alias("cut_off"))
    plain = j.where("state <> 'rooted'").select("node", F.col("state").alias("finding"))
    wrong = join_to_unique(j.where(at_odds).select("node", "root"), missing_above, "root", "cut_off").where("cut_off is null")
    return plain.unionByName(wrong.select("node", F.lit("wrong_root").alias("finding")))
