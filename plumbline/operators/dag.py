"""Acyclic dependencies and histories: levels, reachability, ranges, nearest common ancestors.

Questions of reachability go over labels instead of closures. Runs of nodes with one way in and one way out are
contracted, the rest is cut into disjoint paths, and every node gets its path and its place on it (a node reaches all
lower places of its path). What is left are the edges between paths, so a search keeps one place per path and needs a
round per change of path, whatever the length of the history; generation numbers end it where nothing wanted can follow.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import Accumulator, materialize

# Levels computed, and pointers doubled, per stored round.
LEVELS_PER_ROUND = 8
DOUBLINGS_PER_ROUND = 3
# A round contracts chains if that takes at least one in this many of the nodes left. A loop goes on with the rows that
# still change, and puts the others aside, once they are fewer than one in this many.
WORTH = 4
# Places of a path that are joined together.
STRETCH = 256


class NotConverged(RuntimeError):
    """An iterative operator reached its round limit."""


def _followed(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, top, w, c, open``: ``links`` (the same without ``open``) followed to a top that has no link itself.

    A link says ``value(node) = max(c, value(top) + w)``, and such steps compose, so the way covered doubles with each.
    ``open`` marks the nodes that lie on a ring or above one. ``links`` is a stored table.
    """
    state, hops, total = links.select("node", "top", "w", "c"), 1, None
    ends = links.select(F.col("node").alias("top"), F.lit(True).alias("open"))
    ended: list[DataFrame] = []
    few = False
    for _ in range(max_rounds):
        # Few rows that still move meet the others without moving them: the smaller side of an inner join can be broadcast.
        for _ in range(1 if few else DOUBLINGS_PER_ROUND):
            known = reduce(DataFrame.unionByName, ended, state) if few else state
            ahead = known.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("w").alias("_w"), F.col("c").alias("_c"))
            state = state.join(ahead, "top", "inner" if few else "left").select(
                "node",
                F.coalesce("_top", "top").alias("top"),
                (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                F.greatest("c", F.col("_c") + F.col("w")).alias("c"),
            )
            hops *= 2
        marked = state.join(ends, "top", "left").select("node", "top", "w", "c", F.coalesce("open", F.lit(False)).alias("open"))
        marked = materialize(marked, "followed")
        moving = marked.where("open").count()
        total = links.count() if total is None and moving else total
        if not moving or hops >= total:
            return reduce(DataFrame.unionByName, [d.withColumn("open", F.lit(False)) for d in ended], marked)
        if few or moving * WORTH < total:
            few = True
            ended.append(marked.where("not open").drop("open"))
            state = marked.where("open").drop("open")
        else:
            state = marked.drop("open")
    raise NotConverged(f"links after {max_rounds} rounds")


def _settled(pend: DataFrame, rest: DataFrame) -> DataFrame:
    """``node, v, done`` after ``LEVELS_PER_ROUND`` levels; ``v`` is the level where done, else a lower bound."""
    now = rest.select("node", "v", F.lit(False).alias("done"))
    for _ in range(LEVELS_PER_ROUND):
        below = pend.join(now.withColumnRenamed("node", "needs"), "needs")
        below = below.groupBy("node").agg(F.max(F.col("v") + F.col("w")).alias("m"), F.min("done").alias("d"))
        now = rest.join(below, "node", "left").select("node", F.greatest("v", "m").alias("v"), F.coalesce("d", F.lit(True)).alias("done"))
    return now


def _contracted(pend: DataFrame, rest: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pend`` and ``rest`` without the linked nodes; who needs one of them needs its top instead."""
    over = links.select(F.col("node").alias("needs"), "top", F.col("w").alias("_w"), "c")
    kept = pend.join(links.select("node"), "node", "left_anti").join(over, "needs", "left")
    kept = materialize(
        kept.select(
            "node",
            F.coalesce("top", "needs").alias("needs"),
            (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
            (F.col("w") + F.col("c")).alias("least"),
        ),
        "kept",
    )
    least = kept.groupBy("node").agg(F.max("least").alias("least"))
    rest = rest.join(links.select("node"), "node", "left_anti").join(least, "node", "left")
    return (
        materialize(kept.groupBy("node", "needs").agg(F.max("w").alias("w")), "deps"),
        materialize(rest.select("node", F.greatest("v", "least").alias("v")), "rest"),
    )


def topo_levels(deps: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``node, level``: dependency-free nodes are 0, others one above their deepest dependency.

    ``deps(node, needs)``. Nodes on or behind a cycle never become free; they are returned with a NULL level.

    A node with one dependency left is a function of it, and such functions compose: chains and trees leave the graph
    in logarithmically many steps. Between these, ``LEVELS_PER_ROUND`` levels of the rest are settled per stored round.
    """
    pend = materialize(deps.select("node", "needs").distinct().withColumn("w", F.lit(1)), "deps")
    nodes = pend.select("node").unionByName(pend.select(F.col("needs").alias("node"))).distinct()
    rest = materialize(nodes.withColumn("v", F.lit(0)), "rest")
    placed = Accumulator(rest.select("node", F.col("v").alias("level")).where("false"), "placed")
    hung = Accumulator(pend.select("node", F.col("needs").alias("top"), "w", F.col("w").alias("c")).where("false"), "hung")
    left = rest.count()
    for _ in range(max_rounds):
        if not left:
            break
        contracted = False
        single = pend.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("top"), F.max("w").alias("w")).where("n = 1")
        single = materialize(single.join(rest, "node").select("node", "top", "w", F.col("v").alias("c")), "single")
        if single.count() * WORTH >= left:
            links = hung.add(_followed(single).where("not open"))
            contracted = not links.isEmpty()
            if contracted:
                pend, rest = _contracted(pend, rest, links)
        now = materialize(_settled(pend, rest), "levels")
        done = placed.add(now.where("done").select("node", F.col("v").alias("level")))
        rest = now.where("not done").select("node", "v")
        before, left = left, rest.count()
        pend = materialize(pend.join(done.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs", "w"), "deps")
        if left == before and not contracted:
            break
    else:
        raise NotConverged(f"levels after {max_rounds} rounds")
    # The tops of contracted nodes may have been contracted later themselves.
    known = placed.all()
    links = _followed(hung.all()).select("node", "top", "w", "c")
    behind = links.join(known.select(F.col("node").alias("top"), "level"), "top", "left")
    behind = behind.select("node", F.greatest("c", F.col("level") + F.col("w")).alias("level"), F.col("level").isNull().alias("stuck"))
    behind = behind.select("node", F.when(~F.col("stuck"), F.col("level")).alias("level"))
    return known.unionByName(behind).unionByName(rest.select("node", F.lit(None).cast("int").alias("level")))


@dataclass(frozen=True)
class Labels:
    """``places``: ``node, path, at, gen``; a node reaches all places of its path that are not above its own.

    ``exits``: ``path, at, path_to, at_to, gen_to``, the edges between paths. ``gen`` falls along every edge; it is null on
    and behind cycles, where each node is a path of its own.
    """

    places: DataFrame
    exits: DataFrame


def _runs(links: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """``node, top, w``: the end of each node's chain of ``links(node, top)`` and the way there, in steps or sizes."""
    sized = links.withColumn("w", F.lit(1)) if size is None else links.join(size.withColumnRenamed("node", "top"), "top").withColumnRenamed("size", "w")
    return _followed(materialize(sized.withColumn("c", F.lit(0)), "chains")).where("not open").select("node", "top", "w")


def labels(parents: DataFrame) -> Labels:
    """Path labels of the graph ``parents(child, parent)``."""
    e = materialize(parents.select("child", "parent").where("child != parent").distinct(), "history")
    nodes = e.select(F.col("child").alias("node")).unionByName(e.select(F.col("parent").alias("node"))).distinct()
    # Runs: from a node with one parent to that parent, if it is its only child.
    ups = e.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    downs = e.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    run = _runs(ups.join(downs, "parent").select(F.col("child").alias("node"), F.col("parent").alias("top")))
    runs = nodes.join(run, "node", "left").select("node", F.coalesce("top", "node").alias("seg"), F.coalesce("w", F.lit(0)).alias("k"))
    runs = materialize(runs, "runs")
    sizes = runs.groupBy("seg").agg((F.max("k") + 1).alias("size"))
    side = lambda end: runs.select(F.col("node").alias(end), F.col("seg").alias(f"{end}_seg"))
    between = e.join(side("child"), "child").join(side("parent"), "parent").where("child_seg != parent_seg")
    between = materialize(between.select(F.col("child_seg").alias("s"), F.col("parent_seg").alias("t")).distinct(), "between")
    levels = topo_levels(between.select(F.col("s").alias("node"), F.col("t").alias("needs")))
    segs = sizes.join(levels.withColumnRenamed("node", "seg"), "seg", "left")
    # A run without edges to others is 0; those on and behind cycles have no level.
    met = between.select(F.col("s").alias("seg")).unionByName(between.select(F.col("t").alias("seg"))).distinct().withColumn("met", F.lit(True))
    segs = segs.join(met, "seg", "left").select("seg", "size", F.when(F.col("met"), F.col("level")).otherwise(F.lit(0)).alias("gen"))
    segs = materialize(segs, "segments")

    # Each run goes on with its highest parent, if it is that one's highest child of those that do.
    ranked = between.join(segs.select(F.col("seg").alias("s"), F.col("gen").alias("gs")), "s").join(segs.select(F.col("seg").alias("t"), F.col("gen").alias("gt")), "t")
    upward = ranked.where("gs is not null and gt is not null").groupBy("s").agg(F.max(F.struct("gt", "t")).alias("b"), F.first("gs").alias("gs"))
    chosen = upward.select("s", "gs", F.col("b.t").alias("t")).groupBy("t").agg(F.max(F.struct("gs", "s")).alias("b"))
    chain = materialize(chosen.select(F.col("b.s").alias("node"), F.col("t").alias("top")), "chain")
    along = _runs(chain, segs.select(F.col("seg").alias("node"), "size")).select(F.col("node").alias("seg"), F.col("top").alias("path"), F.col("w").alias("base"))
    placed = segs.join(along, "seg", "left").select("seg", "size", "gen", F.coalesce("path", "seg").alias("path"), F.coalesce("base", F.lit(0)).alias("base"))
    placed = materialize(placed, "placed")

    places = runs.join(placed, "seg").select("node", "path", (F.col("base") + F.col("k")).cast("long").alias("at"), "gen")
    exits = between.join(chain.select(F.col("node").alias("s"), F.col("top").alias("t")), ["s", "t"], "left_anti")
    exits = exits.join(placed.select(F.col("seg").alias("s"), "path", F.col("base").cast("long").alias("at")), "s").join(
        placed.select(F.col("seg").alias("t"), F.col("path").alias("path_to"), (F.col("base") + F.col("size") - 1).cast("long").alias("at_to"), F.col("gen").alias("gen_to")), "t"
    )
    return Labels(materialize(places, "places"), materialize(exits.drop("s", "t"), "exits"))


def _in_stretches(rows: DataFrame, above: str, upto: str) -> DataFrame:
    """A row for each stretch of places that ``(above, upto]`` touches."""
    first, last = F.floor((F.col(above) + 1) / STRETCH), F.floor(F.col(upto) / STRETCH)
    return rows.withColumn("stretch", F.explode(F.sequence(first, last)))


def _stretched(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stretch", F.floor(F.col("at") / STRETCH))


def reach(graph: Labels, tips: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``tip, path, at``: the highest place on each path that a tip reaches, from ``tips(tip, floor)``.

    Edges to a generation below ``floor`` are not followed; a null floor follows all. A round per change of path.
    """
    by = Window.partitionBy("path", "path_to").orderBy("at", F.desc("at_to")).rowsBetween(Window.unboundedPreceding, -1)
    # An edge that leaves higher and arrives lower than another adds nothing.
    higher = F.coalesce(F.col("at_to") > F.max("at_to").over(by), F.lit(True))
    exits = materialize(_stretched(graph.exits.withColumn("more", higher).where("more").drop("more")), "exits")
    start = tips.distinct().join(graph.places.withColumnRenamed("node", "tip"), "tip").select("tip", "floor", "path", "at")
    seen = Accumulator(start.select("tip", "path", "at"), "reach")
    frontier = materialize(start.withColumn("below", F.lit(-1).cast("long")), "frontier")
    # What is seen of the tips that still go on; those that have ended leave it as the frontier shrinks.
    going, size = seen, None
    for _ in range(max_rounds):
        left = frontier.count()
        if not left:
            return materialize(seen.all().groupBy("tip", "path").agg(F.max("at").alias("at")), "reach")
        size = left if size is None else size
        if left * WORTH <= size:
            going, size = Accumulator(going.all().join(frontier.select("tip").distinct(), "tip", "left_semi"), "going"), left
        out = exits.select("path", "stretch", F.col("at").alias("leaves"), "path_to", "at_to", "gen_to")
        step = _in_stretches(frontier, "below", "at").join(out, ["path", "stretch"])
        step = step.where("leaves > below and leaves <= at and (floor is null or gen_to is null or gen_to >= floor)")
        step = step.groupBy("tip", "floor", F.col("path_to").alias("path")).agg(F.max("at_to").alias("at"))
        held = going.all().groupBy("tip", "path").agg(F.max("at").alias("below"))
        new = step.join(held, ["tip", "path"], "left").where("below is null or at > below")
        frontier = materialize(new.select("tip", "floor", "path", "at", F.coalesce("below", F.lit(-1).cast("long")).alias("below")), "frontier")
        for rows in {id(seen): seen, id(going): going}.values():
            rows.add(frontier.select("tip", "path", "at"))
    raise NotConverged(f"reachability after {max_rounds} rounds")


def is_ancestor(parents: DataFrame, pairs: DataFrame, graph: Labels | None = None) -> DataFrame:
    """Adds ``is_ancestor`` to ``pairs(a, b)``: a is b or reachable from it over ``parents(child, parent)``.

    Nothing is closed: each ``b`` is searched down to the lowest generation asked of it. A node that the graph doesn't
    have reaches itself only; a null is nobody's ancestor.
    """
    graph = graph or labels(parents)
    asked = materialize(pairs.select("a", "b").where("a is not null and b is not null").distinct(), "asked")
    placed = materialize(asked.where("a != b").join(graph.places.withColumnRenamed("node", "a"), "a"), "sought")
    lowest = F.when(F.count(F.when(F.col("gen").isNull(), 1)) == 0, F.min("gen")).alias("floor")
    found = reach(graph, placed.groupBy(F.col("b").alias("tip")).agg(lowest))
    hits = placed.join(found.select(F.col("tip").alias("b"), "path", F.col("at").alias("top")), ["b", "path"]).where("at <= top").select("a", "b")
    hits = hits.unionByName(asked.where("a = b")).withColumn("is_ancestor", F.lit(True))
    return pairs.join(hits, ["a", "b"], "left").withColumn("is_ancestor", F.coalesce("is_ancestor", F.lit(False)))


def commit_range(parents: DataFrame, pairs: DataFrame, graph: Labels | None = None) -> DataFrame:
    """``a, b, node``: nodes reachable from the newer end but not from the older one.

    The ends are swapped when ``b`` is an ancestor of ``a``; unrelated ends give no rows. Only the places between the
    two ends' highest ones on each path are listed.
    """
    graph = graph or labels(parents)
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = is_ancestor(parents, pairs.select("a", "b").unionByName(flipped).distinct(), graph)
    both = materialize(both, "related").where("is_ancestor").select("a", "b")
    forward = pairs.select("a", "b").distinct().join(both, ["a", "b"], "left_semi").select("a", "b", F.col("a").alias("old"), F.col("b").alias("new"))
    backward = pairs.select("a", "b").distinct().join(both.toDF("b", "a"), ["a", "b"], "left_semi").where("a != b").select(
        "a", "b", F.col("b").alias("old"), F.col("a").alias("new")
    )
    ends = materialize(forward.unionByName(backward), "ends")
    tips = ends.select(F.col("old").alias("tip")).unionByName(ends.select(F.col("new").alias("tip"))).distinct()
    found = reach(graph, tips.withColumn("floor", F.lit(None).cast("int")))
    newer = ends.join(found.withColumnRenamed("tip", "new"), "new")
    older = found.select(F.col("tip").alias("old"), "path", F.col("at").alias("below"))
    spans = newer.join(older, ["old", "path"], "left").withColumn("below", F.coalesce("below", F.lit(-1).cast("long"))).where("at > below")
    spans = _in_stretches(spans.select("a", "b", "path", "below", F.col("at").alias("top")), "below", "top")
    return spans.join(_stretched(graph.places), ["path", "stretch"]).where("at > below and at <= top").select("a", "b", "node")


def _linear_ancestors(parents: DataFrame, tips: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``ancestors`` where every child has one parent: round k adds the nodes up to 2^k steps away."""
    strides = materialize(
        parents.select(F.col("child").alias("node"), F.col("parent").alias("far"), F.lit(1).alias("steps")).distinct(), "strides"
    )
    seen = materialize(tips.select("tip", F.col("tip").alias("node"), F.lit(0).alias("depth")).distinct(), "seen")
    total = seen.count()
    for _ in range(max_rounds):
        # Files look small enough to broadcast, but each round would bring all strides through the driver twice.
        further = seen.join(strides.hint("merge"), "node").select("tip", F.col("far").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
        seen = materialize(seen.unionByName(further).groupBy("tip", "node").agg(F.min("depth").alias("depth")), "seen")
        now = seen.count()
        if now == total:
            return seen
        total = now
        ahead = strides.select(F.col("node").alias("far"), F.col("far").alias("_far"), F.col("steps").alias("_steps"))
        strides = materialize(
            strides.join(ahead.hint("merge"), "far").select("node", F.col("_far").alias("far"), (F.col("steps") + F.col("_steps")).alias("steps")), "strides"
        )
    raise NotConverged(f"linear history after {max_rounds} rounds")


def _spans(graph: Labels, tips: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """``tip, path, below, at, d``: places in ``(below, at]`` of a path are ``d + at - place`` steps from the tip, none nearer.

    Where a path is entered at several places, a lower one counts only below it and only if it is nearer.
    """
    exits = materialize(_stretched(graph.exits), "exits")
    start = tips.select("tip").distinct().join(graph.places.withColumnRenamed("node", "tip"), "tip")
    state = materialize(start.select("tip", "path", "at", F.lit(0).cast("long").alias("d")), "entries")
    frontier = state
    ended = Accumulator(state.where("false"), "ended")
    size = None
    downward = Window.partitionBy("tip", "path").orderBy(F.desc("at"))
    above = downward.rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(max_rounds):
        left = frontier.count()
        if not left:
            lower = F.coalesce(F.lead("at").over(downward), F.lit(-1).cast("long"))
            return state.unionByName(ended.all()).withColumn("below", lower)
        size = left if size is None else size
        if left * WORTH <= size:
            # Tips that have ended are put aside as the frontier shrinks.
            tips_left, size = frontier.select("tip").distinct(), left
            ended.add(state.join(tips_left, "tip", "left_anti"))
            state = materialize(state.join(tips_left, "tip", "left_semi").select(*state.columns), "entries")
        out = exits.select("path", "stretch", F.col("at").alias("leaves"), "path_to", "at_to")
        step = _in_stretches(frontier.withColumn("below", F.lit(-1)), "below", "at").join(out, ["path", "stretch"]).where("leaves <= at")
        step = step.select("tip", F.col("path_to").alias("path"), F.col("at_to").alias("at"), F.expr("d + at - leaves + 1").alias("d"))
        every = state.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        every = every.groupBy("tip", "path", "at").agg(F.min("d").alias("d"), F.min_by("old", F.struct("d", (~F.col("old")).alias("o"))).alias("old"))
        nearer = F.coalesce(F.col("d") + F.col("at") < F.min(F.col("d") + F.col("at")).over(above), F.lit(True))
        every = materialize(every.withColumn("nearer", nearer).where("nearer").drop("nearer"), "entries")
        state, frontier = every.drop("old"), every.where("not old").drop("old")
    raise NotConverged(f"distances after {max_rounds} rounds")


def ancestors(parents: DataFrame, tips: DataFrame, max_rounds: int = 100_000, graph: Labels | None = None) -> DataFrame:
    """``tip, node, depth``: everything reachable from each tip over ``parents(child, parent)``, nearest depth first.

    A linear history (no child with two parents) is walked with doubling strides, so rings may occur. Otherwise each
    tip keeps the places where it enters paths, with a round per change of path, and the nodes are listed in the end.
    """
    if graph is None:
        several = parents.select("child", "parent").distinct().groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty():
            return _linear_ancestors(parents, tips)
        graph = labels(parents)
    spans = _in_stretches(_spans(graph, tips, max_rounds).withColumnRenamed("at", "top"), "below", "top")
    met = spans.join(_stretched(graph.places), ["path", "stretch"]).where("at > below and at <= top")
    found = met.select("tip", "node", F.expr("int(d + top - at)").alias("depth"))
    unknown = tips.select("tip").distinct().join(graph.places.select(F.col("node").alias("tip")), "tip", "left_anti")
    return found.unionByName(unknown.select("tip", F.col("tip").alias("node"), F.lit(0).alias("depth")))


def first_parent_chain(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """``tip, node, depth`` along the lowest-numbered parent of each child (``parents(child, parent, n)``)."""
    first = parents.groupBy("child").agg(F.min_by("parent", "n").alias("parent"))
    return ancestors(first, tips)


def merge_base(parents: DataFrame, pairs: DataFrame, graph: Labels | None = None) -> DataFrame:
    """``a, b, base``: the nearest common ancestor (smallest summed depth, then id)."""
    tips = pairs.select(F.col("a").alias("tip")).unionByName(pairs.select(F.col("b").alias("tip"))).distinct()
    found = ancestors(parents, tips, graph=graph)
    found = materialize(found, "ancestors")
    of_a = pairs.select("a", "b").join(found.select(F.col("tip").alias("a"), "node", F.col("depth").alias("da")), "a")
    of_b = found.select(F.col("tip").alias("b"), "node", F.col("depth").alias("db"))
    common = of_a.join(of_b, ["b", "node"])
    return common.groupBy("a", "b").agg(F.min_by("node", F.struct((F.col("da") + F.col("db")).alias("d"), "node")).alias("base"))
