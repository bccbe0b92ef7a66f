"""Graph operators on ``edges(src, dst)`` frames.

The iterative ones write each round's state to the shared folder (see
``plans.lineage``), so the plan stays small and a lost executor costs one round
at most. Only counts come to the driver. Loops have a round limit and raise
when it is hit; they never return a partial result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators.changelog import GROUP_MIN_SUPPORT
from plumbline.operators.dag import NotConverged
from plumbline.plans.lineage import Accumulator, materialize

# Defaults of the graph lenses.
SDP_MIN_DELTA = 0.25
HUB_MIN_CHURN = 2
HUB_MIN_INBOUND = 2

# Top-level declarations, and what makes one behavioural.
DECLARATION_RE = (
    r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function\*?|class|const|let|var|interface|type|enum)\s+"
    r"([A-Za-z_$][\w$]*)"
)
BEHAVIOURAL_KEYWORD_RE = r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class)"
BEHAVIOURAL_VALUE_RE = (
    r"{declaration}(?:[^=]|=>)*?=\s*(?:async\s+)?(?:function(?![A-Za-z0-9_])|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
)
BEHAVIOURAL = (BEHAVIOURAL_KEYWORD_RE, BEHAVIOURAL_VALUE_RE)
# A whole identifier as the declarations name them.
IDENTIFIER_RE = r"(?<![\w$])[A-Za-z_$][\w$]*"


def _checksum(df: DataFrame, *cols: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (component = smallest member), by alternating star contraction.

    Large-star links every larger neighbour to the smallest one, small-star
    every smaller-or-equal neighbour; a logarithmic number of rounds turns each
    component into a star around its minimum. The smallest neighbour is a
    map-side combined aggregate, so a hub with a third of the edges costs one
    row per task before its join, and the edge set never grows.
    """
    norm = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    state = materialize(norm, "cc")
    seen = _checksum(state, "u", "v")
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        state = materialize(small, "cc")
        now = _checksum(state, "u", "v")
        if now == seen:
            members = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return members.unionByName(roots)
        seen = now
    raise NotConverged(f"connected components after {max_rounds} rounds")


def ripple_groups(pairs: DataFrame, min_support: int = GROUP_MIN_SUPPORT, module: Column | None = None) -> DataFrame:
    """``group_id, node, module, size``: components over all sufficiently supported pairs.

    One row per member, so a very large group stays distributed.
    """
    comp = connected_components(pairs.where(F.col("support") >= min_support).select("a", "b"))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= 2)
    grouped = comp.join(sizes, "component").select(F.col("component").alias("group_id"), "node", "size")
    return grouped.withColumn("module", module if module is not None else paths.module_of(F.col("node").cast("string")))


def ripple_modules(groups: DataFrame) -> DataFrame:
    """``group_id, size, modules``: distinct modules touched by each group."""
    return groups.groupBy("group_id", "size").agg(F.count_distinct("module").alias("modules"))


def symbol_array(
    text: Column,
    declaration_re: str = DECLARATION_RE,
    name_group: int = 2,
    behavioural: tuple[str, ...] = BEHAVIOURAL,
) -> Column:
    """``array<struct<name, body, behavioral>>`` of a text's top-level declarations.

    The text is cut in front of each declaration; the piece is the symbol's
    body. A symbol is behavioural when one of the patterns matches at the
    beginning of its piece; ``{declaration}`` in a pattern stands for the declaration.
    """
    at_line = declaration_re.removeprefix("(?m)^")
    pieces = F.split(text, f"(?md)(?=^{at_line})")

    def symbol(piece: Column) -> Column:
        is_behavioural = F.lit(False)
        for pattern in behavioural:
            is_behavioural = is_behavioural | piece.rlike("\\A" + pattern.replace("{declaration}", f"(?:{at_line})"))
        return F.struct(
            F.regexp_extract(piece, f"\\A{at_line}", name_group).alias("name"),
            piece.alias("body"),
            is_behavioural.alias("behavioral"),
        )

    return F.filter(F.transform(pieces, symbol), lambda s: F.length(s["name"]) > 0)


def symbols(docs: DataFrame, doc: str = "doc_id", text: str = "text", **pattern) -> DataFrame:
    """``doc, pos, name, body, behavioral`` per top-level declaration."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(symbol_array(F.col(text), **pattern)).alias("pos", "s")).select(
        "doc", "pos", "s.*"
    )


def islands(links: Column, n: Column) -> Column:
    """Number of components of the positions 1..``n`` under ``links`` (array of pairs ``x, y``), inside the row."""
    labels = F.aggregate(
        links,
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda l, e: F.when(F.get(l, e["x"] - 1) == F.get(l, e["y"] - 1), l).otherwise(
            F.transform(
                l,
                lambda v: F.when(
                    v == F.greatest(F.get(l, e["x"] - 1), F.get(l, e["y"] - 1)), F.least(F.get(l, e["x"] - 1), F.get(l, e["y"] - 1))
                ).otherwise(v),
            )
        ),
    )
    return F.size(F.array_distinct(labels))


def cohesion(docs: DataFrame, doc: str = "doc_id", text: str = "text", identifier_re: str = IDENTIFIER_RE, **pattern) -> DataFrame:
    """``doc, symbols, behavioral, components, cohesion`` per document.

    A symbol is linked to every symbol of its document whose name occurs in its
    body as a whole identifier; a body names its own symbol too, which ties
    equally named symbols to the first of them. Names, bodies, links and islands
    all belong to one row, so nothing is shuffled. Cohesion is
    ``1 - (components - 1) / (symbols - 1)``, NULL with fewer than two symbols.
    """
    syms = docs.select(F.col(doc).alias("doc"), symbol_array(F.col(text), **pattern).alias("syms"))
    # Positions are bound once per row; the islands use them several times.
    named = syms.withColumn("names", F.transform("syms", lambda s: s["name"]))
    links = F.flatten(
        F.transform(
            "syms",
            lambda s, i: F.transform(
                F.array_intersect(F.regexp_extract_all(s["body"], F.lit(identifier_re), F.lit(0)), F.col("names")),
                lambda n: F.struct((i + 1).alias("x"), F.array_position(F.col("names"), n).cast("int").alias("y")),
            ),
        )
    )
    record = F.struct(
        F.size("syms").alias("n"),
        F.size(F.filter("syms", lambda s: s["behavioral"])).alias("b"),
        F.filter(links, lambda e: e["x"] != e["y"]).alias("links"),
    )
    base = named.select("doc", F.explode(F.array(record)).alias("r"))
    symbols, components = F.col("r.n").cast("bigint"), islands(F.col("r.links"), F.col("r.n")).cast("bigint")
    out = base.select("doc", symbols.alias("symbols"), F.col("r.b").cast("bigint").alias("behavioral"), components.alias("components"))
    return out.withColumn("cohesion", F.when(F.col("symbols") >= 2, 1 - (F.col("components") - 1) / (F.col("symbols") - 1)))


def barrels(docs: DataFrame, syms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that re-export something and declare no behavioural symbol."""
    re_exports = docs.where(
        F.col(text).rlike(r"(?<![A-Za-z0-9_])export\s+\*|(?<![A-Za-z0-9_])export(?![A-Za-z0-9_])[^\n;]*(?<![A-Za-z0-9_])from\s*['\"]")
    ).select(doc)
    return re_exports.join(syms.where("behavioral").select(F.col("doc").alias(doc)).distinct(), doc, "left_anti")


def with_folders(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().select(
        "src", "dst", paths.module_of(F.col("src")).alias("src_folder"), paths.module_of(F.col("dst")).alias("dst_folder")
    )


def instability(edges: DataFrame, modules: DataFrame | None = None, target: str | None = None) -> DataFrame:
    """``folder, ca, ce, instability, modules`` per folder.

    ``ca`` and ``ce`` count distinct outside modules that point in and that are
    pointed at. ``target`` filters the report only; the counts stay global.
    Distinct (folder, module) pairs are formed first, so counting is map-side.
    """
    e = with_folders(edges).where(F.col("src_folder") != F.col("dst_folder"))
    ca = e.select(F.col("dst_folder").alias("folder"), "src").distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("ca"))
    ce = e.select(F.col("src_folder").alias("folder"), "dst").distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("ce"))
    if modules is None:
        modules = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path")))
    sizes = (
        modules.select("path").distinct().groupBy(paths.module_of(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("modules"))
    )
    out = (
        sizes.join(ca, "folder", "left")
        .join(ce, "folder", "left")
        .select("folder", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"), "modules")
        .withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(F.lit(0.0)))
    )
    if target is not None:
        out = out.where(paths.under_prefix(F.col("folder"), target))
    return out


def sdp_violations(edges: DataFrame, min_delta: float = SDP_MIN_DELTA, target: str | None = None) -> DataFrame:
    """``src_folder, dst_folder, i_from, i_to, delta, edges, sample``: folder edges towards markedly less stable folders."""
    # One row per folder, needed at both ends.
    inst = materialize(instability(edges).select("folder", "instability"), "instability")
    folder_edges = (
        with_folders(edges)
        .where(F.col("src_folder") != F.col("dst_folder"))
        .groupBy("src_folder", "dst_folder")
        .agg(F.count(F.lit(1)).alias("edges"), F.min(F.struct("src", "dst")).alias("s"))
    )
    out = (
        folder_edges.join(inst.select(F.col("folder").alias("src_folder"), F.col("instability").alias("i_from")), "src_folder")
        .join(inst.select(F.col("folder").alias("dst_folder"), F.col("instability").alias("i_to")), "dst_folder")
        .withColumn("delta", F.col("i_to") - F.col("i_from"))
        .where(F.col("delta") >= min_delta)
        .select(
            "src_folder", "dst_folder", "i_from", "i_to", "delta", "edges",
            F.concat_ws(" -> ", "s.src", "s.dst").alias("sample"),
        )
    )
    if target is not None:
        out = out.where(paths.under_prefix(F.col("src_folder"), target) | paths.under_prefix(F.col("dst_folder"), target))
    return out


# Pointer doublings and spreading steps per stored round.
STEPS_PER_ROUND = 2


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _chains(edges: DataFrame, through_rings: bool, max_rounds: int = 64) -> DataFrame:
    """``node, top, peak`` of every node with exactly one way in.

    ``top`` is where following the only way in ends (a node with no or several
    ways in), ``peak`` the largest node on the way, ``node`` included. The
    distance covered doubles with each step, so long chains take logarithmically
    many rounds. A ring has no top; ``through_rings`` goes on until every ring
    has been walked round.
    """
    single = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("top")).where(F.col("n") == 1)
    state = materialize(single.select(F.col("dst").alias("node"), "top", F.greatest("dst", "top").alias("peak")), "chains")
    total, hops, before = state.count(), 1, -1
    for _ in range(max_rounds):
        for _ in range(STEPS_PER_ROUND):
            ahead = state.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("peak").alias("_peak"))
            state = state.join(ahead, "top", "left").select(
                "node", F.coalesce("_top", "top").alias("top"), F.greatest("peak", "_peak").alias("peak")
            )
            hops *= 2
        state = materialize(state, "chains")
        open_rows = state.join(state.select(F.col("node").alias("top")), "top", "left_semi").count()
        if open_rows == 0 or hops >= total or (open_rows == before and not through_rings):
            return state
        before = open_rows
    raise NotConverged(f"chains after {max_rounds} rounds")


def _drop_unreached(edges: DataFrame) -> DataFrame:
    """Edges without those leaving a node nothing leads into, whole chains at a time."""
    sources = edges.select(F.col("src").alias("node")).distinct().join(
        edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"
    )
    sources = materialize(sources, "sources")
    if sources.isEmpty():
        return edges
    hanging = _chains(edges, through_rings=False).join(sources.withColumnRenamed("node", "top"), "top", "left_semi")
    dead = sources.unionByName(hanging.select("node")).withColumnRenamed("node", "src")
    return materialize(edges.join(dead, "src", "left_anti").select("src", "dst"), "trim")


def trim_acyclic(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Drop edges that lie on no cycle because an end has no way in or out, repeatedly.

    A round removes whole chains, so trees vanish in logarithmically many rounds.
    """
    state = materialize(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "trim")
    count = state.count()
    for _ in range(max_rounds):
        if count == 0:
            return state
        state = _flip(_drop_unreached(_flip(_drop_unreached(state))))
        now = state.count()
        if now == count:
            return state
        count = now
    raise NotConverged(f"trimming after {max_rounds} rounds")


def _spread_max(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``node, color``: the largest node that reaches each node (itself included).

    Colours pass along edges step by step, and over chains in one step.
    """
    chains = _chains(edges, through_rings=True)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    known = nodes.withColumn("color", F.col("node")).unionByName(chains.select("node", F.col("peak").alias("color")))
    state = materialize(known.groupBy("node").agg(F.max("color").alias("color")), "color")
    seen = _checksum(state, "node", "color")
    for _ in range(max_rounds):
        for _ in range(STEPS_PER_ROUND):
            arriving = edges.join(state.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "color")
            state = state.unionByName(arriving).groupBy("node").agg(F.max("color").alias("color"))
        over = chains.join(state.withColumnRenamed("node", "top"), "top").select("node", "color")
        state = materialize(state.unionByName(over).groupBy("node").agg(F.max("color").alias("color")), "color")
        now = _checksum(state, "node", "color")
        if now == seen:
            return state
        seen = now
    raise NotConverged(f"colouring after {max_rounds} rounds")


def _rooted(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``node, color``: nodes that the largest node of their colour reaches and that reach it back."""
    colors = _spread_max(edges, max_rounds)
    inner = (
        edges.join(colors.select(F.col("node").alias("src"), "color"), "src")
        .join(colors.select(F.col("node").alias("dst"), F.col("color").alias("_color")), "dst")
        .where(F.col("color") == F.col("_color"))
        .select("src", "dst")
    )
    # The root is the largest node of its colour: a node reaches it exactly if the root is the largest node it reaches.
    back = _spread_max(_flip(materialize(inner, "inner")), max_rounds).withColumnRenamed("color", "_back")
    return (
        colors.join(back, "node", "left")
        .where(F.coalesce("_back", "node") == F.col("color"))
        .select("node", "color")
    )


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between numbers, and the stored table ``node, id`` of these; which node gets which number doesn't matter."""
    pairs = materialize(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "named")
    nodes = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    numbers = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "numbers")
    end = lambda name: numbers.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id"))
    both = pairs.join(end("src"), "src").join(end("dst"), "dst")
    return both.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), numbers


def strongly_connected(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``node, scc`` (scc = largest member) for strongly connected sets of two or more nodes.

    Forward and backward colouring: nodes are coloured with the largest node
    reaching them; those that reach it back form its set. Finished sets leave
    the graph and the rest is trimmed and coloured again. Named nodes go through
    it as numbers, as the largest of many texts is found by sorting them.
    """
    if edges.schema["src"].dataType.typeName() == "string":
        links, numbers = _numbered(edges)
        sets = strongly_connected(links, max_rounds).join(numbers.withColumnRenamed("node", "name"), F.col("node") == F.col("id"))
        sets = materialize(sets.select("scc", "name"), "sets")
        largest = sets.groupBy("scc").agg(F.max("name").alias("largest"))
        return sets.join(largest, "scc").select(F.col("name").alias("node"), F.col("largest").alias("scc"))
    rest = trim_acyclic(edges, max_rounds)
    done: Accumulator | None = None
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        found = _rooted(rest, max_rounds)
        if done is None:
            done = Accumulator(found, "scc")
            found = done.all()
        else:
            found = done.add(found)
        left = rest.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(
            found.select(F.col("node").alias("dst")), "dst", "left_anti"
        )
        rest = trim_acyclic(left, max_rounds)
    else:
        raise NotConverged(f"components after {max_rounds} rounds")
    if done is None:
        kind = edges.select("src").schema[0].dataType
        return edges.sparkSession.createDataFrame([], "node string, scc string").select(
            F.col("node").cast(kind).alias("node"), F.col("scc").cast(kind).alias("scc")
        )
    members = done.all()
    sizes = members.groupBy("color").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return members.join(sizes, "color", "left_semi").select("node", F.col("color").alias("scc"))


def _ring_positions(ring: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, pos`` from ``node, before`` rows, where the start of each ring has no ``before``."""
    state = materialize(
        ring.select("node", "before", F.col("before").isNotNull().cast("bigint").alias("pos")), "ring"
    )
    for _ in range(max_rounds):
        for _ in range(STEPS_PER_ROUND):
            ahead = state.select(F.col("node").alias("before"), F.col("before").alias("_before"), F.col("pos").alias("_pos"))
            state = state.join(ahead, "before", "left").select(
                "node", F.col("_before").alias("before"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos")
            )
        state = materialize(state, "ring")
        if state.where("before IS NOT NULL").isEmpty():
            return state.select("node", "pos")
    raise NotConverged(f"ring positions after {max_rounds} rounds")


def _shortest_walks(inner: DataFrame, starts: DataFrame, max_rounds: int) -> DataFrame:
    """``node, pos``: for each set, the nodes of a shortest cycle through its start.

    All sets advance together, one step per round, keeping one predecessor per
    node; the nodes between the closing edge and the start are then marked by
    pointer doubling.
    """
    kind = inner.schema["src"].dataType
    tree = Accumulator(
        starts.select("scc", F.col("start").alias("node"), F.lit(None).cast(kind).alias("before"), F.lit(0).cast("bigint").alias("pos")), "walk"
    )
    frontier = tree.all()
    closing: Accumulator | None = None
    for pos in range(1, max_rounds):
        if frontier.isEmpty():
            break
        step = (
            frontier.select("scc", F.col("node").alias("src"))
            .join(inner, ["scc", "src"])
            .groupBy("scc", F.col("dst").alias("node"))
            .agg(F.min("src").alias("before"))
            .withColumn("pos", F.lit(pos).cast("bigint"))
        )
        step = materialize(step.join(starts, "scc"), "step")
        ends = step.where(F.col("node") == F.col("start")).select("scc", F.col("before").alias("node"))
        if closing is None:
            closing = Accumulator(ends, "closing")
        else:
            closing.add(ends)
        reached = tree.all().select("scc", "node")
        frontier = tree.add(
            step.join(closing.all().select("scc"), "scc", "left_anti").join(reached, ["scc", "node"], "left_anti")
        )
    else:
        raise NotConverged(f"cycle walk after {max_rounds} rounds")
    if closing is None:
        return tree.all().select("node", "pos").where("false")
    jump = materialize(tree.all().select("node", "before"), "jump")
    marked = materialize(closing.all().select("node"), "marked")
    while not jump.where("before IS NOT NULL").isEmpty():
        further = marked.join(jump, "node").where("before IS NOT NULL").select(F.col("before").alias("node"))
        marked = materialize(marked.unionByName(further).distinct(), "marked")
        ahead = jump.select(F.col("node").alias("before"), F.col("before").alias("_before"))
        jump = materialize(jump.join(ahead, "before", "left").select("node", F.col("_before").alias("before")), "jump")
    return tree.all().join(marked, "node", "left_semi").select("node", "pos")


def cycle_steps(edges: DataFrame, target: str | None = None, max_rounds: int = 10_000) -> DataFrame:
    """``scc, size, pos, node``: per strongly connected set, a shortest cycle through its smallest member, in edge order.

    One row per step, so a cycle may be of any length. Sets that are simple
    rings are ordered by pointer doubling, the others by a walk.
    """
    scc = materialize(strongly_connected(edges, max_rounds), "scc")
    if target is not None:
        under = scc.where(paths.under_prefix(F.col("node"), target)).select("scc").distinct()
        scc = scc.join(under, "scc", "left_semi")
    inner = materialize(
        edges.select("src", "dst")
        .distinct()
        .join(scc.select(F.col("node").alias("src"), "scc"), "src")
        .join(scc.select(F.col("node").alias("dst"), F.col("scc").alias("_scc")), "dst")
        .where((F.col("scc") == F.col("_scc")) & (F.col("src") != F.col("dst")))
        .select("scc", "src", "dst"),
        "inner",
    )
    links = inner.groupBy("scc").agg(F.count(F.lit(1)).alias("links"))
    sets = scc.groupBy("scc").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("start")).join(links, "scc")
    sets = materialize(sets, "sets")
    rings = sets.where(F.col("links") == F.col("size"))
    ring = inner.join(rings.select("scc", "start"), "scc").select(
        F.col("dst").alias("node"), F.when(F.col("dst") != F.col("start"), F.col("src")).alias("before")
    )
    others = sets.where(F.col("links") > F.col("size")).select("scc", "start")
    walked = _shortest_walks(inner.join(others.select("scc"), "scc", "left_semi"), others, max_rounds)
    steps = _ring_positions(ring).unionByName(walked)
    return steps.join(scc, "node").join(sets.select("scc", "size"), "scc").select("scc", "size", "pos", "node")


def cycles(edges: DataFrame, target: str | None = None, longest: int = 1000) -> DataFrame:
    """``scc, size, length, path``: the cycles of ``cycle_steps`` as text.

    A cycle of more than ``longest`` steps has a NULL path here; its steps are
    in ``cycle_steps``.
    """
    steps = materialize(cycle_steps(edges, target), "steps")
    lengths = steps.groupBy("scc", "size").agg(F.count(F.lit(1)).cast("int").alias("length"))
    short = steps.join(lengths.where(F.col("length") <= longest).select("scc"), "scc", "left_semi")
    ordered = short.groupBy("scc").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("node").cast("string").alias("node")))).alias("s"))
    names = F.transform("s", lambda x: x["node"])
    text = ordered.select("scc", F.array_join(F.concat(names, F.slice(names, 1, 1)), " -> ").alias("path"))
    return lengths.join(text, "scc", "left").select("scc", "size", "length", "path")


def volatile_hubs(
    churn: DataFrame,
    edges: DataFrame,
    item: str = "item",
    min_churn: int = HUB_MIN_CHURN,
    min_inbound: int = HUB_MIN_INBOUND,
) -> DataFrame:
    """``item, commits, inbound, score``: churn times distinct inbound modules, both above their floor."""
    inbound = (
        edges.select("src", F.col("dst").alias(item)).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("inbound"))
    )
    return (
        churn.where(F.col("commits") >= min_churn)
        .join(inbound.where(F.col("inbound") >= min_inbound), item)
        .select(item, "commits", "inbound", (F.col("commits") * F.col("inbound")).alias("score"))
    )
