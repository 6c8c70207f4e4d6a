"""Iterative graph algorithms over edge DataFrames: strongly connected components and widest paths.

Edges are (src, dst[, confidence]). Every round is a pre-aggregated minimum
or maximum and an equi-join, written to the shared folder, so a lost executor
repeats one round at most. Joins are by shuffle but for counted, small sides,
so that no round sends much to the driver. A graph of at most ``small`` edges,
a checked size, is solved by one task instead, since a round's overhead would
dominate it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import stored

SMALL = 1_000_000
FEW = 50_000  # so many rows are broadcast in a round


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (node, component) of the components of two or more nodes, without recursion."""
    out: dict = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    number, low, on, stack, rows = {}, {}, set(), [], []
    for root in sorted(out):
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(out[other])))
                    break
                if other in on:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    if len(members) > 1:
                        least = min(members)  # once: a component may hold most of the nodes
                        rows += [(m, least) for m in members]
    return pd.DataFrame(rows, columns=["node", "component"])


def _near(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` by a count, for a join: only few are sent to the driver."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (node, label): the least label that reaches a node along the edges; ``labels`` is (node, label). Only new labels are sent on."""
    edges = stored(edges, "edges")
    now = stored(labels, "labels")
    front = now.where("label is not null")
    while n := front.count():
        sent = edges.join(_near(front, n), edges["src"] == front["node"]).groupBy("dst").agg(F.min("label").alias("got"))
        new = stored(
            now.join(sent.hint("merge"), now["node"] == sent["dst"], "left").select(
                "node", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got").isNotNull() & (F.col("label").isNull() | (F.col("got") < F.col("label")))).alias("changed")
            ),
            "labels",
        )
        now, front = new.select("node", "label"), new.where("changed").select("node", "label")
    return now


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Rows (node, component) of the strongly connected components of two or more nodes; component the least node.

    Self-loops are ignored. While there are more than ``small`` edges: nodes
    without an edge in or out are peeled off as long as that takes a
    twentieth of the edges; then each node takes the least node that reaches
    it, which is a component's root for those that also reach it back within
    the same colour; those found leave. The last ``small`` edges are solved by
    one task.
    """
    schema = f"node {dict(edges.dtypes)['src']}, component {dict(edges.dtypes)['src']}"
    e = stored(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    found, n = None, e.count()
    while n > small:
        into, out = (e.select(c).distinct().hint("merge") for c in ("dst", "src"))
        e = stored(e.join(into.withColumnRenamed("dst", "src"), "src", "left_semi").join(out.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        before, n = n, e.count()
        if n <= small or n < 0.95 * before:
            continue
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(e, nodes.select("node", F.col("node").alias("label")))
        a, b = (colour.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")).hint("merge") for c in ("src", "dst"))
        same = e.join(a, "src").join(b, "dst").where("src_label = dst_label").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = _spread(same, colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label")))
        mine = stored(back.join(colour.withColumnRenamed("label", "component").hint("merge"), "node").where("label = component").select("node", "component"), "components")
        size = mine.groupBy("component").count().where("count > 1").select("component")
        part = mine.join(size.hint("merge"), "component", "left_semi").select("node", "component")
        found = part if found is None else found.union(part)
        gone = mine.select("node").hint("merge")
        e = stored(e.join(gone, e["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"), "edges")
        n = e.count()
    rest = e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_tarjan, schema)
    return rest if found is None else found.union(rest)


def _flood(pdf: pd.DataFrame, levels: tuple[float, ...]) -> pd.DataFrame:
    """Rows (node, reach) of rows (src, dst, confidence); a root is a row of confidence -1."""
    roots = pdf["confidence"] < 0
    out: dict = {}
    for a, b, c in zip(pdf["src"][~roots], pdf["dst"][~roots], pdf["confidence"][~roots], strict=True):
        out.setdefault(a, []).append((b, c))
    reach = dict.fromkeys(pdf["src"][roots], levels[0])
    for level in levels:
        front = list(reach)
        while front:
            found = []
            for node in front:
                for other, confidence in out.get(node, ()):
                    if confidence >= level and other not in reach:
                        reach[other] = level
                        found.append(other)
            front = found
    return pd.DataFrame({"node": list(reach), "reach": [float(x) for x in reach.values()]})


def widest_paths(edges: DataFrame, roots: DataFrame, levels: tuple[float, ...] = (1.0, 0.5), small: int = SMALL) -> DataFrame:
    """Rows (node, reach): the best, over all paths from ``roots`` (node), of the least confidence on the path.

    One breadth-first search for each level, from high to low, over the
    edges of at least that confidence. A node is reached once, and each
    round only follows the edges of the nodes reached last. Up to ``small``
    edges and roots, a counted size, are searched by one task.
    """
    e = stored(edges.select("src", "dst", "confidence"), "edges")
    start = stored(roots.select("node").distinct(), "reached")
    if e.count() + start.count() <= small:
        kind = dict(e.dtypes)["dst"]
        rows = e.union(start.select("node", F.col("node").alias("dst"), F.lit(-1.0))).withColumn("_all", F.lit(0))
        return rows.groupBy("_all").applyInPandas(lambda pdf: _flood(pdf, levels), f"node {kind}, reach double")
    found = start.select("node", F.lit(levels[0]).alias("reach"))
    for level in levels:
        strong = e.where(F.col("confidence") >= level)
        front = found.select("node")
        while n := front.count():
            near = strong.join(_near(front, n), strong["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
            front = stored(near.join(found.hint("merge"), "node", "left_anti"), "reached")
            found = found.union(front.select("node", F.lit(level).alias("reach")))
    return found
