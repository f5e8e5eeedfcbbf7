"""Graphs: strong components and shortest cycles of edge tables, and the strata of formulas.

Tables are (a, b): an edge from a to b. Loops run a few joins a round over what is left; each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.hold import hold as held

Hold = Callable[[DataFrame], DataFrame]


def small_components(edges: dict[Hashable, Iterable[Hashable]]) -> list[list]:
    """Strong components of a graph that fits the driver (formulas, not cells), each after all that it has edges to."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    path: list = []
    found: list[list] = []
    for start in edges:
        if start in index:
            continue
        work = [(start, iter(edges.get(start, ())))]
        index[start] = low[start] = len(index)
        path.append(start)
        on.add(start)
        while work:
            node, ahead = work[-1]
            for other in ahead:
                if other not in index:
                    index[other] = low[other] = len(index)
                    path.append(other)
                    on.add(other)
                    work.append((other, iter(edges.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    cut = path.index(node)
                    found.append(path[cut:])
                    on.difference_update(path[cut:])
                    del path[cut:]
    return found


def small_cycles(edges: dict[str, Iterable[str]]) -> list[list[str]]:
    """For each strong component of a graph that fits the driver, a shortest cycle through its least member, which begins and ends it; of equal ones the least."""
    found = []
    for members in small_components(edges):
        own, start = set(members), min(members)
        paths, seen = [[start]], {start}
        while paths:
            ahead = sorted([*path, b] for path in paths for b in set(edges.get(path[-1], ())) & own)
            closed = [path for path in ahead if path[-1] == start]
            if closed:
                found.append(closed[0])
                break
            paths = []
            for path in ahead:
                if path[-1] not in seen:
                    seen.add(path[-1])
                    paths.append(path)
    return found


def _trimmed(edges: DataFrame, hold: Hold) -> tuple[DataFrame, int]:
    """Without edges from or to nodes that no cycle can hold: those that nothing leads to, or that lead nowhere."""
    edges = hold(edges)
    n = edges.count()
    while n:
        out, into = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = hold(edges.join(out, "b", "left_semi").join(into, "a", "left_semi").select("a", "b"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges, n


def strong_components(edges: DataFrame, hold: Hold = held) -> DataFrame:
    """(id, component): the nodes that lie on a cycle, with the greatest member of their strong component.

    Colouring: each node takes the greatest id from which it can be reached; the nodes of a colour from which its own node can be
    reached are a component. These leave, and the rest, trimmed, goes on. A node between two cycles is in none.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    edges, n = _trimmed(edges.select("a", "b").distinct(), hold)
    done = spark.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("component", kind)]))
    while n:
        colour = edges.select(F.col("a").alias("id")).distinct().withColumn("colour", F.col("id"))
        while True:
            reached = edges.join(colour, F.col("a") == F.col("id")).groupBy("b").agg(F.max("colour").alias("new"))
            step = hold(colour.join(reached, F.col("id") == F.col("b"), "left").select("id", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
            colour = step.select("id", "colour")
            if step.filter("moved").isEmpty():
                break
        tone = lambda c: colour.select(F.col("id").alias(c), F.col("colour").alias(f"of_{c}"))
        inside = hold(edges.join(tone("a"), "a").join(tone("b"), "b").filter("of_a = of_b").select("a", "b", F.col("of_a").alias("colour")))
        found = frontier = hold(colour.filter("id = colour").select("id", "colour"))
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"), "colour").distinct()
            frontier = hold(back.join(found, ["id", "colour"], "left_anti"))
            found = hold(found.unionByName(frontier))
        # a root that has no edge inside its colour is no cycle
        looped = inside.join(found.select(F.col("id").alias("a"), "colour"), ["a", "colour"]).join(found.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"))
        done = hold(done.unionByName(found.join(looped.distinct(), "id", "left_semi").select("id", F.col("colour").alias("component"))))
        gone = lambda c: found.select(F.col("id").alias(c))
        edges, n = _trimmed(edges.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b"), hold)
    return done


def shortest_cycles(edges: DataFrame, components: DataFrame, hold: Hold = held) -> DataFrame:
    """(component, path): for each strong component, a shortest cycle through its least member, which begins and ends the list.

    Breadth-first search inside the components; of paths of equal length to a node the least is kept.
    """
    of = lambda c: components.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    inside = hold(edges.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").filter("of_a = of_b").select("a", "b", F.col("of_a").alias("component")))
    start = components.groupBy("component").agg(F.min("id").alias("start"))
    frontier = seen = hold(start.select("component", "start", F.col("start").alias("id"), F.array("start").alias("path")))
    done = None
    while not frontier.isEmpty():
        step = frontier.join(inside.withColumnRenamed("a", "id"), ["component", "id"]).select("component", "start", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        step = hold(step.groupBy("component", "start", "id").agg(F.min("path").alias("path")))
        closed = step.filter("id = start").select("component", "path")
        done = hold(closed if done is None else done.unionByName(closed))
        frontier = hold(step.join(done, "component", "left_anti").join(seen, ["component", "id"], "left_anti"))
        seen = hold(seen.select("component", "id").unionByName(frontier.select("component", "id")))
    return done if done is not None else start.select("component", F.array("start").alias("path")).limit(0)


def formula_strata(reads: dict[str, list[tuple[str, int, bool]]]) -> dict[str, tuple[int, str, int]]:
    """(level, mode, place) of each formula; reads: the formulas that it reads, by what offset of periods, and whether the period is named.

    A level comes after all levels that it reads. Modes: ``once`` for a formula that does not read itself by any way, all of
    whose cells can be computed together; ``forward`` or ``backward`` for components that read themselves at earlier or at later
    periods alone, period by period, each by place; ``cells`` for the rest, where only cells tell what comes first.
    """
    graph = {t: [other for other, _, _ in refs] for t, refs in reads.items()}
    level: dict[str, int] = {}
    found: dict[str, tuple[int, str, int]] = {}
    for members in small_components(graph):
        own = set(members)
        at = max((level[other] + 1 for t in members for other in graph[t] if other not in own), default=0)
        level |= dict.fromkeys(members, at)
        inner = [(t, other, offset, named) for t in members for other, offset, named in reads[t] if other in own]
        signs = {offset > 0 for _, _, offset, _ in inner if offset}
        still = {t: [other for a, other, offset, named in inner if a == t and not offset and not named] for t in members}
        order = small_components(still)
        if not inner:
            found |= dict.fromkeys(members, (at, "once", 0))
        elif any(named for *_, named in inner) or len(signs) != 1 or any(len(c) > 1 or c[0] in still[c[0]] for c in order):
            found |= dict.fromkeys(members, (at, "cells", 0))
        else:
            place: dict[str, int] = {}
            for (t,) in order:
                place[t] = max((place[other] + 1 for other in still[t]), default=0)
            found |= {t: (at, "backward" if signs == {True} else "forward", place[t]) for t in members}
    return found
