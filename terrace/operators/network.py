"""Betweenness of the players of a pass network; a group is a team of a match, some 14 players."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def betweenness_of(nodes: list[str], edges: list[tuple[str, str, float]]) -> dict[str, float]:
    """Share of the shortest paths between two others that pass through a node (Brandes' accumulation); edges carry lengths."""
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for a, b, length in edges:
        near[a].append((b, length))
        near[b].append((a, length))
    score = dict.fromkeys(nodes, 0.0)
    for source in nodes:
        distance, paths, parents, order = {source: 0.0}, {source: 1.0}, defaultdict(list), []
        heap, done = [(0.0, source)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, length in near[v]:
                through = d + length
                if w not in distance or through < distance[w] - 1e-12:
                    distance[w], paths[w], parents[w] = through, paths[v], [v]
                    heapq.heappush(heap, (through, w))
                elif abs(through - distance[w]) <= 1e-12 and w not in done:
                    paths[w] += paths[v]
                    parents[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in parents[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != source:
                score[w] += share[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in score.items()}


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(match_id, team, player, betweenness); an edge is as long as one over its passes."""
    named = nodes.select("match_id", "team", F.col("player").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("length"))
    rows = named.unionByName(edges.select("match_id", "team", "a", "b", (1.0 / F.col("weight")).alias("length")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        linked = group[group["b"].notna()]
        players = sorted({*group["a"], *linked["b"]})
        found = betweenness_of(players, list(linked[["a", "b", "length"]].sort_values(["a", "b"]).itertuples(index=False, name=None)))
        return pd.DataFrame({"match_id": group["match_id"].iloc[0], "team": group["team"].iloc[0], "player": players, "betweenness": [round(found[p], 4) for p in players]})

    return rows.groupBy("match_id", "team").applyInPandas(run, "match_id int, team string, player string, betweenness double")
