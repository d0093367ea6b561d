"""Minimum cuts of small graphs."""

from __future__ import annotations

from collections import deque


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Label nodes so that the labels' costs and the cut edges' weights together are least.

    ``costs[i]`` is what label True costs node i more than label False; a pair with unlike
    labels costs its weight.  Nodes whose cost outweighs all their edges are settled first (no least
    labelling differs there); max-flow from the terminals labels the others.  Ties become False.
    """
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    cost = list(costs)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(cost[i]) <= sum(near[i].values()):
            continue
        label[i] = cost[i] < 0
        for j, w in near[i].items():
            # Beside a settled node the other label costs the edge.
            cost[j] += -w if label[i] else w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        reached = _flow(open_nodes, cost, near)
        for i in open_nodes:
            label[i] = i in reached
    return [bool(x) for x in label]


def _flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side after max-flow; capacities to the terminals are the costs."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        left.setdefault(i, {})
        for j, w in near[i].items():
            left[i][j] = w
        if cost[i] < 0:
            left[source][i], left[i][source] = -cost[i], 0.0
        elif cost[i] > 0:
            left[i][sink], left[sink][i] = cost[i], 0.0
    tiny = 1e-9
    while True:
        level = {source: 0}
        line = deque([source])
        while line:
            a = line.popleft()
            for b, w in left[a].items():
                if w > tiny and b not in level:
                    level[b] = level[a] + 1
                    line.append(b)
        if sink not in level:
            level.pop(source)
            return set(level)
        tried = {a: iter(list(left[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                push = min(left[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    left[x][y] -= push
                    left[y][x] = left[y].get(x, 0.0) + push
                back = next(k for k in range(len(path) - 1) if left[path[k]][path[k + 1]] <= tiny)
                del path[back + 1 :]
                continue
            for b in tried[a]:
                if left[a][b] > tiny and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                level[a] = -1
                path.pop()
