"""Two-way labelling of least cost by a minimum cut."""

from __future__ import annotations

from collections import deque


def _settled(gain: list[float], links: list[dict[int, float]]) -> list[bool | None]:
    """Labels that no choice of the neighbours can change; their links are folded into the gains of the others."""
    label: list[bool | None] = [None] * len(gain)
    waiting = deque(range(len(gain)))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(gain[i]) >= sum(links[i].values()):
            label[i] = gain[i] > 0
            for j, weight in links[i].items():
                gain[j] += weight if label[i] else -weight
                del links[j][i]
                waiting.append(j)
            links[i] = {}
    return label


def labels(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels that cost least: a node pays |gain| if its label is not its gain's sign, an edge its weight if its ends differ.

    A gain above zero is the capacity from the source, one below zero to the
    sink, an edge's weight the capacity both ways; after a maximum flow the nodes that
    the source still reaches are true. Nodes whose gain outweighs all their
    edges are settled first, which leaves the cut as it is. Equal cuts: false.
    """
    gain = [g / 1.0 for g in gain]
    links: list[dict[int, float]] = [{} for _ in gain]
    for a, b, weight in edges:
        if a != b and weight > 0:
            links[a][b] = links[a].get(b, 0.0) + weight
            links[b][a] = links[b].get(a, 0.0) + weight
    label = _settled(gain, links)
    rest = [i for i, known in enumerate(label) if known is None]
    if rest:
        for i, reached in zip(rest, _reached(rest, gain, links)):
            label[i] = reached
    return [bool(x) for x in label]


def _reached(rest: list[int], gain: list[float], links: list[dict[int, float]]) -> list[bool]:
    """Whether the source reaches each node after a maximum flow, by blocking flows over levels."""
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{place[j]: w for j, w in links[i].items()} for i in rest] + [{}, {}]
    for k, i in enumerate(rest):
        if gain[i] > 0:
            room[source][k], room[k][source] = gain[i], 0.0
        elif gain[i] < 0:
            room[k][sink], room[sink][k] = -gain[i], 0.0
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, left in room[a].items():
                if left > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return [k in level for k in range(len(rest))]
        turn = [list(r) for r in room]
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0.0) + flow
                path = path[: next(n for n, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] <= tiny) + 1]
                continue
            while turn[a] and not (room[a][turn[a][-1]] > tiny and level.get(turn[a][-1]) == level[a] + 1):
                turn[a].pop()
            if turn[a]:
                path.append(turn[a][-1])
            else:
                path.pop()
                if path:
                    turn[path[-1]].pop()
