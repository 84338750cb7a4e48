"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import deque


def texts(rows):
    return {i: (t or "") for i, t in rows}


def components(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def jaccard(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in texts(rows).items()}
    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    seen, links = set(), []
    for ids in owners.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        links.append((a, b))
    least = components(sets, links)
    return {i: (len(sets[i]), least[i]) for i in sets}


def repeats(rows, depth):
    data = {i: t.encode() for i, t in texts(rows).items()}
    first = {}
    for i in sorted(data):
        for p in range(len(data[i]) - depth + 1):
            first.setdefault(data[i][p : p + depth], i)
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for p in range(len(d) - depth + 1):
            if first[d[p : p + depth]] < i:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i] = (len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def flow_by_single_paths(supply: list[int], members: list[list[int]], quota: list[int], max_copies: int) -> list[int]:
    """Words each pattern gives: a maximal flow of least cost, the k-th repetition of a word costing k - 1."""
    n_p, n_s = len(supply), len(quota)
    end = n_p + n_s + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)
        return len(to) - 2

    levels = [[edge(0, 1 + p, supply[p], k) for k in range(max_copies)] for p in range(n_p)]
    for p, sources in enumerate(members):
        for s in sources:
            edge(1 + p, 1 + n_p + s, max_copies * supply[p], 0)
    for s in range(n_s):
        edge(1 + n_p + s, end, quota[s], 0)
    while True:
        dist, via, queue, inside = [float("inf")] * (end + 1), [-1] * (end + 1), deque([0]), {0}
        dist[0] = 0
        while queue:
            a = queue.popleft()
            inside.discard(a)
            for e in out[a]:
                if cap[e] > 0 and dist[a] + cost[e] < dist[to[e]]:
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in inside:
                        queue.append(to[e])
                        inside.add(to[e])
        if via[end] < 0:
            return [sum(cap[e ^ 1] for e in es) for es in levels]
        path, at = [], end
        while at:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount


def shares(total, weights, caps):
    """Each source's target: a level is searched at which shares by weight, stopped at their caps, use the total."""
    low, high = 0.0, max((c / w for c, w in zip(caps, weights, strict=True)), default=0.0)
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(c, level * w) for c, w in zip(caps, weights, strict=True)) < total:
            low = level
        else:
            high = level
    return [min(c, high * w) for c, w in zip(caps, weights, strict=True)]
