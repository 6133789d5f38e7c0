"""The same graph operators in numpy and plain Python, for comparison."""

import heapq
import math

import numpy as np


def knn(x, q, k, skip=None):
    d = ((x - q) ** 2).sum(axis=1)
    order = sorted(range(len(x)), key=lambda j: (d[j], j))
    return [j for j in order if (d[j] >= 1e-24 if skip is None else j != skip)][:k]


def tangent(x, i, k, p):
    near = x[knn(x, x[i], k)]
    u, _, _ = np.linalg.svd((near - near.mean(axis=0)).T, full_matrices=False)
    return u[:, :p]


def distance(a, b, metric):
    t = np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), 0, 1))
    return math.sqrt((t**2).sum() if metric == "geodesic" else (np.sin(t) ** 2).sum())


def representatives(n, m):
    return list(range(n)) if n <= m else sorted({round(1 + (n - 1) * t / (m - 1)) - 1 for t in range(m)})


def entity_matrix(x, owners, k, p, m, metric):
    ids = list(dict.fromkeys(owners))
    t = {}
    for e in ids:
        own = [i for i, o in enumerate(owners) if o == e]
        t[e] = [tangent(x, own[r], k, p) for r in representatives(len(own), m)]
    n = len(ids)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = d[j, i] = np.mean([distance(a, b, metric) for a in t[ids[i]] for b in t[ids[j]]])
    return ids, d


def adjacency(d, k):
    n = len(d)
    return [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]


def greedy(d, start, depth):
    nodes, seen = [start], {start}
    for _ in range(depth):
        left = [j for j in range(len(d)) if j not in seen]
        if not left:
            break
        j = min(left, key=lambda j: (d[nodes[-1], j], j))
        nodes.append(j)
        seen.add(j)
    return nodes


def greedy_to(d, a, b, depth):
    nodes, seen = [a], {a}
    for _ in range(depth):
        if nodes[-1] == b:
            break
        left = [j for j in range(len(d)) if j not in seen]
        if not left:
            break
        j = min(left, key=lambda j: (d[j, b], j))
        nodes.append(j)
        seen.add(j)
    return nodes if nodes[-1] == b else None


def shortest(d, adj, a):
    best, heap = {a: 0.0}, [(0.0, a)]
    while heap:
        c, i = heapq.heappop(heap)
        if c > best[i]:
            continue
        for j in adj[i]:
            if c + d[i, j] < best.get(j, math.inf):
                best[j] = c + d[i, j]
                heapq.heappush(heap, (best[j], j))
    return best


def reachable(d, adj, a, hops):
    best, queue = {a: (0.0, 0)}, [(a, 0.0, 0)]
    while queue:
        i, c, h = queue.pop(0)
        if h == hops:
            continue
        for j in adj[i]:
            n = (c + d[i, j], h + 1)
            if j not in best or n[0] < best[j][0]:
                best[j] = n
            queue.append((j, *n))
    best.pop(a)
    return best


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def attractor(d, i):
    n = len(d)
    if n == 1:
        return i
    nn = [min((j for j in range(n) if j != a), key=lambda j: (d[a, j], j)) for a in range(n)]
    seen = set()
    while i not in seen:
        seen.add(i)
        i = nn[i]
    return i


def gini(x):
    return 0.0 if not sum(x) else sum(abs(a - b) for a in x for b in x) / (2 * len(x) * sum(x))
