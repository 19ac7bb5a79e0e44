"""The graph queries over Python dicts, one row at a time."""

from itertools import product


class Graph:
    def __init__(self, rows):
        """rows: (start, start_label, rel, end, end_label)."""
        self.label, self.edge = {}, {}
        for s, sl, r, e, el in rows:
            self.label.setdefault(s, sl)
            self.label.setdefault(e, el)
            self.edge[s, 0, r, e] = el
            self.edge[e, 1, r, s] = sl

    def steps(self, v, dirs, rels, labels):
        return [d for (s, way, r, d), label in self.edge.items() if s == v and way in dirs and (not rels or r in rels) and (not labels or label in labels)]

    def khop(self, pks, k, direction, rels, labels):
        dirs = {1: (0,), 2: (1,), 3: (0, 1)}.get(direction)
        if k <= 0 or not pks or dirs is None:
            return 0
        seen = {p for p in pks if p in self.label and (not labels or self.label[p] in labels)}
        front = set(seen)
        for _ in range(k):
            front = {d for v in front for d in self.steps(v, dirs, rels, labels)} - seen
            seen |= front
        return len(seen)

    def walks(self, pks, k, direction, rels, labels, distinct):
        dirs = {1: (0,), 2: (1,), 3: (0, 1)}.get(direction)
        if k <= 0 or not pks or dirs is None:
            return 0
        level = list(dict.fromkeys(pks)) if distinct else list(pks)
        for _ in range(k):
            level = [d for v in level for r in (rels or [None]) for d in self.steps(v, dirs, [r] if r else [], labels)]
            level = list(dict.fromkeys(level)) if distinct else level
        return len(level)

    def common(self, pks, rels):
        if len(pks) < 2:
            return 0
        return len(set.intersection(*(set(self.steps(p, (0, 1), rels, [])) for p in pks)))

    def wcc(self, rels, labels):
        parent = {}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for v, label in self.label.items():
            if not labels or label in labels:
                parent.setdefault(v, v)
        for (s, way, r, d), label in self.edge.items():
            if way == 0 and s != d and (not labels or (self.label[s] in labels and label in labels)) and (not rels or r in rels):
                parent.setdefault(d, d)
                parent[find(s)] = find(d)
        return sum(parent[v] == v for v in parent)

    def match(self, nodes, edges):
        names, total = list(nodes), 0
        for values in product(*([v for v, label in self.label.items() if label in nodes[n]] for n in names)):
            at = dict(zip(names, values))
            total += all(any((at[s], {"OUT": 0, "IN": 1}.get(d), r, at[t]) in self.edge for r in rels) for s, t, rels, d in edges)
        return total
