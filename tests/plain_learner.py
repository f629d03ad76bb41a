"""The learner of clustering.MicroClusters, written plainly."""

from __future__ import annotations

import numpy as np


class PlainLearner:
    """The learner by plain dictionaries, each distance and each power made anew."""

    def __init__(self, radius: float, fading: float, every: int = 2, overlap: float = 0.3, least: float = 1.0) -> None:
        self.radius, self.fading, self.every, self.overlap, self.least = radius, fading, every, overlap, least
        self.t, self.next_id = 0, 0
        self.centers: dict[int, np.ndarray] = {}
        self.weights: dict[int, tuple[float, int]] = {}
        self.shared: dict[tuple[int, int], tuple[float, int]] = {}

    def _faded(self, at: tuple[float, int]) -> float:
        return at[0] * 2 ** (-self.fading * (self.t - at[1]))

    def learn(self, x: np.ndarray) -> None:
        self.t += 1
        hits = {i: d for i, c in self.centers.items() if (d := float(np.linalg.norm(c - x))) <= self.radius}
        if not hits:
            self.centers[self.next_id], self.weights[self.next_id] = x.copy(), (1.0, self.t)
            self.next_id += 1
        else:
            before = {i: self.centers[i] for i in hits}
            for i, d in hits.items():
                self.weights[i] = self._faded(self.weights[i]) + 1, self.t
                self.centers[i] = before[i] + np.exp(-(d * d) / (2 * (self.radius / 3) ** 2)) * (x - before[i])
            ids = sorted(hits)
            for a in range(len(ids)):
                for b in range(a + 1, len(ids)):
                    pair = ids[a], ids[b]
                    self.shared[pair] = self._faded(self.shared.get(pair, (0.0, self.t))) + 1, self.t
                    if np.linalg.norm(self.centers[pair[0]] - self.centers[pair[1]]) < self.radius:
                        self.centers[pair[0]], self.centers[pair[1]] = before[pair[0]], before[pair[1]]
        if self.t % self.every == 0:
            self._clean()

    def _clean(self) -> None:
        weak = 2 ** (-self.fading * self.every)
        gone = {i for i, w in self.weights.items() if self._faded(w) < weak}
        for i in gone:
            del self.centers[i], self.weights[i]
        self.shared = {p: s for p, s in self.shared.items() if not gone & set(p) and self._faded(s) >= weak * self.overlap}

    def groups(self) -> dict[int, tuple[int, np.ndarray]]:
        """(group, weighted center of the group) of each micro-cluster that is heavy enough; the group is its smallest member."""
        own = {i: self._faded(w) for i, w in self.weights.items() if self._faded(w) >= self.least * 0.5}
        root = {i: i for i in own}

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for (a, b), s in self.shared.items():
            if a in own and b in own and self._faded(s) / ((own[a] + own[b]) / 2) >= self.overlap:
                low, high = sorted((find(a), find(b)))
                root[high] = low
        members: dict[int, list[int]] = {}
        for i in own:
            members.setdefault(find(i), []).append(i)
        out = {}
        for g, ids in members.items():
            w = np.array([own[i] for i in ids])
            center = (np.stack([self.centers[i] for i in ids]) * w[:, None]).sum(0) / w.sum()
            out |= {i: (g, center) for i in ids}
        return out

    def nearest(self, x: np.ndarray) -> tuple[int, float] | None:
        groups = self.groups()
        found = min(((float(np.linalg.norm(c - x)), g) for g, c in groups.values()), default=None)
        return None if found is None else (found[1], found[0])
