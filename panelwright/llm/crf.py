"""A linear-chain conditional random field in numpy: fitted by its exact gradient, decoded by Viterbi in batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ROUNDS = 150
STEP = 0.2
SHRINK = 1e-3
BATCH = 128


def padded(rows: Sequence[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unequal length side by side, and which places are theirs."""
    size = np.asarray([len(r) for r in rows])
    out = np.full((len(rows), size.max(initial=0), *rows[0].shape[1:]), fill, np.int64)
    own = np.arange(out.shape[1]) < size[:, None]
    out[own] = np.concatenate(rows)
    return out, own


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chain:
    """Weights of (feature, tag), of (tag, next tag) and of first tags. Feature 0 stands for unknown ones."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin

    @classmethod
    def zeros(cls, features: int, tags: int) -> Chain:
        return cls(np.zeros((features, tags)), np.zeros((tags, tags)), np.zeros(tags))

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Of each tag at each place, from the features there (last axis)."""
        out = self.emit[features[..., 0]]
        for slot in range(1, features.shape[-1]):
            out = out + self.emit[features[..., slot]]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of tags ``y`` and, for each place, pair and beginning, seen less expected counts."""
        score = self.scores(x)
        n, length, tags = score.shape
        ahead = np.empty_like(score)
        ahead[:, 0] = self.begin + score[:, 0]
        for t in range(1, length):
            step = _sum_exp(ahead[:, t - 1, :, None] + self.move, 1) + score[:, t]
            ahead[:, t] = np.where(own[:, t, None], step, ahead[:, t - 1])
        total = _sum_exp(ahead[:, -1], 1)
        after = np.zeros_like(score)
        pairs = np.zeros_like(self.move)
        seen = np.eye(tags)[y]
        for t in range(length - 1, 0, -1):
            right = self.move + (score[:, t] + after[:, t])[:, None, :]
            joint = np.exp(ahead[:, t - 1, :, None] + right - total[:, None, None])[own[:, t]]
            pairs += np.einsum("na,nb->ab", seen[own[:, t], t - 1], seen[own[:, t], t]) - joint.sum(0)
            after[:, t - 1] = np.where(own[:, t, None], _sum_exp(right, 2), after[:, t - 1])
        places = np.where(own[..., None], seen - np.exp(ahead + after - total[:, None, None]), 0)
        picked = np.where(own, np.take_along_axis(score, y[..., None], 2)[..., 0], 0).sum()
        picked += self.begin[y[:, 0]].sum() + self.move[y[:, :-1], y[:, 1:]][own[:, 1:]].sum()
        return float(picked - total.sum()), places, pairs, places[:, 0].sum(0)

    @classmethod
    def fit(cls, rows: Sequence[np.ndarray], tags: Sequence[np.ndarray], features: int, kinds: int, rounds: int = ROUNDS) -> Chain:
        """From rows of features (place, slot) and their tags; steps are scaled by past gradients."""
        chain = cls.zeros(features, kinds)
        if not rows:
            return chain
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        parts = []
        for at in range(0, len(order), BATCH):  # rows of like length together
            members = order[at : at + BATCH]
            x, own = padded([rows[i] for i in members])
            parts.append((x, padded([tags[i] for i in members])[0], own))
        flat = np.concatenate([x[own] for x, _, own in parts])
        by_feature = np.argsort(flat, axis=None, kind="stable")
        used, first = np.unique(flat.ravel()[by_feature], return_index=True)
        place = by_feature // flat.shape[1]
        past = [np.full_like(w, 1e-8) for w in (chain.emit, chain.move, chain.begin)]
        for _ in range(rounds):
            found = [chain.gradient(*part) for part in parts]
            places = np.concatenate([g[1][own] for g, (_, _, own) in zip(found, parts, strict=True)])
            pairs, begin = sum(g[2] for g in found), sum(g[3] for g in found)
            emit = np.zeros_like(chain.emit)
            emit[used] = np.add.reduceat(places[place], first)
            for w, g, p in zip((chain.emit, chain.move, chain.begin), (emit, pairs, begin), past, strict=True):
                g = g / len(rows) - SHRINK * w
                p += g * g
                w += STEP * g / np.sqrt(p)
        chain.emit[0] = 0
        return chain

    def decode(self, rows: Sequence[np.ndarray], batch: int = 4096) -> list[np.ndarray]:
        """The most likely tags of each row; of equals, lower tags. Rows of like length advance together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, own = padded([rows[i] for i in part])
            score = self.scores(x)
            best = self.begin + score[:, 0]
            back = np.zeros(score.shape, np.int8)
            for t in range(1, score.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = np.where(own[:, t, None], step.max(1) + score[:, t], best)
            tag = best.argmax(1)
            found = np.zeros(own.shape, np.int64)
            every = np.arange(len(part))
            for t in range(score.shape[1] - 1, -1, -1):
                found[:, t] = tag
                tag = np.where(own[:, t], back[every, t, tag], tag) if t else tag
            for i, tags, mine in zip(part, found, own, strict=True):
                out[i] = tags[mine]
        return out
