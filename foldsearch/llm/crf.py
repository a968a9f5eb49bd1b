"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi where anything but O is possible.

A token's score for a label is a sum over its neighbours, one table for each offset, plus tables for pairs of neighbouring coarse classes and for columns
that say something of the place of a token (see the caller). The neighbours' tables are sums of the weights of a token's features, so a token is scored by looking up rows; features are made once for each distinct token.

All scores are relative to label O (index 0), which so has score 0 everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

OFFSETS = (-6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5)
#: Pairs of offsets whose coarse classes are looked at together.
PAIRS = ((-3, -2), (-2, -1), (-1, 0), (0, 1), (1, 2), (2, 3))
#: Outside tokens to put between sequences, so that none sees another's.
GAP = 6
NEVER = -1e4
#: Positions scored at once.
BLOCK = 1 << 15


@dataclass
class Model:
    labels: list[str]
    classes: int
    features: dict[str, int]
    weights: np.ndarray  # offset x feature x label but O
    pairs: np.ndarray  # pair x class*class x label but O
    moves: np.ndarray  # from label x to label
    starts: np.ndarray
    columns: list[np.ndarray]  # for each column its values x label but O
    extra: dict = field(default_factory=dict)

    def rows(self, tokens: list[tuple[str, ...]]) -> np.ndarray:
        """Scores (offset x token x label but O) of tokens given by their features; unknown features count nothing."""
        out = np.zeros((len(OFFSETS), len(tokens), len(self.labels) - 1), np.float32)
        for i, fs in enumerate(tokens):
            at = [self.features[f] for f in fs if f in self.features]
            if at:
                out[:, i] = self.weights[:, at].sum(axis=1)
        return out

    def emissions(self, table: np.ndarray, ids: np.ndarray, classes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Scores (position x label but O). ``table`` from :meth:`rows`, its token 0 and class 0 standing for outside; sequences are GAP outside tokens apart."""
        n = len(ids)
        e = np.zeros((n, table.shape[2]), np.float32)
        wide = np.zeros(n + 2 * GAP, np.int64)
        wide[GAP : GAP + n] = ids
        cls = np.zeros(n + 2 * GAP, np.int64)
        cls[GAP : GAP + n] = classes
        for at in range(0, n, BLOCK):
            upto = min(n, at + BLOCK)
            part = e[at:upto]
            for k, off in enumerate(OFFSETS):
                part += table[k].take(wide[at + GAP + off : upto + GAP + off], axis=0)
            for k, (a, b) in enumerate(PAIRS):
                part += self.pairs[k].take(cls[at + GAP + a : upto + GAP + a] * self.classes + cls[at + GAP + b : upto + GAP + b], axis=0)
            for own, column in zip(self.columns, columns):
                part += own.take(column[at:upto], axis=0)
        return e

    def possible(self, e: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """Where the best path may have another label than O: the exact gain of the best entity over each position, plus all that moves could add, is above 0.

        An entity of type x from a to b gains B-x at a and I-x after it against O on the whole of it. The best over all a and b around a position
        are two running maxima over sums from the left.
        """
        out = np.zeros(len(e), bool)
        m = self.moves
        for b, name in enumerate(self.labels):
            if not name.startswith("B-"):
                continue
            i = self.labels.index("I-" + name[2:])
            real_from = m[:, 0] > NEVER / 2
            enter = max((m[real_from, b] - m[real_from, 0]).max(), self.starts[b] - self.starts[0])
            leave = 0.0
            for last in (b, i):
                ok = (m[last] > NEVER / 2) & (m[0] > NEVER / 2)
                leave = max(leave, (m[last] - m[0])[ok].max())
            goes_on = max(m[b, i], m[i, i]) - m[0, 0]
            begun = np.where(outside, NEVER, e[:, b - 1].astype(np.float64))
            inside = np.where(outside, NEVER, e[:, i - 1] + goes_on)
            left = np.cumsum(inside)
            ending = left + np.maximum.accumulate(begun - left)
            out |= ending + np.maximum.accumulate(left[::-1])[::-1] - left + enter + leave > -1e-3
        return out & ~outside

    def label(self, e: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """Best labels of all positions: the same as decoding every sequence whole, but done only where :meth:`possible`."""
        out = np.zeros(len(e), np.int64)
        near = self.possible(e, outside)
        near[1:] |= near[:-1].copy()
        near[:-1] |= near[1:].copy()
        near &= ~outside
        if not near.any():
            return out
        edge = np.diff(np.concatenate([[0], near.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        order = np.argsort(end - begin, kind="stable")
        at = 0
        while at < len(order):
            longest = int((end - begin)[order[min(len(order), at + 1000) - 1]])
            take = order[at : at + max(1, min(1000, 40_000 // longest))]
            at += len(take)
            b, n = begin[take], (end - begin)[take]
            grid = np.minimum(b[:, None] + np.arange(n.max())[None], len(e) - 1)
            score = np.zeros((*grid.shape, len(self.labels)), np.float32)
            score[:, :, 1:] = e[grid]
            first = (b == 0) | outside[b - 1]  # else the first position is known to be O, and likewise the last
            last = (end[take] == len(e)) | outside[np.minimum(end[take], len(e) - 1)]
            rows = np.arange(len(take))
            score[rows[~first], 0, 1:] = NEVER
            score[rows[~last], n[~last] - 1, 1:] = NEVER
            got = self.decode(score, n, first)
            for row, (x, k) in enumerate(zip(b, n)):
                out[x : x + k] = got[row, :k]
        return out

    def decode(self, e: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Best labels (sequences x positions) of scores with a column for O; positions beyond a sequence's length get label 0.

        ``first`` tells which rows begin a sequence (all by default).
        """
        n, t, k = e.shape
        begun = self.starts[None] if first is None else np.where(first[:, None], self.starts[None], 0)
        score = (e[:, 0] + begun).astype(np.float32)
        back = np.zeros((n, t, k), np.int8)
        final = score.copy()
        into = np.ascontiguousarray(self.moves.T.astype(np.float32))  # to x from
        for i in range(1, t):
            step = score[:, None, :] + into[None]
            best = step.argmax(axis=2)
            back[:, i] = best
            score = np.take_along_axis(step, best[:, :, None], axis=2)[:, :, 0] + e[:, i]
            going = lengths > i
            final[going] = score[going]
        out = np.zeros((n, t), np.int64)
        here = final.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            inside = lengths > i
            out[inside, i] = here[inside]
            here = np.where(inside, back[rows, i, here], here) if i else here
        return out


def allowed_moves(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """NEVER where label I-x doesn't follow B-x or I-x, and where a sequence would start with I-x."""
    k = len(labels)
    moves, starts = np.zeros((k, k)), np.zeros(k)
    for j, to in enumerate(labels):
        if to.startswith("I-"):
            starts[j] = NEVER
            for i, was in enumerate(labels):
                if was[2:] != to[2:] or was == "O":
                    moves[i, j] = NEVER
    return moves, starts


def train(
    tokens: list[tuple[str, ...]], token_classes: int, ids: np.ndarray, classes: np.ndarray, columns: list[np.ndarray], sizes: list[int], gold: np.ndarray, begins: np.ndarray, lengths: np.ndarray, labels: list[str],
    rounds: int = 60, steps: int = 20, rate: float = 0.08, decay: float = 1e-5, least: int = 3,
) -> Model:
    """Maximise the likelihood of ``gold`` by Adam, each round in ``steps`` parts of the sequences.

    ``ids`` are rows of ``tokens`` (feature names of each distinct token; row 0 is outside), ``classes`` the coarse classes (0 outside), ``columns`` of values below
    ``sizes``, all one after another with GAP outside tokens between sequences, which begin at ``begins``. Features of fewer than ``least`` distinct tokens
    are left out.
    """
    seen: dict[str, int] = {}
    for fs in tokens:
        for f in fs:
            seen[f] = seen.get(f, 0) + (least if f.startswith("w=") else 1)
    names = sorted(f for f, c in seen.items() if c >= least)
    index = {f: i for i, f in enumerate(names)}
    k, n_off, n_feat = len(labels), len(OFFSETS), len(names)
    m = k - 1
    of = np.full((len(tokens), max(len(fs) for fs in tokens)), n_feat, np.int64)  # the row beyond the last feature stays 0
    for i, fs in enumerate(tokens):
        at = [index[f] for f in fs if f in index]
        of[i, : len(at)] = at
    hard_moves, hard_starts = allowed_moves(labels)
    weights = np.zeros((n_feat + 1, n_off * m), np.float32)
    pairs = [np.zeros((token_classes**2, m), np.float32) for _ in PAIRS]
    own = [np.zeros((size, m), np.float32) for size in sizes]
    moves, first_scores = hard_moves.copy(), hard_starts.copy()
    padded = np.concatenate([np.zeros(GAP, np.int64), ids, np.zeros(GAP, np.int64)])
    padded_classes = np.concatenate([np.zeros(GAP, np.int64), classes, np.zeros(GAP, np.int64)])
    groups = []
    for take in np.array_split(np.random.default_rng(1).permutation(len(begins)), steps):
        part_groups = []
        for part in np.array_split(take[np.argsort(lengths[take], kind="stable")], 2):  # like lengths together, so that little is padding
            if len(part) == 0:
                continue
            t = int(lengths[part].max())
            real = np.arange(t)[None] < lengths[part][:, None]
            at = (begins[part][:, None] + np.arange(t)[None])[real]
            used, local = np.unique(np.stack([padded[at + GAP + off] for off in OFFSETS]), return_inverse=True)
            feats = of[used]
            tok, slot = np.nonzero(feats < n_feat)
            by_feature = np.argsort(feats[tok, slot], kind="stable")
            sparse = (feats, feats[tok, slot][by_feature], tok[by_feature])
            duos = [padded_classes[at + GAP + a] * token_classes + padded_classes[at + GAP + b] for a, b in PAIRS]
            g = gold[at]
            one = np.zeros((len(at), m), np.float32)
            one[np.flatnonzero(g), g[g > 0] - 1] = 1
            whole = np.zeros(real.shape, np.int64)
            whole[real] = g
            both = real[:, 1:]
            moved = np.zeros((k, k))
            np.add.at(moved, (whole[:, :-1][both], whole[:, 1:][both]), 1)
            part_groups.append((real, sparse, len(used), local.reshape(n_off, -1), duos, [c[at] for c in columns], one, moved, np.bincount(whole[:, 0], minlength=k), lengths[part]))
        groups.append(part_groups)
    params = [weights, moves, first_scores, *pairs, *own]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    done, every = 0, rounds * len(groups)
    for _ in range(rounds):
        for part_groups in groups:
            grads = [np.zeros_like(p) for p in params]
            size = 0
            for real, (feats, by_feature, tok), n_used, toks, duos, cols, one, moved, begun, n in part_groups:
                size += len(real)
                table = weights.take(feats[:, 0], axis=0)
                for j in range(1, feats.shape[1]):
                    table += weights.take(feats[:, j], axis=0)
                table = table.reshape(n_used, n_off, m)
                flat = np.zeros((len(one), m), np.float32)
                for i in range(n_off):
                    flat += table[toks[i], i]
                for p, d in zip([*pairs, *own], [*duos, *cols]):
                    flat += p.take(d, axis=0)
                e = np.zeros((*real.shape, k), np.float32)
                e[..., 1:][real] = flat
                marg, exp_moves, exp_starts = _expected(e, moves, first_scores, n)
                diff = one - marg[real][:, 1:]
                grads[1] += moved - exp_moves
                grads[2] += begun - exp_starts
                wrong = np.flatnonzero(np.abs(diff).max(axis=1) > 1e-3)  # ever fewer
                diff = diff[wrong]
                of_token = np.stack([_sum_rows(toks[i][wrong], diff, n_used) for i in range(n_off)], axis=1).reshape(n_used, n_off * m)
                on = np.flatnonzero(of_token.any(axis=1)[tok])
                f = by_feature[on]
                begins_f = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
                if len(f):
                    grads[0][f[begins_f]] += np.add.reduceat(of_token.take(tok[on], axis=0), begins_f, axis=0)
                for g, d in zip(grads[3:], [*duos, *cols]):
                    g += _sum_rows(d[wrong], diff, len(g))
            done += 1
            now = rate * min(1.0, 2.0 * (1 - (done - 1) / every))  # slower towards the end
            grads[1][hard_moves == NEVER] = 0
            grads[2][hard_starts == NEVER] = 0
            for p, g, a, b in zip(params, grads, first, second):
                g = g / size
                g -= decay * np.where(p > NEVER / 2, p, 0)
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p += (now / (1 - 0.9**done) * a / (np.sqrt(b / (1 - 0.99**done)) + 1e-5)).astype(p.dtype)
    # weights near nothing are dropped, so that the model sent to the executors is small
    weights = weights[:n_feat]
    kept = np.abs(weights).max(axis=1) > 1e-3
    own_names = {f: i for i, f in enumerate(n for n, u in zip(names, kept) if u)}
    by_offset = np.ascontiguousarray(weights[kept].reshape(-1, n_off, m).transpose(1, 0, 2))
    return Model(labels, token_classes, own_names, by_offset, np.stack(pairs), moves, first_scores, own)


def _sum_rows(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    k = rows.shape[1]
    flat = (at[:, None] * k + np.arange(k)[None]).ravel()
    return np.bincount(flat, weights=rows.ravel(), minlength=size * k).reshape(size, k).astype(np.float32)


def _expected(e: np.ndarray, moves: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of labels, summed marginals of moves and of first labels, by scaled forward and backward passes."""
    n, t, k = e.shape
    x = np.exp(e - e.max(axis=2, keepdims=True))
    a = (np.exp(np.clip(moves, -50, 50)) * (moves > NEVER / 2)).astype(np.float32)
    alpha = np.zeros((t, n, k), np.float32)
    xs = np.ascontiguousarray(x.transpose(1, 0, 2))
    alpha[0] = xs[0] * (np.exp(np.clip(starts, -50, 50)) * (starts > NEVER / 2)).astype(np.float32)
    alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        s = (alpha[i - 1] @ a) * xs[i]
        alpha[i] = s / np.maximum(s.sum(axis=1, keepdims=True), 1e-30)
    beta = np.ones((t, n, k), np.float32)
    for i in range(t - 2, -1, -1):
        s = (beta[i + 1] * xs[i + 1]) @ a.T
        s /= np.maximum(s.sum(axis=1, keepdims=True), 1e-30)
        beta[i] = np.where((lengths > i + 1)[:, None], s, 1.0)
    marg = alpha * beta
    marg /= np.maximum(marg.sum(axis=2, keepdims=True), 1e-30)
    going = np.arange(1, t)[:, None] < lengths[None]
    left, right = alpha[:-1][going], (beta[1:] * xs[1:])[going]
    z = ((left @ a) * right).sum(axis=1)
    exp_moves = a * ((left / np.maximum(z, 1e-30)[:, None]).T @ right) if len(left) else np.zeros((k, k))
    return marg.transpose(1, 0, 2), exp_moves.astype(float), marg[0].sum(axis=0).astype(float)
