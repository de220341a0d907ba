"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import unicodedata
from pathlib import Path
from typing import BinaryIO

import numpy as np

#: Kinds of personal data, in the order of their labels; label 0 is none.
KINDS = ("email", "phone", "id_number", "street_address", "person_name")
LABELS = len(KINDS) + 1
_FIRST, _LAST = 32, 126
#: Codes after the printable ASCII characters: line end, letters of other scripts (large, small), digits, dashes, spaces, all else.
NEWLINE, LARGE, SMALL, DIGIT, DASH, SPACE, OTHER = range(_LAST - _FIRST + 2, _LAST - _FIRST + 9)
VOCABULARY = OTHER + 1
#: Characters of a window, and how many neighbouring windows share.
WINDOW, OVERLAP = 256, 48
_BATCH = 1024


#: Letters that have no decomposition, and what they are read as.
_LETTERS = {"ß": "s", "ø": "o", "Ø": "O", "æ": "a", "Æ": "A", "œ": "o", "Œ": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "t", "Þ": "T", "ı": "i", "ħ": "h", "ẞ": "S", "’": "'", "‘": "'"}


def _code(c: int) -> int:
    if _FIRST <= c <= _LAST:
        return c - _FIRST + 1
    char = chr(c)
    base = ord(_LETTERS.get(char) or unicodedata.normalize("NFD", char)[:1] or char)
    if base != c and _FIRST <= base <= _LAST:
        # letters with marks are read as the letter
        return base - _FIRST + 1
    if char in "\n\r":
        return NEWLINE
    if char.isspace():
        return _code(32)
    if 0x2010 <= c <= 0x2015 or c in (0xAD, 0x2212):
        return DASH
    if char.isdigit():
        return DIGIT
    if char.isalpha():
        return LARGE if char.isupper() else SMALL
    return OTHER


_TABLE = np.array([_code(c) for c in range(0x2100)], np.uint8)


def encode(text: str) -> np.ndarray:
    """One code per character, from 1."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= len(_TABLE)
    out = _TABLE[np.where(high, 0, points)]
    if high.any():
        out[high] = [_code(int(c)) if c < 0xD800 or c > 0xDFFF else OTHER for c in points[high]]
    return out


class Tagger:
    """Weights, scoring and training. Each direction has an input table, a recurrent matrix and its part of the output."""

    def __init__(self, hidden: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.hidden = h = hidden
        f = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = f(VOCABULARY, 4 * h, s=0.3)
            self.weights[f"x{d}"][:, h : 2 * h] += 1.0  # forget gates begin open
            self.weights[f"h{d}"] = f(h, 4 * h, s=1 / np.sqrt(h))
        self.weights["o"] = f(2 * h, LABELS, s=0.2)
        self.weights["ob"] = np.zeros(LABELS, np.float32)
        self.weights["t"] = f(LABELS, LABELS, s=0.1)

    def save(self, path: Path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.weights.items()})

    @classmethod
    def load(cls, path: Path | BinaryIO) -> Tagger:
        with np.load(path) as stored:
            weights = {k: stored[k].astype(np.float32) for k in stored.files}
        out = cls(weights["hf"].shape[0])
        out.weights = weights
        return out

    def _scale(self) -> np.ndarray:
        """Gates are sigmoids, written as halves of tanh, so that one tanh serves all four parts."""
        h = self.hidden
        return np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)

    # --- scoring

    def _run(self, d: str, codes: np.ndarray, out: np.ndarray) -> None:
        """Adds one direction's part of the scores to ``out`` (time, batch, labels)."""
        h, scale = self.hidden, self._scale()
        table, matrix = self.weights[f"x{d}"] * scale, self.weights[f"h{d}"] * scale
        part = self.weights["o"][:h] if d == "f" else self.weights["o"][h:]
        steps = range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1)
        n = codes.shape[1]
        state, cell, z, x = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        gates, new, said = z[:, : 3 * h], np.empty((n, h), np.float32), np.empty((n, LABELS), np.float32)
        for t in steps:
            np.take(table, codes[t], axis=0, out=x, mode="clip")
            np.matmul(state, matrix, out=z)
            z += x
            np.tanh(z, out=z)
            gates *= 0.5
            gates += 0.5
            cell *= z[:, h : 2 * h]
            np.multiply(z[:, :h], z[:, 3 * h :], out=new)
            cell += new
            np.tanh(cell, out=state)
            state *= z[:, 2 * h : 3 * h]
            np.matmul(state, part, out=said)
            out[t] += said

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores (time, batch, labels) of codes (time, batch); 0 stands for no character."""
        out = np.broadcast_to(self.weights["ob"], (*codes.shape, LABELS)).copy()
        self._run("f", codes, out)
        self._run("b", codes, out)
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best label sequences (Viterbi) for several texts' scores (time, labels) at once."""
        move, out = self.weights["t"], [np.zeros(0, np.int8)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        at = 0
        while at < len(order):
            some = order[at : at + 32 * _BATCH]
            # a block holds as many texts as its longest one leaves room for
            while len(some) > 1 and len(some) * len(scores[some[-1]]) > 1_000_000:
                some = some[: len(some) // 2]
            at += len(some)
            sizes = np.array([len(scores[i]) for i in some])
            block = np.zeros((sizes.max(), len(some), LABELS), np.float32)
            for j, i in enumerate(some):
                block[: sizes[j], j] = scores[i]
            best, back, last = block[0].copy(), np.zeros((len(block), len(some), LABELS), np.int8), np.zeros(len(some), np.int8)
            for t in range(len(block)):
                if t:
                    # label by label: so few of them make a slow axis
                    top = best[:, :1] + move[0]
                    for k in range(1, LABELS):
                        step = best[:, k : k + 1] + move[k]
                        back[t][step > top] = k
                        np.maximum(top, step, out=top)
                    best = top + block[t]
                ends = sizes == t + 1
                if ends.any():
                    last[ends] = best[ends].argmax(1)
            path, label, rows = np.zeros(block.shape[:2], np.int8), last, np.arange(len(some))
            for t in range(len(block) - 1, -1, -1):
                # a text's path begins at its own last character
                label = np.where(sizes == t + 1, last, label)
                path[t] = label
                label = back[t, rows, label]
            for j, i in enumerate(some):
                out[i] = path[: sizes[j], j]
        return out

    def may_label(self, scores: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """Where a label other than none could be on the best path of whole texts (time, ..., labels); elsewhere none is, for certain.

        A run of labels is better than none only if what it gains over its characters
        outweighs the cost of the changes at its ends, of which only the text's own ends
        are free. So no run goes over a character that lies in no stretch of such a gain.
        """
        move = self.weights["t"]
        inside = max(0.0, float((move[1:, 1:] - move[0, 0]).max()))
        edge = float(max(move[0, 1:].max(), move[1:, 0].max()) - move[0, 0])
        gain = scores[..., 1:].max(-1) - scores[..., 0] + inside
        if real is not None:
            gain = np.where(real, gain, -1e4)
        sums = np.cumsum(gain, 0, dtype=np.float64)
        before = np.minimum.accumulate(np.concatenate([np.zeros_like(sums[:1]), sums[:-1]]), 0)
        after = np.maximum.accumulate(sums[::-1], 0)[::-1]
        whole = np.where(True if real is None else real, gain, 0).sum(0)
        return (after - before > inside - max(edge, 2 * edge) - 1e-3) | (whole > inside - 1e-3)

    def label(self, texts: list[str]) -> list[np.ndarray | None]:
        """Labels of each character of each text; None where all are none.

        Texts are cut into overlapping windows. In an overlap each character
        takes its scores from the window in which it lies further inside, and
        the best path is then sought over the scores of the whole text.
        """
        codes = [encode(t) for t in texts]
        windows = []
        for i, c in enumerate(codes):
            start = 0
            while True:
                windows.append((i, start, min(WINDOW, len(c) - start)))
                if start + WINDOW >= len(c):
                    break
                start += WINDOW - OVERLAP
        windows = sorted((w for w in windows if w[2] > 0), key=lambda w: w[2])
        scores: dict[int, np.ndarray] = {}
        hit: set[int] = set()
        for at in range(0, len(windows), _BATCH):
            some = windows[at : at + _BATCH]
            longest = some[-1][2]
            block = np.zeros((longest, len(some)), np.uint8)
            for j, (i, start, size) in enumerate(some):
                block[:size, j] = codes[i][start : start + size]
            found = self.emissions(block)
            may = (self.may_label(found, block > 0) & (block > 0)).any(0)
            for j, (i, start, size) in enumerate(some):
                if may[j]:
                    hit.add(i)
                if may[j] or len(codes[i]) > WINDOW:
                    whole = scores.get(i)
                    if whole is None:
                        whole = scores[i] = np.zeros((len(codes[i]), LABELS), np.float32)
                    low = start + (OVERLAP // 2 if start else 0)
                    high = start + size - (OVERLAP // 2 if start + size < len(codes[i]) else 0)
                    whole[low:high] = found[low - start : high - start, j]
        out: list[np.ndarray | None] = [None] * len(texts)
        numbers = sorted(hit)
        for i, labels in zip(numbers, self.decode_apart([scores[i] for i in numbers])):
            if labels.any():
                out[i] = labels
        return out

    def decode_apart(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """``decode``, run only over the stretches where a label could be.

        Where none can be, none is on the best path for certain, so a path falls into
        stretches with a certain none at either end.
        """
        out = [np.zeros(len(s), np.int8) for s in scores]
        order, at = sorted(range(len(scores)), key=lambda i: len(scores[i])), 0
        while at < len(order):
            # many texts at once, in a block with room for the longest of them
            some = order[at : at + _BATCH]
            while len(some) > 1 and len(some) * len(scores[some[-1]]) > 1_000_000:
                some = some[: len(some) // 2]
            at += len(some)
            sizes = np.array([len(scores[i]) for i in some])
            block = np.zeros((len(some), sizes.max(initial=0) + 1, LABELS), np.float32)
            for j, i in enumerate(some):
                block[j, : sizes[j]] = scores[i]
            real = np.arange(block.shape[1]) < sizes[:, None]
            may = self.may_label(block.swapaxes(0, 1), real.T).T & real
            edges = np.diff(np.concatenate([np.zeros((len(some), 1), np.int8), may.astype(np.int8)], 1), axis=1)
            row, first = np.nonzero(edges == 1)
            last = np.nonzero(edges == -1)[1]
            low, high = np.maximum(first - 1, 0), np.minimum(last + 1, sizes[row])
            pieces = []
            for j, a, b in zip(row.tolist(), low.tolist(), high.tolist()):
                piece = block[j, a:b].copy()
                if a > 0:
                    piece[0, 1:] = -1e9
                if b < sizes[j]:
                    piece[-1, 1:] = -1e9
                pieces.append(piece)
            for j, a, b, path in zip(row.tolist(), low.tolist(), high.tolist(), self.decode(pieces)):
                part = out[some[j]][a:b]
                np.maximum(part, path, out=part)
        return out

    # --- training

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character, and its gradients; codes and labels are (time, batch)."""
        h, scale = self.hidden, self._scale()
        steps, n = codes.shape
        kept, states = {}, {}
        for d in "fb":
            x, m = self.weights[f"x{d}"], self.weights[f"h{d}"]
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            all_states, trail = np.empty((steps, n, h), np.float32), {}
            for t in order:
                z = np.tanh((x[codes[t]] + state @ m) * scale)
                z[:, : 3 * h] = 0.5 * z[:, : 3 * h] + 0.5
                before = (state, cell)
                cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
                squashed = np.tanh(cell)
                state = z[:, 2 * h : 3 * h] * squashed
                all_states[t] = state
                trail[t] = (z, *before, squashed)
            kept[d], states[d] = trail, all_states
        both = np.concatenate([states["f"], states["b"]], 2)
        scores = both @ self.weights["o"] + self.weights["ob"]
        loss, d_scores, d_move = self._crf(scores, labels)
        total = steps * n
        d_scores, d_move = d_scores / total, d_move / total
        grads = {"t": d_move, "o": both.reshape(-1, 2 * h).T @ d_scores.reshape(-1, LABELS), "ob": d_scores.sum((0, 1))}
        d_both = d_scores @ self.weights["o"].T
        for d in "fb":
            m = self.weights[f"h{d}"]
            dx, dm = np.zeros_like(self.weights[f"x{d}"]), np.zeros_like(m)
            own = d_both[:, :, :h] if d == "f" else d_both[:, :, h:]
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            rows = np.arange(n)
            for t in order:
                z, state0, cell0, squashed = kept[d][t]
                i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
                ds = ds + own[t]
                dc = dc + ds * o * (1 - squashed * squashed)
                dz = np.concatenate([dc * g * i * (1 - i), dc * cell0 * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g * g)], 1)
                dm += state0.T @ dz
                one = np.zeros((n, VOCABULARY), np.float32)
                one[rows, codes[t]] = 1
                dx += one.T @ dz
                ds, dc = dz @ m.T, dc * f
            grads[f"x{d}"], grads[f"h{d}"] = dx, dm
        return loss / total, grads

    def _crf(self, scores: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood of the label paths, with gradients by the forward-backward sums."""
        move = self.weights["t"]
        steps, n, k = scores.shape
        exp_move = np.exp(move)
        forward, backward, norms = np.empty_like(scores), np.empty_like(scores), np.empty((steps, n), np.float32)
        e = np.exp(scores - scores.max(2, keepdims=True))
        a = e[0]
        for t in range(steps):
            a = e[t] if t == 0 else (forward[t - 1] @ exp_move) * e[t]
            norms[t] = a.sum(1)
            forward[t] = a / norms[t][:, None]
        b = np.ones((n, k), np.float32)
        backward[-1] = b
        d_move = np.zeros((k, k), np.float32)
        for t in range(steps - 1, 0, -1):
            inner = e[t] * backward[t] / norms[t][:, None]
            d_move += (forward[t - 1].T @ inner) * exp_move
            backward[t - 1] = inner @ exp_move.T
        marginal = forward * backward
        log_z = np.log(norms).sum() + scores.max(2).sum()
        grid_t, grid_n = np.indices((steps, n))
        gold = scores[grid_t, grid_n, labels].sum() + move[labels[:-1], labels[1:]].sum()
        marginal[grid_t, grid_n, labels] -= 1
        np.add.at(d_move, (labels[:-1].ravel(), labels[1:].ravel()), -1)
        return float(log_z - gold), marginal, d_move

    def fit(self, batches, rate: float = 6e-3, report=None) -> None:
        """Adam over an iterable of (codes, labels), the rate falling to a twentieth; ``batches`` has a length."""
        self._adam((self.gradients(codes, labels) for codes, labels in batches), len(batches), rate, report)

    def fit_side_by_side(self, makers: list, steps: int, rate: float = 6e-3, report=None) -> None:
        """``fit`` with one process for each of ``makers`` (iterables of batches); each step takes the mean of their gradients."""
        from multiprocessing import get_context

        def work(pipe, batches) -> None:
            for codes, labels in batches:
                weights = pipe.recv()
                if weights is None:
                    return
                self.weights = weights
                pipe.send(self.gradients(codes, labels))

        context, pipes = get_context("fork"), []
        for batches in makers:
            ours, theirs = context.Pipe()
            context.Process(target=work, args=(theirs, batches), daemon=True).start()
            pipes.append(ours)

        def means():
            for _ in range(steps):
                for pipe in pipes:
                    pipe.send(self.weights)
                found = [pipe.recv() for pipe in pipes]
                yield sum(x for x, _ in found) / len(found), {k: sum(g[k] for _, g in found) / len(found) for k in self.weights}
            for pipe in pipes:
                pipe.send(None)

        self._adam(means(), steps, rate, report)

    def _adam(self, gradients, steps: int, rate: float, report) -> None:
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step, (loss, grads) in enumerate(gradients, 1):
            now = rate * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 1.0 / max(norm, 1e-9))
            for k, g in grads.items():
                g = g * clip
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if report:
                report(step, loss)
