"""A small bidirectional GRU over bytes in numpy, trained by backpropagation through time.

Each direction reads one byte per step; the inputs are one-hot, so their weights are a
table of 256 rows. Every position gets a distribution over the classes from the two
states there.
"""

import numpy as np

HIDDEN = 8
SEGMENT = 128  # bytes read from a fresh state
LANES = 2048  # segments read side by side


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGRU:
    def __init__(self, classes: int, seed: int = 3, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.hidden, self.weights = hidden, {}
        for way in "fb":
            self.weights |= {
                f"in_{way}": normal(256, 3 * hidden, by=0.5), f"own_{way}": normal(hidden, 3 * hidden, by=hidden**-0.5),
                f"bias_{way}": np.zeros(3 * hidden, np.float32), f"new_{way}": np.zeros(hidden, np.float32),
            }
        self.weights |= {"out": normal(2 * hidden, classes, by=0.3), "out_bias": np.zeros(classes, np.float32)}

    def _read(self, way: str, data: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, lane, hidden); steps beyond a lane's length reset its state."""
        w, k = self.weights, self.hidden
        # Gates are halves and doubles of one sigmoid: tanh(x) = 2 * sigmoid(2 x) - 1.
        table, own, new = w[f"in_{way}"] + w[f"bias_{way}"], w[f"own_{way}"], w[f"new_{way}"]
        steps, lanes = data.shape[1], data.shape[0]
        states, h = np.empty((steps, lanes, k), np.float32), np.zeros((lanes, k), np.float32)
        short = (lengths < steps).any()
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, s = table[data[:, t]], h @ own
            gates = x[:, : 2 * k] + s[:, : 2 * k]
            _sigmoid(gates)
            z, r = gates[:, :k], gates[:, k:]
            s_new = s[:, 2 * k :] + new
            n = x[:, 2 * k :] + r * s_new
            n *= 2
            _sigmoid(n)
            n *= 2
            n -= 1
            before = h
            h = n + z * (before - n)
            if short:
                h *= (lengths > t)[:, None]
            states[t] = h
            if keep is not None:
                keep.append((t, z, r, n, s_new, before))
        return states

    def probabilities(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(step, lane, class): the distribution of every position."""
        f, b = self._read("f", data, lengths), self._read("b", data, lengths)
        k = self.hidden
        scores = f @ self.weights["out"][:k] + b @ self.weights["out"][k:] + self.weights["out_bias"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions, and its gradients."""
        w, k = self.weights, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._read(way, data, lengths, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        scores = both @ w["out"] + w["out_bias"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        inside = (np.arange(data.shape[1])[:, None] < lengths).astype(np.float32)
        total, lane = inside.sum(), np.arange(len(labels))
        loss = -(np.log(scores[:, lane, labels] + 1e-9) * inside).sum() / total
        scores[:, lane, labels] -= 1
        scores *= inside[:, :, None] / total
        grads = {"out": np.tensordot(both, scores, ((0, 1), (0, 1))), "out_bias": scores.sum((0, 1))}
        d_states = scores @ w["out"].T
        for i, way in enumerate("fb"):
            own = w[f"own_{way}"]
            g_in, g_own = np.zeros_like(w[f"in_{way}"]), np.zeros_like(own)
            g_new, carried = np.zeros(k, np.float32), np.zeros((len(labels), k), np.float32)
            for t, z, r, n, s_new, before in reversed(kept[way]):
                dh = (d_states[t, :, i * k : (i + 1) * k] + carried) * inside[t][:, None]
                dz, dn = dh * (before - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
                dr, ds = dn * s_new * r * (1 - r), dn * r
                d_in = np.concatenate([dz, dr, dn], axis=1)
                d_own = np.concatenate([dz, dr, ds], axis=1)
                np.add.at(g_in, data[:, t], d_in)
                g_own += before.T @ d_own
                g_new += ds.sum(0)
                carried = dh * z + d_own @ own.T
            grads |= {f"in_{way}": g_in, f"own_{way}": g_own, f"new_{way}": g_new, f"bias_{way}": g_in.sum(0)}
        return float(loss), grads

    def train(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int, batch: int = 192,
              rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam; returns the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        first = {n: np.zeros_like(x) for n, x in self.weights.items()}
        second = {n: np.zeros_like(x) for n, x in self.weights.items()}
        for epoch in range(epochs):
            order, seen = rng.permutation(len(labels)), []
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                loss, grads = self.gradients(data[chosen], lengths[chosen], labels[chosen])
                seen.append(loss)
                step += 1
                pace = rate * (1 - epoch / epochs) ** 0.5 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    self.weights[name] -= (pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts in rows of ``size``: rows, their lengths, the text of each row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // size)
    owner = np.repeat(np.arange(len(texts)), rows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    lengths = np.minimum(sizes[owner] - nth * size, size)
    data = np.zeros((len(owner), size), np.uint8)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    data[np.arange(size) < lengths[:, None]] = whole
    return data, lengths, owner


def pooled(model: BiGRU, texts: list[bytes], classes: int) -> np.ndarray:
    """(text, class): the mean distribution over all positions of each text."""
    data, lengths, owner = segments(texts)
    sums = np.zeros((len(texts), classes))
    order = np.argsort(-lengths, kind="stable")  # full rows together
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        steps = int(lengths[part].max())
        found = model.probabilities(np.ascontiguousarray(data[part][:, :steps]), lengths[part])
        found *= (np.arange(steps)[:, None] < lengths[part])[:, :, None]
        np.add.at(sums, owner[part], found.sum(0))
    return sums / np.maximum(1, [[len(t)] for t in texts])
