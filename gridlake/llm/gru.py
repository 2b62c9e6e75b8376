"""A small gated recurrent language model in numpy: training by truncated backpropagation, and scoring.

The output is factored: a class of words first, then the word within its class, so one token costs two
softmaxes of about the square root of the vocabulary.  Classes grow with their words' rank, so that most
tokens' second softmax is short and rare words need few classes.
"""

from __future__ import annotations

import numpy as np

END, UNKNOWN = 0, 1
_STEPS, _ROWS = 4, 1024  # steps and rows at a time, whose arrays stay in the processor's cache
_NAMES = ("inputs", "u", "bias", "class_w", "class_b", "word_w", "word_b")


class _Room:
    """What the windows of one training share, so that no window asks for memory again: arrays by name, and the weights
    but the inputs' in one vector, with their gradients in another (biases of words are a last row of their weights)."""

    def __init__(self, model: Gru) -> None:
        n, kind = model.hidden, model.u.dtype
        shapes = [(n, 3 * n), (3 * n,), (n, len(model.class_b)), (len(model.class_b),), (len(model.class_b), n + 1, model.word_w.shape[2])]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.values, self.slopes = np.empty(ends[-1], kind), np.zeros(ends[-1], kind)
        self.kind, self.held = kind, {}
        self.used = np.zeros(0, np.int64)  # rows of the inputs that the last window changes
        split = lambda flat: [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]
        self.weights, self.gradients = split(self.values), split(self.slopes)
        for name, view in self.named(self.weights).items():
            view[:] = getattr(model, name)

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        found = self.held.get(name)
        if found is None or found.shape != shape:
            found = self.held[name] = np.zeros(shape, self.kind)
        return found

    @staticmethod
    def named(parts: list[np.ndarray]) -> dict[str, np.ndarray]:
        u, bias, class_w, class_b, words = parts
        return {"u": u, "bias": bias, "class_w": class_w, "class_b": class_b, "word_w": words[:, :-1], "word_b": words[:, -1]}


def _exp_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Sum of each row's exponentials, which overwrite x, and the shift taken from the row before (only far-off logits need one)."""
    top: np.ndarray | float = 0.0
    if len(x) and not (x.min() > -60 and x.max() < 60):
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype), top


def _loss(x: np.ndarray, at: np.ndarray, total: int) -> float:
    """Summed loss of one column of each row's softmax; x (one stretch of memory) becomes the loss's gradient over total."""
    flat, at = x.reshape(-1), np.arange(0, x.size, x.shape[1]) + at
    picked = flat.take(at)
    sums, top = _exp_sums(x)
    x *= (1 / (sums * total))[:, None]
    flat[at] = flat.take(at) - 1 / total
    return float((np.log(sums) + top - picked).sum())


def _log_prob(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one column; x (one stretch of memory) is overwritten."""
    picked = x.reshape(-1).take(np.arange(0, x.size, x.shape[1]) + at)
    sums, top = _exp_sums(x)
    return picked - top - np.log(sums)


class Gru:
    """Parameters as float32 arrays; inputs has a row of gate inputs for each word."""

    _room: _Room | None = None

    def __init__(self, counts: np.ndarray, hidden: int = 32, per_class: int = 64, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        sizes = [per_class // 8, per_class // 8 * 3, per_class // 2] if per_class % 8 == 0 else [per_class]
        while sum(sizes) < len(counts):
            sizes.append(per_class if sum(sizes) < 8 * per_class else 2 * per_class)
        self.sizes, size, most = np.array(sizes), sum(sizes), max(sizes)
        edges = [0, *(np.flatnonzero(np.diff(self.sizes)) + 1).tolist(), len(sizes)]
        self.runs = [(sizes[a], range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]  # neighbours of one size
        self.kinds = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)  # each word's class, and its place there
        self.places = np.arange(size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid = np.full((len(sizes), most), 1e-3)
        grid[self.kinds[: len(counts)], self.places[: len(counts)]] = counts + 0.5
        grid[np.arange(most) >= self.sizes[:, None]] = 0
        draw = lambda *shape: (rng.standard_normal(shape) * 0.08).astype(np.float32)
        self.inputs, self.u = draw(size, 3 * hidden), draw(hidden, 3 * hidden)
        self.bias = np.zeros(3 * hidden, np.float32)
        self.class_w, self.class_b = draw(hidden, len(grid)) * 0.1, np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        self.word_w = draw(len(grid), hidden, most) * 0.1
        self.word_b = np.log(np.where(grid > 0, grid, 1) / grid.sum(1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _NAMES])

    def load(self, values: np.ndarray) -> Gru:
        at = 0
        for n in _NAMES:
            old = getattr(self, n)
            setattr(self, n, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def log_probs(self, states: np.ndarray, targets: np.ndarray, part: int = _ROWS) -> np.ndarray:
        """Natural log of the probability of each target after each state."""
        kind = self.kinds[targets]
        order = np.argsort(kind, kind="stable")  # a radix sort; each class is then one slice
        kind, word = kind[order], self.places[targets[order]]
        states, found = np.take(states, order, axis=0, mode="clip"), np.empty(len(order), np.float32)
        room = np.empty(part * max(len(self.class_b), self.word_w.shape[2]), states.dtype)
        rows = lambda n, size: room[: n * size].reshape(n, size)
        for a in range(0, len(order), part):  # parts that stay in the processor's cache
            b = min(a + part, len(order))
            x = np.matmul(states[a:b], self.class_w, out=rows(b - a, len(self.class_b)))
            x += self.class_b
            found[a:b] = _log_prob(x, kind[a:b])
        edges, first, held = np.searchsorted(kind, np.arange(len(self.class_b) + 1)).tolist(), 0, 0
        for c, size in enumerate(self.sizes.tolist()):
            w, bias = self.word_w[c, :, :size], self.word_b[c, :size]
            for a in range(edges[c], edges[c + 1], part):
                b = min(a + part, edges[c + 1])
                if held + b - a > part or (held and size != x.shape[1]):
                    found[first : first + held] += _log_prob(x[:held], word[first : first + held])
                    held = 0
                if not held:
                    first, x = a, rows(part, size)
                np.matmul(states[a:b], w, out=x[held : held + b - a])
                x[held : held + b - a] += bias
                held += b - a
        found[first : first + held] += _log_prob(x[:held], word[first : first + held])
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, tokens: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss, its gradients, and the last state, over one window of (steps, streams).

        States lie as (steps, units, streams) inside, so that each gate is one stretch of memory.  While a training
        runs, inputs has gradients of the rows that the window changes only (the room's `used`), and the next window
        overwrites the others."""
        steps, width = tokens.shape
        n, total, room = self.hidden, steps * width, self._room or _Room(self)
        (u, bias, class_w, class_b, word_w), (g_u, g_bias, g_class_w, g_class_b, g_word) = room.weights, room.gradients
        tokens, goal = tokens.ravel(), targets.ravel()
        live = (tokens != END).astype(u.dtype).reshape(steps, width)  # a document starts from an empty state
        starts = (live == 0).any(1).tolist()
        a, gates = room("a", steps, 3 * n, width), room("gates", steps, 2 * n, width)
        new, states = room("new", steps, n, width), room("states", steps + 1, n, width)
        down = u.T.copy()
        down[: 2 * n] *= -1  # gates of opposite sign: sigmoid(v) is 1 / (1 + exp(-v))
        states[0], some = h.T, room("some", _STEPS * width, 3 * n)
        for begin in range(0, steps, _STEPS):
            end = min(begin + _STEPS, steps)
            x = np.take(self.inputs, tokens[begin * width : end * width], axis=0, out=some[: (end - begin) * width], mode="clip")
            x += bias
            for t, x in enumerate(x.reshape(-1, width, 3 * n).transpose(0, 2, 1), begin):
                own, row, gate, made, h = states[t], a[t], gates[t], new[t], states[t + 1]
                if starts[t]:
                    own = own * live[t]
                np.matmul(down, own, out=row)
                np.subtract(row[: 2 * n], x[: 2 * n], out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[n:], row[2 * n :], out=made)
                made += x[2 * n :]
                np.tanh(made, out=made)
                np.subtract(own, made, out=h)
                h *= gate[:n]
                h += made
        last, out = states[-1].T.copy(), states[1:]
        # outputs, by classes of targets: each class is one slice
        kind = self.kinds[goal]
        order = np.argsort(kind, kind="stable")
        kind, word = kind[order], self.places[goal[order]]
        by_token, flat, flat_1 = room("by_token", total, n), room("flat", total, n), room("flat_1", total, n + 1)
        by_token.reshape(steps, width, n)[:] = out.transpose(0, 2, 1)
        np.take(by_token, order, axis=0, out=flat, mode="clip")
        flat_1[:, :n], flat_1[:, n] = flat, 1
        back, more_back, back_w = room("back", total, n), room("more_back", total, n), class_w.T
        loss, of_class = 0.0, room("class", total, len(class_b))
        for i in range(0, total, _ROWS):
            at = slice(i, min(i + _ROWS, total))
            d = np.matmul(flat[at], class_w, out=of_class[at])
            d += class_b
            loss += _loss(d, kind[at], total)
            np.matmul(d, back_w, out=back[at])
        np.matmul(flat.T, of_class, out=g_class_w)
        np.matmul(np.ones(total, u.dtype), of_class, out=g_class_b)
        edges, of_word = np.searchsorted(kind, np.arange(len(class_b) + 1)).tolist(), room("word", total * word_w.shape[2])
        g_word[np.diff(edges) == 0] = 0
        for size, classes in self.runs:
            begin, end = edges[classes[0]], edges[classes[-1] + 1]
            d = of_word[: (end - begin) * size].reshape(-1, size)
            slices = [(c, i, j, d[i - begin : j - begin]) for c, i, j in ((c, edges[c], edges[c + 1]) for c in classes) if i < j]
            for c, i, j, own in slices:
                np.matmul(flat_1[i:j], word_w[c, :, :size], out=own)
            for i in range(begin, end, _ROWS):
                j = min(i + _ROWS, end)
                loss += _loss(d[i - begin : j - begin], word[i:j], total)
            for c, i, j, own in slices:
                np.matmul(flat_1[i:j].T, own, out=g_word[c, :, :size])
                np.matmul(own, word_w[c, :n, :size].T, out=more_back[i:j])
        back += more_back
        more_back[order] = back
        sent = room("sent", steps, n, width)
        sent[:] = more_back.reshape(steps, width, n).transpose(0, 2, 1)
        # back through the steps; by: what dh is multiplied by for z, r, the state's part of new, and new
        d, bys, keeps = room("d", steps, 4, n, width), room("by", _STEPS, 4, n, width), room("keep", _STEPS, 2 * n, width)
        rows, dh, more_dh = d.reshape(steps, 4 * n, width)[:, : 3 * n], np.zeros((n, width), u.dtype), np.empty((n, width), u.dtype)
        for begin in range((steps - 1) // _STEPS * _STEPS, -1, -_STEPS):
            end = min(begin + _STEPS, steps)
            made, by = new[begin:end], bys[: end - begin]
            keep = np.subtract(1, gates[begin:end], out=keeps[: end - begin])
            np.subtract(out[begin:end], made, out=by[:, 0])
            by[:, 0] *= keep[:, :n]
            np.multiply(made, made, out=by[:, 3])
            np.subtract(1, by[:, 3], out=by[:, 3])
            by[:, 3] *= keep[:, :n]
            np.multiply(by[:, 3], gates[begin:end, n:], out=by[:, 2])
            np.multiply(by[:, 2], keep[:, n:], out=by[:, 1])
            by[:, 1] *= a[begin:end, 2 * n :]
            for t in range(end - 1, begin - 1, -1):
                dh += sent[t]
                np.multiply(dh, by[t - begin], out=d[t])
                np.matmul(u, rows[t], out=more_dh)
                dh *= gates[t, :n]
                dh += more_dh
                if starts[t]:
                    dh *= live[t]
        for t in np.flatnonzero(starts):
            states[t] *= live[t]
        np.matmul(states[:-1], rows.transpose(0, 2, 1), out=room("of_u", steps, n, 3 * n)).sum(0, out=g_u)
        dx = room("dx", total, 3 * n)
        parts = dx.reshape(steps, width, 3 * n)
        parts[:, :, : 2 * n], parts[:, :, 2 * n :] = rows[:, : 2 * n].transpose(0, 2, 1), d[:, 3].transpose(0, 2, 1)
        np.matmul(np.ones(total, u.dtype), dx, out=g_bias)
        # inputs: a word that occurs once needs no sum
        order = np.argsort(tokens.astype(np.int16) if len(self.inputs) < 1 << 15 else tokens, kind="stable")
        tokens = tokens[order]
        begin = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1])
        times = np.append(begin[1:], total) - begin
        used, summed, often = tokens[begin], dx[order[begin]], times > 1
        if often.any():
            several = order[np.repeat(often, times)]
            several = np.take(dx, several, axis=0, out=room("several", total, 3 * n)[: len(several)], mode="clip")
            summed[often] = np.add.reduceat(several, np.cumsum(times[often]) - times[often])
        g, room.used = room.named(room.gradients), used
        if self._room is None:
            g["inputs"] = np.zeros_like(self.inputs)
            g["inputs"][used] = summed
        else:
            g["inputs"] = summed
        return loss / total, g, last

    def train(self, stream: np.ndarray, streams: int = 64, steps: int = 32, rate: float = 0.08, least_updates: int = 60) -> float:
        """Adagrad over a token stream (documents end with END), cut into parallel streams; returns the last mean loss.

        Every token is learned once, whatever the stream's length; a short one is cut into fewer parallel streams,
        so that least_updates steps are made where it has the tokens for them."""
        total = len(stream) - 1
        if total < 1:
            return 0.0
        width = max(1, min(streams, total // (least_updates * steps)))
        length = total // width
        tokens, targets = (x[: width * length].reshape(width, length).T for x in (stream[:-1], stream[1:]))
        room = self._room = _Room(self)
        for name, view in room.named(room.weights).items():
            setattr(self, name, view)
        memory, of_inputs, room_for = np.full_like(room.values, 1e-6), np.full_like(self.inputs, 1e-6), np.empty_like(room.values)

        def update(tokens: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
            loss, g, h = self.gradients(tokens, targets, h)
            used, g, all_g = room.used, g["inputs"], room.slopes
            squares, all_squares = g * g, np.multiply(all_g, all_g, out=room_for)
            norm = float(np.sqrt(squares.sum() + all_squares.sum()))
            scale = tokens.size / (width * steps) * min(1.0, 1.0 / max(norm, 1e-9))
            if scale != 1:
                for x, power in ((g, 1), (all_g, 1), (squares, 2), (all_squares, 2)):
                    x *= scale**power
            squares += of_inputs[used]
            of_inputs[used] = squares
            all_g *= rate
            g *= rate
            g /= np.sqrt(squares, out=squares)
            self.inputs[used] -= g
            np.add(memory, all_squares, out=memory)
            all_g /= np.sqrt(memory, out=all_squares)
            np.subtract(room.values, all_g, out=room.values)
            return loss, h

        h, loss = np.zeros((width, self.hidden), np.float32), 0.0
        for at in range(0, length, steps):
            loss, h = update(tokens[at : at + steps], targets[at : at + steps], h)
        rest = width * length
        if rest < total:  # fewer tokens than streams: after the last stream's end
            update(stream[rest:-1, None], stream[rest + 1 :, None], h[-1:])
        self._room = None
        return loss

    def score(self, documents: list[np.ndarray], group: int = 2048, steps: int = 32) -> np.ndarray:
        """log10 probability of each document's tokens (END last); the state runs through from window to window.

        Documents of a group go side by side, the longest first; no array is as large as the longest document times the group."""
        lengths, n = np.array([len(d) for d in documents]), self.hidden
        order, out, inputs, u = np.argsort(-lengths, kind="stable"), np.zeros(len(documents)), self.inputs + self.bias, self.u.copy()
        inputs[:, : 2 * n] *= -1  # sigmoid(v) is 1 / (1 + exp(-v))
        u[:, : 2 * n] *= -1
        x, a, gates, made = (np.empty((group, size), u.dtype) for size in (3 * n, 3 * n, 2 * n, n))
        for g in range(0, len(order), group):
            at = order[g : g + group]
            size = lengths[at]
            tokens = np.concatenate([documents[i] for i in at])
            start = np.cumsum(size) - size
            h, total, last = np.zeros((len(at), n), np.float32), np.zeros(len(at)), np.full(len(at), END)
            for begin in range(0, int(size[0]), steps):
                times = np.arange(begin, min(begin + steps, int(size[0])))
                lives = np.searchsorted(-size, -times, "left")  # documents longer than t
                ends = np.cumsum(lives)
                states, goals = np.empty((ends[-1], n), np.float32), np.empty(ends[-1], tokens.dtype)
                for t, live, end in zip(times.tolist(), lives.tolist(), ends.tolist(), strict=True):
                    own, row, old = np.take(inputs, last[:live], axis=0, out=x[:live], mode="clip"), a[:live], h[:live]
                    np.matmul(old, u, out=row)
                    gate = np.add(own[:, : 2 * n], row[:, : 2 * n], out=gates[:live])
                    np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                    new = np.multiply(gate[:, n:], row[:, 2 * n :], out=made[:live])
                    new += own[:, 2 * n :]
                    np.tanh(new, out=new)
                    h = np.subtract(old, new, out=states[end - live : end])
                    h *= gate[:, :n]
                    h += new
                    last = np.take(tokens, start[:live] + t, out=goals[end - live : end], mode="clip")
                owners = np.arange(ends[-1]) - np.repeat(ends - lives, lives)
                total += np.bincount(owners, self.log_probs(states, goals), len(at))
            out[at] = total / np.log(10)
        return out
