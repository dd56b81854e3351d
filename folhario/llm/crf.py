"""A linear-chain conditional random field over word-shape features, in numpy.

Training maximises the likelihood by Adam over padded batches (forward-backward).
Decoding is Viterbi over many sequences at once. A token's features depend only on
its spelling, so each spelling's scores are worked out once and looked up afterwards.
"""

from __future__ import annotations

import re

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\S\n]+|[^\w\s]|_")
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
PAD = "\x00"
_PLAIN = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def tokenise(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, where each starts, and what stands before it: 0 nothing, 1 blanks, 2 a line end."""
    parts = TOKEN.findall(text)
    if not parts:
        return [], np.empty(0, np.int32), np.empty(0, np.int8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int32)
    gap = np.fromiter((2 if p == "\n" else 1 if p.isspace() else 0 for p in parts), np.int8, len(parts))
    keep = np.flatnonzero(gap == 0)
    before = np.zeros(len(parts), np.int8)
    before[1:] = np.maximum(gap[:-1], 0)
    if len(parts) > 1:  # blanks at the start of a new line don't hide the line end
        before[2:] = np.where((gap[1:-1] == 1) & (gap[:-2] == 2), 2, before[2:])
    before = before[keep]
    before[:1] = 2
    return [parts[i] for i in keep], starts[keep], before


def tokenise_batch(texts: list[str | None], number) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: type numbers, starts, ends and what stands before each token, as `tokenise` has them.

    `number` numbers a list of tokens; blanks and line ends are told by their numbers, so
    that all but the splitting is done on whole arrays.
    """
    parts = [TOKEN.findall(t) if t else [] for t in texts]
    flat = [w for p in parts for w in p]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if not flat:
        empty = np.empty(0, np.int32)
        return [(empty, empty, empty, np.empty(0, np.int8))] * len(texts)
    types, gaps = number(flat)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes)
    first = bounds[:-1][counts > 0]
    offset = np.zeros(len(flat), np.int64)
    base = np.concatenate(([0], ends))[first]
    offset[first] = np.diff(np.concatenate(([0], base)))
    ends -= np.cumsum(offset)
    before = np.zeros(len(flat), np.int8)
    before[1:] = gaps[:-1]
    before[2:] = np.where((gaps[1:-1] == 1) & (gaps[:-2] == 2), 2, before[2:])
    keep = np.flatnonzero(gaps == 0)
    cuts = np.searchsorted(keep, bounds)
    types, starts, stops, before = types[keep], (ends - sizes)[keep], ends[keep], before[keep]
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    before[heads] = 2
    return [(types[a:b], starts[a:b], stops[a:b], before[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def shape(token: str) -> str:
    """A token's form: letters by case and length, digits by their number, other characters themselves."""
    c = token[0]
    if c.isdigit():
        return f"d{min(len(token), 12)}"
    if c.isalpha():
        if len(token) == 1:
            return "X" if c.isupper() else "x"
        kind = "XX" if token.isupper() else "Xx" if c.isupper() else "xx"
        return f"{kind}{'s' if len(token) < 4 else 'l'}"
    return token


class Model:
    """Scores of features by label, for each offset; transitions between labels."""

    def __init__(self, labels: list[str], lexicon: dict[str, str]):
        self.labels = labels
        #: token, lower case -> name of the small word list it is in
        self.lexicon = lexicon
        self.maps: list[dict[str, int]] = [{}, {}, {}, {}]
        self.weights: list[np.ndarray] = []
        self.before = np.zeros((3, len(labels)))
        self.after = np.zeros((3, len(labels)))
        self.pairs: np.ndarray | None = None
        self.step = np.zeros((len(labels), len(labels)))
        self.types: dict[str, int] = {}
        self.tables: np.ndarray | None = None
        self.shapes: np.ndarray | None = None
        self.gaps: np.ndarray | None = None

    def features(self, token: str) -> tuple[str, str, str, str]:
        low = token.lower()
        if not low.isascii():
            low = low.translate(_PLAIN)
        return low, shape(token) if token != PAD else PAD, (low[-3:] if token[0].isalpha() and len(low) > 3 else ""), self.lexicon.get(low, "")

    def ids(self, token: str, grow: bool) -> tuple[int, int, int, int]:
        """Feature ids; 0 stands for features never seen in training."""
        out = []
        for m, f in zip(self.maps, self.features(token)):
            out.append(m.setdefault(f, len(m) + 1) if grow else m.get(f, 0))
        return tuple(out)  # type: ignore[return-value]

    def fit(self, data: list[tuple[list[str], np.ndarray, np.ndarray]], epochs: int = 18, rate: float = 0.12, decay: float = 2e-4, rare: int = 2, seed: int = 5) -> Model:
        """Train on (tokens, what stands before each, label numbers)."""
        rng = np.random.default_rng(seed)
        n_labels = len(self.labels)
        seen: dict[str, int] = {}
        for tokens, _, _ in data:
            for t in tokens:
                low = self.features(t)[0]
                seen[low] = seen.get(low, 0) + 1
        every = {t for tokens, _, _ in data for t in tokens} | {PAD}
        kinds = {t: self.ids(t, True) for t in sorted(every)}
        known = {w for w, n in seen.items() if n >= rare} | {PAD}
        # rare words count as unseen, so that the model learns to do without them
        kinds = {t: ((i[0] if self.features(t)[0] in known else 0), *i[1:]) for t, i in kinds.items()}
        self.maps[0] = {w: i for w, i in self.maps[0].items() if w in known}
        sizes = [max(m.values(), default=0) + 1 for m in self.maps]
        n_shapes = sizes[1]
        params = [np.zeros((len(OFFSETS), s, n_labels)) for s in sizes] + [np.zeros((3, n_labels)), np.zeros((3, n_labels)), np.zeros((2, n_shapes * n_shapes, n_labels)), np.zeros((n_labels, n_labels))]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
        batches = [order[i : i + 48] for i in range(0, len(order), 48)]
        made = []
        for batch in batches:
            longest = max(len(data[i][0]) for i in batch)
            f = np.zeros((len(batch), longest + 6, 4), np.int64)
            f[:] = kinds[PAD]
            before = np.zeros((len(batch), longest + 1), np.int64)
            y = np.zeros((len(batch), longest), np.int64)
            size = np.array([len(data[i][0]) for i in batch])
            for r, i in enumerate(batch):
                tokens, b, lab = data[i]
                f[r, 3 : 3 + len(tokens)] = [kinds[t] for t in tokens]
                before[r, : len(tokens)] = b
                before[r, len(tokens)] = 2
                y[r, : len(tokens)] = lab
            made.append((f, before, y, size))
        t = 0
        for epoch in range(epochs):
            lr = rate * (1.0 if epoch < epochs * 0.6 else 0.3)
            for k in rng.permutation(len(made)):
                f, before, y, size = made[k]
                grads = self._gradient(params, f, before, y, size, n_shapes)
                t += 1
                for p, g, a, b in zip(params, grads, m1, m2):
                    g = g + decay * p
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.99
                    b += 0.01 * g * g
                    p -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-3)
        self.weights = [p.astype(np.float32) for p in params[:4]]
        self.before, self.after, self.pairs, self.step = (p.astype(np.float32) for p in params[4:])
        return self

    @staticmethod
    def _scores(params, f, before, n_shapes):
        longest = f.shape[1] - 6
        out = params[4][before[:, :longest]] + params[5][before[:, 1 : longest + 1]]
        for o in range(len(OFFSETS)):
            for j in range(4):
                out = out + params[j][o][f[:, o : o + longest, j]]
        s = f[:, :, 1]
        out = out + params[6][0][s[:, 2 : 2 + longest] * n_shapes + s[:, 3 : 3 + longest]] + params[6][1][s[:, 3 : 3 + longest] * n_shapes + s[:, 4 : 4 + longest]]
        return out

    def _gradient(self, params, f, before, y, size, n_shapes):
        """The negative log-likelihood's gradient, a token on average."""
        e = self._scores(params, f, before, n_shapes)
        step = params[7]
        rows, longest, n = e.shape
        live = np.arange(longest)[None, :] < size[:, None]
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        top = step.max()
        trans = np.exp(step - top)
        for t in range(1, longest):
            m = alpha[:, t - 1].max(1, keepdims=True)
            new = np.log(np.exp(alpha[:, t - 1] - m) @ trans + 1e-300) + m + top + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
        beta = np.zeros_like(e)
        for t in range(longest - 2, -1, -1):
            x = beta[:, t + 1] + e[:, t + 1]
            m = x.max(1, keepdims=True)
            new = np.log(np.exp(x - m) @ trans.T + 1e-300) + m + top
            beta[:, t] = np.where(live[:, t + 1, None], new, 0)
        last = alpha[:, -1]
        m = last.max(1)
        z = np.log(np.exp(last - m[:, None]).sum(1)) + m
        g = np.exp(alpha + beta - z[:, None, None])
        g[~live] = 0
        r, c = np.nonzero(live)
        g[r, c, y[r, c]] -= 1
        total = float(len(r))
        # transitions
        both = live[:, 1:]
        a = alpha[:, :-1][both]
        b = (beta + e)[:, 1:][both]
        zz = np.broadcast_to(z[:, None], both.shape)[both]
        pair = np.exp(a[:, :, None] + b[:, None, :] + step[None] - zz[:, None, None]).sum(0)
        np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), -1)
        flat = g[r, c]

        def gather(idx, n_ids):
            return np.stack([np.bincount(idx, weights=flat[:, k], minlength=n_ids) for k in range(n)], axis=1)

        out = []
        for j in range(4):
            out.append(np.stack([gather(f[r, c + o, j], params[j].shape[1]) for o in range(len(OFFSETS))]))
        out.append(gather(before[r, c], 3))
        out.append(gather(before[r, c + 1], 3))
        s = f[:, :, 1]
        out.append(np.stack([gather(s[r, c + 2] * n_shapes + s[r, c + 3], n_shapes**2), gather(s[r, c + 3] * n_shapes + s[r, c + 4], n_shapes**2)]))
        out.append(pair)
        return [x / total * 8 for x in out]

    def numbered(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Type numbers of tokens, and 2 for line ends, 1 for blanks, 0 for all others."""
        types = self.lookup(tokens)
        return types, self.gaps[types]

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Type numbers of tokens; scores of spellings not met before are worked out in one go."""
        if self.tables is None or len(self.types) > 400_000:
            self.types = {PAD: 0}
            self.tables = self._score_types([PAD])
            self.shapes = np.array([self.ids(PAD, False)[1]], np.int32)
            self.gaps = np.zeros(1, np.int8)
        types = self.types
        new = [t for t in set(tokens) if t not in types]
        if new:
            for t in new:
                types[t] = len(types)
            self.tables = np.concatenate([self.tables, self._score_types(new)], axis=1)
            self.gaps = np.concatenate([self.gaps, np.array([2 if t == "\n" else 1 if t.isspace() else 0 for t in new], np.int8)])
            self.shapes = np.concatenate([self.shapes, np.array([self.ids(t, False)[1] for t in new], np.int32)])
        return np.fromiter(map(types.__getitem__, tokens), np.int32, len(tokens))

    def _score_types(self, tokens: list[str]) -> np.ndarray:
        ids = np.array([self.ids(t, False) for t in tokens])
        return np.stack([sum(self.weights[j][o][ids[:, j]] for j in range(4)) for o in range(len(OFFSETS))])

    def decode(self, sequences: list[tuple[np.ndarray, np.ndarray]], batch: int = 256) -> list[np.ndarray]:
        """The best label sequence of each (type numbers, what stands before); sequences of like length go together."""
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i][0])), key=lambda i: len(sequences[i][0]))
        n_shapes = self.weights[1].shape[1]
        at = 0
        while at < len(order):
            # few long sequences at a time keep the memory of a batch bounded
            take = max(1, min(batch, 400_000 // max(1, len(sequences[order[min(at + batch, len(order)) - 1]][0]))))
            part = order[at : at + take]
            at += take
            size = np.array([len(sequences[i][0]) for i in part])
            longest = int(size.max())
            types = np.zeros((len(part), longest + 6), np.int32)
            before = np.full((len(part), longest + 1), 2, np.int8)
            for r, i in enumerate(part):
                types[r, 3 : 3 + size[r]] = sequences[i][0]
                before[r, : size[r]] = sequences[i][1]
            # time first, so that a step of the chain is one block of memory
            types, before = np.ascontiguousarray(types.T), np.ascontiguousarray(before.T)
            e = self.before[before[:longest]] + self.after[before[1 : longest + 1]]
            for o in range(len(OFFSETS)):
                e += self.tables[o][types[o : o + longest]]
            s = self.shapes[types]
            e += self.pairs[0][s[2 : 2 + longest] * n_shapes + s[3 : 3 + longest]]
            e += self.pairs[1][s[3 : 3 + longest] * n_shapes + s[4 : 4 + longest]]
            back = np.zeros((longest, len(part), len(self.labels)), np.int8)
            score = e[0]
            step = self.step[None]
            for t in range(1, longest):
                live = int(np.searchsorted(size, t, side="right"))  # sizes rise: sequences from here on go on
                x = score[live:, :, None] + step
                k = x.argmax(1)
                back[t, live:] = k
                score[live:] = np.take_along_axis(x, k[:, None, :], 1)[:, 0] + e[t, live:]
            now = score.argmax(1)
            best = np.zeros((longest, len(part)), np.int8)
            rows = np.arange(len(part))
            for t in range(longest - 1, -1, -1):
                best[t] = now
                inside = size > t
                now = np.where(inside, back[t, rows, now], now)
            for r, i in enumerate(part):
                out[i] = best[: size[r], r]
        return out
