"""Linear-chain conditional random field: trained on a small table, decoded by Viterbi in numpy batches."""

import zlib

import numpy as np

BUCKETS = 1 << 13


def feature_ids(names):
    """Hashed ids of a token's active features."""
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class Chain:
    """Weights of emissions [features, labels] and transitions [labels, labels]."""

    def __init__(self, labels):
        self.labels = labels
        self.emit = np.zeros((BUCKETS, labels))
        self.step = np.zeros((labels, labels))
        self.begin = np.zeros(labels)

    def scores(self, tokens):
        """Emission scores of a list of tokens, each a list of feature ids."""
        if not tokens:
            return np.zeros((0, self.labels))
        sizes = np.array([len(t) for t in tokens])
        flat = np.concatenate([np.asarray(t, np.int64) for t in tokens])
        return np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))

    def decode(self, chains, batch=256):
        """Best labels of each chain (a list of tokens)."""
        return self.paths(self.scores([t for c in chains for t in c]), [len(c) for c in chains], batch)

    def paths(self, scores, sizes, batch=256):
        """Best labels of chains of `sizes` tokens, whose emission scores follow each other, by Viterbi over batches
        of similar length."""
        out = [None] * len(sizes)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        starts = np.cumsum([0, *sizes])
        at = 0
        while at < len(order):
            stop = at + 1  # as many as fit when padded to the longest of them
            while stop < len(order) and stop - at < batch and (stop + 1 - at) * sizes[order[stop]] <= 400_000:
                stop += 1
            some = order[at:stop]
            at = stop
            lengths = np.array([sizes[i] for i in some])
            top = int(lengths.max(initial=0))
            if not top:
                for i in some:
                    out[i] = []
                continue
            emit = np.zeros((len(some), top, self.labels), np.float32)
            for row, i in enumerate(some):
                emit[row, : lengths[row]] = scores[starts[i]:starts[i + 1]]
            best = emit[:, 0] + self.begin
            back = np.zeros((top, len(some), self.labels), np.int8)
            for t in range(1, top):
                through = best[:, :, None] + self.step[None]
                back[t] = through.argmax(axis=1)
                more = through.max(axis=1) + emit[:, t]
                best = np.where((t < lengths)[:, None], more, best)
            path = np.zeros((len(some), top), np.int64)
            now = best.argmax(axis=1)
            rows = np.arange(len(some))
            for t in range(top - 1, -1, -1):
                ends = t == lengths - 1
                now = np.where(ends, best.argmax(axis=1), now)
                path[:, t] = now
                if t:
                    now = np.where(t < lengths, back[t][rows, now], now)
            for row, i in enumerate(some):
                out[i] = path[row, : lengths[row]].tolist()
        return out

    def slack(self):
        """Per label, what label 0 must lead it by at a token so that no best path can hold that label there: the most
        that its steps from and to any neighbours, or from the beginning, can be better."""
        come = np.concatenate([self.step, self.begin[None]])  # from each label, or from the beginning
        go = np.concatenate([self.step, np.zeros((self.labels, 1))], axis=1)  # to each label, or to the end
        return (come - come[:, :1]).max(axis=0) + (go - go[:1]).max(axis=1)

    def fit(self, chains, labels, rounds=120, rate=0.3, penalty=0.02):
        """Maximum likelihood with an L2 penalty, by Adam on the whole table."""
        keep = [i for i, c in enumerate(chains) if c]
        chains, labels = [chains[i] for i in keep], [labels[i] for i in keep]
        n, k = len(chains), self.labels
        lengths = np.array([len(c) for c in chains])
        top = int(lengths.max())
        mask = np.arange(top)[None] < lengths[:, None]
        flat = [t for c in chains for t in c]
        ids = np.concatenate([np.asarray(t, np.int64) for t in flat])
        owner = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
        gold = np.zeros((n, top), np.int64)
        gold[mask] = np.concatenate([np.asarray(y) for y in labels])
        wanted = np.eye(k)[gold] * mask[..., None]
        pairs = np.einsum("bti,btj->ij", wanted[:, :-1], wanted[:, 1:])
        weights = [self.emit, self.step, self.begin]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for turn in range(1, rounds + 1):
            emit = np.zeros((n, top, k))
            emit[mask] = self.scores(flat)
            ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
            ahead[:, 0] = emit[:, 0] + self.begin
            for t in range(1, top):
                value = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.step[None], axis=1) + emit[:, t]
                ahead[:, t] = np.where(mask[:, t, None], value, ahead[:, t - 1])
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            for t in range(top - 2, -1, -1):
                value = np.logaddexp.reduce(self.step[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(mask[:, t + 1, None], value, 0)
            single = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
            both = np.zeros((k, k))
            for t in range(1, top):
                joint = ahead[:, t - 1, :, None] + self.step[None] + (emit[:, t] + behind[:, t])[:, None, :]
                both += (np.exp(joint - total[:, None, None]) * mask[:, t, None, None]).sum(axis=0)
            error = (single - wanted)[mask]
            slope = np.stack([np.bincount(ids, error[owner, j], BUCKETS) for j in range(k)], axis=1)
            slopes = [slope, both - pairs, (single[:, 0] - wanted[:, 0]).sum(axis=0)]
            for w, g, a, b in zip(weights, slopes, first, second):
                g = g + penalty * w
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                w -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-6)
        return self
