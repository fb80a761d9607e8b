"""Character-level bidirectional LSTM with CRF transitions, in numpy (problem 2).

Characters enter as ids; the input weights of the LSTM are rows of a table, so the first product is
a lookup.  Both directions run as one stacked product.  Emissions of overlapping windows are joined
(each character takes them from the window in which it is farther from an edge) and one Viterbi path
is decoded over the whole text, so labels agree across windows.
"""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "national_id", "street_address", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_TAGS = len(TAGS)
WINDOW, STRIDE = 160, 112

_EXTRA = 12
VOCAB = 1 + 95 + _EXTRA


def char_ids(text: str) -> np.ndarray:
    """0 is padding, 1..95 printable ASCII, then classes of other characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ids = codes - 31
    other = (codes < 32) | (codes > 126)
    if other.any():
        for k in np.flatnonzero(other):
            ids[k] = 96 + _kind(chr(codes[k]))
    return ids


_memo: dict[str, int] = {}


def _kind(ch: str) -> int:
    got = _memo.get(ch)
    if got is None:
        c = unicodedata.category(ch)
        if ch in "\r\n\t":
            got = 0
        elif ch in "＋（）－＠":
            got = 1
        elif c == "Lu":
            got = 2
        elif c == "Ll":
            got = 3
        elif c[0] == "L":
            got = 4
        elif c[0] == "N":
            got = 5
        elif c[0] == "Z":
            got = 6
        elif c[0] == "P":
            got = 7
        elif c[0] == "M":
            got = 8
        elif c[0] == "S":
            got = 9
        elif c[0] == "C":
            got = 10
        else:
            got = 11
        _memo[ch] = got
    return got


def _allowed() -> np.ndarray:
    """Transitions that make sense: I-x only after B-x or I-x."""
    ok = np.ones((N_TAGS, N_TAGS), dtype=bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                ok[i, j] = s[2:] == t[2:]
    return ok


ALLOWED = _allowed()
_START = np.array([t[0] != "I" for t in TAGS])


class Model:
    """Parameters: P (2,V,4H) input table, U (2,H,4H), W (2H,K), b (K), T (K,K)."""

    def __init__(self, hidden: int = 48, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        s = 1 / np.sqrt(h)
        self.p = {
            "P": rng.uniform(-s, s, (2, VOCAB, 4 * h)).astype(np.float32),
            "U": rng.uniform(-s, s, (2, h, 4 * h)).astype(np.float32),
            "W": rng.uniform(-s, s, (2 * h, N_TAGS)).astype(np.float32),
            "b": np.zeros(N_TAGS, np.float32),
            "T": np.zeros((N_TAGS, N_TAGS), np.float32),
        }
        self.p["P"][:, :, h : 2 * h] += 0.5  # remember at first

    @classmethod
    def load(cls, path) -> Model:
        m = cls.__new__(cls)
        with np.load(path) as z:
            m.p = {k: z[k].astype(np.float32) for k in z.files}
        return m

    def save(self, path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    # ------------------------------------------------------------ forward

    def hidden(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """ids (B,L) padded with 0 -> states (L,B,2H); with ``keep`` also what backward needs."""
        n, width = ids.shape
        h_size = self.p["U"].shape[1]
        both = np.stack([ids, _reverse(ids, lengths)])  # (2,B,L)
        h = np.zeros((2, n, h_size), np.float32)
        c = np.zeros_like(h)
        states = np.empty((width, 2, n, h_size), np.float32)
        kept = [] if keep else None
        table, u = self.p["P"], self.p["U"]
        for t in range(width):
            z = np.matmul(h, u)
            z[0] += table[0][both[0, :, t]]
            z[1] += table[1][both[1, :, t]]
            gates = z[:, :, : 3 * h_size]
            np.multiply(gates, 0.5, out=gates)
            np.tanh(z, out=z)
            np.multiply(gates, 0.5, out=gates)
            np.add(gates, 0.5, out=gates)
            i, f, o, g = (z[:, :, k * h_size : (k + 1) * h_size] for k in range(4))
            c_old = c
            c = f * c_old + i * g
            tc = np.tanh(c)
            h_old = h
            h = o * tc
            states[t] = h
            if keep:
                kept.append((z, c_old, tc, h_old))
        fwd = states[:, 0]
        bwd = _reverse_time(states[:, 1], lengths)
        return np.concatenate([fwd, bwd], axis=2), (both, kept)

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(B,L,K)"""
        s, _ = self.hidden(ids, lengths)
        return (s @ self.p["W"] + self.p["b"]).transpose(1, 0, 2)

    def text_emissions(self, texts: list[str], batch_chars: int = 80_000) -> list[np.ndarray]:
        """Emissions of whole texts, stitched from overlapping windows; windows of like length share a batch."""
        pieces = []  # (text, start, ids)
        out = []
        for n, t in enumerate(texts):
            ids = char_ids(t)
            out.append(np.zeros((len(ids), N_TAGS), np.float32))
            start = 0
            while True:
                pieces.append((n, start, ids[start : start + WINDOW]))
                if start + WINDOW >= len(ids):
                    break
                start += STRIDE
        order = sorted((k for k in range(len(pieces)) if len(pieces[k][2])), key=lambda k: len(pieces[k][2]))
        margin = (WINDOW - STRIDE) // 2
        at = 0
        while at < len(order):
            stop = at
            longest = 0
            while stop < len(order) and (stop == at or (longest := max(longest, len(pieces[order[stop]][2]))) * (stop - at + 1) <= batch_chars):
                stop += 1
            group = order[at:stop]
            lengths = np.array([len(pieces[k][2]) for k in group])
            ids = np.zeros((len(group), lengths.max()), np.int64)
            for r, k in enumerate(group):
                ids[r, : lengths[r]] = pieces[k][2]
            e = self.emissions(ids, lengths)
            for r, k in enumerate(group):
                n, start, own = pieces[k]
                a = 0 if start == 0 else margin
                z = len(own) if start + len(own) >= len(out[n]) else len(own) - margin
                out[n][start + a : start + z] = e[r, a:z]
            at = stop
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tag path of one text's emissions."""
        return self.paths([e])[0] if len(e) else np.zeros(0, np.int64)

    def paths(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag paths of several texts, decoded side by side; each is as long as its text."""
        order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        t = np.where(ALLOWED, self.p["T"], -1e4).astype(np.float32)
        for at in range(0, len(order), 512):
            group = [k for k in order[at : at + 512] if len(emissions[k])]
            if not group:
                continue
            lengths = np.array([len(emissions[k]) for k in group])
            width = int(lengths[0])
            e = np.zeros((width, len(group), N_TAGS), np.float32)
            for r, k in enumerate(group):
                e[: lengths[r], r] = emissions[k]
            back = np.empty((width, len(group), N_TAGS), np.int8)
            score = np.where(_START, e[0], np.float32(-1e4))
            for k in range(1, width):
                n = int(np.searchsorted(-lengths, -k, side="left"))  # the texts longer than k come first
                s = score[:n, :, None] + t
                best = s.argmax(axis=1)
                back[k, :n] = best
                score[:n] = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + e[k, :n]
            path = np.zeros((width, len(group)), np.int64)
            now = score.argmax(axis=1)
            for k in range(width - 1, -1, -1):
                live = lengths > k
                path[k] = now
                if k:
                    now = np.where(live, back[k, np.arange(len(group)), now], now)
            for r, k in enumerate(group):
                out[k] = path[: lengths[r], r]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) in each text.

        Texts whose every character is O by a margin that no transition can turn need no Viterbi.
        """
        gain = float(np.where(ALLOWED, self.p["T"], -np.inf).max() - self.p["T"][0, 0]) * 2
        emissions = self.text_emissions(texts)
        open_ = [k for k, e in enumerate(emissions) if len(e) and not (e[:, 1:].max(axis=1) + gain < e[:, 0]).all()]
        res: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for k, path in zip(open_, self.paths([emissions[k] for k in open_]), strict=True):
            res[k] = spans_of(path)
        return res

    # ------------------------------------------------------------ training

    def step(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray):
        """Mean CRF loss per character of a batch and its gradients."""
        n, width = ids.shape
        h_size = self.p["U"].shape[1]
        s, (both, kept) = self.hidden(ids, lengths, keep=True)
        e = s @ self.p["W"] + self.p["b"]  # (L,B,K)
        loss, de, dt = crf(e, tags.T, lengths, self.p["T"])
        g = {"W": np.tensordot(s, de, ([0, 1], [0, 1])), "b": de.sum(axis=(0, 1)), "T": dt}
        ds = de @ self.p["W"].T
        back = np.stack([ds[:, :, :h_size], _reverse_time(ds[:, :, h_size:], lengths)], axis=1)  # (L,2,B,H)
        dp, du = np.zeros_like(self.p["P"]), np.zeros_like(self.p["U"])
        dh = np.zeros((2, n, h_size), np.float32)
        dc = np.zeros_like(dh)
        ut = self.p["U"].transpose(0, 2, 1)
        dzs = np.empty((width, 2, n, 4 * h_size), np.float32)
        for t in range(width - 1, -1, -1):
            z, c_old, tc, h_old = kept[t]
            i, f, o, gg = (z[:, :, k * h_size : (k + 1) * h_size] for k in range(4))
            dh = dh + back[t]
            do = dh * tc
            dc = dc + dh * o * (1 - tc * tc)
            dz = dzs[t]
            dz[:, :, :h_size] = dc * gg * i * (1 - i)
            dz[:, :, h_size : 2 * h_size] = dc * c_old * f * (1 - f)
            dz[:, :, 2 * h_size : 3 * h_size] = do * o * (1 - o)
            dz[:, :, 3 * h_size :] = dc * i * (1 - gg * gg)
            du += np.matmul(h_old.transpose(0, 2, 1), dz)
            dh = np.matmul(dz, ut)
            dc = dc * f
        for d in range(2):
            flat, ids_d = dzs[:, d].reshape(-1, 4 * h_size), both[d].T.reshape(-1)
            order = np.argsort(ids_d, kind="stable")
            first = np.flatnonzero(np.diff(ids_d[order], prepend=-1))
            dp[d][ids_d[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        dp[:, 0] = 0
        g["P"], g["U"] = dp, du
        scale = 1 / max(1, int(lengths.sum()))
        return loss * scale, {k: v * scale for k, v in g.items()}


def _reverse(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    col = np.arange(ids.shape[1])[None, :]
    src = lengths[:, None] - 1 - col
    return np.where(src >= 0, np.take_along_axis(ids, np.maximum(src, 0), 1), 0)


def _reverse_time(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    src = lengths[None, :] - 1 - np.arange(x.shape[0])[:, None]
    out = np.take_along_axis(x, np.maximum(src, 0)[:, :, None], 0)
    out[src < 0] = 0
    return out


def crf(e: np.ndarray, tags: np.ndarray, lengths: np.ndarray, t: np.ndarray):
    """Negative log likelihood, and its gradients for emissions (L,B,K) and transitions."""
    width, n, k = e.shape
    live = np.arange(width)[:, None] < lengths[None, :]
    trans = np.where(ALLOWED, t, -1e4).astype(np.float32)
    alpha = np.empty_like(e)
    alpha[0] = e[0] + np.where(_START, 0, -1e4)
    for s in range(1, width):
        x = alpha[s - 1][:, :, None] + trans[None]
        m = x.max(axis=1)
        new = m + np.log(np.exp(x - m[:, None, :]).sum(axis=1)) + e[s]
        alpha[s] = np.where(live[s][:, None], new, alpha[s - 1])
    last = alpha[-1]
    m = last.max(axis=1)
    log_z = m + np.log(np.exp(last - m[:, None]).sum(axis=1))
    beta = np.zeros_like(e)
    dt = np.zeros((k, k), np.float64)
    for s in range(width - 2, -1, -1):
        x = trans[None] + (e[s + 1] + beta[s + 1])[:, None, :]
        m = x.max(axis=2)
        new = m + np.log(np.exp(x - m[:, :, None]).sum(axis=2))
        on = live[s + 1]
        beta[s] = np.where(on[:, None], new, 0)
        pair = np.exp(alpha[s][:, :, None] + x - log_z[:, None, None])
        dt += (pair * on[:, None, None]).sum(axis=0)
    marg = np.exp(alpha + beta - log_z[None, :, None])
    marg[~live] = 0
    de = marg
    idx_l, idx_b = np.nonzero(live)
    gold = e[idx_l, idx_b, tags[idx_l, idx_b]].sum()
    de[idx_l, idx_b, tags[idx_l, idx_b]] -= 1
    both = live[1:] & live[:-1]
    a, b = tags[:-1][both], tags[1:][both]
    gold += t[a, b].sum()
    np.subtract.at(dt, (a, b), 1)
    return float(log_z.sum() - gold), de.astype(np.float32), np.where(ALLOWED, dt, 0).astype(np.float32)


def spans_of(path: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    k, n = 0, len(path)
    while k < n:
        if path[k] == 0:
            k += 1
            continue
        kind = TAGS[path[k]][2:]
        end = k + 1
        while end < n and TAGS[path[end]] == f"I-{kind}":
            end += 1
        out.append((k, end, kind))
        k = end
    return out
