"""Secret scans: exact patterns, and a character convolutional network over further candidates.

Base spans come from three patterns (assigned values, access keys, long hexadecimal runs) and always stay. Every other run of
16 or more key characters is a candidate, without any rule before it; a small network in numpy reads it
with the characters around it and rejects words, slugs and numbers. It is trained on labelled findings (made ones, as no
table holds any; ``train`` takes others); its scores are calibrated on held-out findings and cut at the highest threshold
that keeps the demanded recall of ``find`` there: a key that lies in no candidate counts as missed. Accepted candidates are
added as spans of kind ``cnn``. The network scores base spans too; ``scores`` gives what it makes of each span.

Null texts count as empty; texts without findings give no spans and the hash of the empty text. Positions
are code points of the whole text, ends exclusive. Repeated rows give equal findings; empty tables give empty results. Input
columns named like a new one are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import append

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # of a maximal run of 32 or more the whole, as with + and a test of its length
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
KINDS = ("assign", "access", "hex", "cnn")

#: Characters the network reads at a time, and the sides; over a longer candidate this window moves by STRIDE, and the greatest score counts.
INSIDE, SIDE, STRIDE = 40, 20, 20
LENGTH = INSIDE + 2 * SIDE
CHARS = 32 + 96  # classes: code points below 128, less the controls, and two for all others
DIM, WIDTH, FILTERS = 8, 5, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of key characters that are long enough; what is a key is left to the network."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def run_around(text: str, start: int, end: int) -> tuple[int, int]:
    """The candidate that holds most of a labelled span; the span itself where none does."""
    return max(candidates(text), key=lambda c: min(end, c[1]) - max(start, c[0]), default=(start, end))


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a span, of a longer one its first INSIDE, and its surroundings; 0 where there is nothing."""
    return windows(text, start, min(end, start + INSIDE))[0]


def places(start: int, end: int) -> list[int]:
    """Where the windows over a candidate begin: every character lies in one, the last ends with the candidate."""
    return [*range(start, end - INSIDE, STRIDE), max(start, end - INSIDE)]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of all windows over a candidate, a row each."""
    n, at = max(end, start + INSIDE), np.array(places(start, end)) - start
    parts = (text[max(0, start - SIDE) : start].rjust(SIDE, "\0"), text[start:end].ljust(n - start, "\0"), text[end : end + SIDE].ljust(SIDE, "\0"))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, codes, 126 + (codes & 1)).astype(np.int16)
    return np.lib.stride_tricks.sliding_window_view(codes, LENGTH)[at]


# ---- labelled findings

#: Of long words of several languages.
SYLLABLES = "ver ge be ent er un ein aus auf ab an zu heit keit ung lich isch schaft chen taet nicht die der ist sch tz ch st en in con pro pre dis inter re de trans tion sion ment able ible ness less ful ity ive ous al ly ing ist ism eau eux aux elle que tre quer ment age ance ence cion dad mente ando iendo ar er ir os as la le li lo ma na ra ri ro sa se ta te ti to tor va vo qua quo gno gli zione".split()


def _keys(r: random.Random) -> str:
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    return r.choice(
        [
            lambda: pick(alnum, 20, 48),
            lambda: "ghp_" + pick(alnum, 36, 36),
            lambda: "sk-" + pick(alnum, 32, 48),
            lambda: "xoxb-" + pick(string.digits, 10, 12) + "-" + pick(alnum, 20, 26),
            lambda: "AIza" + pick(alnum + "_-", 35, 35),
            lambda: pick(alnum + "+/", 38, 44) + "==",
            lambda: pick("0123456789abcdef", 32, 64),
            lambda: "eyJ" + pick(alnum + "_-", 30, 60),
            lambda: pick(alnum, 16, 24),
            lambda: pick(alnum, 16, 18),
            lambda: pick(alnum, 16, 18),
            lambda: pick(r.choice([string.ascii_lowercase, string.ascii_uppercase]) + string.digits, 16, 18),
            lambda: pick(r.choice([string.ascii_lowercase, string.ascii_uppercase]) + string.digits, 16, 18),
            lambda: pick(string.ascii_lowercase + string.digits, 16, 32),
            lambda: pick(string.ascii_uppercase + string.digits, 16, 32),
        ]
    )()


def _others(r: random.Random) -> str:
    word = lambda: "".join(r.choices("etaoinshrdlucmfwygpb", k=r.randint(2, 9)))
    return r.choice(
        [
            lambda: "-".join([word() for _ in range(r.randint(3, 6))] + [str(r.randint(1, 2030))]),
            lambda: "_".join([word() for _ in range(r.randint(3, 5))]) + f"_v{r.randint(1, 99)}",
            lambda: "/".join([word() for _ in range(r.randint(2, 5))] + [str(r.randint(100, 99999))]),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}00",
            lambda: word() + str(r.randint(10**12, 10**15)) + word(),
            lambda: "".join(word().title() for _ in range(3)) + str(r.randint(1, 9999)),
            lambda: "=" * r.randint(12, 30) + f"x{r.randint(10, 99)}",
            lambda: f"page-{r.randint(1, 99)}-of-{r.randint(100, 999)}-{word()}",
            lambda: word() * 3 + str(r.randint(1000, 99999)),
            lambda: "-".join(word() for _ in range(r.randint(3, 7))),
            lambda: "/".join(word() for _ in range(r.randint(3, 7))),
            lambda: "".join(word().title() for _ in range(r.randint(2, 5))),
            lambda: "_".join(word() for _ in range(r.randint(3, 6))).upper(),
            lambda: r.choice([str, str.title, str.upper])("".join(r.choices(SYLLABLES, k=r.randint(4, 10)))),
            lambda: "".join(r.choices(SYLLABLES, k=r.randint(5, 8))),
            lambda: "".join(r.choices(SYLLABLES, k=r.randint(5, 8))).capitalize(),
            lambda: r.choice("-_/").join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(3, 7))),
            lambda: r.choice("=-_+/") * r.randint(16, 80),
            lambda: str(r.randint(10**15, 10**20)),
        ]
    )()


def labelled_findings(n: int = 3000, seed: int = 20) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made findings: keys of many forms and look-alikes, in prose and in settings."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlucmfwygpb", k=r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    part = lambda: r.choice([word(), word(), r.choice(SYLLABLES) + r.choice(SYLLABLES), str(r.randint(1, 2030))])
    path = lambda k: r.choice("///-_").join(part() for _ in range(k))
    names = ("key", "auth", "credential", "bearer", "access", "private_key", "client_secret", "signature")
    out = []
    while len(out) < n:
        y = r.random() < 0.5
        s = _keys(r) if y else _others(r)
        if len(s) < 16:
            continue
        hint = r.random()
        if y and hint < 0.5 or hint < 0.05:
            lead = r.choice(names) + r.choice([": ", "=", " = ", '="', " "])
        else:
            lead = r.choice(["", "see ", "(", "https://" + word() + ".org/", "id ", "file "])
        before = prose(r.randint(0, 5)) + r.choice([" ", "\n", ". "]) + lead
        after = r.choice(["", " ", '"', ".", "\n"]) + prose(r.randint(0, 5))
        if r.random() < 0.25:  # inside of a longer run
            before += path(r.randint(1, 12)) + r.choice("/=_-")
            after = r.choice("/=_-") + path(r.randint(1, 12)) + after if r.random() < 0.7 else after
        out.append((before + s + after, len(before), len(before) + len(s), int(y)))
    return out


def labelled_windows(findings: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the runs around labelled spans, and their labels.

    A window of a key's run is a secret if it holds 16 characters of the key or all; one with fewer is left out.
    """
    x, y = [], []
    for t, a, b, label in findings:
        start, end = run_around(t, a, b)
        for at, w in zip(places(start, end), windows(t, start, end), strict=True):
            shared = min(b, at + INSIDE, end) - max(a, at)
            if not label or shared <= 0 or shared >= min(16, b - a):
                x.append(w)
                y.append(label and shared > 0)
    return np.array(x), np.array(y, np.float64)


# ---- the network


@dataclass
class Network:
    """Embedding, one convolution with maximum over places, one output; then calibration and threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def hidden(self, x: np.ndarray):
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - WIDTH + 1, WIDTH * DIM)
        z = cols @ self.kernel + self.bias
        # inside and outside of the candidate count apart
        inside = slice(SIDE - WIDTH // 2, SIDE + INSIDE - WIDTH // 2)
        a = z[:, inside]
        b = np.concatenate([z[:, : inside.start], z[:, inside.stop :]], axis=1)
        return cols, a, b, np.concatenate([a.max(axis=1), b.max(axis=1), a.mean(axis=1)], axis=1), inside

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss of labelled windows, and its gradients by embed, kernel, bias, out and out_bias."""
        cols, a, b, h, inside = self.hidden(x)
        n, r = len(x), np.maximum(h, 0)
        raw = r @ self.out + self.out_bias
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        d = (p - y) / n
        dh = np.outer(d, self.out) * (h > 0)
        dz = np.zeros((n, LENGTH - WIDTH + 1, FILTERS))
        rows, f = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        dz[rows, a.argmax(axis=1) + inside.start, f] += dh[:, :FILTERS]
        outside = np.concatenate([np.arange(inside.start), np.arange(inside.stop, dz.shape[1])])
        dz[rows, outside[b.argmax(axis=1)], f] += dh[:, FILTERS : 2 * FILTERS]
        dz[:, inside] += dh[:, None, 2 * FILTERS :] / a.shape[1]
        dcols = (dz @ self.kernel.T).reshape(n, -1, WIDTH, DIM)
        de = np.zeros((n, LENGTH, DIM))
        for w in range(WIDTH):
            de[:, w : w + dcols.shape[1]] += dcols[:, :, w]
        demb = np.zeros_like(self.embed)
        np.add.at(demb, x, de)
        loss = float((np.logaddexp(0, raw) - y * raw).mean())
        return loss, [demb, np.tensordot(cols, dz, ([0, 1], [0, 1])), dz.sum(axis=(0, 1)), r.T @ d, np.array([d.sum()])]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.hidden(x[s : s + 256])[3], 0) @ self.out + self.out_bias for s in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.empty(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of a secret."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.97, epochs: int = 6, seed: int = 5) -> Network:
    """Adam on logistic loss; a fifth of the findings is held out for calibration and the threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    held, used = ([findings[k] for k in part] for part in (order[: len(order) // 5], order[len(order) // 5 :]))
    (x, y), seen = labelled_windows(used), labelled_windows(held)
    used = np.arange(len(x))
    net = Network(rng.normal(0, 0.3, (CHARS, DIM)), rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 3 * FILTERS), 0.0)
    par = [net.embed, net.kernel, net.bias, net.out, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    step = 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for s in range(0, len(used), 64):
            k = used[s : s + 64]
            _, grad = net.gradients(x[k], y[k])
            step += 1
            for q, g, m1, v1 in zip(par, grad, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                q -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
            net.out_bias = float(par[4][0])
    return _calibrated(net, *seen, held, recall)


def _calibrated(net: Network, x: np.ndarray, y: np.ndarray, findings: list[tuple[str, int, int, int]], recall: float) -> Network:
    """Slope and shift by Newton steps on held-out logistic loss; then the highest cut with the recall.

    Recall is that of ``find`` over the keys that the patterns leave: one that lies in no candidate scores 0.
    """
    z = net.raw(x)
    a, b = 1.0, 0.0
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, g = p * (1 - p) + 1e-6, p - y
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, [(g * z).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    keys = [(t, a, b) for t, a, b, label in findings if label and not any(s < b and a < e for s, _, e in base_spans(t))]
    runs = judged([t for t, _, _ in keys], net)
    good = np.sort([max((p for s, e, p in found if s < b and a < e), default=0.0) for (_, a, b), found in zip(keys, runs, strict=True)])
    net.threshold = float(min(0.9, good[int((1 - recall) * len(good))])) if len(good) else 0.5
    return net


@lru_cache(maxsize=2)
def standard_network(recall: float = 0.97) -> Network:
    return train(labelled_findings(), recall)


# ---- texts


def clear(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that overlap no base finding; both come in order, so one walk over both is enough."""
    out, k, reach = [], 0, 0
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def scored(texts: list[str | None], spans: list[list[tuple[int, int]]], net: Network) -> list[list[float]]:
    """The network's score of each span of each text: the greatest over the span's windows."""
    seen = [windows(t, a, b) for t, found in zip(texts, spans, strict=True) for a, b in found]
    if not seen:
        return [[] for _ in texts]
    starts = np.cumsum([0, *map(len, seen[:-1])])
    p = iter(np.maximum.reduceat(net.score(np.concatenate(seen)), starts).tolist())
    return [[next(p) for _ in found] for found in spans]


def judged(texts: list[str | None], net: Network) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of each text's candidates beside its base findings."""
    spans = [clear(candidates(t), base_spans(t)) if t else [] for t in texts]
    return [[(a, b, p) for (a, b), p in zip(found, got, strict=True)] for found, got in zip(spans, scored(texts, spans, net), strict=True)]


def weighed(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of all findings of each text: base ones, whatever their score, and those the network adds."""
    base = [base_spans(t or "") for t in texts]
    added = judged(texts, net)
    own = scored(texts, [[(a, b) for a, _, b in found] for found in base], net)
    return [
        sorted([(*span, p) for span, p in zip(found, ps, strict=True)] + [(a, 3, b, p) for a, b, p in new if p >= net.threshold])
        for found, ps, new in zip(base, own, added, strict=True)
    ]


def find(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all findings of each text."""
    return [[x[:3] for x in found] for found in weighed(texts, net)]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("n_cnn", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("scores", T.StringType()),
]


def scan(df: DataFrame, net: Network | None = None, text: str = "text") -> DataFrame:
    """Appends counts by kind, the hash of the base spans, all spans as text, and the network's score of each span."""
    held = df.sparkSession.sparkContext.broadcast(net or standard_network())

    def make():
        def run(texts):
            out = [[] for _ in FIELDS]
            for found in weighed(texts, held.value):
                spans = [x[:3] for x in found]
                base = named([s for s in spans if s[1] < 3])
                row = [sum(s[1] == k for s in spans) for k in range(4)] + [hashlib.sha256(base.encode()).hexdigest(), named(spans), ",".join(f"{x[3]:.3f}" for x in found)]
                for x, v in zip(out, row, strict=True):
                    x.append(v)
            return out

        return run

    return append(df, text, FIELDS, make, rows=512)


def redact(df: DataFrame, net: Network | None = None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces each finding in the text by ``mark``; findings that overlap become one mark. Null stays null."""
    held = df.sparkSession.sparkContext.broadcast(net or standard_network())

    def clean(t, spans):
        if not spans:
            return t
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def make():
        return lambda texts: [[clean(t, s) for t, s in zip(texts, find(texts, held.value), strict=True)]]

    order = df.columns
    renamed = df.withColumn("__text", df[text]).drop(text)
    return append(renamed, "__text", [T.StructField(text, T.StringType())], make, rows=512).select(*order)
