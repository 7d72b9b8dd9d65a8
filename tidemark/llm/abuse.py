"""Abusive, hateful or sexual content: a bidirectional GRU with attention pooling, trained in numpy.

Words are undisguised (letters written as digits or signs, stretched and spaced-out letters) and enter
twice: as a hashed word vector and as the mean of hashed character-trigram vectors of the word as written
and undisguised. Two GRUs read each window of WINDOW words in both directions; attention pools their
states; a logistic unit scores the window. All overlapping windows (STRIDE words apart) of a text are
scored whole; the document's score is the greatest.

Labels are given to documents, by raters who err: a document's label is its raters' majority. The rated
documents are halved, and a network is fitted to each half in ROUNDS of STEPS steps. A round picks windows (of a
document with such content the likeliest one, of another the two likeliest and random ones) by the scores of
the other half's network, before the first round of the other half's naive Bayes over words and word pairs;
from the second round on, documents whose label is likelier wrong than right by that network's scores are left out. So a
wrong label is never defended by the network that learnt it by heart. The final network is fitted anew, in LAST
steps, to what is left of both halves. At most TRAIN_DOCS rated documents are used, drawn by a hash of their
id; the threshold is set on a held-out fifth of them, or is 0.5 where that fifth is too small.
All numbers of steps are the same at every size.
"""

from __future__ import annotations

import io
import re
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

ship(sys.modules[__name__])

WINDOW, STRIDE = 24, 12
WORDS, GRAMS, DW, DC, H = 1 << 14, 1 << 13, 24, 16, 24
TRAIN_DOCS, ROUNDS, STEPS, LAST, BATCH, RATE, NEGATIVES, RARE = 9000, 3, 250, 900, 128, 4e-3, 4, 4.0
#: Raters' rate of errors; fewest positives to set a threshold on.
NOISE, LEAST = 0.05, 15
#: Difference of F1 that a held-out fifth can't tell from chance.
TIE = 0.01
# Letters written as digits and signs.
LEET = str.maketrans("013457@$!|€", "oieastasiie")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_STRETCH = re.compile(r"(\w)\1{2,}")
_LETTER = re.compile(r"[^\W\d_]")


def undisguise(word: str) -> str:
    """Lower case; signs and digits among letters read as letters; a letter written three times or more once."""
    w = word.lower()
    core = w.strip(".,;:?\"'()[]{}…-–!")
    if core and not core.isalpha() and _LETTER.search(core):
        core = core.translate(LEET)
    core = _STRETCH.sub(r"\1", _EDGE.sub("", core))
    if not core:
        return "0" if any(c.isdigit() for c in w) else w[:1]
    return "0" if core.isdigit() else core


def words_of(text: str) -> list[str]:
    """Words as written, runs of three or more single letters joined into one."""
    out, run = [], []
    for w in text.split():
        if len(w) == 1 and not w.isdigit() and not (w in "-–&+=/|*" ):
            run.append(w)
            continue
        if run:
            bare = w.rstrip(".,;:?!")
            if len(run) >= 2 and len(bare) == 1:
                run.append(bare)
                out.append("".join(run))
                run = []
                continue
            out.extend(["".join(run)] if len(run) >= 3 else run)
            run = []
        out.append(w)
    if run:
        out.extend(["".join(run)] if len(run) >= 3 else run)
    return out


def word_inputs(word: str) -> tuple[int, list[int]]:
    """The bucket of the undisguised word (1 ..) and those of its character trigrams."""
    u = undisguise(word)
    crc = zlib.crc32
    marked = [f"<{u}>"]
    raw = word.lower()
    if raw != u:
        marked.append(f"<{raw}>")
    grams = [crc(m[i : i + 3].encode()) % GRAMS for m in marked for i in range(max(1, len(m) - 2))]
    return crc(u.encode()) % (WORDS - 1) + 1, grams


class Lexicon:
    """Rows for the words met so far; row 0 pads."""

    def __init__(self, limit: int = 400_000):
        self.row, self.word, self.grams, self.limit = {}, [0], [[0]], limit

    def rows(self, words: list[str]) -> list[int]:
        out, row = [], self.row
        for w in words:
            r = row.get(w)
            if r is None:
                r = row[w] = len(self.word)
                a, b = word_inputs(w)
                self.word.append(a)
                self.grams.append(b)
            out.append(r)
        return out


def windows(rows: list[int]) -> np.ndarray:
    """All windows of a text, as an array (n, WINDOW) padded with 0; every word lies in at least one."""
    n = len(rows)
    count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
    padded = np.zeros((count - 1) * STRIDE + WINDOW, dtype=np.int32)
    padded[:n] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def _sig(x):
    return 1.0 / (1.0 + np.exp(-x))


def _gather(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indexes of at, and the sums of their values' rows."""
    order = np.argsort(at, kind="stable")
    met, starts = np.unique(at[order], return_index=True)
    return met, np.add.reduceat(values[order], starts, axis=0)


class Net:
    """Parameters in p; forward for scoring, step for training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(np.float32)
        d = DW + DC
        self.p = {"Ew": f(WORDS, DW), "Ec": f(GRAMS, DC), "v": f(2 * H), "w": f(2 * H), "c": np.zeros(1, np.float32) - 1}
        for k in "fb":
            self.p |= {f"W{k}": f(d, 3 * H, k=d**-0.5), f"U{k}": f(H, 3 * H, k=H**-0.5), f"B{k}": np.zeros(3 * H, np.float32)}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t, self.rate = 0, RATE

    def dump(self) -> bytes:
        b = io.BytesIO()
        np.savez(b, **self.p)
        return b.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Net:
        net = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            net.p = {k: z[k] for k in z.files}
        return net

    def embed(self, word: np.ndarray, grams: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of words, their flattened trigrams and the trigrams' shares."""
        n = np.array([len(g) for g in grams])
        flat = np.concatenate([np.asarray(g) for g in grams])
        share = np.repeat(1.0 / n, n).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        chars = np.add.reduceat(self.p["Ec"][flat] * share[:, None], starts, axis=0)
        return np.concatenate([self.p["Ew"][word], chars], axis=1), flat, share

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The words' parts of the gates, which depend on the word alone."""
        out = {}
        for k in "fb":
            out[k] = x @ self.p[f"W{k}"] + self.p[f"B{k}"]
        return out

    def forward(self, proj: dict[str, np.ndarray], win: np.ndarray, keep: bool = False):
        n, t = win.shape
        mask = (win > 0).astype(np.float32)
        hs = np.empty((t, n, 2 * H), np.float32)
        tape: dict = {"f": [], "b": []}
        for j, k in enumerate("fb"):
            U = self.p[f"U{k}"]
            h = np.zeros((n, H), np.float32)
            for i in range(t) if k == "f" else range(t - 1, -1, -1):
                x = proj[k][win[:, i]]
                g = h @ U
                zr = _sig(x[:, : 2 * H] + g[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(x[:, 2 * H :] + r * g[:, 2 * H :])
                mk = mask[:, i : i + 1]
                new = h + mk * (1 - z) * (c - h)
                if keep:
                    tape[k].append((i, h, z, r, c, g[:, 2 * H :]))
                h = new
                hs[i, :, j * H : (j + 1) * H] = h
        e = hs @ self.p["v"]
        e = np.where(mask.T > 0, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, hs)
        out = pooled @ self.p["w"] + self.p["c"][0]
        return (out, (hs, a, pooled, tape, mask)) if keep else out

    def step(self, lex: Lexicon, win: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        uniq, inv = np.unique(win, return_inverse=True)
        small = inv.reshape(win.shape)
        if uniq[0] != 0:  # row 0 must stay the pad
            uniq, small = np.concatenate([[0], uniq]), small + 1
        word = np.array([lex.word[u] for u in uniq])
        grams = [lex.grams[u] for u in uniq]
        x, flat, share = self.embed(word, grams)
        out, (hs, a, pooled, tape, mask) = self.forward(self.project(x), small, keep=True)
        q = _sig(out)
        g: dict[str, np.ndarray] = {}
        do = (weight * (q - y) / len(y)).astype(np.float32)
        g["w"], g["c"] = pooled.T @ do, np.array([do.sum()], np.float32)
        dp = do[:, None] * self.p["w"]
        da = np.einsum("nh,tnh->tn", dp, hs)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, hs)
        dhs = a[:, :, None] * dp[None] + de[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for j, k in enumerate("fb"):
            U = self.p[f"U{k}"]
            gates_at = np.empty((win.shape[1], win.shape[0], 3 * H), np.float32)
            gU = np.zeros_like(U)
            dh = np.zeros((win.shape[0], H), np.float32)
            for i, h, z, r, c, gn in reversed(tape[k]):
                dh = dh + dhs[i, :, j * H : (j + 1) * H]
                mk = mask[:, i : i + 1]
                dc = dh * mk * (1 - z) * (1 - c * c)
                dz = dh * mk * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                gates_at[i] = gates
                gU += h.T @ rec
                dh = dh * (1 - mk * (1 - z)) + rec @ U.T
            met, sums = _gather(small.T.ravel(), gates_at.reshape(-1, 3 * H))
            gp = np.zeros((len(uniq), 3 * H), np.float32)
            gp[met] = sums
            gp[0] = 0
            g[f"U{k}"], g[f"W{k}"], g[f"B{k}"] = gU, x.T @ gp, gp.sum(axis=0)
            dx += gp @ self.p[f"W{k}"].T
        n = np.array([len(b) for b in grams])
        rows = {"Ew": _gather(word, dx[:, :DW]), "Ec": _gather(flat, np.repeat(dx[:, DW:], n, axis=0) * share[:, None])}
        self.t += 1
        for k, v in (g | {k: v for k, (_, v) in rows.items()}).items():
            at = rows[k][0] if k in rows else slice(None)  # of the word vectors only those met are moved
            v = np.clip(v, -1, 1)
            m = self.m[k][at] = self.m[k][at] + 0.1 * (v - self.m[k][at])
            q2 = self.s[k][at] = self.s[k][at] + 0.01 * (v * v - self.s[k][at])
            up = m / (1 - 0.9**self.t) / (np.sqrt(q2 / (1 - 0.99**self.t)) + 1e-7)
            self.p[k][at] -= self.rate * (up + (0.0 if k in ("c",) else 0.01 * self.p[k][at]))
        return float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).mean())


class Scorer:
    """Scores texts; projections of words are kept while the vocabulary is within a limit."""

    def __init__(self, net: Net, lex: Lexicon | None = None):
        self.net, self.lex = net, lex or Lexicon()
        self.proj = {k: np.zeros((0, 3 * H), np.float32) for k in "fb"}

    def _extend(self) -> None:
        have, need = len(self.proj["f"]), len(self.lex.word)
        if need > have:
            x, _, _ = self.net.embed(np.array(self.lex.word[have:]), self.lex.grams[have:])
            more = self.net.project(x)
            self.proj = {k: np.concatenate([self.proj[k], more[k]]) for k in "fb"}

    def logits(self, win: np.ndarray, chunk: int = 2048) -> np.ndarray:
        self._extend()
        return np.concatenate([self.net.forward(self.proj, win[i : i + chunk]) for i in range(0, len(win), chunk)])

    def texts(self, texts: list[str]) -> np.ndarray:
        """Greatest window score of each text, as a probability."""
        if len(self.lex.word) > self.lex.limit:
            self.__init__(self.net)
        wins, owner = [], []
        for k, t in enumerate(texts):
            rows = self.lex.rows(words_of(t))
            if rows:
                w = windows(rows)
                wins.append(w)
                owner.append(np.full(len(w), k))
        out = np.full(len(texts), -np.inf)
        if wins:
            np.maximum.at(out, np.concatenate(owner), self.logits(np.concatenate(wins)))
        return _sig(out)


def _first_scores(word: np.ndarray, every: np.ndarray, owner: np.ndarray, y: np.ndarray, fit: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Naive Bayes scores (the six likeliest words and word pairs) of the windows of documents ask, counted over documents fit."""
    size = 1 << 20
    pair = lambda w: (word[w[..., :-1]] * 40503 + word[w[..., 1:]]) % (size - WORDS) + WORDS
    count = np.zeros((2, size), np.float32)
    for k in np.flatnonzero(fit):
        w = every[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
        count[int(y[k]), np.unique(np.concatenate([word[w].ravel(), pair(w).ravel()]))] += 1
    total = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()], dtype=np.float32)
    ratio = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    ratio = np.where(count.sum(axis=0) >= 2, ratio, 0).astype(np.float32)
    ratio[[0, 1]] = 0
    out = np.zeros(len(every), np.float32)
    at = np.flatnonzero(ask[owner])
    for i in range(0, len(at), 20_000):
        w = every[at[i : i + 20_000]]
        out[at[i : i + 20_000]] = np.sort(np.concatenate([ratio[word[w]], ratio[pair(w)]], axis=1), axis=1)[:, -6:].sum(axis=1)
    return out


def right(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How likely each document's label is right, given its score by a network that hasn't seen it and raters who err at a rate of
    NOISE: the score says as much as a logistic curve through all documents' labels does, errors taken out, however weak the
    network is."""
    x = np.stack([np.ones(len(top)), np.clip(top, -8, 8)], axis=1)
    b = np.zeros(2)
    for _ in range(25):
        p = _sig(x @ b)
        w = p * (1 - p) + 1e-6
        b += np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * b)
    p = np.clip((_sig(x @ b) - NOISE) / (1 - 2 * NOISE), 1e-3, 1 - 1e-3)
    yes, no = np.where(y == 1, p, 1 - p) * (1 - NOISE), np.where(y == 1, 1 - p, p) * NOISE
    return yes / (yes + no)


def _choose(rng, score: np.ndarray, at: np.ndarray, y: np.ndarray, fit: np.ndarray, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels to fit: of a document with such content its likeliest window, of another the two likeliest and random
    ones; documents whose label is likelier wrong than right are left out."""
    chosen, labels = [], []
    for k in fit:
        s = score[at[k] : at[k + 1]]
        if trusted[k] < 0.5:
            continue
        picks = {int(s.argmax())} if y[k] else {*np.argsort(-s)[:2].tolist(), *rng.integers(0, len(s), NEGATIVES - 2).tolist()}
        chosen += [at[k] + p for p in picks]
        labels += [int(y[k])] * len(picks)
    return np.array(chosen, dtype=int), np.array(labels, np.float32)


def _descend(net: Net, lex: Lexicon, rng, every: np.ndarray, chosen: np.ndarray, labels: np.ndarray, steps: int) -> None:
    """A number of steps over the chosen windows in random order, the last third of them small ones."""
    if not 0 < labels.sum() < len(labels):
        return
    weight = np.where(labels == 1, max(1.0, min(4.0, 0.5 * (labels == 0).sum() / labels.sum())), 1.0).astype(np.float32)
    order = np.concatenate([rng.permutation(len(chosen)) for _ in range(-(-steps * BATCH // len(chosen)))])
    for k in range(steps):
        o = order[k * BATCH : (k + 1) * BATCH]
        net.rate = RATE * (0.3 if k > 2 * steps / 3 else 1.0)
        net.step(lex, every[chosen[o]], labels[o], weight[o])


def train_model(texts: list[str], y: np.ndarray, held: np.ndarray, sure: np.ndarray | None = None, seed: int = 3) -> tuple[Net, float, dict]:
    """A network fitted to the texts that aren't held out, and the threshold best on those that are.

    The threshold has the greatest F1 over held-out documents with sure labels, where there are LEAST positives among them; else it is 0.5, not tuned at all. Raters see such content more often than the corpus has it, so documents without it count RARE times.
    """
    rng = np.random.default_rng(seed)
    lex = Lexicon()
    docs = [windows(lex.rows(words_of(t)) or [0]) for t in texts]
    net, stats = Net(), {"docs": len(texts), "positive": int(y.sum())}
    half = rng.permutation(len(docs)) % 2
    sides = [~held & (half == h) for h in (0, 1)]
    if any(not 0 < y[s].sum() < s.sum() for s in sides):
        return net, 1.1, stats
    word, every = np.array(lex.word, dtype=np.int64), np.concatenate(docs)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    best = lambda s: np.maximum.reduceat(s, at[:-1])
    # every document is scored by what was fitted to the other half, so that no mislabelled one vouches for itself
    score = sum(_first_scores(word, every, owner, y, sides[h], ~sides[h]) for h in (0, 1))
    nets = [Net(seed + 10 + h) for h in (0, 1)]
    for r in range(ROUNDS):
        new = np.zeros(len(every), np.float32)
        trusted = right(best(score), y) if r else np.ones(len(docs))
        for h in (0, 1):
            _descend(nets[h], lex, rng, every, *_choose(rng, score, at, y, np.flatnonzero(sides[h]), trusted), STEPS)
            ask = np.flatnonzero(~sides[h][owner])
            new[ask] += Scorer(nets[h], lex).logits(every[ask])
        new[held[owner]] /= 2
        score = new
    _descend(net, lex, rng, every, *_choose(rng, score, at, y, np.flatnonzero(~held), right(best(score), y)), LAST)
    check = np.flatnonzero(held if sure is None else held & sure)
    if y[check].sum() < LEAST:
        return net, 0.5, stats
    top = best(Scorer(net, lex).logits(every))
    grid = np.linspace(-1, 7, 65)
    weight = np.where(y[check] == 1, 1.0, RARE)
    f1 = [2 * (y[check] * (top[check] >= g)).sum() / max(1, y[check].sum() + (weight * (top[check] >= g)).sum()) for g in grid]
    near = np.flatnonzero(np.array(f1) >= max(f1) - TIE)  # the middle of what is as good within a standard error
    stats["f1"] = float(max(f1))
    return net, float(_sig(grid[near[len(near) // 2]])), stats


def majority(labels: DataFrame) -> DataFrame:
    """(doc_id, y, sure): each rated document's majority label, ties counted as not abusive; repeats of a rater once.
    It is sure if two raters or more agree."""
    one = labels.where("abusive IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "rater").agg(
        F.max_by("abusive", F.coalesce(F.col("rated_at").cast("string"), F.lit(""))).alias("abusive")
    )
    share = F.avg(F.col("abusive").cast("double"))
    return one.groupBy("doc_id").agg(
        (share > 0.5).cast("int").alias("y"), ((F.count(F.lit(1)) >= 2) & share.isin(0.0, 1.0)).cast("int").alias("sure")
    )


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[bytes, float, dict]:
    """Network, threshold and figures from at most about `most` rated documents, fitted in one task."""
    rated = majority(labels)
    count = rated.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))
    part = (1 << 20) if count <= most else int((1 << 20) * most / count)
    rated = rated.where(h < part)
    text = docs.select("doc_id", "text").where("text IS NOT NULL")
    sample = text.join(F.broadcast(rated), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"), F.max("sure").alias("sure"))

    def run(batches):
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"doc_id": [], "text": [], "y": [], "sure": []})])
        pdf = pdf.sort_values("doc_id")
        held = pdf["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 10 < 2).to_numpy(bool)
        net, threshold, stats = train_model(pdf["text"].tolist(), pdf["y"].to_numpy(int), held, pdf["sure"].to_numpy(int) == 1)
        yield pd.DataFrame({"net": [net.dump()], "threshold": [threshold], "f1": [stats.get("f1", 0.0)], "docs": [stats["docs"]]})

    got = sample.repartition(1).mapInPandas(run, "net binary, threshold double, f1 double, docs bigint").first()
    if got is None:
        return Net().dump(), 1.1, {"docs": 0}
    return bytes(got.net), got.threshold, {"docs": got.docs, "f1": got.f1}


def score(docs: DataFrame, net: bytes) -> DataFrame:
    """(doc_id, source, score) for every document with a text; NULL and blank texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a model of fixed size, about 3 MB

    def run(batches):
        scorer = Scorer(Net.load(shared.value))
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            out, k = [], 0
            while k < len(texts):  # slices of bounded length, so that memory doesn't follow the longest texts
                e, size = k, 0
                while e < len(texts) and (e == k or size + len(texts[e]) < 2_000_000):
                    size += len(texts[e])
                    e += 1
                out.append(scorer.texts(texts[k:e]))
                k = e
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": np.concatenate(out) if out else []})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, score double")
