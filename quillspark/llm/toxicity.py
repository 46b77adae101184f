"""Toxicity by weak supervision.

Voters (words of a lexicon, groups of words in other languages, patterns, and
word beginnings) each fire on a document or abstain.  The word beginnings are
proposed by labelled rows on which no other voter fires: those whose documents
are labelled toxic far more often than chance allows.  A generative label model
tells how good each voter is from how often voters fire and fire together,
never from labels: given the class they are independent but for some correlated
pairs, so off the diagonal the covariance matrix is u u^T, with u_j the (scaled)
difference of voter j's rates in the two classes.  u is fitted to the counts of
all documents; pairs that stand off the fit are the correlated ones, are left
out of the next fit, and share their weight in a posterior where both fire;
pairs that avoid each other (words of different languages), or whose meetings
are too few to tell, say nothing.  A voter
that has no other to be judged by keeps a weak prior: that it is right in
``TRUST`` of its cases, or in ``DOUBT`` of them if it looks at signs only.  A logistic classifier over voters and hashed words is
trained on the posterior labels; labels calibrate its scores.

The covariance is of all documents (one number for each pair of voters that
fire together).  Word beginnings, classifier and calibration are fitted on about
``sample`` rows of the learning part each, chosen by the hash of their ids, and
on fewer where these would have more than ``WORDS_HELD`` words.  Labels are
looked up for rows of the learning part only.  Language, source and id are no
inputs.  The texts are read for the sample, for the counts, and for the scores.

Rows: null and empty texts fire no voter and get the score of that; rows of one
id or of none are scored each by its own text, and repeated rows alike; a score
equal to the threshold is predicted; a null, absent or other label is no label,
of several of one id the largest counts; without labels the score is not
calibrated; without documents there is no row.  Further columns are not read,
whatever they are called, and :func:`keep_clean` returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import common as c

# Words of insult, each a voter.
WORDS = (
    "idiot moron stupid clown loser pathetic scum worthless trash disgusting dumb jerk vermin filth "
    "imbecile garbage hate bastard bitch fuck shit asshole retard whore cretin coward pig"
).split()
# Groups of words, each group a voter.
GROUPS = {
    "plural": "idiots morons clowns losers jerks bastards bitches assholes pigs cowards imbeciles cretins fools",
    "mild": "fool ugly lame sucks crap damn liar creep freak lunatic brainless useless ridiculous despicable repulsive",
    "curse": "fucking fucked fucker bullshit shitty dickhead motherfucker cunt prick wanker twat slut",
    "threat": "kill murder strangle stab behead exterminate lynch",
    "de": "idioten dumm dummkopf arschloch scheisse scheiße abschaum versager trottel wertlos erbärmlich widerlich hurensohn schlampe vollidiot",
    "fr": "imbécile connard connasse salaud salope merde putain abruti ordure minable débile crétin dégoûtant pouffiasse",
    "es": "idiota imbécil estúpido estúpida puta mierda basura cabrón pendejo asqueroso inútil gilipollas escoria payaso perdedor",
}
ADDRESS = "you your youre u du sie tu vous usted eres".split()
PATTERNS = ("you_are", "shouting", "exclaiming", "masked")
FIXED = (*WORDS, *GROUPS, *PATTERNS)
SIZES = (4, 5, 6, 7, 8)  # bytes of a word beginning; they fit into one number
PRIOR = 0.1  # share of toxic documents that the label model assumes
TRUST, DOUBT = 0.9, 0.2
SLOTS = 1 << 16
WORDS_HELD = 6_000_000


class Stems(NamedTuple):
    """Word beginnings: by size sorted numbers and the voter of each."""

    by_size: dict[int, tuple[np.ndarray, np.ndarray]]
    many: int

    @property
    def voters(self) -> int:
        return len(FIXED) + self.many


NO_STEMS = Stems({}, 0)


class Model(NamedTuple):
    votes: np.ndarray
    words: np.ndarray
    bias: float
    slope: float
    shift: float
    stems: Stems


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return c.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), c.folded()).hashes


def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lexicon's words, sorted, and the voter of each."""
    words = [*WORDS, *(w for g in GROUPS.values() for w in g.split())]
    voter = [*range(len(WORDS)), *(len(WORDS) + k for k, g in enumerate(GROUPS.values()) for _ in g.split())]
    h, first = np.unique(_hash_words(words), return_index=True)
    return h, np.array(voter)[first]


def _beginnings(data: np.ndarray, t: c.Tokens, size: int) -> np.ndarray:
    """The first ``size`` bytes of each token, lower-cased, as a number; 0 for shorter ones."""
    out = np.zeros(len(t.start), c.U)
    long = np.flatnonzero(t.end - t.start >= size)
    for k in range(size):
        byte = data[t.start[long] + k]
        out[long] |= (byte + np.uint8(32) * ((byte >= 65) & (byte <= 90))).astype(c.U) << c.U(8 * k)
    return out


def _read(data: np.ndarray, at: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], near: np.ndarray, stems: Stems) -> tuple[c.Tokens, np.ndarray, np.ndarray]:
    """Tokens of texts, the matrix (text, voter) of votes, and which tokens are in the lexicon."""
    t = c.tokens(data, at, c.folded())
    of, n = t.text_of(), len(at) - 1
    votes = np.zeros((n, stems.voters), bool)
    known, voter = lexicon
    spot = np.minimum(np.searchsorted(known, t.hashes), len(known) - 1)
    hit = known[spot] == t.hashes
    votes[of[hit], voter[spot[hit]]] = True
    for size, (begin, whose) in stems.by_size.items():
        h = _beginnings(data, t, size)
        spot = np.minimum(np.searchsorted(begin, h), len(begin) - 1)
        own = begin[spot] == h
        votes[of[own], whose[spot[own]]] = True
        hit = hit | own
    address = np.isin(t.hashes, near)
    for back in (1, 2, 3):
        pair = hit[back:] & address[:-back] & (of[back:] == of[:-back])
        votes[of[back:][pair], FIXED.index("you_are")] = True

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[at])

    upper, lower = count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    votes[:, FIXED.index("shouting")] = upper > np.maximum(20, 2 * lower)
    bang, star = data == 33, data == 42
    votes[:, FIXED.index("exclaiming")] = count(bang & np.append(False, bang[:-1])) >= 3
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    masked = np.zeros(len(data), bool)
    masked[1:-1] = star[1:-1] & letter[:-2] & (letter[2:] | star[2:])
    votes[:, FIXED.index("masked")] = count(masked) >= 2
    return t, votes, hit


def _sketches(docs: DataFrame) -> DataFrame:
    """(row, toxic, a, b, sketch) of documents (row, text, toxic): the least
    hashes of their three-word runs under some orders."""
    mul = c.mix(np.arange(1, 17, dtype=c.U)) | c.U(1)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, 16), c.U)
            for i, _, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, c.folded())
                of, size = t.text_of(), np.diff(t.first)
                ok = np.flatnonzero(t.whole(3, of))
                h, text = c.grams(t.hashes, 3)[ok], of[ok]
                for k in (1, 2):  # texts of fewer words are one run
                    short = np.flatnonzero(size == k)
                    if len(short):
                        h, text = np.append(h, c.grams(t.hashes, k)[t.first[short]]), np.append(text, short)
                order = np.argsort(text, kind="stable")
                h, text = h[order], text[order]
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else text
                for k in range(16):
                    if len(first):
                        out[i + text[first], k] = np.minimum.reduceat(c.mix(h * mul[k]), first)
            sketch = pa.ListArray.from_arrays(np.arange(0, out.size + 1, 16, dtype=np.int32), pa.array(out.view(np.int64).ravel()))
            yield pa.record_batch([b.column("row"), b.column("toxic"), pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64)), sketch], names=["row", "toxic", "a", "b", "sketch"])
        c.trim()

    return docs.select("row", "text", "toxic").mapInArrow(least, "row long, toxic int, a long, b long, sketch array<long>")


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` (row, text, toxic) without most near copies of one another: rows
    of one label that share a least hash, and half of a sketch, with the first
    row that has it, so that copies don't pass for evidence."""
    marks = _sketches(docs)
    for mark in ("a", "b"):
        head = marks.groupBy(mark, "toxic").agg(F.min(F.struct("row", "sketch")).alias("h"))
        agree = F.size(F.filter(F.arrays_zip(F.col("sketch").alias("x"), F.col("h.sketch").alias("y")), lambda z: z["x"] == z["y"]))
        marks = c.salted(marks, head, [mark, "toxic"]).where((F.col("row") == F.col("h.row")) | (agree < 8)).drop("h")
    return docs.join(marks.select("row"), "row", "left_semi")


def _together(docs: DataFrame, stems: Stems) -> tuple[int, int, np.ndarray]:
    """Documents, their words, and on how many of them each two voters fire."""
    m, near = stems.voters, _hash_words(ADDRESS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon()
        total, n, words = np.zeros((m, m), np.int64), 0, 0
        for b in batches:
            n += b.num_rows
            for _, _, data, at in c.slices(b.column("text")):
                t, v, _ = _read(data, at, lexicon, near, stems)
                words += len(t.hashes)
                v = v[v.any(1)].astype(np.float32)
                total += (v.T @ v).astype(np.int64)
        flat = np.append(total.ravel(), [n, words])
        cell = np.flatnonzero(flat)
        c.trim()
        yield pa.record_batch([pa.array(cell), pa.array(flat[cell])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each two voters
    flat = np.zeros(m * m + 2)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-2]), int(flat[-1]), flat[:-2].reshape(m, m)


def label_model(n: int, together: np.ndarray, prior: float = PRIOR, right: np.ndarray | float = TRUST, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of firing in the positive and the negative class, and which
    voters are correlated.  A voter that never fires has equal rates."""
    m = len(together)
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    live = (mean > 0) & (mean < 1)
    noise = np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean)) / max(n, 1)) + 1e-12
    s = np.sqrt(prior * (1 - prior))
    believed = mean * (right / prior - (1 - right) / (1 - prior)) * s  # u of a voter that is ``right`` in such a share of its cases
    by_chance = max(n, 1) * np.outer(mean, mean)  # how often two independent voters would fire together
    pair = np.outer(live, live) & ~np.eye(m, dtype=bool)
    sure = pair & (cov > 4 * noise)
    use = sure | pair & (by_chance >= 5) & (together >= by_chance / 2)
    u = np.where(live, believed, 0)
    for i in np.flatnonzero(live):  # of every three voters each product of two is known; a median bears tied pairs
        j, k = np.nonzero(np.triu(sure & sure[i][:, None] & sure[i][None, :]))
        if len(j):
            u[i] = np.sqrt(np.median(cov[i, j] * cov[i, k] / cov[j, k]))
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    off = np.abs(cov - np.outer(u, u))
    tied = sure & (off > 8 * noise) & (off > 0.15 * np.outer(sd, sd))
    weight = np.where(use & ~tied, noise**-2.0, 0)
    most = mean / prior * s  # u of a voter that is never wrong
    trust = np.where(live, 1 / np.maximum(0.5 * believed, 1e-12) ** 2, 1)  # the prior's weight, which few counts outweigh
    for _ in range(rounds):  # least squares on the pairs that are left, voter by voter
        for i in np.flatnonzero(live):
            u[i] = np.clip((weight[i] @ (cov[i] * u) + trust[i] * believed[i]) / (weight[i] @ u**2 + trust[i]), 0, most[i])
    p1 = np.clip(mean + u * (1 - prior) / s, 1e-6, 1 - 1e-6)
    p0 = np.clip(mean - u * prior / s, 1e-6, 1 - 1e-6)
    p0 = np.maximum(p0, 0.005 * mean)  # no voter is taken for faultless
    return np.where(live, p1, 0.5), np.where(live, p0, 0.5), tied


def posterior(votes: np.ndarray, p1: np.ndarray, p0: np.ndarray, tied: np.ndarray, prior: float) -> np.ndarray:
    """Probability of the positive class; voters that don't fire abstain."""
    share = votes / (1 + votes @ tied)
    return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + share @ np.log(p1 / p0), -30, 30)))


def _tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k, n + 1))


def find_stems(rows: DataFrame, prior: float, chance: float = 0.01, purity: float = 0.9) -> Stems:
    """Word beginnings of labelled documents (text, toxic) that tell a toxic
    one; ``purity``: least share of toxic ones among the documents that have
    it; ``chance``: expected number of beginnings that get in by chance.  One
    that goes on where another stops adds no document, and is left out."""
    groups = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.asarray(b.column("toxic")).astype(np.int64)
            hs, ys = [], []
            for i, _, data, at in c.slices(b.column("text")):
                t = c.tokens(data, at, c.folded())
                of = t.text_of()
                for size in SIZES:
                    h = _beginnings(data, t, size)
                    order = np.lexsort((h, of))
                    o, h = of[order], h[order]
                    new = h != 0
                    new[1:] &= (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                    hs.append(h[new])
                    ys.append(toxic[i + o[new]])
            if not hs:
                continue
            h, at_ = np.unique(np.concatenate(hs), return_inverse=True)
            n1, n = np.bincount(at_, np.concatenate(ys)).astype(np.int32), np.bincount(at_).astype(np.int32)
            yield c.packed_batch([(p, len(x[0]), c.pack(*x)) for p, x in c.by_part((c.mix(h) % c.U(groups)).astype(np.int64), h, n1, n)])
        c.trim()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n1, n = c.unpack_all(pdf["blob"], pdf["n"], c.U, np.int32, np.int32)
        h, at = np.unique(h, return_inverse=True)
        n1, n = np.bincount(at, n1).astype(int), np.bincount(at, n).astype(int)
        keep = (n1 >= 4) & (n1 >= purity * n)
        out = pd.DataFrame({"h": h[keep].view(np.int64), "n1": n1[keep], "n": n[keep]})
        return pd.concat([out, pd.DataFrame({"h": [0], "n1": [0], "n": [int((n >= 4).sum())]})])

    found = rows.select("text", "toxic").mapInArrow(count, c.PACKED).groupBy("part").applyInPandas(choose, "h long, n1 int, n int").collect()  # of a bounded sample
    tested = max(1, sum(r["n"] for r in found if not r["h"]))
    size_of = lambda h: (h.bit_length() + 7) // 8
    good = [r for r in found if r["h"] and _tail(r["n1"], r["n"], prior) * tested < chance]
    chosen: list[int] = []
    for h in sorted((r["h"] & (2**64 - 1) for r in good), key=lambda h: (size_of(h), h)):
        if not any(h & ((1 << 8 * size_of(x)) - 1) == x for x in chosen):
            chosen.append(h)
    by_size = {k: np.array(sorted(h for h in chosen if size_of(h) == k), c.U) for k in SIZES}
    voter = {h: len(FIXED) + k for k, h in enumerate(sorted(chosen))}
    return Stems({k: (v, np.array([voter[int(h)] for h in v])) for k, v in by_size.items() if len(v)}, len(chosen))


def _bag(t: c.Tokens, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and count of every word outside the lexicon, a word once a
    text; scale of each text, by which its counts have norm 1."""
    key = np.unique(t.text_of()[~hit] * SLOTS + (t.hashes[~hit] % c.U(SLOTS)).astype(np.int64), return_counts=True)
    of, many = key[0] // SLOTS, np.sqrt(key[1])
    return of, key[0] % SLOTS, many, 1 / np.sqrt(np.maximum(np.bincount(of, many**2, len(t.first) - 1), 1))


def train(votes: np.ndarray, first: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, penalty: float = 2.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic weights of voters and word slots by accelerated gradient."""
    n, m = votes.shape
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    w, b = np.zeros(m + SLOTS, np.float32), 0.0
    near, near_b, t = w.copy(), b, 1.0
    mean_sq = votes.sum(1).mean() + np.bincount(row, value**2, n).mean() + 1
    rate = np.float32(4.0 / mean_sq)
    for _ in range(steps):
        z = votes @ near[:m] + np.bincount(row, value * near[m:][slot], n) + near_b
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(n, 1)).astype(np.float32)
        grad = np.concatenate([votes.T @ err, np.bincount(slot, value * err[row], SLOTS)]).astype(np.float32)
        grad[m:] += np.float32(penalty / max(n, 1)) * near[m:]
        grad[:m] += np.float32(0.01 / max(n, 1)) * near[:m]
        w_new, b_new = near - rate * grad, near_b - float(rate) * float(err.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        near, near_b = w_new + np.float32((t - 1) / t_new) * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w[:m].astype(float), w[m:].astype(float), b


def calibrate(z: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve from scores to labels (Newton)."""
    if len(z) < 50 or label.min() == label.max():
        return 1.0, 0.0
    x = np.stack([z, np.ones(len(z))], 1)
    start = np.array([1.0, 0.0])
    loss = lambda b: np.logaddexp(0, x @ b).sum() - label @ (x @ b) + 0.5 * ((b - start) ** 2).sum()
    beta = start
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - label) + beta - start)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta - step
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3: rows of remainder 1 are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(3))


def _features(few: DataFrame, stems: Stems) -> pa.Table:
    """Of documents (row, text, toxic): votes, and words as slots and weights."""
    near = _hash_words(ADDRESS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon()
        for b in batches:
            bits, slots, weights = [], [], []
            for _, _, data, at in c.slices(b.column("text")):
                t, v, hit = _read(data, at, lexicon, near, stems)
                text, slot, many, scale = _bag(t, hit)
                cuts = np.searchsorted(text, np.arange(len(at)))
                bits += [x.tobytes() for x in np.packbits(v, axis=1)]
                slots += [slot[s:e].astype(np.int32).tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                weights += [(many[s:e] * scale[k]).astype(np.float32).tobytes() for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.record_batch([b.column("row"), b.column("toxic"), *(pa.array(x, pa.binary()) for x in (bits, slots, weights))], names=["row", "toxic", "bits", "slots", "weights"])
        c.trim()

    return few.select("row", "toxic", "text").mapInArrow(features, "row long, toxic int, bits binary, slots binary, weights binary").toArrow().sort_by("row")


def _raw(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The bytes of a binary column, one after another."""
    one = column.combine_chunks()
    at = np.frombuffer(one.buffers()[1], np.int32)[one.offset : one.offset + len(one) + 1]
    return np.frombuffer(one.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind) if len(one) and at[-1] > at[0] else np.zeros(0, kind)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """The model of identified documents (see common) and labels (doc_id, toxic)."""
    learn = F.coalesce(fold("key") != 1, F.lit(False)) & F.col("key").isNotNull()
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).where(learn).groupBy("key").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("s")).first()
    spread = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 20))  # rows of one id are drawn each by its own text, copies once
    n = docs.count()
    bound = lambda of: int(min(1.0, sample / max(1, of)) * (1 << 20))
    few = docs.where(F.col("id").isNotNull() & learn & (spread < max(bound(n), bound(rate["n"] or n)))).dropDuplicates(["key", "tie"])
    few = c.cut(few.join(known, "key", "left").select(spread.alias("spread"), "toxic", "text", F.xxhash64("key", "tie").alias("row")), "sample")
    stems = NO_STEMS
    if rate["n"]:
        drawn = F.col("toxic").isNotNull() & (F.col("spread") < bound(rate["n"]))
        over = few.where(drawn).count() / (2 * sample)  # above 1 where some labelled ids have very many texts
        labelled = few.where(drawn & (F.col("spread") < int(bound(rate["n"]) / max(1.0, over))))
        near = _hash_words(ADDRESS)

        def quiet(texts: pa.Array) -> np.ndarray:
            lexicon = _lexicon()
            return np.concatenate([np.zeros(0, bool), *(~_read(data, at, lexicon, near, NO_STEMS)[1].any(1) for _, _, data, at in c.slices(texts))])

        stems = find_stems(_once(c.filtered(labelled, "text", quiet)), float(np.clip(rate["s"] / rate["n"], 0.005, 0.5)))
    n, words, together = _together(docs, stems)
    right = np.full(stems.voters, TRUST)
    right[[FIXED.index(x) for x in ("shouting", "exclaiming", "masked")]] = DOUBT
    p1, p0, tied = label_model(n, together, right=right)
    share = min(1.0, sample / max(1, n), WORDS_HELD / max(1, words))
    rows = _features(few.where(F.col("spread") < int(share * (1 << 20))), stems)  # about ``sample`` rows, and WORDS_HELD words
    m = stems.voters
    if not rows.num_rows:
        return Model(np.zeros(m), np.zeros(SLOTS), float(np.log(PRIOR / (1 - PRIOR))), 1.0, 0.0, stems)
    v = np.unpackbits(_raw(rows["bits"], np.uint8).reshape(rows.num_rows, -1), axis=1, count=m).astype(np.float32)
    many = np.array([len(x) for x in rows["slots"].to_pylist()]) // 4
    first, slot, value = np.append(0, np.cumsum(many)), _raw(rows["slots"], np.int32), _raw(rows["weights"], np.float32)
    label = np.array([-1 if x is None else x for x in rows["toxic"].to_pylist()])
    del rows
    pa.default_memory_pool().release_unused()  # the driver goes on with other work
    wv, ww, bias = train(v, first, slot, value, posterior(v, p1, p0, tied, PRIOR))
    z = v @ wv + np.bincount(np.repeat(np.arange(len(v)), many), value * ww[slot], len(v)) + bias
    return Model(wv, ww, bias, *calibrate(z[label >= 0], label[label >= 0].astype(float)), stems)


def _scores(texts: pa.Array, m: Model, near: np.ndarray) -> np.ndarray:
    lexicon, out = _lexicon(), [np.zeros(0)]
    for _, _, data, at in c.slices(texts):
        t, v, hit = _read(data, at, lexicon, near, m.stems)
        text, slot, many, scale = _bag(t, hit)
        z = v @ m.votes + np.bincount(text, many * m.words[slot], len(at) - 1) * scale + m.bias
        out.append(1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30))))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(key, score) of documents (key, text)."""
    held, near = docs.sparkSession.sparkContext.broadcast(model), _hash_words(ADDRESS)  # SLOTS numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("key"), pa.array(_scores(b.column("text"), held.value, near))], names=["key", "score"])

    return docs.mapInArrow(rate, "key long, score double")


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``df``."""
    docs = c.identified(df, doc_id, text)
    out = score(docs.select(F.col("id").alias("key"), "text"), fit(docs, labels, sample))
    return out.select(F.col("key").alias("doc_id"), F.coalesce(fold("key") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, least: float = 0.7) -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, as they are: each task
    scores and filters its rows, and nothing is shuffled for it."""
    held, near = df.sparkSession.sparkContext.broadcast(fit(c.identified(df, doc_id, text), labels, sample)), _hash_words(ADDRESS)
    return c.filtered(df, text, lambda texts: _scores(texts, held.value, near) < least)
