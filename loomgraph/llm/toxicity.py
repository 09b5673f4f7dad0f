"""Toxic spans by a linear-chain conditional random field.

Fitting, on a bounded sample of labelled documents (see ``fitted``), in one task: the tables label documents, not tokens, so
words and word beginnings that occur in many toxic and in hardly any clean documents label the tokens of toxic documents.
A two-label chain is fitted to these tokens by gradient ascent on its likelihood, with exact marginals of tokens and
of pairs. Its features are the word, its beginnings and end, and the words before and after; for some of the labelled tokens
those that gave the label are hidden, so that the others must tell. A logistic curve turns a document's expected number of
toxic tokens, of those that are at all likely, into a score.

Scoring, of every whole text: forward-backward marginals of each token give spans and the score. Chains of a group of
documents advance together, one step of all at a time.

Defined cases: null or empty text: no tokens, the curve's score at 0. Null id: not held out. No labelled rows of both kinds:
every score is 0. Repeated rows are scored alike. Empty table: no rows. Long texts: whole, in time and memory of their
length. Extra columns: kept only where asked for; asked-for columns named score or spans give way to the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small, table, trim, written
from .words import ALNUM, Table, Words, groups, mix, ngram_hash, span_hash

#: Lengths of word beginnings, in bytes; 0 stands for the whole word. These may label tokens.
PARTS = (0, 4, 5, 6)
#: Bytes of a word's end; tokens of a marginal from LIKELY on count for a document; one in HIDDEN labelled tokens has its label's features hidden.
END, LIKELY, HIDDEN = 3, 0.1, 8
_NONE = np.empty(0)


def _features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, hashes) of each kind of feature that may label a token."""
    for k, n in enumerate(PARTS):
        salt = np.uint64(k + 1)
        if not n:
            yield np.arange(len(w.hash)), mix(w.hash + salt)
        else:
            long = np.flatnonzero(w.end - w.start > n)
            yield long, mix(span_hash(w.symbols, w.start[long], w.start[long] + n) + salt)


def _context(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, hashes) of the word's end, and of the words before and after it in its text."""
    long = np.flatnonzero(w.end - w.start > END)
    yield long, mix(span_hash(w.symbols, w.end[long] - END, w.end[long]) + np.uint64(11))
    inner = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    yield inner + 1, mix(w.hash[inner] + np.uint64(12))
    yield inner, mix(w.hash[inner + 1] + np.uint64(13))


def _messages(u: np.ndarray, first: np.ndarray, step: np.ndarray, over: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of label 1 to 0 of each token: by its own features (``over``: written over ``u``), by what stands up to it, and after it.

    Messages are odds, so nothing under- or overflows; chains are taken longest first, so those still running are a prefix.
    """
    e = np.exp(step)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than t
    odds = np.clip(u, -50, 50, out=u if over else None)
    np.exp(odds, out=odds)
    ahead, back = np.ones(len(u)), np.ones(len(u))
    r = None
    for t, n in enumerate(running.tolist()):
        at = start[:n] + t
        r = odds[at] if r is None else odds[at] * (e[0, 1] + e[1, 1] * r[:n]) / (e[0, 0] + e[1, 0] * r[:n])
        ahead[at] = r
    last = len(running) - 1
    b = np.ones(0)
    for t in range(last, 0, -1):
        n = int(running[t])
        at = start[:n] + t
        b = np.concatenate([b, np.ones(n - len(b))])
        x = odds[at] * b
        b = (e[1, 0] + e[1, 1] * x) / (e[0, 0] + e[0, 1] * x)
        back[at - 1] = b
    return odds, ahead, back


def marginals(u: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(toxic) of each token. ``u``: log odds by the features; chain c is ``u[first[c]:first[c + 1]]``; ``step[i, j]``: log weight of j after i."""
    _, ahead, back = _messages(u, first, step)
    both = ahead * back
    return both / (1 + both)


def _inner(first: np.ndarray) -> np.ndarray:
    """The tokens with one before them in their chain."""
    inner = np.ones(first[-1], bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    return np.flatnonzero(inner)


def pair_marginals(u: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and P(i, j) of each two neighbours' labels, as (pairs, 2, 2)."""
    odds, ahead, back = _messages(u, first, step)
    here = _inner(first)
    r, x = ahead[here - 1], odds[here] * back[here]
    pairs = np.stack([np.ones(len(here)), x, r, r * x], axis=1).reshape(-1, 2, 2) * np.exp(step)
    both = ahead * back
    return both / (1 + both), pairs / pairs.sum(axis=(1, 2), keepdims=True)


class Model:
    """Features (hash to place), their weights, bias, transitions and the curve."""

    def __init__(self, hashes: np.ndarray):
        self.table = Table(max(1, len(hashes)))
        self.table.add(hashes, np.arange(len(hashes), dtype=np.int32))
        self.weights, self.bias, self.step, self.curve = np.full(len(hashes), 12.0), -9.0, np.zeros((2, 2)), (-30.0, 0.0)
        self.plain: dict[int, float] = {}

    def active(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and the features they have."""
        tokens, features = [], []
        for at, h in (*_features(w), *_context(w)):
            k = self.table.find(h)
            tokens.append(at[k >= 0])
            features.append(k[k >= 0])
        return np.concatenate(tokens), np.concatenate(features)

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's score; the tokens of documents with any feature, and their marginals."""
        tokens, features = self.active(w)
        docs, size = len(w.first) - 1, np.diff(w.first)
        hit = np.zeros(docs, bool)
        hit[w.doc[tokens]] = True
        # a chain without features depends on its length alone: one of each length is run, and kept
        fresh = [n for n in np.unique(size[~hit]).tolist() if n not in self.plain]
        at = np.flatnonzero(hit)
        u = np.full(len(w.hash), self.bias)
        np.add.at(u, tokens, self.weights[features])
        own = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in at]) if len(at) else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(np.concatenate([size[at], np.array(fresh, np.int64)]))]).astype(np.int64)
        p = marginals(np.concatenate([u[own], np.full(sum(fresh), self.bias)]), first, self.step) if len(first) > 1 else _NONE
        total = np.concatenate([[0.0], np.cumsum(np.where(p >= LIKELY, p, 0.0))])
        sums = total[first[1:]] - total[first[:-1]]
        self.plain.update(zip(fresh, sums[len(at) :].tolist(), strict=True))
        expected = np.array([self.plain.get(n, 0.0) for n in size.tolist()])
        expected[at] = sums[: len(at)]
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(expected), -60, 60))), own, p[: len(own)]

    def __getstate__(self):
        return self.__dict__ | {"plain": {}}


#: Tokens whose pairs of labels are held at once, and bytes of text whose features are.
PAIRS, PART = 1 << 17, 1 << 21


def _summed(u: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and the sum of all P(i, j) of ``pair_marginals``, of which only a part is held at once. ``u`` is used up."""
    odds, ahead, back = _messages(u, first, step, over=True)
    begins = np.zeros(len(u), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    odds *= back
    total, e = np.zeros(4), np.exp(step).ravel()
    for lo in range(1, len(u), PAIRS):
        inner = np.flatnonzero(~begins[lo : lo + PAIRS]) + lo
        r, x = ahead[inner - 1], odds[inner]
        pairs = np.stack([np.ones(len(inner)), x, r, r * x]) * e[:, None]
        total += (pairs / pairs.sum(axis=0)).sum(axis=1)
    ahead *= back
    ahead /= 1 + ahead
    return ahead, total.reshape(2, 2)


class _Counts:
    """How often each hash stands with and without the label, over parts of the texts: as large as the distinct hashes."""

    def __init__(self):
        self.keys, self.on, self.all = np.empty(0, np.uint64), _NONE, _NONE
        self.labelled = self.seen = 0.0

    def add(self, h: np.ndarray, label: np.ndarray) -> None:
        some, place = np.unique(h, return_inverse=True)
        on, n = np.bincount(place, weights=label, minlength=len(some)), np.bincount(place, minlength=len(some)).astype(float)
        self.keys, place = np.unique(np.concatenate([self.keys, some]), return_inverse=True)
        self.on = np.bincount(place, weights=np.concatenate([self.on, on]), minlength=len(self.keys))
        self.all = np.bincount(place, weights=np.concatenate([self.all, n]), minlength=len(self.keys))
        self.labelled, self.seen = self.labelled + label.sum(), self.seen + len(label)

    def leaning(self, least: int, lift: float = 3.0) -> np.ndarray:
        """The features that stand at ``least`` labelled tokens and ``lift`` times as often there as at others."""
        rate = (self.on / max(1.0, self.labelled)) / ((self.all - self.on + 0.5) / max(1.0, self.seen - self.labelled))
        return self.keys[(self.on >= least) & (rate >= lift)]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, Words]]:
    """The words of the texts, a part of the texts at a time, with the place of the part's first text."""
    for lo, hi in groups(texts, PART):
        yield lo, Words([t.lower() for t in texts[lo:hi]], ALNUM)


def fit(sample: list[tuple[int, bytes]], rounds: int = 40, least: int = 4, lift: float = 20.0) -> Model:
    """Fit on (toxic 0 or 1, text). A feature needs ``least`` toxic documents and ``lift`` times the clean documents' rate.

    Words and features are made for a part of the texts at a time; what is held of all texts is eight numbers a token.
    """
    if len({y for y, _ in sample}) < 2:
        return Model(np.empty(0, np.uint64))
    y = np.array([t for t, _ in sample], bool)
    # near copies of a document must not vouch for its words: one document for each smallest shingle hash
    seen, ok, counts = set(), np.zeros(len(sample), bool), [_Counts() for _ in PARTS]
    for begin, words in _parts([t for _, t in sample]):
        grams = ngram_hash(words.hash, 5)
        for d, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True), begin):
            g = grams[lo : hi - 4] if hi - lo >= 5 else words.hash[lo:hi]
            marks = {int(g.min()), int(mix(g).min())} if len(g) else set()
            ok[d] = bool(marks) and not marks & seen
            seen |= marks
        for kind, (at, h) in zip(counts, _features(words), strict=True):
            d = words.doc[at] + begin
            h, d = h[ok[d]], d[ok[d]]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
            kind.add(h[new], y[d[new]].astype(float))
    found = []
    for kind in counts:
        toxic, clean = kind.on, kind.all - kind.on
        rate = (toxic / max(1, (y & ok).sum())) / ((clean + 0.3) / max(1, (~y & ok).sum()))
        found.append(kind.keys[(toxic >= least) & (rate >= lift)])
    own = np.unique(np.concatenate(found))
    if not len(own):
        return Model(own)
    # the chain is fitted on the toxic documents and as many clean ones
    clean = np.flatnonzero(~y)
    use = np.sort(np.concatenate([np.flatnonzero(y), clean[: max(1, int(y.sum()))]]))
    texts, by_word, marks, sizes, context = [sample[i][1] for i in use], Model(own), [], [], None
    for begin, w in _parts(texts):
        gold = np.zeros(len(w.hash))
        gold[by_word.active(w)[0]] = 1
        gold *= y[use][w.doc + begin]  # no token of a clean document is toxic
        marks.append(gold)
        sizes.append(np.diff(w.first))
        kinds = list(_context(w))
        context = context or [_Counts() for _ in kinds]
        for kind, (at, h) in zip(context, kinds, strict=True):
            kind.add(h, gold[at])
    gold, first = np.concatenate(marks), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    m = Model(np.unique(np.concatenate([own, *(kind.leaning(least) for kind in context)])))
    by_label = np.zeros(len(m.weights), bool)
    by_label[m.table.find(own)] = True
    m.weights[~by_label] = 0.0
    hidden = (gold > 0) & (mix(np.arange(len(gold), dtype=np.uint64)) % np.uint64(HIDDEN) == 0)
    tokens, features = [], []
    for begin, w in _parts(texts):
        at, k = m.active(w)
        at = at + first[begin]
        shown = ~(hidden[at] & by_label[k])
        tokens.append(at[shown])
        features.append(k[shown])
    tokens, features = np.concatenate(tokens), np.concatenate(features)
    here = _inner(first)
    seen_w = np.bincount(features, weights=gold[tokens], minlength=len(m.weights))
    seen_t, power = np.zeros((2, 2)), [np.full(len(m.weights), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    np.add.at(seen_t, (gold[here - 1].astype(int), gold[here].astype(int)), 1)
    labelled, size = gold.sum(), len(gold)
    del here, hidden, gold, marks
    for _ in range(rounds):
        u = np.full(size, m.bias)
        np.add.at(u, tokens, m.weights[features])
        p, pairs = _summed(u, first, m.step)
        slope = [seen_w - np.bincount(features, weights=p[tokens], minlength=len(m.weights)) - 0.01 * m.weights, labelled - p.sum(), seen_t - pairs - 0.01 * m.step]
        power = [s + g * g for s, g in zip(power, slope, strict=True)]
        moves = [0.5 * g / np.sqrt(s) for s, g in zip(power, slope, strict=True)]
        m.weights, m.bias, m.step = m.weights + moves[0], float(np.clip(m.bias + moves[1], -14, 0)), np.clip(m.step + moves[2], -3, 3)
    # the curve, by Newton steps on the documents' expected counts
    m.curve = (0.0, 1.0)
    score = np.empty(len(sample))
    for lo, hi in groups([t for _, t in sample], PART):
        s, _, _ = m.scores(Words([t.lower() for _, t in sample[lo:hi]], ALNUM))
        score[lo:hi] = s
    x = np.stack([np.ones(len(y)), np.log(score / (1 - score))], axis=1)  # log1p(expected)
    c = np.array([-3.0, 4.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([0.5, 0.5])
        c = c + np.clip(np.linalg.solve(h, x.T @ (y - q) - 0.5 * (c - [-3.0, 4.0])), -2, 2)
    m.curve = (float(c[0]), float(c[1]))
    return m


def fitted(documents: DataFrame, labels: DataFrame, toxic: int = 3000, max_bytes: int = 20_000) -> Model:
    """Fit on at most about ``toxic`` documents of each label, of up to ``max_bytes`` bytes, outside the held-out fold.

    The ids are chosen from ``labels`` alone, so that of ``documents`` only the chosen texts are moved: to one task, which
    sends back the model. The sample has up to 2.2 * toxic rows, of 2.2 * toxic * max_bytes bytes.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("label"))
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, toxic / max(1, n.get(1, 0))).otherwise(toxic / max(1, n.get(0, 0))) * 1_000_000
    chosen = written(own.where(F.pmod(F.xxhash64("labelled", F.lit("sample")), F.lit(1_000_000)) < share), "chosen")
    ok = documents.select("doc_id", "text").where((F.octet_length("text") <= max_bytes) & (fold("doc_id", 3) != 1))
    rows = ok.join(small(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "label", "text").limit(2 * toxic * 11 // 10)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(y, t) for b in batches for y, t in zip(b.column("label").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)]
        if sample:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(sample))], pa.binary())})
            sample.clear()
            trim()

    got = rows.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(model, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([])


def scored(documents: DataFrame, model: Model, columns: list[str], least: float | None = None, text: str = "text") -> DataFrame:
    """``columns`` with score and spans (code points); with ``least``, only documents that score below it."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some thousand features, as the sample is bounded
    kinds = {f.name: f.dataType.simpleString() for f in documents.select(*columns).schema.fields if f.name not in ("score", "spans")}
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    # columns go by their places, whatever they are called
    places = [f"c{k}" for k in range(len(kinds))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column("words").cast(pa.binary()).to_pylist()]
            keep = b.select(places)
            for lo, hi in groups(texts):
                w = Words([t.lower() for t in texts[lo:hi]], ALNUM)
                score, own, p = m.scores(w)
                spans: list[list] = [[] for _ in range(hi - lo)]
                tagged = own[p >= 0.5]
                if len(tagged):
                    points = np.cumsum((w.symbols & 0xC0) != 0x80)
                    for run in np.split(tagged, np.flatnonzero((np.diff(tagged) != 1) | (np.diff(w.doc[tagged]) != 0)) + 1):
                        d = int(w.doc[run[0]])
                        base = points[w.at[d] - 1]
                        spans[d].append({"start": int(points[w.start[run[0]]] - base - 1), "end": int(points[w.end[run[-1]] - 1] - base)})
                out = pa.RecordBatch.from_arrays([*keep.slice(lo, hi - lo).columns, pa.array(score), pa.array(spans, spans_type)], names=[*places, "score", "spans"])
                yield out if least is None else out.filter(pa.array(score < least))
        trim()

    d = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kinds, places, strict=True)], F.col(text).cast("string").alias("words"))
    schema = "".join(f"{p} {t}, " for p, t in zip(places, kinds.values(), strict=True))
    out = d.mapInArrow(rows, f"{schema}score double, spans array<struct<start: long, end: long>>")
    return out.withColumnsRenamed(dict(zip(places, kinds, strict=True)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = scored(documents, fitted(documents, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
