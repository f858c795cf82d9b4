"""Toxicity by weak supervision.

Many voters (lexicons written by hand, lexicons induced from the labelled rows,
and patterns) look at a bounded sample. A generative model estimates how often
each votes on toxic and on clean texts and how voters depend on each other, and
gives every sampled text a posterior label. A linear classifier over hashed words
and word stems learns those posteriors and scores every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import erfc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from leasegrain.llm.common import map_arrow, seeded, slices
from leasegrain.llm.langid import fold

#: At most so many labelled rows of each class are looked at, by seeded order.
ROWS_PER_CLASS = 4000
DIMENSIONS_BITS = 20
#: Prefix lengths (bytes) that stand for stems, beside whole words.
STEMS = (4, 5, 6)
#: A feature counts if at least SUPPORT sampled texts hold it and it tells the classes apart; of those that
#: are taken to, at most the share FALSE is expected to be chance. So rare kinds of abuse count like common ones.
SUPPORT, FALSE, INDUCED_VOTERS, EM_ROUNDS, FIT_ROUNDS = 8, 1e-4, 12, 30, 300
#: A word joins an induced lexicon if it is so much (log) likelier in toxic texts.
ODDS = 3.0
#: How often a human label says toxic of a clean and of a toxic text.
ANNOTATOR = (0.005, 0.98)
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15

#: Words of abuse by language and kind; each line is one voter.
LEXICONS = {
    "insult-mind": "idiot idiots idiotic moron morons moronic stupid imbecile dumb dumbass fool brainless halfwit dimwit simpleton retard",
    "insult-worth": "loser losers worthless pathetic useless trash garbage scum filth vermin lowlife clown coward wretch",
    "insult-disgust": "disgusting gross repulsive vile nasty sickening hideous revolting",
    "profanity": "damn crap hell bastard bastards bitch bitches asshole arse ass shit bullshit fuck fucking fucker",
    "threat": "kill die hang shoot stab burn destroy hurt suffer beat",
    "hate": "hate hated hateful despise loathe subhuman degenerate parasite parasites",
    "de": "idiot idioten dumm dummkopf trottel depp arschloch scheisse scheiße abschaum versager wertlos erbärmlich ekelhaft müll",
    "fr": "idiot idiote imbécile crétin stupide connard connasse merde ordure minable pathétique dégoûtant inutile raclure",
    "es": "idiota idiotas imbécil estúpido estúpida tonto basura mierda cabrón escoria inútil patético asqueroso perdedor payaso",
}
#: Voters by pattern over the whole text.
PATTERNS = {
    "you-are-a": r"(?i)\byou(?:'re| are) (?:an?|the|so|such) ",
    "shut-up": r"(?i)\b(?:shut up|get lost|go away|drop dead)\b",
    "shouting": r"(?:\b[A-Z]{4,}\b[^a-z]{1,3}){3}",
    "marks": r"[!?]{3,}",
    "masked": r"\b\w+[*#@$]{2,}\w*\b",
}

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def places(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((keys ^ (keys >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - DIMENSIONS_BITS)).astype(np.int64)


def _chunk(b: np.ndarray) -> np.ndarray:
    letter = np.concatenate([[False], _LETTER[b], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int64)
    up, down = powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    found = [places((total[ends] - total[starts]) * down[starts])]
    for k in STEMS:
        s = starts[ends - starts > k]
        found.append(places(((total[s + k] - total[s]) * down[s]) ^ np.uint64(0xABCD0000 + k)))
    return np.unique(np.concatenate(found))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed places of the words (letters, any non-ASCII byte counts as one) and stems of a text."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if len(data) <= CHUNK:
        return _chunk(np.frombuffer(data, np.uint8))
    found, at = [], 0
    while at < len(data):
        stop = data.find(b" ", at + CHUNK)
        stop = len(data) if stop < 0 else stop
        found.append(_chunk(np.frombuffer(data, np.uint8, stop - at, at)))
        at = stop
    return np.unique(np.concatenate(found))


def telling(rows: list[np.ndarray], weight: np.ndarray, support: int, false: float = FALSE) -> tuple[np.ndarray, np.ndarray]:
    """Features and their log-odds, of those that ``weight`` (chance of being toxic per row) tells apart.

    The bound follows the step-up rule for false discoveries: the ``k`` surest of
    ``n`` features count, for the largest ``k`` whose last one would be so sure by
    chance at most ``false * k / n`` of the time.
    """
    size = 1 << DIMENSIONS_BITS
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    bad = np.bincount(flat, np.repeat(weight, [len(r) for r in rows]), minlength=size)
    all_ = np.bincount(flat, minlength=size)
    good, n_bad, n_good = all_ - bad, weight.sum() + 1, (1 - weight).sum() + 1
    odds = np.log((bad + 0.5) / n_bad) - np.log((good + 0.5) / n_good)
    rate = np.maximum(all_ / (n_bad + n_good), 1e-12)
    sure = np.abs(bad / n_bad - good / n_good) / np.sqrt(rate * (1 / n_bad + 1 / n_good))
    tested = np.flatnonzero(all_ >= support)
    tested = tested[np.argsort(-sure[tested], kind="stable")]
    chance = np.array([erfc(x / 2**0.5) for x in sure[tested]])
    passed = np.flatnonzero(chance <= false * np.arange(1, len(tested) + 1) / max(1, len(tested)))
    chosen = np.sort(tested[: passed[-1] + 1]) if len(passed) else tested[:0]
    return chosen, odds[chosen]


def votes(texts: list[str], rows: list[np.ndarray], induced: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """Matrix of 0 and 1: which voter speaks up for which text."""
    names, columns = [], []
    lexicons = {k: np.array([place_of(w) for w in words.split()]) for k, words in LEXICONS.items()}
    for name, words in [*lexicons.items(), *((f"induced-{k}", w) for k, w in enumerate(induced))]:
        mark = np.zeros(1 << DIMENSIONS_BITS, bool)
        mark[words.astype(np.int64)] = True
        names.append(name)
        columns.append([bool(mark[r].any()) for r in rows])
    for name, pattern in PATTERNS.items():
        seen = re.compile(pattern)
        names.append(name)
        columns.append([bool(seen.search(t)) for t in texts])
    return np.array(columns, float).T.reshape(len(texts), len(names)), names


def place_of(word: str) -> int:
    """The place of a whole word."""
    b = np.frombuffer(word.encode(), np.uint8)
    up, _ = powers(len(b) + 1)
    return places(np.array([((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)]).sum(dtype=np.uint64)]))[0]


def label_model(seen: np.ndarray, prior: float, annotated: np.ndarray | None = None, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior chance of toxic per row, and the estimated rates and discounts of the voters.

    EM for the rates at which voters speak up on either class; a voter that does
    not speak up abstains, and a text without any vote is clean as far as the prior
    says. Votes that go together within a class beyond chance are not independent
    evidence: where voters speak up together, each one's weight is divided by one
    plus its positive residual correlations with the others. ``annotated`` is a
    voter that never abstains, the human label of each row, with the fixed rates
    ``ANNOTATOR``: it anchors the classes, so that EM can't swap or stretch them.
    """
    n, k = seen.shape
    post = np.where(seen.sum(axis=1) > 0, 0.9, 0.02) if annotated is None else np.where(annotated > 0.5, 0.95, 0.02)
    corr = np.zeros((k, k))
    hit = np.full((2, k), 0.5)
    for _ in range(rounds):
        for y, w in ((0, 1 - post), (1, post)):
            hit[y] = np.clip((w @ seen + 0.5) / (w.sum() + 2), 1e-3, 1 - 1e-3)
        # a voter may be useless, but does not speak for the clean class by speaking up
        hit[1] = np.maximum(hit[1], hit[0])
        left = seen - (np.outer(post, hit[1]) + np.outer(1 - post, hit[0]))
        cov = left.T @ left / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.maximum(cov / np.outer(sd, sd), 0)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        llr = (seen / (1 + seen @ corr)) @ np.log(hit[1] / hit[0])
        silent = np.log1p(-hit[1]).sum() / (1 + corr.sum() / k) - np.log1p(-hit[0]).sum() / (1 + corr.sum() / k)
        llr = np.where(seen.sum(axis=1) > 0, llr, silent)
        if annotated is not None:
            right = ANNOTATOR
            llr = llr + np.where(annotated > 0.5, np.log(right[1] / right[0]), np.log((1 - right[1]) / (1 - right[0])))
        post = 1 / (1 + np.exp(-np.clip(llr + np.log(prior / (1 - prior)), -30, 30)))
    return post, {"rates": hit, "correlations": corr}


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        x = self.bias + float(self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def fit(rows: list[tuple[str | None, int]], prior: float) -> tuple[Classifier, dict]:
    """A classifier from ``(text, toxic)`` rows drawn by class; ``prior`` is the rate of toxic among all labelled rows."""
    size = 1 << DIMENSIONS_BITS
    if len({y for _, y in rows}) < 2:
        return Classifier(np.zeros(size, np.float32), float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))), {}
    texts = [t or "" for t, _ in rows]
    label = np.array([y for _, y in rows], float)
    found = [features(t) for t in texts]
    words, odds = telling(found, label, SUPPORT)
    words = words[odds > ODDS]
    induced = [words[words % INDUCED_VOTERS == k] for k in range(INDUCED_VOTERS)]
    seen, names = votes(texts, found, induced)
    drawn = float(label.mean())
    post, told = label_model(seen, drawn, label)
    chosen, odds = telling(found, post, SUPPORT)
    chosen = chosen[odds > ODDS / 2]
    weights, bias = np.zeros(size), 0.0
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    inner = [p[p >= 0] for p in (place[r] for r in found)]
    w, grown, bias_grown = np.zeros(len(chosen)), np.full(len(chosen), 1e-3), 1e-3
    flat, owner = np.concatenate(inner), np.repeat(np.arange(len(inner)), [len(r) for r in inner])
    for _ in range(FIT_ROUNDS):
        out = np.bincount(owner, w[flat], minlength=len(inner)) + bias
        pull = (post - 1 / (1 + np.exp(-np.clip(out, -30, 30)))) / len(inner)
        step = np.bincount(flat, pull[owner], minlength=len(chosen)) - 1e-4 * w
        grown += step * step
        bias_grown += pull.sum() ** 2
        w = np.maximum(w + 0.3 * step / np.sqrt(grown), 0)
        bias += 0.3 * pull.sum() / np.sqrt(bias_grown)
    weights[chosen] = w
    margin = np.bincount(owner, w[flat], minlength=len(inner)) + bias
    scale, shift = calibrate(margin, label, prior)
    told |= {"voters": names, "posterior": post, "label": label, "n_features": len(chosen)}
    return Classifier((weights * scale).astype(np.float32), bias * scale + shift), told


def calibrate(margin: np.ndarray, label: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift that make the margin a log-odds of the label, at the rate ``prior`` of toxic rows."""
    weight = np.where(label > 0.5, prior / max(label.mean(), 1e-9), (1 - prior) / max(1 - label.mean(), 1e-9))
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton, damped
        p = 1 / (1 + np.exp(-np.clip(scale * margin + shift, -30, 30)))
        g, h = weight * (label - p), weight * np.maximum(p * (1 - p), 1e-6)
        a, b, c = (h * margin * margin).sum() + 1, (h * margin).sum(), h.sum() + 1e-3
        u, v = (g * margin).sum(), g.sum()
        det = a * c - b * b
        scale, shift = scale + 0.5 * (c * u - b * v) / det, shift + 0.5 * (a * v - b * u) / det
        scale = min(max(scale, 0.05), 20.0)
    return float(scale), float(shift)


def sample(docs: DataFrame, known: DataFrame, per_class: int = ROWS_PER_CLASS) -> tuple[list[tuple[str, int]], float]:
    """The sample's texts; ids are drawn from the labels first, so that only their texts are moved."""
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], 0.0
    limit = F.lit(0.0)
    for y, n in counts.items():
        limit = F.when(F.col("toxic") == y, min(1.0, per_class / n) * (1 << 52)).otherwise(limit)
    drawn = known.where(F.col("_hash") <= limit).select("doc_id", "toxic")
    # at most about per_class rows of each class: a bounded list of ids
    texts = docs.join(F.broadcast(drawn), "doc_id").select("text", "toxic", seeded(23, F.col("doc_id")).alias("h")).orderBy("h", "toxic", "text")
    got = [(r["text"], int(r["toxic"])) for r in texts.limit(3 * per_class).toLocalIterator()]
    return got, counts.get(1, 0) / total


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; null and empty texts get the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    clear = docs.drop("score", "predicted")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            scores = np.array([shared.value.score(t) for t in batch.column("text").to_pylist()])
            columns = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "predicted"])

    fields = _parse_datatype_string("score double, predicted int").fields
    return map_arrow(clear, run, StructType([*clear.schema.fields, *fields]))


def judge(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of ``docs(doc_id, text)``, learnt from ``labels(doc_id, toxic)`` outside the held-out fold.

    Rows without a label (or with a null one) are scored like others; repeated ids
    are scored per row, a label that repeats counts once per pair of rows; an empty
    table gives no rows. Without labels of both classes every text gets the rate of
    toxic among them (0 without any).
    """
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part = clean.withColumn("held_out", fold("doc_id", 5) == held_out)
    known = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold("doc_id", 5) != held_out).withColumn("_hash", seeded(23, F.col("doc_id")))
    rows, prior = sample(clean, known)
    classifier, _ = fit(rows, prior)
    return score(part, classifier).select("doc_id", "held_out", "score", "predicted")
