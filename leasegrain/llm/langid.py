"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier over hashed byte n-grams
predicts each bit. Decoding weighs each bit's loss by how well its classifier
did on rows kept out of its fit, and takes the language with the least loss.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrain.llm.common import give_back, map_arrow, seeded, slices

#: At most so many labelled rows of each language are fitted on, by seeded order.
ROWS_PER_LANGUAGE = 600
DIMENSIONS, EPOCHS, RATE, DECAY = 1 << 16, 10, 0.5, 1e-6
#: A language whose loss is within this of the next one's is flagged as ambiguous.
MARGIN = 0.05
UNKNOWN = "und"
JUDGED = ("lang_pred", "score", "ambiguous")
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 18


def grams(text: str) -> np.ndarray:
    """Hashed places of all byte 1- to 4-grams of the text, ASCII letters lowered."""
    b = np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, b)
    b = np.where((b >= 9) & (b <= 13), 32, b)
    out, key = [b], b
    for n in (2, 3, 4):
        key = key[:-1] * np.uint32(257) + b[n - 1 :]
        out.append((key * np.uint32(2654435761) >> np.uint32(16)) ^ np.uint32(n * 7919 & 0xFFFF))
    return np.concatenate(out) & np.uint32(DIMENSIONS - 1)


def codewords(languages: list[str], seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 per language: all splits for few languages, else seeded columns far apart."""
    k = len(languages)
    if k <= 6:
        masks = [m for m in range(1, 1 << (k - 1))]
        return np.array([[1 if m >> i & 1 else -1 for m in masks] for i in range(k)], np.int8).reshape(k, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        code = np.where(rng.random((k, bits)) < 0.5, 1, -1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def margins(self, text: str) -> np.ndarray:
        places, total = grams(text), np.zeros(len(self.bias), np.float64)
        for k in range(0, len(places), CHUNK):
            total += self.weights[places[k : k + CHUNK]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(places)) * SCALE + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score in [0, 1] and whether the next language is nearly as good."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.log1p(np.exp(-np.clip(self.code * margins, -30, 30))) @ self.trust
        order = np.argsort(loss, kind="stable")
        chance = np.exp(loss.min() - loss)
        score = float(chance[order[0]] / chance.sum())
        return self.languages[order[0]], score, bool(loss[order[1]] - loss[order[0]] < MARGIN)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(text))


#: Margins are means over n-grams; this brings them to the range of a log-odds.
SCALE = 400.0


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Model:
    """A model from ``(text, language)`` rows; a fifth is kept out to weigh the bits."""
    languages = sorted({lang for _, lang in rows})
    code = codewords(languages) if len(languages) > 1 else np.ones((len(languages), 1), np.int8)
    bits = code.shape[1]
    weights, bias, trust = np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits), np.ones(bits) / max(1, bits)
    if len(languages) < 2:
        return Model(languages, code, weights, bias, trust)
    place = {lang: k for k, lang in enumerate(languages)}
    data = []
    for text, lang in rows:
        where, n = np.unique(grams(text), return_counts=True)
        data.append((where, (n / n.sum() * SCALE).astype(np.float32), code[place[lang]].astype(np.float64)))
    kept = [k for k in range(len(rows)) if k % 5 != 0]
    rng, grown = np.random.default_rng(seed), np.zeros((DIMENSIONS, bits), np.float32)
    for _ in range(EPOCHS):
        for k in rng.permutation(kept):
            where, x, y = data[k]
            out = x @ weights[where] + bias
            pull = y / (1 + np.exp(np.clip(y * out, -30, 30)))
            step = np.outer(x, pull).astype(np.float32) - DECAY * weights[where]
            grown[where] += step * step
            weights[where] += RATE * step / np.sqrt(grown[where] + 1e-6)
            bias += 0.01 * pull
    model = Model(languages, code, weights, bias, trust)
    right = np.zeros(bits)
    held = [k for k in range(len(rows)) if k % 5 == 0]
    for k in held:
        where, x, y = data[k]
        right += (x @ weights[where] + bias) * y > 0
    rate = np.clip((right + 1) / (len(held) + 2), 0.501, 0.9999)
    model.trust = np.log(rate / (1 - rate))
    model.trust /= model.trust.sum()
    del data, grown
    give_back()
    return model


def fold(column: str = "doc_id", parts: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def sample(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, seed: int = 17) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, the first by a seeded hash of the id; texts come to the driver.

    The hash threshold is set from exact counts, so only about the wanted rows are
    ordered and no language meets in one task.
    """
    labelled = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    drawn = labelled.withColumn("_hash", seeded(seed, F.col("doc_id")))
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * per_language / n) * (1 << 52))]) if counts else None
    if limits is None:
        return []
    near = drawn.where(F.col("_hash") <= limits[F.col("lang")]).select("lang", "_hash", "text").orderBy("lang", "_hash", "text")
    out, taken = [], {}
    for r in near.limit(int(2 * per_language * len(counts) + 1000)).toLocalIterator():
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            out.append((r["text"], r["lang"]))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred, score, ambiguous``.

    Null texts and texts without a letter get ``und``, score 0; whole texts are
    read in chunks. An empty table gives no rows; other columns are carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    from pyspark.sql.types import StructType, _parse_datatype_string

    clear = docs.drop("lang_pred", "score", "ambiguous")
    return map_arrow(clear, run, StructType([*clear.schema.fields, *_parse_datatype_string(fields).fields]))


def identify(docs: DataFrame, held_out: int = 2) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with ``held_out, lang_pred, score, ambiguous``; fitted on the rows of the other folds."""
    part = docs.withColumn("held_out", fold() == held_out)
    model = fit(sample(part.where("not held_out").select("doc_id", "text", "lang")))
    return predict(part, model)


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` whose language is recognised: a codeword is nearest, and by a clear margin.

    Null texts, texts without a letter and ambiguous ones go. Where no labelled
    row gives a model, only null texts and those without a letter go. Rows,
    repeated ones too, are judged one by one; an empty table gives an empty table;
    columns named like a judgement keep their own values.
    """
    part = docs.withColumn("held_out", fold() == 2)
    model = fit(sample(part.where("not held_out").select("doc_id", "text", "lang")))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    clash = [c for c in docs.columns if c in JUDGED]
    own = docs.withColumn("_own", F.struct(*clash)).drop(*clash) if clash else docs
    found = predict(own, model).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return found.select(*[F.col(f"_own.`{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])
