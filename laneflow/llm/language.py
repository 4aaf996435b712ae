"""Language ID by error-correcting output codes over character n-grams.

Each language has a codeword.  For every bit a binary classifier tells the
languages with a one from those with a zero: a linear model over hashed n-grams
of bytes whose weights are smoothed log odds, from counts over all labelled
texts.  Decoding compares the bits' margins with every codeword under a loss in
which each bit counts, for each language, as much as it was right on labelled
texts of that language; the nearest codeword wins, and a text with two codewords
nearly as near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laneflow.llm.common import fresh, release, small_batches

UNDETERMINED = "und"
# Hash buckets of n-grams, n-gram lengths in bytes, and bytes scored at a time.
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
SLICE = 1 << 20
# Losses of the best two codewords closer than this are a tie in practice.
AMBIGUOUS = 0.02

# ASCII letters to lower case, all else in ASCII to a space; bytes of other characters stay.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint32(2654435761)


# -------------------------------------------------------------------- features


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, a slice at a time.

    Case is folded, and runs of other characters than letters become one space.
    """
    data = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    space = data == 32
    data = data[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    longest = max(GRAMS)
    for at in range(0, len(data), SLICE):
        part, grams = data[at : at + SLICE + longest - 1], []
        for n in GRAMS:
            stop = min(SLICE, len(part) - n + 1)
            if stop <= 0:
                continue
            code = np.full(stop, n, np.uint32)
            for i in range(n):
                code = code * np.uint32(257) + part[i : i + stop]
            grams.append((code * _MIX) >> shift)
        yield np.concatenate(grams)


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    for part in gram_buckets(text, buckets):
        counts += np.bincount(part, minlength=buckets)
    return counts


# ------------------------------------------------------------------- codewords


def codewords(n: int, bits: int = 64, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages.

    Up to seven languages get the exhaustive code, every split into two sides
    once; more get the random code with the largest least distance among a
    hundred, in which no bit is constant.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        sides = [c for size in range(n - 1) for c in combinations(range(1, n), size)]
        code = -np.ones((n, len(sides)))
        code[0] = 1
        for j, side in enumerate(sides):
            code[list(side), j] = 1
        return code
    rng, best, distance = np.random.default_rng(seed), None, -1.0
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        if bits - agree.max() > distance:
            best, distance = code, bits - agree.max()
    return best


# ----------------------------------------------------------------------- model


@dataclass
class Model:
    """``weights``: buckets by bits; ``scale``: of each bit's margin; ``trust``: of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    buckets: int = BUCKETS

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds per n-gram of each bit."""
        total, count = np.zeros(self.weights.shape[1]), 0
        for part in gram_buckets(text, self.buckets):
            hits = np.bincount(part, minlength=self.buckets)
            used = np.flatnonzero(hits)
            total += hits[used] @ self.weights[used]
            count += len(part)
        return total / max(count, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """The language, a score between 0 and 1, and whether a second one is nearly as near."""
        losses = (self.trust * np.exp(-np.clip(self.code * margins / self.scale, -8, 8))).sum(1)
        share = np.exp(losses.min() - losses)
        best = int(losses.argmin())
        rest = np.delete(losses, best)
        return self.languages[best], float(1 / share.sum()), bool(len(rest) and rest.min() - losses[best] < AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        return self.decode(self.margins(text))


def train(df: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, bits: int = 64) -> Model:
    """Fit on all rows with a language and a letter in the text.

    Two passes: n-gram counts by language, then the bits' margins on the same
    rows.  Either pass sums within tasks and in Spark; what reaches the driver is
    one row per language and bucket, and one per language and bit.  Rows without
    language or text, or without letters, teach nothing.  Without any labelled
    row the model knows no language and answers ``und`` throughout.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, of in zip(batch.column(0), batch.column(1), strict=True):
                if has_letter(whole := value.as_py()):
                    counts = sums.setdefault(of.as_py(), np.zeros(buckets, np.int64))
                    counts += gram_counts(whole, buckets)
        for of, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([of] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": counts[used]})

    found = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), buckets))
    counts[[languages.index(x) for x in found["lang"]], found["bucket"].to_numpy(np.int64)] = found["n"]
    code = codewords(len(languages), bits)

    # Every language weighs the same within its side, whatever its number of texts.
    shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * buckets)
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    side = lambda members: (members.T @ shares) / np.maximum(members.sum(0), 1)[:, None]
    weights = np.log(np.maximum(side(ones), 1e-12)).T - np.log(np.maximum(side(zeros), 1e-12)).T
    n_bits = code.shape[1]
    model = Model(languages, code, weights, np.ones(n_bits), np.full(code.shape, 1 / n_bits), buckets)
    if len(languages) < 2:
        return model

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        n, right, size = np.zeros(len(languages), np.int64), np.zeros(code.shape), np.zeros(code.shape)
        for batch in batches:
            for value, of in zip(batch.column(0), batch.column(1), strict=True):
                if has_letter(whole := value.as_py()):
                    i, margins = number[of.as_py()], model.margins(whole)
                    n[i] += 1
                    right[i] += margins * code[i] > 0
                    size[i] += np.abs(margins)
        at = np.argwhere(np.ones(code.shape, bool))
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(at[:, 0], pa.int32()), "j": pa.array(at[:, 1], pa.int32()), "n": n[at[:, 0]], "hits": right.ravel(), "size": size.ravel(),
        })

    sums = rows.mapInArrow(judge, "i int, j int, n bigint, hits double, size double").groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("size").alias("size")
    ).toPandas()
    n, right, size = (np.zeros(code.shape) for _ in range(3))
    place = (sums["i"].to_numpy(), sums["j"].to_numpy())
    n[place], right[place], size[place] = sums["n"], sums["hits"], sums["size"]
    accuracy = (right + 1) / (n + 2)
    trust = np.maximum(2 * accuracy - 1, 1e-3)
    model.trust = trust / trust.sum(1, keepdims=True)
    model.scale = np.maximum(size.sum(0) / n.sum(0), 1e-9) / 2
    return model


def identify(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """All columns of ``df`` with the language, a score from 0 to 1 and a flag for ambiguity.

    Null texts and texts without a letter get ``und``, score 0, flagged.  Whole
    texts are scored, a slice at a time.  Columns of the three names are replaced.
    """
    small_batches(df.sparkSession)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    # Sent to each executor once; its size is set by buckets x bits.
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang", "score", "ambiguous"), shared.value.predict(t.as_py()), strict=True)) for t in texts], kind)

    (answer,) = fresh(df, "__language")
    out = df.withColumn(answer, run(F.col(f"`{text}`")))
    kept: list[Column] = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return out.select(*kept, *[F.col(answer)[part].alias(name) for part, name in zip(("lang", "score", "ambiguous"), names, strict=True)])
