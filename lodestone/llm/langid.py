"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over hashed character trigrams that tells the languages with
a one from those with a zero. A text gets a margin for every bit, and decoding takes the codeword of least loss, where a
bit's loss counts by how well its classifier did on the training rows. A close second makes the text ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, small

DIMENSIONS = 2048
#: Bytes that part words: all of ASCII but a-z.
_PART = np.arange(256, dtype=np.uint8)
_PART[:0x61] = 0x20
_PART[0x7B:0x80] = 0x20
#: Texts are counted in pieces of so many characters, all of them; a bound on memory.
PIECE = 1 << 20
#: Languages that may each give the driver a whole sample.
FULL_LANGS = 200


def features(text: str | None) -> np.ndarray | None:
    """Square roots of a whole text's trigram shares, hashed to DIMENSIONS; None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(text), PIECE):
        b = _PART[np.frombuffer(b" " + text[at : at + PIECE].lower().encode("utf-8", "replace") + b" ", np.uint8)].astype(np.uint32)
        gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        gram = gram[(b[1:-1] != 0x20)]
        counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(21), minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dimensions + 1 x bits
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of features, and a score from 0 (a tie) to 1."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = np.exp(-np.clip(margin[:, None, :] * self.code[None], -4, 4) * 2) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        least = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] if len(self.langs) > 1 else least * 2
        return [self.langs[i] for i in order[:, 0]], np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1, far from each other. No bit repeats another or its opposite, so each classifier tells something of its own.

    If there are no more than bits ways to split the languages in two, all of them, so that any two words differ in half of
    them or more; else the best of some random draws of splits, balanced ones past seven languages.
    """
    if n < 2:
        return np.ones((n, 1))
    if n < 32 and (1 << (n - 1)) - 1 <= bits:
        # The last language is always on one side; every choice of the others but none of them.
        return np.array([[1.0 if split >> i & 1 else -1.0 for split in range(1, 1 << (n - 1))] for i in range(n)])
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        seen: dict[bytes, np.ndarray] = {}
        while len(seen) < bits:
            # Few languages have too few balanced splits; then any split will do.
            split = np.where(np.argsort(rng.random(n)) < ((n + 1) // 2 if n > 7 else rng.integers(1, n)), 1.0, -1.0)
            seen.setdefault((split * split[0]).tobytes(), split)
        code = np.array(list(seen.values())).T
        apart = float(((bits - code @ code.T) / 2)[np.tril_indices(n, -1)].min()) / bits
        if apart > far:
            best, far = code, apart
    return best


def fit(rows: list[tuple[str, str]], bits: int = 15, ridge: float = 0.05) -> Model:
    """rows: (text, language). Each bit's classifier is a ridge regression on its signs, languages weighing alike."""
    x, y = [], []
    for text, lang in rows:
        if (f := features(text)) is not None:
            x.append(f)
            y.append(lang)
    langs = sorted(set(y))
    code = codewords(len(langs), max(bits, 2 * int(np.ceil(np.log2(max(2, len(langs)))))))
    if not langs:
        return Model([], code, np.zeros((DIMENSIONS + 1, 1)), np.ones(1))
    at = np.searchsorted(langs, y)
    a = np.concatenate([np.array(x), np.ones((len(x), 1))], axis=1)
    weigh = 1 / np.bincount(at)[at] / len(langs)
    target = code[at]
    left = a.T @ (a * weigh[:, None])
    left[np.diag_indices_from(left)] += ridge / DIMENSIONS
    weights = np.linalg.solve(left, a.T @ (target * weigh[:, None]))
    right = ((a @ weights * target) > 0).T @ weigh
    trust = np.maximum(np.log(np.maximum(right, 1e-3) / np.maximum(1 - right, 1e-3)), 1e-3)
    return Model(langs, code, weights, trust / trust.sum())


def training_sample(docs: DataFrame, labelled: str, per_lang: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """About per_lang labelled rows of each language, picked by a hash of their id; the bound on what reaches the driver.

    Past FULL_LANGS languages each gives fewer, so that the total stays what it is for so many, but one at least.
    """
    million = 1_000_000
    rows = docs.filter(labelled).filter(F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit("pick"), F.col(id_col)), F.lit(million)).alias("pick"))
    # A language's share is read from its count; its row of least hash is always there.
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("pick").alias("least")))
    langs = counts.count()
    if not langs:
        return []
    per_lang = min(per_lang, max(1, FULL_LANGS * per_lang // langs))
    share = counts.select(F.col("lang").alias("of"), F.greatest(F.ceil(F.lit(per_lang * million) / F.col("n")), F.col("least") + 1).alias("share"))
    picked = rows.join(small(share, 64, langs), F.col("lang") == F.col("of")).filter("pick < share")
    # Past the bound, which hashes make unlikely, those of least hash.
    return [(r[0], r[1]) for r in picked.orderBy("pick", "lang", "text").select("text", "lang").limit(2 * per_lang * langs).collect()]


def identify(docs: DataFrame, model: Model, text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """docs with lang_pred, score and ambiguous. A text that is null or has no letter is "und" with score 0, as is any if nothing was learned.

    Texts of any length are counted whole. Rows don't depend on each other, so equal rows and ids, or null ids, change nothing;
    a column of docs that is named like a result gives way to it.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            m, rows = shared.value, texts.tolist()
            langs, scores = ["und"] * len(rows), np.zeros(len(rows))
            for at in range(0, len(rows), 512):
                found = [(at + i, f) for i, t in enumerate(rows[at : at + 512]) if m.langs and (f := features(t)) is not None]
                if found:
                    got, score = m.decode(np.array([f for _, f in found]))
                    for (i, _), lang, s in zip(found, got, score, strict=True):
                        langs[i], scores[i] = lang, s
            yield pd.DataFrame({"lang": langs, "score": scores})

    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous", "_found")]
    found = F.col("_found")
    out = docs.withColumn("_found", F.pandas_udf(predict, "lang string, score double")(F.col(f"`{text_col}`")))
    return out.select(*own, found["lang"].alias("lang_pred"), found["score"].alias("score"), ((found["lang"] == "und") | (found["score"] < ambiguous_below)).alias("ambiguous"))
