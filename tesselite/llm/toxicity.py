"""Toxicity scores from a counterfactual-regularised classifier.

A logistic model over the words of a text and the beginnings of its words (their presence) is fitted on labelled
texts, both kinds weighing the same. Every labelled text that
holds an identity term is paired with copies in which the term is swapped for others; the squared change of the
model's logit between the two is penalised, so that naming a group by itself moves a score as little as naming
any other. Labels are learnt from a bounded number of labelled rows of each kind, in the order of a hash of
their id; nothing but the text is an input of a score.

Defined results: null and empty texts score the model's bias; labels that are null are left out, of several
labels of one id the highest counts, and of several texts of one labelled id one is learnt from (the last in order of its
distinct words); without labelled rows of both kinds the score is the share of toxic rows
(0 without any); rows that share an id are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, trim
from .words import hashes, slices, tokens

#: Labelled rows of each kind that are learnt from at most, words that become features at most, the least number of
#: labelled texts that a feature is in, and the lengths of the beginnings of words.
LEARNT, FEATURES, LEAST, STEMS = 2_000, 2_048, 3, (4, 5)
#: The logit that the bias is drawn to: a text without evidence is clean.
WITHOUT = -2.0
PUNCTUATION = "\"'`.,;:!?()[]{}<>*_~#%&$|/\\-–—…«»“”‘’„¿¡"
#: Words that name a group, by kind: a word is swapped for the others of its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic", "mexican", "chinese", "indian"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("muslimisch", "christlich", "jüdisch", "schwul", "lesbisch"),
    ("musulman", "chrétien", "juif", "gay", "noir", "blanc"),
    ("musulmán", "cristiano", "judío", "negro", "blanco"),
)


TERMS = pa.array(sorted({t for g in IDENTITY for t in g}))


#: Endings with which a term is still the same term, where the result is no term itself.
ENDINGS = "s|e|es|en|er|em|n|ne|nes|ns|a|as|o|os"
_INFLECTED = "^(" + "|".join(sorted((t.as_py() for t in TERMS if len(t.as_py()) > 3 or t.as_py() == "gay"), key=lambda t: (-len(t), t))) + f")(?:{ENDINGS})$"


def forms(words: pa.Array) -> list[pa.Array]:
    """What each word may be known by: itself without punctuation at its ends (identity terms without their ending), and its first 4 and 5 characters (but not
    those of identity terms, on which the penalty couldn't act)."""
    own = pc.utf8_trim(words.cast(pa.string()), characters=PUNCTUATION)
    own = pc.if_else(pc.is_in(own, value_set=TERMS), own, pc.replace_substring_regex(own, _INFLECTED, "\\1"))
    size = pc.if_else(pc.is_in(own, value_set=TERMS), min(STEMS), pc.utf8_length(own))
    short = [pc.if_else(pc.greater(size, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(own, 0, n), "", "*"), None) for n in STEMS]
    return [pc.if_else(pc.greater(size, 0), own, None), *short]


def features_of(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: the known forms of words that each text holds."""
    bounds, index, words = tokens(texts)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
    n, pairs = max(1, len(known)), [np.zeros(0, np.int64)]
    for form in forms(words) if len(words) else []:
        at = pc.index_in(form, value_set=known, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        found = at[index]
        pairs.append(of[found >= 0] * n + found[found >= 0])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // n, pairs % n


def vocabulary(texts: pa.Array, at_once: int = 250) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct forms of words that are in LEAST texts at least, and the distinct (text, form) pairs. Forms are
    counted by hash and in lots, so that rare ones never stand in memory as text."""
    total, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for k in range(0, len(texts), at_once):
        bounds, index, words = tokens(texts.slice(k, at_once))
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int64)
        met = []
        for form in forms(words) if len(words) else []:
            there = form.is_valid().to_numpy(zero_copy_only=False)
            h = np.zeros(len(form), np.uint64)
            h[there] = hashes(form.drop_null())
            own, number = np.unique(h, return_inverse=True)
            pair = np.unique((of * len(own) + number[index])[there[index]])
            met.append(own[pair % len(own)])
        lot, n = np.unique(np.concatenate(met), return_counts=True) if met else (total[:0], times[:0])
        both, at = np.unique(np.concatenate([total, lot]), return_inverse=True)
        total, times = both, np.bincount(at, weights=np.concatenate([times, n]), minlength=len(both)).astype(np.int64)
    total = total[times >= LEAST]
    names: set[str] = set()
    for k in range(0, len(texts), at_once):
        _, _, words = tokens(texts.slice(k, at_once))
        for form in forms(words) if len(words) else []:
            form = pc.unique(form.drop_null())
            names.update(form.filter(pa.array(np.isin(hashes(form), total))).to_pylist())
    known = pa.array(sorted(names), pa.string())
    parts = [(k, features_of(texts.slice(k, at_once), known)) for k in range(0, len(texts), at_once)]
    none = np.zeros(0, np.int64)
    return known, np.concatenate([none, *(of + k for k, (of, _) in parts)]), np.concatenate([none, *(f for _, (_, f) in parts)])


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        of, feature = features_of(texts, pa.array(self.words, pa.string()))
        z = self.bias + np.bincount(of, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], toxic: np.ndarray, penalty: float = 1.0, ridge: float = 2e-5, rounds: int = 600, rate: float = 0.1) -> Model:
    """penalty: weight of the mean squared logit change under identity swaps."""
    toxic = np.asarray(toxic, float)
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model([], np.zeros(0), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    rows = pa.array(texts, pa.large_string())
    known, of, word = vocabulary(rows)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    a, b = (np.bincount(word, weights=x[of], minlength=len(known)) for x in (toxic, 1 - toxic))
    gap = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    z = np.abs(gap) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    z[(a + b < LEAST) | (z < 2)] = -1
    terms = pc.is_in(known, value_set=TERMS).to_numpy(zero_copy_only=False)
    z[terms & (a + b > 0)] = np.inf  # identity terms are features always, for the penalty to hold them
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 0]
    number = np.full(len(known), -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[word] >= 0
    of, word = of[keep], number[word[keep]]
    names = known.take(pa.array(chosen)).to_pylist()
    place = {w: k for k, w in enumerate(names)}
    # Swapped pairs: a row for each text that holds a term, and each other term of its kind. The presence of all other
    # words cancels out, so the change of the logit is the difference of two weights (none for a term never met).
    pairs: dict[tuple[int, int], float] = {}
    times = np.bincount(word, minlength=len(names))
    for group in IDENTITY:
        for s in group:
            for t in group:
                if s != t and (i := place.get(s)) is not None:
                    pairs[i, place.get(t, -1)] = pairs.get((i, place.get(t, -1)), 0.0) + times[i] / (len(group) - 1)
    total = sum(pairs.values()) or 1.0
    left, right = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    share = np.array(list(pairs.values())) / total
    weight = np.where(toxic > 0, 0.5 / n1, 0.5 / n0)
    n, w, bias = len(toxic), np.zeros(len(names) + 1), 0.0  # the last weight stands for no word and stays 0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(of, weights=w[word], minlength=n))))
        error = (p - toxic) * weight
        g = np.bincount(word, weights=error[of], minlength=len(w)) + ridge * w
        if len(share):
            d = 2 * penalty * share * (w[left] - w[right])
            np.add.at(g, left, d)
            np.add.at(g, right, -d)
        g[-1] = 0
        gb = error.sum() + 0.01 * (bias - WITHOUT)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-9)
    return Model(names, w[:-1], float(bias))


def held_out(id_col):
    """Whether labels of this id are kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learnt: int = LEARNT, **settings) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    some = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(learnt) for c in ("y > 0", "y <= 0")]
    some = some[0].unionByName(some[1])  # at most twice ``learnt`` rows
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(some), "id")
    rows = rows.select("id", "y", _cut("text").alias("text")).groupBy("id").agg(F.first("y").alias("y"), F.max("text").alias("text"))  # a repeated id counts once
    pdf = rows.toPandas().sort_values(["id", "text"])
    texts, toxic = pdf["text"].tolist(), (pdf["y"] > 0).to_numpy()
    del pdf
    model = fit(texts, toxic, **settings)
    del texts
    trim()
    return model


def _cut(column: str):
    """The distinct words of a text, by the same rule that scoring uses: all that fitting needs of it."""

    @F.pandas_udf("string")
    def distinct(texts):
        import pandas as pd

        out = []
        for some in slices(pa.array(texts, pa.large_string())):
            bounds, index, found = tokens(some)
            found = found.to_pylist()
            out += [" ".join(sorted(found[k] for k in set(index[a:b].tolist()))) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pd.Series(out, dtype="object")

    return distinct(column)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in batches:
            at = 0
            for texts in slices(g.column(1)):
                yield pa.RecordBatch.from_arrays([g.column(0).slice(at, len(texts)), pa.array(shared.value.score(texts))], ["id", "score"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(fn, f"{id_col} long, score double")


def score_of(spark: SparkSession, model: Model, text_col: str = "text"):
    """The score as a column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def fn(texts):
        import pandas as pd

        return pd.Series(np.concatenate([np.zeros(0), *(shared.value.score(some) for some in slices(pa.array(texts, pa.large_string())))]))

    return fn(text_of(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
