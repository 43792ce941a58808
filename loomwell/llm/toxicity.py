"""Toxicity: a classifier regularised by counterfactuals.

Logistic regression over hashed words and word beginnings with an L1 penalty. For each training text a counterfactual is
made by swapping its identity terms (group names) for others of the same kind; the squared difference of the two logits is
penalised, so that a mere mention of a group moves the score little. Training uses a bounded, class-balanced sample of the
labelled rows outside the held-out fold; the intercept is then put where the sample errs least, each row weighing as many
labelled documents outside the fold as it stands for (so the classes count by their true frequencies).

Edge cases: null texts count as empty; empty texts get the intercept's score; with one class only all rows get its label's
score (0 or 1), without labels 0; repeated rows and labels do no harm; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import features as X
from loomwell.llm.scratch import filter_documents, small_batches

#: Groups of identity terms that can stand for each other in a neutral sentence: by language, and within it by kind, number and
#: gender, so that a swapped sentence stays in its language and keeps its grammar. Words of several languages form groups of their own.
IDENTITY_TERMS: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"), ("christians", "muslims", "jews", "buddhists", "atheists", "catholics", "sikhs"),
        ("black", "white", "asian", "latino", "african", "european", "american", "arab", "indigenous"), ("lesbian", "straight"), ("lesbians", "heterosexuals"),
        ("young", "old"), ("elderly", "teenage"), ("disabled", "blind", "deaf", "paralyzed", "autistic"),
        ("immigrant", "refugee", "foreigner"), ("immigrants", "refugees", "foreigners"),
    ),
    "de": (
        ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden", "buddhisten", "atheisten", "katholiken"),
        ("christliche", "muslimische", "jüdische", "hinduistische", "buddhistische"), ("christlichen", "muslimischen", "jüdischen", "hinduistischen", "buddhistischen"),
        ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"), ("schwarzen", "weißen", "asiatischen", "afrikanischen", "europäischen", "arabischen"),
        ("schwule", "lesbische", "bisexuelle", "heterosexuelle"), ("schwulen", "lesbischen", "bisexuellen", "heterosexuellen"),
        ("blinde", "gehörlose", "behinderte", "gelähmte"), ("blinden", "gehörlosen", "behinderten", "gelähmten"), ("einwanderer", "flüchtlinge", "ausländer"),
    ),
    "fr": (
        ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("fille", "garçon"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
        ("chrétien", "musulman", "juif", "hindou"), ("chrétienne", "juive", "hindoue"), ("noirs", "blancs", "africains", "européens", "asiatiques"),
        ("homosexuels", "hétérosexuels", "bisexuels"), ("homosexuelles", "hétérosexuelles", "bisexuelles", "lesbiennes"),
        ("aveugles", "sourds", "handicapés", "paralysés"), ("immigrés", "réfugiés", "étrangers"), ("immigrées", "réfugiées", "étrangères"),
    ),
    "es": (
        ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("niña", "niño"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
        ("cristiano", "musulmán", "judío", "ateo"), ("cristiana", "musulmana", "judía", "atea"), ("negros", "blancos", "africanos", "europeos", "asiáticos"),
        ("bisexuales", "homosexuales", "heterosexuales"), ("ciegos", "sordos", "discapacitados", "paralíticos"), ("inmigrantes", "refugiados", "extranjeros"),
    ),
    "several": (("gay", "queer"), ("bisexual", "homosexual", "heterosexual"), ("transgender", "cisgender")),
}


def identity_groups() -> list[tuple[str, ...]]:
    return [g for groups in IDENTITY_TERMS.values() for g in groups]


def swapper(groups: Sequence[Sequence[str]] | None = None):
    """A function that replaces each identity term of a text by the next of its group."""
    groups = identity_groups() if groups is None else groups
    to = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    if not to:
        return lambda text: text
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, to), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def swap(m: re.Match) -> str:
        new = to[m[0].lower()]
        return new.capitalize() if m[0][:1].isupper() else new

    return lambda text: pattern.sub(swap, text)


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float


def fit(data: dict[str, np.ndarray], pairing: float = 1.0, l1: float = 1e-3, least: int = 5, steps: int = 150) -> Logistic:
    """``pairing``: weight of the squared logit difference between a text and its counterfactual."""
    y = (data["y"] > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Logistic(np.zeros(X.DIM, np.float32), 30.0 if len(y) and y[0] else -30.0)
    dims = X.common_dims(data, least)
    rows = X.project(data, dims)
    n, d = len(y), len(dims)
    at = data["z_at"] if "z_at" in data else np.zeros(0, np.int64)  # most texts name no group: only the others have a term

    def differs(k: int) -> bool:
        """Whether the k-th changed text has other features than before."""
        i = at[k]
        return not np.array_equal(data["x_dim"][data["x_ptr"][i] : data["x_ptr"][i + 1]], data["z_dim"][data["z_ptr"][k] : data["z_ptr"][k + 1]])

    apart = np.array([differs(k) for k in range(len(at))], bool)
    pairs = max(1, int(apart.sum()))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        logit = X.row_sums(p[:d], rows["x_ptr"], rows["x_dim"]) + p[d]
        s = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        value = float((np.logaddexp(0, logit) - y * logit).mean())
        g = (s - y) / n
        per_row = g.copy()
        if len(at):
            gap = (logit[at] - p[d] - X.row_sums(p[:d], rows["z_ptr"], rows["z_dim"])) * apart
            value += pairing * float((gap * gap).sum()) / pairs
            h = 2 * pairing * gap / pairs
            per_row[at] += h
        grad = np.concatenate((X.column_sums(per_row, rows["x_ptr"], rows["x_dim"], d), [g.sum()]))
        if len(at):
            grad[:d] -= X.column_sums(h, rows["z_ptr"], rows["z_dim"], d)
        return value, grad

    start = np.zeros(d + 1)
    p = X.minimise(loss, start, np.concatenate((np.full(d, l1), [0.0])), steps)
    # the intercept that errs least, midway between neighbours on a tie
    logit = X.row_sums(p[:d], rows["x_ptr"], rows["x_dim"])
    order = np.argsort(logit)
    z, t = logit[order], y[order]
    true = [data["sizes"][(data["grades"] > 0) == toxic].sum() for toxic in (False, True)] if "sizes" in data else [(1 - y).sum(), y.sum()]
    wrong = np.concatenate(([0], np.cumsum(t))) * true[1] / y.sum() + (np.sum(1 - t) - np.concatenate(([0], np.cumsum(1 - t)))) * true[0] / (1 - y).sum()
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-6)
    cut = (edges[best[0]] + edges[best[-1]]) / 2
    weights = np.zeros(X.DIM, np.float32)
    weights[dims] = p[:d]
    return Logistic(weights, float(-cut))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8000, folds: int = 5, fold: int = 0,
          groups: Sequence[Sequence[str]] | None = None, pairing: float = 1.0) -> Logistic:
    return fit(X.training_rows(docs, labels, label, sample, False, folds, fold, swapper(groups)), pairing)


def score_texts(m: Logistic, texts: pa.Array) -> np.ndarray:
    out = np.empty(len(texts))
    for i, n, doc, dim in X.batch_features(texts, False):
        logit = np.bincount(doc, weights=m.weights[dim], minlength=n) + m.bias
        out[i : i + n] = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    return out


def keep_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """The rows of docs, with all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold))
    return filter_documents(docs, lambda texts: score_texts(shared.value, texts) < 0.5)


def score(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, score of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the fold is not learned from."""
    out = score(docs, train(docs, labels, folds=folds, fold=fold))
    return out.select("doc_id", X.held_out(folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
