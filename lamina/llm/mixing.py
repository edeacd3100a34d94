"""Operator 6: mixing to target weights with soft membership.

A classifier trained on a labelled table gives every document its posteriors over domains. Rates r
are fitted by distributed projected-gradient least squares so that the expected tokens of each domain,
the sum of rate * tokens * posterior, meet the targets. The objective is the sum of the squared misses,
each in parts of its target, and RIDGE times the mean square of the changes r - 1, which picks the
mildest of equal rates. The gradient of a document's rate is its posteriors times one number for each
domain, so the steps add up to one number c for each domain and the projected rate is
max(least, 1 + p . c): the least rate is 0, and that of documents whose likeliest domain has one
(FLOORS) is that, so that mixing loses no good document. Each step goes down the gradient in the norm
of the inverse Gram matrix of the rows above their least rate, is halved until the objective (its dual,
which is convex in c) falls, and steps go on until the gradient vanishes. A step is one sum over all
rows, of as many numbers as there are domains and pairs of them, so the driver holds only these, and
rates are an expression that any task can evaluate. Sums are in whole numbers: neither order nor
partitioning changes a rate.

Without a total, targets are made so large that least rates alone exceed none of them: the total is
HEADROOM times the largest, over all domains, of the tokens at least rates over the domain's share. While
a domain's target is missed by more than CLOSE of it, the total is raised by RAISE and the fit goes on
from there, until that no longer brings targets nearer.

The classifier is multinomial logistic regression on the words that occur in a text, hashed to
FEATURES columns. It is fitted on at most MAX_LABELLED labelled rows, those with the least hashes
of their ids; it is then applied to all rows.

Null and empty texts have no tokens and the posteriors of no evidence; very long ones are read whole.
A domain without tokens can't be met; the other targets still are, as nearly as possible. Without
labelled rows the posteriors are equal. Of equal posteriors the first domain is the likeliest. Repeated
rows count each time and get equal rates and copies. An empty table gives an empty result. Columns of
any name pass through `mixed`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textvec as tv
from lamina.llm.shared import named, numbered, over_texts, place, ship, written

FEATURES, MAX_LABELLED = 1 << 16, 5000
FIT_STEPS, PENALTY = 120, 2.0
#: Weight of the changes of rates, gradient (in parts of all tokens) that ends the fit, and a bound
#: of its steps, which the convex dual doesn't reach.
RIDGE, TOLERANCE, MAX_STEPS = 1e-7, 1e-6, 200
#: Domains and the share of tokens each is to have.
TARGETS = {"good": 0.90, "low": 0.07, "toxic": 0.03}
#: Least rates of documents by their likeliest domain: none of these is lost.
FLOORS = {"good": 1.0}
#: Without a total: so much more than what least rates need, the miss in parts of a target from which
#: on the total is raised, and by how much.
HEADROOM, CLOSE, RAISE = 1.1, 1e-3, 1.25
#: Posteriors and rates are whole numbers of these parts.
UNIT = 1_000_000


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The place of a labelled row's domain in TARGETS."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 1, 0).otherwise(1)


def features(b: tv.Block) -> tuple[np.ndarray, np.ndarray]:
    """The different word features of each text: text, feature, in order."""
    starts, ends, doc = b.words()
    at = b.hasher(61, lower=True)(starts, ends) % np.uint64(FEATURES)
    both = np.unique(doc * FEATURES + at.astype(np.int64))
    return both // FEATURES, both % FEATURES


def _logits(owner: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
    return np.stack([np.bincount(owner, w[feature], n) / size for w in weights], axis=1) + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, domains: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases. labelled: (id, domain). Takes features, not texts, to the driver."""
    ship(docs.sparkSession)
    chosen = labelled.select(named(id_column).alias("_id"), F.col("domain").cast("int").alias("_y")).filter("_id is not null and _y is not null")
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    texts = docs.select(named(id_column).alias("_id"), named(text_column).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_y", "_id", "_text")

    def run(batches):
        for batch in batches:
            lists = []
            for b in tv.blocks(batch.column(2)):
                owner, feature = features(b)
                edge = np.searchsorted(owner, np.arange(b.n + 1))
                lists += [feature[edge[k] : edge[k + 1]].astype(np.int32) for k in range(b.n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["_y", "_id", "_f"])

    kind = texts.schema["_id"].dataType.simpleString()
    got = texts.mapInArrow(run, f"_y int, _id {kind}, _f array<int>").dropDuplicates(["_id"]).toArrow().sort_by("_id")
    y = got["_y"].to_numpy()
    weights, bias = np.zeros((domains, FEATURES)), np.zeros(domains)
    if not len(y):
        return weights, bias
    f = got["_f"].combine_chunks()
    owner = np.repeat(np.arange(len(y)), np.diff(f.offsets.to_numpy()))
    feature = f.flatten().to_numpy()
    truth = np.eye(domains)[y]
    size = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(y))))
    square_w, square_b = np.full_like(weights, 1e-8), np.full(domains, 1e-8)
    for _ in range(FIT_STEPS):
        error = (_softmax(_logits(owner, feature, len(y), weights, bias)) - truth) / len(y)
        slope_b = error.sum(axis=0)
        for k in range(domains):
            slope = np.bincount(feature, (error[:, k] / size)[owner], FEATURES) + PENALTY * 1e-5 * weights[k]
            square_w[k] += slope**2
            weights[k] -= 0.5 * slope / np.sqrt(square_w[k])
        square_b += slope_b**2
        bias -= 0.5 * slope_b / np.sqrt(square_b)
    return weights, bias


def with_posteriors(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, np.ndarray], text_column: str = "text") -> DataFrame:
    """The columns `keep`, _tokens (words) and _p0, _p1, ... in parts of UNIT that sum to it."""
    weights, bias = model[0].astype(np.float32), model[1]

    def of_texts(texts: pa.Array) -> list[pa.Array]:
        tokens, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(bias)), np.int64)]
        for b in tv.blocks(texts):
            tokens.append(tv.counts_of(b.words()[2], b.n))
            p = np.floor(_softmax(_logits(*features(b), b.n, weights, bias)) * UNIT).astype(np.int64)
            p[:, 0] += UNIT - p.sum(axis=1)
            shares.append(p)
        return [pa.array(np.concatenate(tokens)), *[pa.array(c) for c in np.concatenate(shares).T]]

    return over_texts(docs, keep, text_column, ", ".join(["_tokens long", *[f"_p{k} long" for k in range(len(bias))]]), of_texts)


def _floor(targets: dict[str, float], floors: dict[str, float]) -> Column:
    """The least rate of a row; of equal posteriors the first counts."""
    p = [F.col(f"_p{k}") for k in range(len(targets))]
    out = F.lit(0.0)
    for k, d in enumerate(targets):
        if d in floors:
            likeliest = F.lit(True)
            for j in range(len(targets)):
                if j != k:
                    likeliest = likeliest & ((p[k] > p[j]) if j < k else (p[k] >= p[j]))
            out = F.when(likeliest, F.lit(float(floors[d]))).otherwise(out)
    return out


def _rate(changes: list[np.ndarray], floor: Column | None = None) -> Column:
    """The rate in parts of UNIT after these changes."""
    r, floor = F.lit(1.0), F.lit(0.0) if floor is None else floor
    for c in changes:
        for k, v in enumerate(c):
            r = r + F.col(f"_p{k}") * F.lit(float(v) / UNIT)
        r = F.greatest(r, floor)
    return F.round(r * UNIT).cast("long")


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, total_tokens: int | None = None, floors: dict[str, float] | None = None) -> tuple[list[np.ndarray], dict]:
    """The change of rates (none, or one number for each domain), and a report with current, target and fitted tokens of each domain.
    rows: _tokens and posteriors, a table that can be read repeatedly."""
    n = len(targets)
    product = lambda x, y: F.coalesce(F.sum(x.cast("decimal(20,0)") * y.cast("decimal(10,0)")), F.lit(0))  # noqa: E731  exact
    p = [F.col(f"_p{k}") for k in range(n)]
    floors = floors or {}
    floor = _floor(targets, floors)

    def sums(changes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens of each domain, the Gram matrix of the rows above their least rate (at
        the start, of all) and the tokens times the square of the rates."""
        r = rows.select("_tokens", *p, _rate(changes, floor).alias("_rate"), floor.alias("_least"))
        alive = F.when(F.col("_rate") > F.col("_least") * UNIT, F.col("_tokens")) if changes else F.col("_tokens")
        square = F.coalesce(F.sum((F.col("_tokens") * F.col("_rate")).cast("decimal(20,0)") * F.col("_rate").cast("decimal(18,0)")), F.lit(0))
        row = [float(v) for v in r.agg(*[product(F.col("_tokens") * F.col("_rate"), v) for v in p], *[product(alive * p[i], p[j]) for i in range(n) for j in range(n)], square).first()]
        return np.array(row[:n]) / UNIT**2, np.array(row[n:-1]).reshape(n, n) / UNIT**2, row[-1] / UNIT**2

    current, gram, square = sums([])
    share = np.array(list(targets.values())) / sum(targets.values())
    there = share > 0
    given = total_tokens is not None
    if not given:
        least = rows.select(floor.alias("_least"), "_tokens", *p).agg(*[F.coalesce(F.sum(F.col("_least") * F.col("_tokens") * v), F.lit(0.0)) for v in p]).first() if floors else [0.0] * n
        least = np.round(np.array(least, float) / UNIT, 3)  # sums of floats: what order changes is rounded away
        total_tokens = HEADROOM * max([*(least[there] / share[there]), current.sum()])
    c, fitted, gram_c, square_c, steps = np.zeros(n), current, gram, square, 0
    best = None
    while True:
        target = share * total_tokens
        ridge = RIDGE * np.square(np.maximum(target, 1e-3 * target.sum())) / max(1.0, target.sum())
        gradient = lambda c, f: f - target + ridge * c  # noqa: B023, E731
        dual = lambda c, f, q: c @ f - q / 2 + f.sum() - target @ c + ridge @ (c * c) / 2  # noqa: B023, E731  without a constant
        near = TOLERANCE * max(1.0, target.sum())
        slope, height, part, left = gradient(c, fitted), dual(c, fitted, square_c), 1.0, MAX_STEPS
        direction = np.linalg.lstsq(gram_c + np.diag(ridge), -slope, rcond=None)[0]
        while left and np.abs(slope).max() > near:
            left -= 1
            tried = c + part * direction
            new, new_gram, new_square = sums([tried])
            new_slope, new_height = gradient(tried, new), dual(tried, new, new_square)
            if new_height <= height + 1e-4 * part * (slope @ direction) or np.abs(new_slope).max() <= np.abs(slope).max() / 2:
                c, fitted, gram_c, square_c, slope, height, part, steps = tried, new, new_gram, new_square, new_slope, new_height, 1.0, steps + 1
                direction = np.linalg.lstsq(new_gram + np.diag(ridge), -slope, rcond=None)[0]
            elif part < 1e-6:
                break  # rates are in parts of UNIT: nothing is left to gain
            else:
                part /= 2
        reach = there & (current > 0)
        miss = float(np.abs(fitted[reach] / target[reach] - 1).max()) if reach.any() and total_tokens else 0.0
        if best is None or miss < 0.9 * best[0]:
            best = (miss, c, target, fitted, total_tokens)
        else:
            break  # a larger total doesn't bring targets nearer
        if given or miss <= CLOSE:
            break
        total_tokens *= RAISE
    miss, c, target, fitted, total_tokens = best
    return ([c] if np.any(c) else []), {"domains": list(targets), "current": current, "target": target, "fitted": fitted, "steps": steps, "miss": miss}


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of copies whose mean is the rate, chosen by a hash of the row."""
    return (F.floor(rate / F.lit(UNIT)) + F.when(F.pmod(F.xxhash64(F.lit(97), *key), F.lit(UNIT)) < F.pmod(rate, F.lit(UNIT)), 1).otherwise(0)).cast("long")


def _labelled(labels: DataFrame, id_column: str) -> DataFrame:
    return labels.select(named(id_column), domain_of().alias("domain"))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text", floors: dict[str, float] = FLOORS) -> DataFrame:
    """Each row's id, n_tokens, posterior of each domain and rate (in millionths) and n_copies."""
    model = fit(docs, _labelled(labels, id_column), len(targets), id_column, text_column)
    inner = docs.select(named(id_column).alias("_id"), named(text_column).alias("_txt"))
    rows = written(with_posteriors(inner, ["_id"], model, "_txt"), "mixing-rows")
    changes, _ = fit_rates(rows, targets, floors=floors)
    rate = _rate(changes, _floor(targets, floors))
    return rows.select(F.col("_id").alias(id_column), F.col("_tokens").alias("n_tokens"), *[F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(targets)], rate.alias("rate"), copies(rate, F.col("_id"), F.col("_tokens")).alias("n_copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_column: str = "doc_id", text_column: str = "text", floors: dict[str, float] = FLOORS) -> DataFrame:
    """The documents, each as often as n_copies of `rates` says, with their columns. Texts are
    written once beside their posteriors; the fit reads the posteriors alone."""
    model = fit(docs, _labelled(labels, id_column), len(targets), id_column, text_column)
    inner = numbered(docs)
    rows = written(with_posteriors(inner, inner.columns, model, place(docs, text_column)), "mixing-rows")
    changes, _ = fit_rates(rows, targets, floors=floors)
    often = rows.withColumn("_copies", copies(_rate(changes, _floor(targets, floors)), F.col(place(docs, id_column)), F.col("_tokens"))).filter("_copies > 0")
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*inner.columns).toDF(*docs.columns)
