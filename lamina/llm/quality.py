"""Operator 7: quality rules and robust multivariate outliers.

Base rules reject texts with few words or many repeated ones. The others get a vector of
transformed statistics; for each language and source a minimum-covariance-determinant estimate
finds the centre and spread of the densest half of the vectors, and a text is rejected when its
squared Mahalanobis distance exceeds a chi-square quantile.

The estimate: from several starts (the medians, and the quartiles of one or two statistics in their
place) it concentrates step by step on the half of the rows with the least distances, until the determinant
of their covariance no longer falls; of the starts, the one with the least determinant holds. The
half is exact but for rows whose distances differ by less than a part in `BINS` of a doubling, which
enter in equal parts. A statistic that has one value in more than half of a group's rows, as most
shares are nil in most texts, has no spread in its densest half: that value is its centre and its
`LEAST` standard deviation its spread. The same least spread stands in for any direction in which the
half doesn't vary, and nowhere else.

The estimate of a group of n rows is blended with that of its language, and that with the estimate of
all rows, in the ratio of n to `PRIOR_ROWS`: a small group leans on the larger ones, smoothly.

Fits read cells, not rows: vectors in whole units with the number of rows that have them. Cells are
counted once; a step sums them by group, start and bin of distance, in whole numbers, so neither
order nor partitioning changes a result, and no group of any size is ever gathered. What is gathered
for a group are its bins, of which there are at most BINS * 24, and its values of one statistic.

Null texts have no words and fail; null languages and sources are groups of their own. Very long
texts are counted whole. Equal distances fall on one side. Repeated rows count each time. An empty
table gives an empty result. Columns whose names are those of results are replaced by them.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import textvec as tv
from lamina.llm.shared import named, numbered, over_texts, place, ship, without, written

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Rows that the wider estimate weighs, share of the dense part, upper tail, and by how much the
#: logarithm of a determinant must fall to go on.
PRIOR_ROWS, SUPPORT, TAIL, FALL = 60, 0.5, 1e-6, 1e-4
#: Steps that all starts make before the best one is followed to its end.
TRIAL_STEPS = 2
#: Usual words that averages are drawn towards, as texts of few words vary more: so many, of so
#: many characters.
PRIOR_WORDS, USUAL_CHARS = 20, 5
#: Whole units to one and least standard deviation of each statistic: log words, log characters a
#: word, roots of the shares of symbols, repeated lines and words.
UNITS = (64, 512, 64, 64, 64)
LEAST = (0.5, 0.14, 0.10, 0.16, 0.14)
DIM = len(UNITS)
#: Distance bins for each doubling, between 2**-8 and 2**16.
BINS, _LOW, _HIGH = 32, -8, 16

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_MORE = ", ".join(f"{k} long" for k in _COUNTS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def block_counts(b: tv.Block) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    data = b.data
    starts, ends, doc = b.words()
    window, at = tv.windows(b.hasher(1)(starts, ends), doc, 5)
    times, _ = tv.repeated(doc[at], window)
    edge = np.zeros(len(starts) + 1, np.int64)
    twice = at[times > 1]
    edge[twice] += 1
    np.subtract.at(edge, twice + 5, 1)
    covered = np.cumsum(edge[:-1]) > 0
    l_start, l_end, l_doc = b.spans(data != 0x0A)
    full = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)  # a word begins in the line
    l_start, l_end, l_doc = l_start[full], l_end[full], l_doc[full]
    _, earlier = tv.repeated(l_doc, b.hasher(2)(l_start, l_end))
    return {
        "n_words": tv.counts_of(doc, b.n),
        "word_chars": b.count(((data & 0xC0) != 0x80) & ~tv._SPACE[data]),
        "n_symbols": b.count(_SYMBOL[data]),
        "n_lines": tv.counts_of(l_doc, b.n),
        "n_dup_lines": tv.counts_of(l_doc[earlier], b.n),
        "n_repeat_words": tv.counts_of(doc[covered], b.n),
    }


def _of_texts(texts: pa.Array) -> list[pa.Array]:
    got = [block_counts(b) for b in tv.blocks(texts)]
    return [pa.array(np.concatenate([g[k] for g in got]) if got else [], pa.int64()) for k in _COUNTS]


def text_counts(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns `keep` and the counts of each text: words (runs without 0x20 and 0x09-0x0D),
    code points in words, symbols `#*$%&|<>`, lines with a word, those equal to an earlier one, and
    words in 5-word windows that occur twice or more in the text."""
    taken = set(_COUNTS)
    return over_texts(docs, [c for c in keep if c.lower() not in taken], text_column, _MORE, _of_texts)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _statistics() -> list[Column]:
    """The vector in whole units."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    some = F.col("n_words") + F.lit(float(PRIOR_WORDS))
    x = [
        F.log(words),
        F.log((F.col("word_chars") + F.lit(float(PRIOR_WORDS * USUAL_CHARS))) / some),
        F.sqrt(F.col("n_symbols") / some),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.round(v * u).cast("long").alias(f"_x{i}") for i, (v, u) in enumerate(zip(x, UNITS, strict=True))]


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(share: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_share(dim / 2, mid / 2) < share else (low, mid)
    return high


def consistency(dim: int) -> float:
    """Makes the spread of the dense part of normal data that of all."""
    return SUPPORT / _gamma_share(dim / 2 + 1, chi2_quantile(SUPPORT, dim) / 2)


_X = [f"_x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_UPPER = np.triu_indices(DIM)
_STATE = "_g long, _s int, _rows long, _m array<double>, _p array<double>, _flat int, _det double, _moved boolean"
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.bool_()]


def _state(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], names=_FIELDS)


def starts(k: np.ndarray, value: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(centre, inverse spread, statistics without spread as bits) of each start of a group, from
    how many rows have each value of each statistic. A statistic without spread has no weight here:
    it doesn't choose the dense half."""
    centre, low, high, flat = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM), 0
    for i in range(DIM):
        order = np.argsort(value[k == i])
        v, n = value[k == i][order] / UNITS[i], rows[k == i][order]
        upto, total = np.cumsum(n), n.sum()
        low[i], centre[i], high[i] = (v[np.searchsorted(upto, share * total)] for share in (0.25, 0.5, 0.75))
        if 2 * n.max() > total:
            centre[i] = v[n.argmax()]
            flat |= 1 << i
    free = np.array([not flat >> i & 1 for i in range(DIM)])
    spread = np.maximum((high - low) / 1.349, 1 / np.array(UNITS))
    inverse = np.diag(np.where(free, 1 / spread**2, 0.0))
    out = [(centre, inverse, flat)]
    some = np.flatnonzero(free).tolist()
    for places in [(i,) for i in some] + list(itertools.combinations(some, 2)):
        for quartiles in itertools.product((low, high), repeat=len(places)):
            moved = centre.copy()
            for i, q in zip(places, quartiles, strict=True):
                moved[i] = q[i]
            out.append((moved, inverse, flat))
    return out


def dense_half(bins: np.ndarray, moments: np.ndarray, flat: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, logarithm of its determinant) of the nearer half. moments: for each bin
    rows, sums and sums of products; the last bin that is needed enters in part. The determinant is
    that of the statistics with spread; of a covariance without full rank it is minus 1000 for each
    direction that is lacking, and the logarithm of the rest."""
    order = np.argsort(bins)
    t = moments[order].astype(float)
    free = [i for i in range(DIM) if not flat >> i & 1]
    rows, total = np.cumsum(t[:, 0]), t[:, 0].sum()
    half = min(total, max(math.ceil(SUPPORT * total), (total + len(free) + 1) // 2))
    part = np.clip((half - (rows - t[:, 0])) / t[:, 0], 0, 1)
    sums = part @ t / half
    unit = np.array(UNITS, float)
    mean = sums[1 : 1 + DIM] / unit
    cov = np.zeros((DIM, DIM))
    cov[_UPPER] = sums[1 + DIM :]
    cov = (cov + np.triu(cov, 1).T) / np.outer(unit, unit) - np.outer(mean, mean)
    for i in range(DIM):
        if i not in free:
            cov[i], cov[:, i] = 0.0, 0.0
    least = np.array(LEAST)[free]
    size = np.linalg.eigvalsh(cov[np.ix_(free, free)] / np.outer(least, least)) if free else np.ones(0)
    full = size > 1e-9
    return mean, cov, float(np.log(size[full]).sum() - 1000.0 * (~full).sum())


def spread_of(cov: np.ndarray, flat: int) -> np.ndarray:
    """The covariance for all rows: made consistent, and with the least spread in the directions that
    have none."""
    least = np.array(LEAST)
    free = DIM - bin(flat).count("1")
    size, axes = np.linalg.eigh(cov / np.outer(least, least))
    size = np.where(size > 1e-9, size * (consistency(free) if free else 1.0), 1.0)
    return (axes * size) @ axes.T * np.outer(least, least)


def _few(df: DataFrame) -> DataFrame:
    """No more partitions than there are cores: a state has a row for each start of each group, so
    that most of its shuffle's partitions have none, and a step would cost what its empty tasks do."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def _start(cells: DataFrame) -> DataFrame:
    """All starts of all groups."""
    each = cells.select("_g", "_n", F.posexplode(F.array(*_X)).alias("_k", "_v")).groupBy("_g", "_k", "_v").agg(F.sum("_n").alias("_n"))
    lists = each.groupBy("_g").agg(F.collect_list(F.struct("_k", "_v", "_n")).alias("_l"))

    def run(batches):
        for batch in batches:
            rows = []
            for g, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k, v, n = (x.to_numpy(zero_copy_only=False) for x in one.values.flatten())
                for s, (centre, inverse, flat) in enumerate(starts(k, v, n)):
                    rows.append((g, s, int(n[k == 0].sum()), centre, inverse.ravel(), flat, math.inf, True))
            yield _state(rows)

    return _few(lists).mapInArrow(run, _STATE)


def _distance() -> Column:
    """The squared distance of _x to _m by _p."""
    d = [F.col(f"_x{i}") / F.lit(float(UNITS[i])) - F.get("_m", F.lit(i)) for i in range(DIM)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + d[i] * d[j] * F.get("_p", F.lit(i * DIM + j)) * (1.0 if i == j else 2.0)
    return out


def _concentrate(cells: DataFrame, state: DataFrame) -> DataFrame:
    """The next state of every start, and whether its determinant fell; where not, the state before."""
    x = [F.col(c) for c in _X]
    near = F.greatest(F.least(_distance(), F.lit(2.0**_HIGH)), F.lit(2.0**_LOW))
    joined = cells.join(state.select("_g", "_s", "_m", "_p"), "_g").select("_g", "_s", F.ceil(F.log2(near) * BINS).cast("int").alias("_b"), "_n", *x)
    sums = joined.groupBy("_g", "_s", "_b").agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_n") * v).alias(f"_t{i}") for i, v in enumerate(x)], *[F.sum(F.col("_n") * x[i] * x[j]).alias(f"_t{i}{j}") for i, j in _PAIRS])
    moments = F.array(*[F.col(c) for c in sums.columns[3:]])
    lists = sums.groupBy("_g", "_s").agg(F.collect_list(F.struct(F.col("_b"), moments.alias("_t"))).alias("_l"))
    both = lists.join(state, ["_g", "_s"]).select(*_FIELDS[:-1], "_l")

    def run(batches):
        for batch in batches:
            old = batch.select(_FIELDS[:-1]).to_pylist()
            rows = []
            for i, e in enumerate(old):
                bins, t = batch.column(batch.num_columns - 1)[i].values.flatten()
                mean, cov, det = dense_half(bins.to_numpy(), t.flatten().to_numpy().reshape(len(bins), -1), e["_flat"])
                if det < e["_det"] - FALL:
                    held = np.array([e["_flat"] >> k & 1 for k in range(DIM)], bool)
                    inverse = np.linalg.inv(spread_of(cov, e["_flat"]))
                    inverse[held], inverse[:, held] = 0.0, 0.0  # distances of the free statistics choose
                    rows.append((e["_g"], e["_s"], e["_rows"], mean, inverse.ravel(), e["_flat"], det, True))
                else:
                    rows.append((*e.values(), False))
            yield _state(rows)

    return _few(both).mapInArrow(run, _STATE)


def _best(state: DataFrame) -> DataFrame:
    """The start with the least determinant; of equal ones the first."""
    rest = [c for c in _FIELDS if c not in ("_g", "_det")]
    return state.groupBy("_g").agg(F.min(F.struct("_det", *rest)).alias("_b")).select("_g", *[F.col(f"_b.{c}").alias(c) for c in _FIELDS[1:]])


def estimates(cells: DataFrame) -> DataFrame:
    """The estimate of each group: its rows, _m, _p (of the free statistics) and _flat. Every step
    lowers the determinant of each start that goes on, so no half comes twice and the loop ends."""
    moving, still, step = written(_start(cells), "quality-start"), [], 0
    while not moving.isEmpty():
        new = written(_concentrate(cells, moving), "quality-step")
        step += 1
        if step < TRIAL_STEPS:
            moving = new  # a start that stood still does so again
            continue
        if step == TRIAL_STEPS:
            new = written(_few(_best(new)), "quality-best")
        still.append(new.filter("not _moved"))
        moving = new.filter("_moved")
    out = moving
    for d in still:
        out = out.unionByName(d)
    return written(_few(out), "quality-settled")


def _blended(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(_g2, _m, _p): for each group the centre and inverse spread after blending. groups: (_g2, _g1)."""
    state = found.select("_g", F.struct("_rows", "_m", "_p", "_flat").alias("_e"))
    wide = groups.select("_g2", "_g1", F.lit(0).cast("long").alias("_g0"))
    for k in (0, 1, 2):
        wide = wide.join(state.select(F.col("_g").alias(f"_g{k}"), F.col("_e").alias(f"_e{k}")), f"_g{k}")
    wide = wide.select("_g2", "_e0", "_e1", "_e2")

    def own(e: dict) -> tuple[np.ndarray, np.ndarray, float]:
        p = np.array(e["_p"]).reshape(DIM, DIM)
        free = [i for i in range(DIM) if not e["_flat"] >> i & 1]
        spread = np.diag(np.square(LEAST))
        if free and e["_rows"] > 1:
            spread[np.ix_(free, free)] = np.linalg.inv(p[np.ix_(free, free)])
        return np.array(e["_m"]), spread, float(e["_rows"])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                mean, spread, _ = own(row["_e0"])
                for k in ("_e1", "_e2"):
                    m, c, n = own(row[k])
                    w = n / (n + PRIOR_ROWS)
                    mean, spread = w * m + (1 - w) * mean, w * c + (1 - w) * spread
                rows.append((mean, np.linalg.inv(spread).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (0, 1)]], names=["_g2", "_m", "_p"])

    return wide.mapInArrow(run, "_g2 long, _m array<double>, _p array<double>")


def _group(level: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(level), *[v for c in columns for v in (named(c).isNull(), F.coalesce(named(c).cast("string"), F.lit("")))])


def _judged(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds base_failed, distance and kept to a table of counts that can be read repeatedly."""
    ship(rows.sparkSession)
    grouped = rows.withColumn("base_failed", base_failed()).select("*", *_statistics(), _group(2, lang, source).alias("_g2"), _group(1, lang).alias("_g1"))
    good = grouped.filter(~F.col("base_failed"))
    cells = good.groupBy("_g2", "_g1", *_X).agg(F.count("*").alias("_n"))
    cells = written(cells, "quality-cells")
    groups = written(cells.select("_g2", "_g1").distinct(), "quality-groups")
    levels = cells.select(F.explode(F.array(F.col("_g2"), F.col("_g1"), F.lit(0).cast("long"))).alias("_g"), *_X, "_n").groupBy("_g", *_X).agg(F.sum("_n").alias("_n"))
    limits = written(_blended(groups, estimates(written(levels, "quality-levels"))), "quality-limits")
    most = chi2_quantile(1 - TAIL, DIM)
    out = grouped.join(limits, "_g2", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(most), F.lit(True)))
    return out.select(*map(named, rows.columns), "base_failed", "distance", "kept")


def verdicts(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds base_failed, distance (null where base_failed) and kept to rows of text_counts. The rows
    are written once."""
    return _judged(written(without(counted, ["base_failed", "distance", "kept"]), "quality-counts"), lang, source)


def keep_good(docs: DataFrame, lang: str = "lang", source: str = "source", text_column: str = "text") -> DataFrame:
    """The documents that pass, with their columns. Texts are written once beside their counts, so
    that neither they nor their keys are shuffled; fits read the counts alone."""
    inner = numbered(docs)
    rows = written(text_counts(inner, inner.columns, place(docs, text_column)), "quality-counts")
    judged = _judged(rows, place(docs, lang), place(docs, source))
    return judged.filter("kept").select(*inner.columns).toDF(*docs.columns)
