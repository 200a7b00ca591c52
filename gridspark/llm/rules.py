"""Quality rules with robust multivariate outliers.

Every whole text gives a few counts, and from these a vector of transformed rates. For each
language and source a minimum-covariance-determinant estimate of the vectors' centre and scatter is
made over all rows, and a text is rejected when its squared Mahalanobis distance exceeds a far quantile of the
chi-square distribution.

Three starts (centres by medians or modes, scales fixed or by quartiles) go through concentration steps side by side; of each group
that one stays whose covariance has the least determinant. The steps run as aggregations: rows are summed by group and by a fine
logarithmic bin of their distance; the bins from the nearest on that together hold
at least the share `h` are the next subset (ties at its edge belong to it), and their sums give its mean and covariance. So a
group that holds a third of all rows is a few hundred partial sums, every row counts,
and reruns choose the same subsets. A last step reweights: all rows within the 97.5 % quantile.

The same estimates are made for each language and for all rows. A group's centre and scatter are drawn towards its language's, and these towards the
whole's, with the weight of `prior` rows: a small group leans on its language, a large one on itself, and there is no size at which this changes.

Defined results: null text has no words (it fails the base rule); null lang or source is a value of its own; rows are judged one by one, so repeated
rows have equal verdicts and ties too; a very long text takes some hundred bytes a word at most; without any row that passes the base rule the method has no verdict;
an empty table gives an empty table; other columns are not read, so their names cannot clash. Scatter has a noise floor per
statistic, so that a statistic that is constant in a group rejects nothing by rounding.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, by_group, col, in_batches, small

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: The vector, and the least standard deviation each of its parts is given.
PARTS = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
FLOORS = (0.12, 0.045, 0.12, 0.12, 0.08)
P = len(PARTS)
#: Distance bins an octave, and the range of log2 distance they cover.
PER_OCTAVE, LOW, HIGH = 16, -20, 40

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_RNG = np.random.default_rng(7)
_MIX = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions covered by windows of ids that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    u = ids.astype(np.uint64)
    h = u[:n] * _MIX[0]
    for j in range(1, window):
        h += u[j : j + n] * _MIX[j]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]  # equal windows have equal sums
    if not same.any():
        return 0
    at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    at, start = order[at], np.r_[True, s[at[1:]] != s[at[:-1]]]
    group, lead = np.cumsum(start) - 1, at[start]
    equal = np.ones(len(at), bool)
    for j in range(window):
        equal &= u[at + j] == u[lead[group] + j]
    if not equal.all():  # different windows of one sum: told apart by themselves
        own = [u[i : i + window].tobytes() for i in at]
        times = Counter(own)
        equal = np.array([times[x] > 1 for x in own])
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[equal], 1)
    np.add.at(edge, at[equal] + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    b = np.frombuffer(raw, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        int(((b >= 65) & (b <= 90)).sum()),
    )


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([counts(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x) for x in got.T)], names=["id", "lang", "source", *COUNTS])

    rows = docs.select(col(id_col).cast("long").alias("id"), *[col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return in_batches(rows).mapInArrow(run, "id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> dict:
    rate = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "word_length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        "symbols": rate("n_symbols", "word_chars"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "capitals": rate("n_capitals", "word_chars"),
    }


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma at (k/2, x/2), by its power series or, far out, its continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in PAIRS]


def _moments(n: float, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = sums[:P] / n
    cov = np.empty((P, P))
    for x, (i, j) in zip(sums[P:] / n, PAIRS):
        cov[i, j] = cov[j, i] = x - mean[i] * mean[j]
    return mean, cov


def _with_floor(cov: np.ndarray) -> np.ndarray:
    """The scatter plus a noise floor a part, which bounds its least eigenvalue: two parts that move
    together in the core of a group then reject no text in which only one of them moves a little."""
    return cov + np.diag(np.square(FLOORS))


MODEL_DDL = "lang string, source string, start int, mean array<double>, cov array<double>, inverse array<double>, log_det double, n long"
GROUP = ["lang", "source", "start"]
STARTS = 3


def _model(pdf: pd.DataFrame, start: int, mean: np.ndarray, cov: np.ndarray, n: float) -> pd.DataFrame:
    whole = _with_floor(cov)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "source": [pdf["source"].iloc[0]], "start": [start], "mean": [mean], "cov": [cov.ravel()], "inverse": [np.linalg.inv(whole).ravel()], "log_det": [np.linalg.slogdet(whole)[1]], "n": [int(n)]})


def concentrate(bins: np.ndarray, n: np.ndarray, sums: np.ndarray, h: float, reweight: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance (made consistent at the normal) and rows of the next subset, from counts and sums by bin of distance."""
    share = 0.975 if reweight else h
    limit = chi2_quantile(share, P)
    order = np.argsort(bins)
    bins, n, sums = bins[order], n[order], sums[order]
    if reweight:  # all rows within the quantile
        keep = bins <= math.floor(math.log2(limit) * PER_OCTAVE)
        keep[0] = True
    else:
        keep = np.r_[0, np.cumsum(n)[:-1]] < h * n.sum()
    mean, cov = _moments(n[keep].sum(), sums[keep].sum(0))
    return mean, cov * share / chi2_cdf(limit, P + 2), n.sum()


def _step(h: float, reweight: bool):
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, cov, n = concentrate(pdf["bin"].to_numpy(), pdf["n"].to_numpy(float), pdf[SUMS].to_numpy(float), h, reweight)
        return _model(pdf, int(pdf["start"].iloc[0]), mean, cov, n)

    return step


#: Width of the histogram that starts are read from.
WIDTH = 1 / 64


def starts(bins: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and standard deviations to start from, by histograms of the parts: medians with the floors alone; medians, then modes, with the quartiles' range."""
    middle, mode, spread = [], [], []
    for x, n in zip(bins, counts):
        order = np.argsort(x)
        x, n = x[order], n[order]
        total = np.cumsum(n)
        low, mid, high = (float(x[np.searchsorted(total, total[-1] * q)]) + 0.5 for q in (0.25, 0.5, 0.75))
        middle.append(mid * WIDTH)
        mode.append((float(x[n.argmax()]) + 0.5) * WIDTH)
        spread.append((high - low) * WIDTH / 1.349)
    none = np.zeros(P)
    return [(np.array(middle), none), (np.array(middle), np.array(spread)), (np.array(mode), np.array(spread))]


def _distance(mean: str = "mean", inverse: str = "inverse"):
    """Squared Mahalanobis distance; the sum is written out, so it stays in generated code."""
    d = [F.col(p) - F.get(mean, F.lit(i)) for i, p in enumerate(PARTS)]
    terms = [(1 if i == j else 2) * F.get(inverse, F.lit(i * P + j)) * d[i] * d[j] for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def mcd(rows: DataFrame, staged: Staged, *, h: float = 0.75, c_steps: int = 4, bound: int = 20_000) -> DataFrame:
    """MODEL_DDL rows, one for each (lang, source) of rows, which have the parts as columns."""
    hist = rows.select("lang", "source", F.posexplode(F.array(*PARTS)).alias("part", "x"))
    hist = hist.groupBy("lang", "source", "part", F.floor(F.col("x") / WIDTH).alias("bin")).agg(F.count("*").alias("n"))

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        of = [pdf[pdf["part"] == part] for part in range(P)]
        found = starts([x["bin"].to_numpy() for x in of], [x["n"].to_numpy() for x in of])
        return pd.concat([_model(pdf, k, mean, np.diag(np.square(sd)), of[0]["n"].sum()) for k, (mean, sd) in enumerate(found)])

    model = staged.put(by_group(hist, ["lang", "source"], start, MODEL_DDL))
    groups = model.count()
    for k in range(c_steps + 1):
        last = k == c_steps
        if last:  # of each group the start of least determinant
            best = F.min_by(F.struct(*[c for c in model.columns if c not in ("lang", "source")]), F.struct("log_det", "start"))
            model = model.groupBy("lang", "source").agg(best.alias("m")).select("lang", "source", "m.*")
        near = apply_model(rows, model, groups, bound)
        log = F.floor(F.log2(F.greatest("distance", F.lit(2.0**LOW))) * PER_OCTAVE)
        binned = near.withColumn("bin", F.least(log, F.lit(HIGH * PER_OCTAVE)))
        sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(PARTS)] + [F.sum(F.col(PARTS[i]) * F.col(PARTS[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
        binned = binned.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"), *sums)
        before, model = model, staged.put(by_group(binned, GROUP, _step(h, last), MODEL_DDL))
        if not last:
            staged.drop(before)
    return model


def apply_model(rows: DataFrame, model: DataFrame, groups: int, bound: int = 20_000) -> DataFrame:
    """Rows with their distance, one for each start that the model has of their group."""
    m = model.select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "mean", "inverse", *[c for c in ("start",) if c in model.columns])
    on = F.col("lang").eqNullSafe(F.col("m_lang")) & F.col("source").eqNullSafe(F.col("m_source"))
    return rows.join(small(m, groups, bound), on, "left").withColumn("distance", _distance()).drop("m_lang", "m_source", "mean", "inverse")


#: Stands for all sources, and for all languages.
POOL = "\x00pool"


def drawn(levels: list[tuple[float, np.ndarray, np.ndarray]], prior: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and scatter of the innermost of (rows, mean, covariance), from the outermost on each drawn towards the one before by `prior` rows."""
    out = None
    for n, mean, cov in levels:
        if not n:
            continue
        w = 1.0 if out is None else n / (n + prior)
        out = (mean, cov) if out is None else (w * mean + (1 - w) * out[0], w * cov + (1 - w) * out[1])
    return out


def shrunk(groups: DataFrame, model: DataFrame, n_models: int, prior: float, bound: int = 20_000) -> DataFrame:
    """(lang, source, mean, inverse) of every group, drawn towards its language and the whole."""
    levels = []
    for name, lang, source in (("g", F.col("lang"), F.col("source")), ("l", F.col("lang"), F.lit(POOL)), ("w", F.lit(POOL), F.lit(POOL))):
        m = model.select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), F.struct("n", "mean", "cov").alias(name))
        groups = groups.join(small(m, n_models, bound), lang.eqNullSafe(F.col("m_lang")) & source.eqNullSafe(F.col("m_source")), "left").drop("m_lang", "m_source")
        levels.insert(0, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                found = drawn([(m["n"], np.array(m["mean"]), np.array(m["cov"]).reshape(P, P)) for m in (r[x] for x in levels) if m is not None], prior)
                if found:
                    out.append((r["lang"], r["source"], found[0], np.linalg.inv(_with_floor(found[1])).ravel()))
            yield pd.DataFrame(out, columns=["lang", "source", "mean", "inverse"])

    return groups.mapInPandas(run, "lang string, source string, mean array<double>, inverse array<double>")


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    prior: float = 50,
    quantile: float = 1 - 1e-8,
    h: float = 0.75,
    staged: Staged | None = None,
) -> DataFrame:
    """id, lang, source, the counts, base_failed, distance (null without a verdict) and kept, one row per input row."""
    staged = staged or Staged(docs.sparkSession, "rules")
    rows = text_counts(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = staged.put(rows.withColumn("base_failed", failed).withColumns(vector()))
    # Every row counts in its group, in its language and in the whole.
    levels = F.array(*[F.struct(a.alias("lang"), b.alias("source")) for a, b in ((F.col("lang"), F.col("source")), (F.col("lang"), F.lit(POOL)), (F.lit(POOL), F.lit(POOL)))])
    fit = rows.where(~F.col("base_failed")).select(F.explode(levels).alias("of"), *PARTS).select("of.lang", "of.source", *PARTS)
    model = mcd(fit, staged, h=h)
    groups = staged.put(rows.select("lang", "source").distinct(), 1)
    n_models, n = model.count(), groups.count()
    model = staged.put(shrunk(groups, model, n_models, prior))
    judged = apply_model(rows, model, n)
    far = F.coalesce(F.col("distance") > chi2_quantile(quantile, P), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select("id", "lang", "source", *COUNTS, "base_failed", "distance", "kept")
