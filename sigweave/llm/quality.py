"""Quality rules: base statistics of each text, and robust multivariate outliers among them.

`statistics` counts words, characters in words, symbols, repeated lines and repeated runs of
words over whole texts. `outliers` estimates, for each language and source, a location and a
scatter of the transformed statistics by the minimum covariance determinant, and rejects the
rows whose Mahalanobis distance from it is over a chi-squared quantile.

The determinant is that of the regularised scatter T + c S, as in the minimum regularised
covariance determinant: S is the covariance of COVERAGE of a stratum's rows, c makes it
consistent for normal rows, and T is diagonal with the squares of FLOORS. Most texts have no
symbol and no repeat at all, so without T the least determinant is 0 and says nothing.

STARTS estimates of each stratum (medians and absolute deviations, all rows, and small sets of
rows chosen by a hash) take concentration steps: the COVERAGE share of the rows nearest to an
estimate gives the next one, whose determinant is no greater. After two steps the BEST
determinants of a stratum go on until a step gains less than TOLERANCE, and the least is
taken. A step sums moments by bins of distance, and the bin that the share ends in counts in
part, so that every step has exactly the same share. All rows take part; a shuffle carries
one sum for each task, estimate and bin, so a source with a third of all rows costs no more
than others.

A language and source of fewer than LEAST rows is judged by the estimate of all rows of its
language, and a language of fewer by that of all rows.

Null text: no words, so the base rules fail it. Null language or source: strata of their own.
Ties in the distance are kept or rejected alike. Repeated rows and ids are judged each on its
own. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm import words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: The least scatter (a standard deviation) that each transformed statistic is given.
FLOORS = {"log_words": 0.8, "log_length": 0.12, "symbols": 0.25, "dup_lines": 0.12, "repeats": 0.15}
FEATURES = list(FLOORS)
COVERAGE, LEAST = 0.75, 60
STARTS, DRAWN, BEST = 6, 24, 2
TOLERANCE, STEPS = 1e-3, 40
#: Bins of distance to an octave.
BINS = 16
#: The most strata whose estimates are broadcast, some 2 KB each; more are joined by a shuffle.
BROADCAST = 10_000
#: Chi-squared with five degrees of freedom at 1 - 1e-6.
CUTOFF = 35.89


def count_block(texts: list[bytes]) -> np.ndarray:
    """COUNTS of each text of a block, as rows."""
    h, at = words.hashes(texts)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    out[:, 0] = np.diff(at)
    for i, t in enumerate(texts):
        buf = np.frombuffer(t, np.uint8)
        out[i, 1] = np.count_nonzero(~words.is_space(buf) & ((buf & 0xC0) != 0x80))
        out[i, 2] = np.count_nonzero(_SYMBOL[buf])
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 3], out[i, 4] = len(lines), len(lines) - len(set(lines))
    g, gat = words.windows(h, at, 5)
    own = words.owners(gat)
    order = np.lexsort((g, own))
    same = (g[order][1:] == g[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = np.flatnonzero(twice)
    first = first + (at[:-1] - gat[:-1])[own[first]]  # from a window's place to its first word's
    covered = np.zeros(len(h) + 1, np.int64)
    for j in range(5):
        covered[first + j] = 1
    out[:, 5] = np.add.reduceat(covered, at[:-1]) * (np.diff(at) > 0) if len(texts) else 0
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, *keep, *COUNTS) of each row."""
    columns = [id_col, *keep]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = words.encoded(part.column(len(columns)))
                if not texts:
                    continue
                found = np.concatenate([count_block(texts[i:j]) for i, j in words.blocks(texts)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*columns, *COUNTS])

    return docs.select(*(docs[c] for c in columns), docs[text_col].alias("__text")).mapInArrow(run, schema)


def base_failed() -> F.Column:
    """The rules that need no other document."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def transformed(stats: DataFrame) -> DataFrame:
    """Adds FEATURES: statistics on scales where clean text is roughly normal."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "log_words": F.log(n.cast("double")),
        "log_length": F.log((F.col("word_chars") + 1) / n),
        "symbols": F.log1p(10 * F.col("n_symbols") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def _distance() -> F.Column:
    """Squared Mahalanobis distance of FEATURES from `centre` under `inverse` (row-major)."""
    k = len(FEATURES)
    away = [F.col(f) - F.col("centre")[i] for i, f in enumerate(FEATURES)]
    return sum((away[i] * away[j] * F.col("inverse")[i * k + j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)), F.lit(0.0))


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_MOMENTS = ["__w", *(f"__s{i}" for i in range(len(FEATURES))), *(f"__p{i}{j}" for i, j in _PAIRS)]


def _moments() -> list[F.Column]:
    """_MOMENTS of the rows of a group: their number, sums and sums of products."""
    terms = [F.lit(1.0), *(F.col(f) for f in FEATURES), *(F.col(FEATURES[i]) * F.col(FEATURES[j]) for i, j in _PAIRS)]
    return [F.sum(t).alias(m) for t, m in zip(terms, _MOMENTS, strict=True)]


def _solved(moments: DataFrame) -> DataFrame:
    """(stratum, start, before, centre, inverse, logdet) from (stratum, start, before, *_MOMENTS)."""
    k, floors = len(FEATURES), np.square(list(FLOORS.values()))
    rows, columns = np.array(_PAIRS).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array([b.column(c).to_numpy() for c in _MOMENTS]).T
            m = m[:, 1:] / m[:, :1]
            centre, products = m[:, :k], np.zeros((len(m), k, k))
            products[:, rows, columns] = products[:, columns, rows] = m[:, k:]
            scatter = CONSISTENCY * (products - centre[:, :, None] * centre[:, None, :]) + np.diag(floors)
            inverse = np.linalg.inv(scatter).reshape(-1, k * k)
            found = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (centre, inverse)]
            yield pa.RecordBatch.from_arrays([b.column("stratum"), b.column("start"), b.column("before"), *found, pa.array(np.linalg.slogdet(scatter)[1])], names=["stratum", "start", "before", "centre", "inverse", "logdet"])

    return moments.select("stratum", "start", "before", *_MOMENTS).mapInArrow(run, "stratum string, start int, before double, centre array<double>, inverse array<double>, logdet double")


def _consistency(share: float, k: int) -> float:
    """share / P(chi2 with k+2 degrees < its k-degree quantile at share), by bisection on series."""

    def cdf(x: float, df: int) -> float:
        term = total = 1.0 / math.gamma(df / 2 + 1)
        for i in range(1, 200):
            term *= x / 2 / (df / 2 + i)
            total += term
        return total * math.exp(-x / 2) * (x / 2) ** (df / 2)

    lo, hi = 0.0, 100.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, k) < share else (lo, mid)
    return share / cdf(lo, k + 2)


CONSISTENCY = _consistency(COVERAGE, len(FEATURES))


def _strata(stats: DataFrame) -> DataFrame:
    """(lang, source, stratum, size, judges): the strata that rows of a language and source are part of, and the one that judges them."""
    counts = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    of_lang, of_all = Window.partitionBy("lang"), Window.partitionBy(F.lit(0))  # over counts, one row for each language and source
    levels = counts.withColumns({"m": F.sum("n").over(of_lang), "least": F.min("n").over(of_lang), "t": F.sum("n").over(of_all)})
    levels = levels.withColumn("few", F.min("m").over(of_all) < LEAST)
    lang, source = F.struct(F.col("lang").alias("v")), F.struct(F.col("source").alias("v"))
    named = [
        (F.to_json(F.struct(lang.alias("l"), source.alias("s"))), "n", F.col("n") >= LEAST, F.col("n") >= LEAST),
        (F.to_json(F.struct(lang.alias("l"))), "m", (F.col("m") >= LEAST) & (F.col("least") < LEAST), (F.col("m") >= LEAST) & (F.col("n") < LEAST)),
        (F.lit("{}"), "t", F.col("few"), F.col("m") < LEAST),
    ]
    # A small language's sources are small too, so exactly one level judges each row.
    each = F.array(*(F.struct(name.alias("stratum"), F.col(size).alias("size"), member.alias("member"), judges.alias("judges")) for name, size, member, judges in named))
    return levels.select("lang", "source", F.inline(each)).where("member").drop("member")


def _joined(frame: DataFrame, small: DataFrame, on: F.Column | str, fits: bool) -> DataFrame:
    return frame.join(F.broadcast(small) if fits else small, on)


def _starts(x: DataFrame, fits: bool) -> DataFrame:
    """_MOMENTS of each stratum's starts."""
    k = range(len(FEATURES))
    medians = x.groupBy("stratum").agg(F.array(*(F.percentile_approx(f, 0.5, 1000) for f in FEATURES)).alias("c"))
    mad = _joined(x, medians, "stratum", fits).groupBy("stratum", "c").agg(F.array(*(F.percentile_approx(F.abs(F.col(f) - F.col("c")[i]), 0.5, 1000) for i, f in enumerate(FEATURES))).alias("d"))
    products = [F.col("c")[i] * F.col("c")[j] + (F.pow(F.col("d")[i] * 1.4826, 2) if i == j else 0.0) for i, j in _PAIRS]
    first = mad.select("stratum", F.lit(0).alias("start"), *(v.alias(m) for v, m in zip([F.lit(1.0), *(F.col("c")[i] for i in k), *products], _MOMENTS, strict=True)))
    share = DRAWN / F.col("size") * 2.0**32
    drawn = F.filter(F.sequence(F.lit(1), F.lit(STARTS - 1)), lambda r: (r == 1) | (F.xxhash64(*(c for c in x.columns), r).bitwiseAND(0xFFFFFFFF) < share))
    rest = x.select("*", F.explode(drawn).alias("start")).groupBy("stratum", "start").agg(*_moments())
    return first.unionByName(rest).withColumn("before", F.lit(None).cast("double"))


def _concentrated(x: DataFrame, params: DataFrame, fits: bool) -> DataFrame:
    """_MOMENTS of the COVERAGE share of each stratum nearest to each of its estimates; `before` is the estimate's determinant."""
    binned = _joined(x, params.withColumn("before", F.col("logdet")), "stratum", fits).withColumn("bin", F.floor(F.log2(_distance() + 0.01) * BINS))
    keys = ["stratum", "start", "before"]
    sums = binned.groupBy(*keys, "size", "bin").agg(*_moments())
    upto = F.sum("__w").over(Window.partitionBy("stratum", "start").orderBy("bin"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("size") * COVERAGE - upto + F.col("__w")) / F.col("__w")))
    weighed = sums.withColumn("part", part).where("part > 0")
    return weighed.groupBy(*keys).agg(*(F.sum(F.col(m) * F.col("part")).alias(m) for m in _MOMENTS))


def estimates(x: DataFrame, fits: bool = True) -> DataFrame:
    """(stratum, centre, inverse, logdet) of the rows (stratum, size, *FEATURES); `fits` says that the strata may be broadcast."""
    running = _solved(_starts(x, fits)).checkpoint()
    settled = []
    for step in range(1, STEPS + 1):
        running = _solved(_concentrated(x, running, fits)).checkpoint()
        if step == 1:
            continue  # a start's own determinant is of another share
        if step == 2:
            order = Window.partitionBy("stratum").orderBy("logdet", "start")
            running = running.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= BEST).drop("__r")
        still = F.col("before") - F.col("logdet") >= TOLERANCE
        settled.append(running.where(~still))
        running = running.where(still)
        if running.isEmpty():
            break
    found = reduce(DataFrame.unionByName, [*settled, running])
    best = found.groupBy("stratum").agg(F.min_by(F.struct("centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("b"))
    return best.select("stratum", "b.*")


def outliers(stats: DataFrame) -> DataFrame:
    """Adds `distance` (squared) and `outlier` to transformed statistics with lang and source."""
    strata = _strata(stats).checkpoint()
    fits = strata.count() <= BROADCAST
    named = strata.withColumnsRenamed({"lang": "__l", "source": "__s"})
    mine = stats["lang"].eqNullSafe(named["__l"]) & stats["source"].eqNullSafe(named["__s"])
    params = estimates(_joined(stats, named, mine, fits).select("stratum", "size", *FEATURES), fits).checkpoint()
    judges = named.where("judges").join(params.drop("logdet"), "stratum")
    judged = _joined(stats, judges, mine, fits).withColumn("distance", _distance())
    return judged.withColumn("outlier", F.col("distance") > CUTOFF).drop("stratum", "size", "judges", "centre", "inverse", "__l", "__s")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, *COUNTS, *FEATURES, base_failed, distance, outlier, kept) of each row of (doc_id, text, lang, source).

    The statistics are written to the checkpoint folder, as all steps read them again.
    """
    stats = transformed(statistics(docs)).checkpoint()
    return outliers(stats).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
