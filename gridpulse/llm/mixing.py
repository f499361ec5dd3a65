"""Mixing to target weights with soft domain membership.

A classifier fitted to the labelled rows gives every document its posteriors over the domains. Each document gets a nonnegative rate (expected
copies); projected-gradient least squares moves the rates, from 1 for all, until the expected tokens of each domain,
sum over documents of rate * tokens * posterior, meet the targets. A step needs one distributed sum of as many numbers as there are domains; the
rates themselves never leave the table. The residuals are weighted with the inverse Gram matrix of the domain token vectors, so that
domains of very different size converge alike. The gradient steps are accelerated and end when a lower bound of the objective,
found in the same sums, shows that the rates are the least-squares solution. Only DataFrame functions touch the rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, remove, run_folder, text_of, written

#: Domains by the labels table, and the share of the mixture's tokens each is to have.
DOMAINS = {"plain": "quality = 1 and toxic = 0", "toxic": "toxic = 1", "junk": "quality = 0 and toxic = 0"}
WEIGHTS = {"plain": 0.97, "toxic": 0.01, "junk": 0.02}
#: Hashed word features; the model is FEATURES x domains numbers.
FEATURES = 16_384
#: Labelled rows that the classifier is fitted to, at most.
MAX_LABELLED = 20_000
#: Features count whose rate in a domain lies so many standard deviations from the rate in all labelled rows; the others are noise that adds up in long texts.
LEAST_DEVIATION = 4.0
#: Labelled rows of average content that each domain is smoothed with.
SMOOTHING_ROWS = 10
#: Newton steps of the calibration at most, and the rows' worth of its pull to the start.
NEWTON_STEPS, PULL = 20, 1.0
#: Copies of a document at most, unless the caller bounds them otherwise. Without a bound least squares buys the last tokens of a target with hundreds of copies of a few documents.
MAX_RATE = 2.0
TOLERANCE = 1e-4
#: Rates are the solution when the objective is proven to lie within this share of its smallest value (and of what the steps can gain); more steps than this are an error.
OPTIMALITY = 0.005
MAX_STEPS = 1000
#: Words a posterior may rest on: the log odds of longer texts are scaled down to it.
EVIDENCE_WORDS = 400


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FEATURES).cast("long")).cast("int")


def _features(text: str) -> Column:
    return F.array_distinct(F.transform(_words(F.col(text)), _feature))


def _model(seen: dict, sizes: dict, k: int) -> list[list[float]]:
    """Log odds per feature of each domain but the first against the first: naive Bayes over hashed words. A domain's rate of a feature is smoothed
    towards the rate in all rows, and is that rate unless it differs by ``LEAST_DEVIATION``."""
    n = sum(sizes.values())
    chance = [[1.0] * FEATURES for _ in range(k)]
    for f in {f for _, f in seen}:
        rate = sum(seen.get((j, f), 0) for j in range(k)) / n
        for j in range(k):
            size, count = sizes.get(j, 0), seen.get((j, f), 0)
            deviation = abs(count - size * rate) / math.sqrt(size * rate * (1 - rate) * (1 - size / n) + 0.25)
            chance[j][f] = (count + SMOOTHING_ROWS * rate) / (size + SMOOTHING_ROWS) if deviation > LEAST_DEVIATION else rate
    return [[math.log(c / b) for c, b in zip(chance[j], chance[0])] for j in range(1, k)]


def _evidence(rows: DataFrame, odds: list[list[float]]) -> DataFrame:
    """``rows`` with the column ``features`` replaced by ``e_1``, ...: the log odds of each domain but the first, those of texts with more than
    ``EVIDENCE_WORDS`` distinct features scaled down to it. No join and no shuffle; the steps are projections of their own, so that each is computed once."""
    tables = [F.split(F.lit(" ".join(f"{x:.5f}" for x in row)), " ").cast("array<double>") for row in odds]
    rest = [c for c in rows.columns if c != "features"]
    summed = lambda table: F.aggregate("features", F.lit(0.0), lambda a, f: a + F.get(table, f))
    rows = rows.select(*rest, F.least(F.lit(1.0), F.lit(float(EVIDENCE_WORDS)) / F.greatest(F.lit(1.0), F.size("features"))).alias("scale"),
                       *(summed(t).alias(f"odds_{j}") for j, t in enumerate(tables, 1)))
    return rows.select(*rest, *((F.col(f"odds_{j}") * F.col("scale")).alias(f"e_{j}") for j in range(1, len(odds) + 1)))


def _chances(rows: DataFrame, theta: list[float]) -> DataFrame:
    """``rows`` with ``p_0``, ...: softmax of 0 and theta[0] * e_j + theta[j]."""
    k = len(theta)
    names = rows.columns
    rows = rows.select(*names, F.lit(0.0).alias("z_0"), *((F.lit(theta[0]) * F.col(f"e_{j}") + F.lit(theta[j])).alias(f"z_{j}") for j in range(1, k)))
    rows = rows.withColumn("top", F.greatest(*(F.col(f"z_{j}") for j in range(k))) if k > 1 else F.col("z_0"))
    rows = rows.select(*names, *(F.exp(F.col(f"z_{j}") - F.col("top")).alias(f"w_{j}") for j in range(k)))
    total = sum((F.col(f"w_{j}") for j in range(1, k)), F.col("w_0"))
    return rows.select(*names, *((F.col(f"w_{j}") / total).alias(f"p_{j}") for j in range(k)))


def _calibrated(scored: DataFrame, theta: list[float]) -> list[float]:
    """The slope of the evidence and the domains' offsets under which rows that the evidence was not fitted to (k, e_1, ...) are likeliest: Newton steps from ``theta``,
    each one sum; a pull of ``PULL`` rows towards the start keeps them finite."""
    k, start = len(theta), theta
    e = [F.lit(0.0), *(F.col(f"e_{j}") for j in range(1, k))]

    def sums(theta: list[float]) -> tuple[float, list[float], list[list[float]]]:
        rows = _chances(scored, theta)
        p = [F.col(f"p_{j}") for j in range(k)]
        mean = sum((x * y for x, y in zip(p, e)), F.lit(0.0))
        mine = lambda cells: sum((F.when(F.col("k") == j, c).otherwise(0.0) for j, c in enumerate(cells)), F.lit(0.0))
        grad = [mine(e) - mean, *(mine([F.lit(float(i == j)) for i in range(k)]) - p[j] for j in range(1, k))]
        bend = {(0, 0): sum((x * y * y for x, y in zip(p, e)), F.lit(0.0)) - mean * mean}
        bend |= {(0, j): p[j] * (e[j] - mean) for j in range(1, k)}
        bend |= {(i, j): p[i] * (float(i == j) - p[j]) for i in range(1, k) for j in range(i, k)}
        got = rows.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in (-F.log(F.greatest(mine(p), F.lit(1e-300))), *grad, *bend.values()))).first()
        off = [t - s for t, s in zip(theta, start)]
        curve = dict(zip(bend, got[1 + k:]))
        return (got[0] + PULL * _dot(off, off) / 2, [g - PULL * o for g, o in zip(got[1:1 + k], off)],
                [[curve[min(i, j), max(i, j)] + PULL * (i == j) for j in range(k)] for i in range(k)])

    loss, grad, bend = sums(theta)
    for _ in range(NEWTON_STEPS):
        step = [_dot(row, grad) for row in _inverse(bend)]
        if max(map(abs, step)) < 1e-4:
            break
        size = 1.0
        while size > 1e-3:
            tried = [t + size * x for t, x in zip(theta, step)]
            tried[0] = max(0.0, tried[0])  # evidence never counts against itself
            found = sums(tried)
            if found[0] <= loss:
                break
            size /= 4
        else:
            break
        theta, (loss, grad, bend) = tried, found
    return theta


def fit_classifier(docs: DataFrame, labels: DataFrame, folder: str, domains: dict[str, str] = DOMAINS, max_labelled: int = MAX_LABELLED) -> tuple[list[float], list[list[float]]]:
    """(calibration, log odds per feature of each domain but the first).

    Naive Bayes over hashed words, fitted to at most ``max_labelled`` labelled rows, those with the smallest id hashes; the sample is so bounded that it may be broadcast.
    Its evidence is calibrated on held-out rows: either half of the labelled rows is scored by a model of the other half, and one slope and an offset per domain
    are fitted to these scores. Without labelled rows all domains are equally likely.
    """
    k = len(domains)
    domain = F.coalesce(*(F.when(F.expr(rule), j) for j, rule in enumerate(domains.values())))
    sample = (labels.select("doc_id", domain.alias("k")).filter("k is not null and doc_id is not null").dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    labelled = written(docs.select("doc_id", text_of().alias("t")).join(F.broadcast(sample), "doc_id").select("k", half.alias("half"), _features("t").alias("features")), folder, "labelled")
    seen, sizes = [{}, {}], [{}, {}]
    for r in labelled.select("half", "k", F.explode("features").alias("f")).groupBy("half", "k", "f").count().collect():  # at most 2 * domains * FEATURES
        seen[r.half][r.k, r.f] = r["count"]
    for r in labelled.groupBy("half", "k").count().collect():
        sizes[r.half][r.k] = r["count"]
    both = lambda a, b: {x: a.get(x, 0) + b.get(x, 0) for x in {*a, *b}}
    every = both(*sizes)
    prior = [math.log(every.get(j, 0) + 1) for j in range(k)]
    theta = [1.0, *(p - prior[0] for p in prior[1:])]
    if k > 1 and all(sizes):
        held_out = [_evidence(labelled.filter(F.col("half") == h), _model(seen[1 - h], sizes[1 - h], k)) for h in (0, 1)]
        theta = _calibrated(written(held_out[0].union(held_out[1]), folder, "held-out"), theta)
    return theta, _model(both(*seen), every, k)


def with_posteriors(rows: DataFrame, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """``rows`` with the text column ``t`` replaced by ``posteriors``, an array over the domains."""
    theta, odds = model
    rest = [c for c in rows.columns if c != "t"]
    rows = _chances(_evidence(rows.select(*rest, _features("t").alias("features")), odds), theta)
    return rows.select(*rest, F.array(*(F.col(f"p_{j}") for j in range(len(theta)))).alias("posteriors"))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a small symmetric matrix, a little ridge added for domains without tokens."""
    n = len(m)
    ridge = 1e-9 * max(1e-12, max(m[i][i] for i in range(n)))
    a = [[m[i][j] + (ridge if i == j else 0.0) for j in range(n)] + [float(i == j) for j in range(n)] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i])]
    return [row[n:] for row in a]


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b))


def _solved(rows: DataFrame, folder: str, target: list[float], expected: list[float], gram: list[list[float]], max_rate: float, max_steps: int, met: float) -> DataFrame:
    """``rows`` with the rates from 0 to ``max_rate`` that are least squares for the targets: accelerated projected gradient, restarted when the objective goes up.

    ``expected`` and ``gram`` are those of rate 1 for all; the metric is the inverse of ``gram`` throughout, so a step of 1 never overshoots. Every step is one sum,
    which also gives the dual objective at the step's gradient: a lower bound of what any rates can reach. The steps end when the objective is within ``OPTIMALITY`` of the best
    bound, or all totals within ``met`` of their targets; if ``max_steps`` come first, RuntimeError gives the residuals.
    """
    k, spark, metric = len(target), rows.sparkSession, _inverse(gram)
    names = rows.columns
    share = [F.col("n_tokens") * F.get("posteriors", j) for j in range(k)]

    def objective(totals: list[float]) -> float:
        gap = [e - t for e, t in zip(totals, target)]
        return _dot(gap, [_dot(row, gap) for row in metric]) / 2

    start = min(1.0, float(max_rate))
    now = before = [start * e for e in expected]
    rows = rows.select(*names, F.lit(start).alias("last"), F.lit(start).alias("rate"))
    value = first = objective(now)
    bound, inertia, step, table = 0.0, 1.0, 0, None  # no objective is below 0
    while max(abs(e - t) for e, t in zip(now, target)) > met and value - bound > OPTIMALITY * min(value, first - bound) + 1e-9 * first:
        if step == max_steps:
            raise RuntimeError(f"mixing: rates are not least squares after {step} steps: objective {value:.6g}, lower bound {bound:.6g}, residual tokens {[e - t for e, t in zip(now, target)]}")
        further = (1 + math.sqrt(1 + 4 * inertia * inertia)) / 2
        beta = (inertia - 1) / further
        gap = [e + beta * (e - b) - t for e, b, t in zip(now, before, target)]
        pull = [_dot(row, gap) for row in metric]
        # a projection of its own, so that a rate is computed once
        rows = rows.select(*names, F.col("last").alias("older"), F.col("rate").alias("last"), sum((s * F.lit(p) for s, p in zip(share, pull)), F.lit(0.0)).alias("slope"))
        rows = rows.select(*names, "last", "slope", F.least(F.lit(float(max_rate)), F.greatest(F.lit(0.0), F.col("last") + F.lit(beta) * (F.col("last") - F.col("older")) - F.col("slope"))).alias("rate"))
        step += 1
        if step % 10 == 0:  # the plan stays short
            rows = written(rows, folder, f"rates-{step}")
            if table is not None:
                remove(spark, table)
            table = f"{folder}/rates-{step}"
        got = rows.agg(*(F.coalesce(F.sum(F.col("rate") * s), F.lit(0.0)) for s in share), F.coalesce(F.sum(F.least(F.lit(0.0), F.col("slope"))), F.lit(0.0))).first()
        before, now = now, list(got[:k])
        bound = max(bound, max_rate * got[k] - _dot(pull, gap) / 2 - _dot(pull, target))
        inertia, value = 1.0 if objective(now) > value else further, objective(now)
    return rows.select(*names, "rate", F.array(*(F.lit(e - t) for e, t in zip(now, target))).alias("residual"))


def mix(docs: DataFrame, labels: DataFrame, folder: str, domains: dict[str, str] = DOMAINS, weights: dict[str, float] = WEIGHTS, total_tokens: float | None = None,
        whole: str | None = None, max_rate: float = MAX_RATE, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, h, n_tokens, posteriors, rate, residual): one row per row of ``docs``; h is the text's hash, tokens are words.

    ``total_tokens``: tokens of the mixture; by default as many as the domain allows that is scarcest for its weight, so that this one keeps all it has.
    ``whole``: the domain that keeps all it has instead, whatever the others have; a domain whose weight then asks for more than ``max_rate`` allows is to have
    what that allows. Rates lie from 0 to ``max_rate``. They may not reach the targets: they are the least-squares solution in the metric of the first step, to ``OPTIMALITY``, and
    ``residual``, the same in every row, has each domain's expected tokens less its target; RuntimeError if ``max_steps`` don't get there.
    Null and blank texts have no tokens, the offsets alone as evidence, and keep rate 1 (or ``max_rate``, if less), since no
    domain feels them. Null ids and repeated rows are rows like any other; labels of unknown documents are left out. An empty table gives no row.
    """
    if list(domains) != list(weights) or min(weights.values()) < 0 or sum(weights.values()) <= 0 or max_rate <= 0:
        raise ValueError("weights are nonnegative numbers for the same domains, and the largest rate is positive")
    names, k = list(domains), len(domains)
    model = fit_classifier(docs, labels, folder, domains, max_labelled)
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), text.alias("t"))
    rows = written(with_posteriors(rows, model), folder, "posteriors")
    share = [F.col("n_tokens") * F.get("posteriors", j) for j in range(k)]
    got = rows.agg(*(F.coalesce(F.sum(s), F.lit(0.0)) for s in share), *(F.coalesce(F.sum(s * t), F.lit(0.0)) for s in share for t in share)).first()
    expected, gram = list(got[:k]), [list(got[k + i * k:2 * k + i * k]) for i in range(k)]
    w = [weights[n] / sum(weights.values()) for n in names]
    if total_tokens is None and whole is not None:
        total_tokens = expected[names.index(whole)] / w[names.index(whole)]
    if total_tokens is None:
        total_tokens = min((expected[j] / w[j] for j in range(k) if w[j] > 0 and expected[j] > 0), default=0.0)
    target = [total_tokens * x for x in w]
    if whole is not None:
        target = [min(t, max_rate * e) for t, e in zip(target, expected)]
    return _solved(rows, folder, target, expected, gram, max_rate, max_steps, tolerance * max(1.0, total_tokens))


def draw(docs: DataFrame, rates: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part of the rate, and once more with the chance of the rest, by a hash of id and text.

    The decision is a function of the row, so it is the same in every run and after a lost task. Rows with equal ids and texts are drawn alike.
    """
    h, copies = free_name(docs, "h"), free_name(docs, "copies")
    keyed = docs.withColumn(h, F.xxhash64(text_of(text_column)))
    chance = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rates.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias(copies)).distinct()
    joined = keyed.join(drawn.filter(F.col(copies) > 0).hint("merge"), keyed[id_column].eqNullSafe(drawn["_i"]) & (keyed[h] == drawn["_h"]))
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(docs[c] for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rates = mix(docs, labels, run_folder(spark, "mixing"))
    return rates.select("doc_id", "n_tokens", *(F.get("posteriors", j).alias(f"p_{n}") for j, n in enumerate(DOMAINS)), "rate",
                        *(F.get("residual", j).alias(f"residual_{n}") for j, n in enumerate(DOMAINS)))
