"""Mixing by soft membership: predicted domain posteriors, and document rates whose expected token totals meet targets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, cut

_SPLIT = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")


def labelled_sample(labelled: DataFrame, key_col: str, domain_col: str, max_documents: int) -> DataFrame:
    """At most max_documents labelled rows, those whose keys hash least; of the rest, only a margin reaches the last sort."""
    rows = labelled.filter(F.col(key_col).isNotNull() & F.col(domain_col).isNotNull()).withColumn("_lot", F.pmod(F.xxhash64(F.lit("sample"), F.col(key_col)), F.lit(1 << 30)))
    n = rows.count()
    if n > max_documents:
        rows = rows.filter(F.col("_lot") < int((1 << 30) * min(1.0, (max_documents + 8 * math.sqrt(max_documents)) / n)))
        rows = rows.orderBy("_lot", key_col, domain_col).limit(max_documents)
    return rows.drop("_lot")


def train_domain_model(labelled: DataFrame, text_col: str, domain_col: str, buckets: int, smoothing: float) -> tuple[list[str], list[float], DataFrame]:
    """Multinomial naive Bayes over hashed words of the labelled texts.

    Returns the domains in order, their log priors, and bucket -> log probabilities: a table of `buckets` rows at most.
    """
    rows = labelled.select(F.col(domain_col).alias("_domain"), F.col(text_col).alias("_text")).dropna()
    sizes = {r["_domain"]: r["n"] for r in rows.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(sizes)
    words = rows.select("_domain", F.explode(_words(F.col("_text"))).alias("w")).select("_domain", F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("bucket"))
    counts = words.groupBy("bucket").agg(*[F.sum((F.col("_domain") == d).cast("double")).alias(f"c{k}") for k, d in enumerate(domains)] or [F.lit(0).alias("c")])
    counts = cut(counts)
    totals = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(len(domains))] or [F.lit(0)]).first()
    logs = [F.log((F.col(f"c{k}") + smoothing) / F.lit(totals[k] + smoothing * buckets)) for k in range(len(domains))]
    table = counts.select("bucket", F.array(*logs).alias("logs") if logs else F.array().cast("array<double>").alias("logs"))
    n = sum(sizes.values())
    return domains, [math.log(sizes[d] / n) for d in domains], table


def domain_posteriors(docs: DataFrame, model: tuple[list[str], list[float], DataFrame], buckets: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, n_tokens (words) and posterior, one number per domain; log-odds are averaged over words beyond 64 of them.

    Long texts would otherwise all look certain; words never seen in training say nothing. A text without words gets the
    priors. Rows with equal ids and texts are kept apart by a row number of the scan, not joined.
    """
    domains, priors, table = model
    k = len(domains)
    rows = docs.select(F.col(id_col).alias("_id"), *keep, _words(F.col(text_col)).alias("_w")).withColumn("_row", F.monotonically_increasing_id())
    head = ["_id", "_row", *keep]
    hashed = rows.select(*head, F.size("_w").cast("long").alias("n_tokens"), F.explode_outer("_w").alias("_x")).withColumn("bucket", F.pmod(F.xxhash64("_x"), F.lit(buckets)))
    joined = hashed.join(F.broadcast(table), "bucket", "left")
    sums = joined.groupBy(*head, "n_tokens").agg(*[F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.get("logs", F.lit(i)))), F.lit(0.0)).alias(f"s{i}") for i in range(k)] or [F.lit(0).alias("s")])
    weight = F.least(F.lit(1.0), F.lit(64.0) / F.greatest("n_tokens", F.lit(1)))
    scores = F.array(*[F.col(f"s{i}") * weight + F.lit(priors[i]) for i in range(k)]).cast("array<double>")
    raised = sums.withColumn("_s", scores).withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    share = F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    return raised.select("_id", *keep, "n_tokens", share.alias("posterior"))


def _rate(pull: list[float]) -> Column:
    """max(_floor, 1 - posterior . pull): the rate at the multipliers `pull`, one number per domain."""
    return F.greatest(F.col("_floor"), F.lit(1.0) - _dot(pull))


def _dot(pull: list[float]) -> Column:
    return sum((F.get("posterior", F.lit(i)) * F.lit(float(x)) for i, x in enumerate(pull)), F.lit(0.0))


def fit_rates(weighted: DataFrame, target: list[float], goal: float, iterations: int, tolerance: float) -> tuple[list[float], float]:
    """Multipliers of the rates (see _rate) whose totals come nearest to target, and the largest gap left, as a share of goal.

    weighted: n_tokens, posterior, _floor. Minimises |t - T|^2 / 2 + mu sum_i n_i (r_i - 1)^2 / 2 over r >= _floor, where t
    and T are totals and targets as shares of goal: of all rates that come as near, those nearest to 1. Its dual has one
    unknown per domain and is piecewise quadratic; each Newton round is one aggregation. mu starts at tolerance and falls
    tenfold until the gap is within tolerance or hardly shrinks, five times at most: a gap that then remains is one no rates
    can close, or only by extreme ones. Raises if `iterations` rounds do not reach the optimum.
    """
    k = len(target)
    wanted = np.array(target) / goal
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, Hessian over the rates above their floors, and the value of the dual without its linear terms."""
        x = F.lit(1.0) - _dot(list(pull))
        low, free = F.col("_floor"), x > F.col("_floor")
        rows = weighted.select("posterior", (F.col("n_tokens") * F.greatest(low, x)).alias("m"), F.when(free, F.col("n_tokens")).otherwise(0).alias("o"), (F.col("n_tokens") * F.when(free, x * x / 2).otherwise(low * x - low * low / 2)).alias("v"))
        p = [F.get("posterior", F.lit(i)) for i in range(k)]
        got = rows.agg(*[F.sum(F.col("m") * p[i]) for i in range(k)], *[F.sum(F.col("o") * p[i] * p[j]) for i, j in pairs], F.sum("v")).first()
        found = np.array([x or 0.0 for x in got]) / goal
        hess = np.zeros((k, k))
        for (i, j), h in zip(pairs, found[k:-1], strict=True):
            hess[i, j] = hess[j, i] = h
        return found[:k], hess, float(found[-1])

    pull, rounds, last = np.zeros(k), 1, math.inf
    now, hess, value = at(pull)
    for level in range(6):
        mu = tolerance / 10**level
        slope = wanted + mu * pull - now
        while np.abs(slope).max() > tolerance / 100:
            step = np.linalg.solve(hess + mu * np.eye(k), -slope)
            before = value + wanted @ pull + mu / 2 * pull @ pull
            for _ in range(40):
                if rounds >= iterations:
                    raise RuntimeError(f"the rates have not converged in {iterations} rounds: slope {np.abs(slope).max():.3g} of the goal")
                rounds += 1
                near = pull + step
                now, hess, value = at(near)
                slope = wanted + mu * near - now
                # the dual is convex: still falling along the step, or lower than before, is progress
                if slope @ step <= 0 or value + wanted @ near + mu / 2 * near @ near < before:
                    break
                step = step / 2
            pull = near
        gap = float(np.abs(now - wanted).max())
        if gap <= tolerance or last - gap < tolerance / 10:
            break
        last = gap
    return [float(x) for x in pull], gap


def mix_to_targets(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    keep: list[str] | None = None,
    total_tokens: float | None = None,
    buckets: int = 1 << 14,
    max_documents: int = 20_000,
    smoothing: float = 1.0,
    iterations: int = 200,
    tolerance: float = 1e-4,
    known: DataFrame | None = None,
    protect: bool = False,
) -> DataFrame:
    """One row per row of docs: id, columns `keep`, n_tokens, posterior (in order of domain name), rate, copies and gap.

    labelled: domain and text, or domain and id, whose texts are then those of docs; the classifier is fitted on at most
    max_documents of its rows. targets: share of the tokens that each domain of the labelled table shall have (domains not named: 0; shares are
    scaled to 1). total_tokens: what the mixture shall hold, by default what docs hold. rate: expected copies of a
    document; copies: rate rounded up or down by a hash of the id, so that its expectation is the rate and equal inputs
    give equal results. gap: the largest difference between a domain's expected total and its target, as a share of the
    goal; above tolerance where the targets cannot be met by rates of 0 or more (see fit_rates). known: id and domain of documents whose domain need not be predicted (null domains are ignored, of
    several the first by name counts); their posterior is 1 there. protect: documents that lie mainly in a domain whose
    target is no less than what docs hold of it get a rate of 1 or more, so only documents of the other domains are dropped
    or thinned; targets that this puts out of reach show in gap. Null or blank texts have no tokens and the prior as posterior; they take the rate it implies.
    A labelled table without rows leaves all rates at 1 and posteriors empty. Repeated rows are treated alike; extra
    columns are dropped unless in keep. Only hashed word weights (buckets x domains) are broadcast.
    """
    if text_col in labelled.columns:
        sample = labelled_sample(labelled.select(domain_col, text_col), text_col, domain_col, max_documents)
    else:
        chosen = cut(labelled_sample(labelled.select(id_col, domain_col), id_col, domain_col, max_documents))
        sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    model = train_domain_model(sample, text_col, domain_col, buckets, smoothing)
    soft = cut(domain_posteriors(docs, model, buckets, id_col, text_col, list(keep or [])))
    asked = [max(0.0, targets.get(d, 0.0)) for d in model[0]]
    shares = [a / sum(asked) for a in asked] if sum(asked) > 0 else []
    if known is not None and shares:
        place = F.array_position(F.array(*map(F.lit, model[0])), F.col("_known"))
        sure = F.array(*[F.when(place == i + 1, 1.0).otherwise(0.0) for i in range(len(shares))])
        truth = known.filter(F.col(domain_col).isin(model[0])).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("_known"))
        soft = cut(soft.join(truth, "_id", "left").withColumn("posterior", F.when(F.col("_known").isNull(), F.col("posterior")).otherwise(sure)).drop("_known"))
    held = soft.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))) for i in range(len(shares))]).first()
    goal = total_tokens if total_tokens is not None else float(held[0] or 0)
    target = [s * goal for s in shares]
    wanted = [float(protect and t > 0 and t >= (h or 0)) for t, h in zip(target, held[1:], strict=True)]
    mainly = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    soft = soft.withColumn("_floor", F.coalesce(F.get(F.array(*map(F.lit, wanted)), mainly), F.lit(0.0)) if any(wanted) else F.lit(0.0))
    pull, gap = fit_rates(soft, target, goal, iterations, tolerance) if shares and goal > 0 else ([0.0] * len(shares), 0.0)
    rate = F.round(_rate(pull), 6)
    lot = F.pmod(F.xxhash64(F.lit("copies"), F.col("_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = soft.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + lot).cast("long")).withColumn("gap", F.lit(gap))
    return out.drop("_floor").withColumnRenamed("_id", id_col)


def labelled_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of docs with the domain that the table of labels gives them: toxic, poor (quality 0) or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select(id_col, domain.alias("domain")).join(docs.select(id_col), id_col, "left_semi")
