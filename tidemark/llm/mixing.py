"""Soft-membership mixing to target weights, in DataFrame functions alone.

A naive Bayes classifier over hashed words, counted on labelled rows, gives every document the probabilities of its
domains.  Projected gradient steps on the least squares problem then find a nonnegative rate for each document so that the
expected tokens of each domain (rate * tokens * probability, summed) match the targets.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.licenses import words

BUCKETS = 1 << 16


def domain(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row; null if a label that it needs is null."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def _bucket(word: Column, buckets: int) -> Column:
    """Where a word's weight is found; null for an empty piece."""
    return F.when(word != "", F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))


def word_weights(df: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", label: str = "domain", sample_rows: int = 20_000, buckets: int = BUCKETS, alpha: float = 0.5, shrink: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """Log weights of each word bucket in each domain (columns w0, w1, ... in the order of `domains`), and log priors.

    A weight is the log of a bucket's share of the domain's words over its share of all words, pulled towards zero by
    `shrink`, so that what a language or topic does to all its words a little does not add up to a domain.

    Fitted on about sample_rows labelled rows (1.5 times that at most), chosen by a threshold on a hash of their key.
    """
    known = labelled.where(F.col(label).isin(domains) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("domain"))
    n = known.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    some = known.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(int(1.5 * sample_rows))
    rows = df.select(F.col(key).alias(key), F.col(text).alias("t")).join(F.broadcast(some), key)
    counts = rows.select("domain", F.explode(words(F.col("t"))).alias("w")).where("w <> ''").groupBy(_bucket(F.col("w"), buckets).alias("bucket")).agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)])
    counts = cut(counts, "word-counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(domains))]).first()
    docs = {r["domain"]: r["n"] for r in some.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    every = sum(docs.values())
    prior = {d: float(np.log((docs.get(d, 0) + 1) / (every + len(domains)))) for d in domains}
    whole, seen = max(1, sum(totals)), sum((F.col(f"c{i}") for i in range(1, len(domains))), F.col("c0"))
    logs = [F.log((F.col(f"c{i}") + alpha) / (seen + alpha) * ((whole + alpha * buckets) / (n + alpha * buckets))) for i, n in enumerate(totals)]
    weights = counts.select("bucket", *[(F.signum(x) * F.greatest(F.abs(x) - shrink, F.lit(0.0))).alias(f"w{i}") for i, x in enumerate(logs)])
    return weights, prior


def domain_posteriors(df: DataFrame, weights: DataFrame, prior: dict[str, float], key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, temper: float = 0.5) -> DataFrame:
    """(key, text_hash, n_words, p_<domain> ...) for each distinct (key, text), from summed log weights times `temper` and
    the priors, which a text without known words has."""
    names = list(prior)
    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("ws"))
    rows = rows.select("k", "text_hash", F.posexplode_outer("ws").alias("at", "w"))  # what stands beside a generator is made anew for each of its rows
    rows = rows.select("k", "text_hash", "at", _bucket(F.col("w"), buckets).alias("bucket")).join(F.broadcast(weights), "bucket", "left")
    same = F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1))  # repeated rows
    sums = rows.groupBy("k", "text_hash").agg(same.alias("same"), F.count("bucket").alias("n"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))])
    logs = [temper * F.col(f"s{i}") / F.col("same") + prior[d] for i, d in enumerate(names)]
    out = sums.select("k", "text_hash", (F.col("n") / F.col("same")).cast("long").alias("n_words"), "same", *[x.alias(f"l{i}") for i, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(len(names))])
    parts = [F.exp(F.col(f"l{i}") - top) for i in range(len(names))]
    whole = sum(parts[1:], parts[0])
    return out.select(F.col("k").alias(key), "text_hash", "n_words", "same", *[(p / whole).alias(f"p_{d}") for p, d in zip(parts, names)])


def fit_rates(rows: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), spare: bool = False, headroom: float = 1.05, most_steps: int = 60, tolerance: float = 1e-4) -> tuple[Column, dict]:
    """Rate of each row as a column expression, and what was reached.

    Of all nonnegative rates with the wanted expected tokens of the domains, those with the least squares of their distance
    from one, weighed by the tokens: these are 1 + a sum of multipliers times posteriors, projected to zero where that is
    negative.  There is no other floor and no ceiling, unless `spare` asks that rows that more probably than not belong to
    the domains in `keep` stay at one or more, for a pipeline that must not lose clean documents; the targets are met by the
    other rates then, and the total is such that none of them is below what the spared rows have.  Each step moves the multipliers along the gradient, scaled by the
    inverse of the posteriors' products over the rows that are not at zero, and is halved while it does not lower the
    problem's dual, until each domain's tokens are within `tolerance` of its target.  A step is one sum over the rows that
    returns a few numbers.
    The total is such that no domain in `keep` has to shrink (all of them, if it is empty), times `headroom`, so that rows
    that surely belong to these stay above a rate of one although others of their domain take part of the tokens.
    Where no rates meet the targets (equal posteriors, say), met is False and the nearest rates found are returned.
    """
    names = list(targets)
    d = len(names)
    weight = F.col("n_words") * F.col("same")
    p = [F.col(f"p_{x}") for x in names]
    floor = F.when(sum((F.col(f"p_{x}") for x in keep if x in names), F.lit(0.0)) >= 0.5, 1.0).otherwise(0.0) if spare else F.lit(0.0)
    got = rows.agg(*[F.sum(weight * x) for x in p], *[F.sum(weight * floor * x) for x in p]).first()
    if got is None or got[0] is None or sum(got[:d]) <= 0:
        return F.lit(1.0), {"tokens": {x: 0.0 for x in names}, "targets": {x: 0.0 for x in names}, "steps": 0, "met": True}
    now, least = np.array(got[:d]), np.array(got[d:])
    share = np.array([targets[x] for x in names])
    share = share / share.sum()
    held = [i for i, x in enumerate(names) if (x in keep or not keep) and share[i] > 0 and now[i] > 0]
    want = headroom * share * max([now[i] / share[i] for i in held] + [least[i] / share[i] for i in range(d) if share[i] > 0] or [now.sum()])
    near = tolerance * np.where(want > 0, want, want.max())

    def at(by: np.ndarray) -> tuple[Column, float, np.ndarray, np.ndarray]:
        """Rates, the dual's value, tokens, and their changes with the multipliers."""
        add = sum((float(m) * x for m, x in zip(by[1:], p[1:])), float(by[0]) * p[0])
        rate = F.greatest(floor, 1.0 + add)
        free = F.when(1.0 + add >= floor, weight).otherwise(0.0)
        got = rows.agg(F.sum(weight * (rate * add - (rate - 1.0) * (rate - 1.0) / 2)), *[F.sum(weight * rate * x) for x in p], *[F.sum(free * p[i] * p[j]) for i in range(d) for j in range(i, d)]).first()
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = got[d + 1 :]
        return rate, got[0] - float(by @ want), np.array(got[1 : d + 1]), gram + np.triu(gram, 1).T

    by = np.zeros(d)
    rate, value, now, gram = at(by)
    every = gram  # a part of it, so that a domain whose rows are all at zero can move again
    steps, met = 0, bool((np.abs(now - want) <= near).all())
    while not met and steps < most_steps:
        move = np.linalg.lstsq(gram + 1e-3 * every, want - now, rcond=1e-12)[0]
        slope = float((now - want) @ move)
        while steps < most_steps:
            steps += 1
            new = at(by + move)
            if new[1] <= value + 1e-4 * slope + 1e-12 * abs(value):
                break
            move, slope = move / 2, slope / 2
        else:
            break
        if np.abs(new[2] - now).max() <= 1e-9 * want.max():  # no rates come nearer
            break
        by = by + move
        rate, value, now, gram = new
        met = bool((np.abs(now - want) <= near).all())
    return rate, {"tokens": dict(zip(names, now.tolist())), "targets": dict(zip(names, want.tolist())), "steps": steps, "met": met}


def _unmixed(rows: DataFrame, targets: dict[str, float]) -> dict:
    """Facts as of fit_rates() where every rate is one."""
    got = rows.agg(*[F.coalesce(F.sum(F.col("n_words") * F.col("same") * F.col(f"p_{x}")), F.lit(0.0)) for x in targets]).first()
    whole, share = sum(got), sum(targets.values())
    return {"tokens": dict(zip(targets, got)), "targets": {x: whole * t / share for x, t in targets.items()}, "steps": 0, "met": whole == 0}


def mix_rates(df: DataFrame, labels: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", sample_rows: int = 20_000, spare: bool = False) -> DataFrame:
    """(key, text_hash, n_words, same, p_<domain> ..., rate, copies, want_<domain> ..., got_<domain> ..., met) for each distinct
    (key, text) of df.

    want_ and got_ are the expected tokens of each domain that were asked for and that the rates reach, the same in every
    row, met whether they agree; same is the number of rows of that key and text.  copies is the rate's whole part, and one more with the probability of its fraction, by a hash of key and text.
    labels has the key, quality and toxic; rows whose labels do not tell a domain are not learnt from, and with none at
    all every document has equal posteriors and a rate of one.  A warning gives the totals where the targets are not met.  A null text counts as empty: no words, so any rate changes no total.
    Repeated rows weigh in each time.  Columns of df but key and text are not read; empty tables give empty results.
    """
    names = list(targets)
    told = labels.select(key, domain(F.col("quality"), F.col("toxic")).alias("domain"))
    weights, prior = word_weights(df, told, names, key, text, sample_rows=sample_rows)
    rows = cut(domain_posteriors(df, weights, prior, key, text), "posteriors")
    if weights.isEmpty():  # nothing was learnt
        rate, facts = F.lit(1.0), _unmixed(rows, targets)
    else:
        rate, facts = fit_rates(rows, targets, keep, spare)
    if not facts["met"]:
        warnings.warn(f"no rates found that meet the targets: expected tokens {facts['tokens']}, targets {facts['targets']}", stacklevel=2)
    rows = rows.withColumn("rate", F.round(rate, 6))  # so that the order of sums does not decide over a copy
    part = F.pmod(F.xxhash64(key, "text_hash", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("copies", (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    told = [F.lit(round(facts[of][x], 3)).alias(f"{name}_{x}") for name, of in (("want", "targets"), ("got", "tokens")) for x in names]
    return rows.select("*", *told, F.lit(facts["met"]).alias("met"))


def mix(df: DataFrame, labels: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", sample_rows: int = 20_000, spare: bool = False) -> DataFrame:
    """df with each row repeated as often as mix_rates() says, or left out at no copies."""
    rates = mix_rates(df, labels, targets, keep, key, text, sample_rows, spare).select(F.col(key).alias("__k"), F.col("text_hash").alias("__h"), F.col("copies").alias("__n")).where("__n > 0")
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__h"))
    out = df.join(rates, same).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
