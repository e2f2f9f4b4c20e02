"""Mixing sources to target weights by soft membership.

A naive Bayes classifier learnt from a labelled table gives each document a posterior over domains.
Documents then get nonnegative rates (expected numbers of copies) such that the expected tokens of
each domain, sum of rate * tokens * posterior, match the targets. The rates are a least-squares
fit by projected gradients. Everything is DataFrame and SQL expressions; the driver sees domains'
totals, class counts of hashed features, and a matrix of domains by domains."""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fitting import sample_by_class
from .tables import drop_since, mark, newest, stash

log = logging.getLogger("tarnbeck.llm")

#: Slots for beginnings of words, which stand for stems, and for the last character of a token. Stems carry over to
#: inflected words: of sf0.1's labelled good documents 93 % fall into their domain, by whole words 84 %.
SLOTS = 1 << 15
ENDS = 128
BEGINNING = 5
#: A slot counts for or against a domain only if its log ratio is so many standard errors from 0 and
#: so large: weak ratios, as of words of a language that a domain has more of, add up over a text.
SURE = 3.0
STRONG = 1.5
#: The most that evidence can say: naive Bayes takes words for independent and is too certain.
MOST_EVIDENCE = 10.0
#: Gradient steps between two tables of the rates.
STEPS_A_TABLE = 8
#: Targets count as met when no domain is further off, as a share of all tokens.
TOLERANCE = 1e-4


def _tokens(text: Column) -> Column:
    """Runs of anything but blanks; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda t: t != "")


def _codes(tokens: Column) -> Column:
    """For each token one number: a slot of its beginning, lower case, and its last character, of
    which only marks count as evidence."""

    def code(t: Column) -> Column:
        slot = F.pmod(F.xxhash64(F.lower(F.substring(t, 1, BEGINNING))), F.lit(SLOTS))
        return (slot * ENDS + F.least(F.ascii(F.substring(t, -1, 1)), F.lit(ENDS - 1))).cast("int")

    return F.transform(tokens, code)


def _salted(k: int):
    return lambda c: F.xxhash64(c, F.lit(k))


@dataclass(frozen=True)
class Classifier:
    """Log ratios of each domain to the first: of the priors, of beginnings and last characters of
    tokens, and of having no token that says anything about the domain."""

    domains: list[str]
    prior: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    silent: np.ndarray


def learn_domains(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, per_class: int) -> Classifier:
    """Learnt from about per_class labelled documents of each domain. An id with several labels has the one that sorts
    first; counts of slots are summed in Spark, SLOTS + ENDS rows a domain at most."""
    clean = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna()
    clean = clean.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in clean.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    prior = np.array([sizes[d] for d in domains], float)
    starts, ends = np.ones((len(domains), SLOTS)), np.ones((len(domains), ENDS))
    if domains:
        picked = sample_by_class(clean, "domain", "doc_id", per_class)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        coded = texts.join(F.broadcast(picked), "doc_id").select("domain", F.array_distinct(_codes(_tokens(F.col("text")))).alias("codes"))
        # near copies would make chance words look like evidence: one of those with an equal min-hash counts
        sketch = [F.array_min(F.transform("codes", _salted(k))).alias(f"m{k}") for k in range(2)]
        single = coded.select("domain", "codes", *sketch).groupBy("domain", "m0", "m1").agg(F.min("codes").alias("codes"))
        codes = single.select("domain", F.explode("codes").alias("code"))
        halves = F.array(F.floor(F.col("code") / ENDS).cast("int"), (F.col("code") % ENDS - ENDS).cast("int"))
        counts = codes.groupBy("domain", "code").count().select("domain", "count", F.explode(halves).alias("slot"))
        table = counts.groupBy("domain", "slot").agg(F.sum("count").alias("n")).toArrow()
        own = np.array([domains.index(d) for d in table["domain"].to_pylist()], np.int64)
        slot, n = table["slot"].to_numpy(), table["n"].to_numpy()
        starts[own[slot >= 0], slot[slot >= 0]] += n[slot >= 0]
        ends[own[slot < 0], slot[slot < 0] + ENDS] += n[slot < 0]
    tables = [_log_ratios(t) if domains else t for t in (starts, ends)]
    tables[1][:, [chr(c).isalnum() or c == ENDS - 1 for c in range(ENDS)]] = 0.0
    silent = np.zeros(len(domains))
    if domains:
        flags = [F.avg((_evidence("codes", tables[0][k], tables[1][k]) == 0).cast("double")).alias(f"s{k}") for k in range(len(domains))]
        for r in single.groupBy("domain").agg(F.count("*").alias("n"), *flags).collect():
            own = domains.index(r["domain"])
            for k in range(1, len(domains)):
                share = (r[f"s{k}"] * r["n"] + 0.5) / (r["n"] + 1)
                silent[k] += np.log(share) * ((own == k) - (own == 0))
    return Classifier(domains, np.log(prior / prior.sum()) if domains else prior, tables[0], tables[1], silent)


def _log_ratios(counts: np.ndarray) -> np.ndarray:
    """(domains, slots): log ratios to the first domain, 0 where they are weak or within sampling error."""
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    ratio = logs - logs[0]
    error = np.sqrt(1.0 / counts + 1.0 / counts[0])
    return np.where((np.abs(ratio) >= SURE * error) & (np.abs(ratio) >= STRONG), ratio, 0.0)


def _numbers(values: np.ndarray) -> Column:
    """A constant array; as text it is one literal, whatever its length."""
    return F.split(F.lit(",".join(f"{v:.4g}" for v in values)), ",").cast("array<double>")


def _evidence(codes: str, starts: np.ndarray, ends: np.ndarray) -> Column:
    start, end = _numbers(starts), _numbers(ends)
    return F.aggregate(
        codes, F.lit(0.0), lambda s, c: s + F.get(start, F.shiftright(c, 7)) + F.get(end, c.bitwiseAND(ENDS - 1))
    )


def posteriors(docs: DataFrame, text_col: str, model: Classifier) -> DataFrame:
    """docs with columns __tokens (long) and __post (array of double, one entry a domain)."""
    most = F.lit(MOST_EVIDENCE)
    coded = docs.withColumn("__codes", _codes(_tokens(F.col(text_col))))
    count = F.size("__codes")
    logits = []
    said = coded.withColumns({f"__said{k}": _evidence("__codes", model.starts[k], model.ends[k]) for k in range(1, len(model.domains))})
    for k in range(len(model.domains)):
        base = F.lit(float(model.prior[k] - model.prior[0]))
        if k:
            heard = F.greatest(-most, F.least(most, F.col(f"__said{k}")))
            base = base + F.when(F.col(f"__said{k}") == 0, F.lit(float(model.silent[k]))).otherwise(heard)
        logits.append(base)
    scored = said.select(*docs.columns, count.cast("long").alias("__tokens"), F.array(*logits).alias("__logit"))
    top = F.array_max("__logit")
    shares = scored.withColumn("__exp", F.transform("__logit", lambda x: F.exp(x - top)))
    post = F.transform("__exp", lambda x: x / F.aggregate("__exp", F.lit(0.0), lambda s, y: s + y))
    return shares.withColumn("__post", post).drop("__logit", "__exp")


def replay(post: Column, steps: list[np.ndarray], rate: Column, before: Column) -> Column:
    """struct(rate, before) after gradient steps: each is a row of weights g and a momentum m, and
    makes of the last two rates max(0, rate + m * (rate - before) - post . g) and rate."""
    start = F.struct(rate.alias("rate"), before.alias("before"))
    if not steps:
        return start
    rows = F.from_json(F.lit(json.dumps([[float(x) for x in s] for s in steps])), F.lit("array<array<double>>"))
    n = len(steps[0]) - 1

    def one(s: Column, g: Column) -> Column:
        moved = s["rate"] + g[n] * (s["rate"] - s["before"])
        for k in range(n):
            moved = moved - post[k] * g[k]
        return F.struct(F.greatest(F.lit(0.0), moved).alias("rate"), s["rate"].alias("before"))

    return F.aggregate(rows, start, one)


def fit_rates(mass: DataFrame, targets: np.ndarray, rounds: int = 150, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], float]:
    """mass (tokens long, post array<double>): the steps that `replay` takes from rates of 1, and the
    largest distance of a domain's total from its target that is left, as a share of all targets.

    Projected gradients with momentum, restarted when the misfit grows. The misfit of the domains'
    totals is measured in the metric of H, the sum of tokens * post post', in which a gradient step of
    length 1 never overshoots: g = H^-1 (totals - targets). A round is one aggregation; every
    STEPS_A_TABLE rounds the rates go into a table, so neither plans nor lineage grow. It ends when all
    totals are within the tolerance, as a share of all targets, or when nothing more is gained."""
    n, since = len(targets), mark()
    cells = [F.sum(F.col("tokens") * F.col("post")[i] * F.col("post")[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(n)]
    head = mass.agg(*cells).head()
    inverse = np.linalg.pinv(np.array([float(x or 0.0) for x in head]).reshape(n, n), rcond=1e-10, hermitian=True)
    state = mass.select("tokens", "post", F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))
    steps: list[np.ndarray] = []
    kept, last, t, misfits, left = 0, None, 1.0, [], 0.0
    totals = [F.sum(F.col("tokens") * F.col("post")[k] * F.col("now.rate")).alias(f"t{k}") for k in range(n)]
    for _ in range(rounds):
        now = state.select("tokens", "post", replay(F.col("post"), steps[kept:], F.col("rate"), F.col("before")).alias("now"))
        total = np.array([float(x or 0.0) for x in now.agg(*totals).head()])
        miss = total - targets
        misfits.append(float(miss @ inverse @ miss))
        left = float(np.abs(miss).max(initial=0.0)) / max(1.0, targets.sum())
        stuck = len(misfits) > 20 and misfits[-1] > 0.99 * misfits[-21]
        if left <= tolerance or stuck:
            break
        if len(misfits) > 1 and misfits[-1] > misfits[-2]:
            t = 1.0
        after = (1.0 + math.sqrt(1.0 + 4.0 * t * t)) / 2.0
        momentum = (t - 1.0) / after if last is not None else 0.0
        ahead = total + momentum * (total - last) if last is not None else total
        steps.append(np.append(inverse @ (ahead - targets), momentum))
        last, t = total, after
        if len(steps) - kept == STEPS_A_TABLE:
            done = replay(F.col("post"), steps[kept:], F.col("rate"), F.col("before"))
            state, kept = stash(state.select("tokens", "post", done.alias("now")).select("tokens", "post", "now.*"), "rates"), len(steps)
            drop_since(mass.sparkSession, since, [newest()])
    return steps, left


def mix_sources(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    total_tokens: float | None = None, per_class: int = 4000, seed: int = 9,
) -> DataFrame:
    """docs with columns tokens, domain_posterior (map), rate and copies.

    labelled (doc_id, domain) is what the classifier learns from; targets are weights of domains,
    scaled to sum to 1, of total_tokens (those of docs, if not given). rate is the expected number of
    copies; copies is a whole number with that expectation, drawn by a hash of id and text. Domains
    without a target are to get 0; targets of domains without a label can't be met and their weight
    goes unused. What is missed by more than TOLERANCE is logged as a warning. Without any label all rates are 1. Rates change the less the surer the match:
    documents with equal posteriors get equal rates.

    Null and empty texts have 0 tokens, the prior as posterior, and the rate that goes with it.
    Repeated rows are rows of their own. An empty table gives no rows. Other columns stay; columns
    with the names of the added ones are replaced.
    """
    added = ("tokens", "domain_posterior", "rate", "copies")
    whole = docs.select(
        F.struct("*").alias("whole"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("lot")
    )
    model = learn_domains(docs, labelled, id_col, text_col, per_class)
    domains = model.domains
    keep = [F.col("whole").getField(c).alias(c) for c in docs.columns if c not in added]
    if not domains:
        return whole.select(
            *keep, F.size(_tokens(F.col("text"))).cast("long").alias("tokens"), F.lit(None).cast("map<string,double>").alias("domain_posterior"),
            F.lit(1.0).alias("rate"), F.lit(1).alias("copies"),
        )
    scored = stash(
        posteriors(whole, "text", model).select("whole", "lot", F.col("__tokens").alias("tokens"), F.col("__post").alias("post")), "posteriors"
    )
    goal = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    total = total_tokens if total_tokens is not None else float(scored.agg(F.sum("tokens")).head()[0] or 0)
    steps, left = fit_rates(scored.select("tokens", "post"), goal / max(1e-300, sum(max(0.0, float(v)) for v in targets.values())) * total)
    if left > TOLERANCE:
        log.warning("the targets are missed by %.4f of all tokens: no nonnegative rates of these documents come nearer", left)
    rate = replay(F.col("post"), steps, F.lit(1.0), F.lit(1.0))["rate"]
    done = scored.select("*", rate.alias("rate"))
    chance = F.pmod(F.col("lot"), F.lit(1 << 30)) / float(1 << 30)
    return done.select(
        *keep, "tokens", F.map_from_arrays(F.lit(domains), "post").alias("domain_posterior"), "rate",
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"),
    )


def label_domains(labels: DataFrame, toxic: bool = True) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, if that is a domain, else good or rough by quality."""
    domain = F.when(F.lit(toxic) & (F.col("toxic") == 1), "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "rough")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


#: Shares of the tokens that the mix aims at; and where toxic documents are gone already.
TARGETS = {"good": 0.85, "rough": 0.1, "toxic": 0.05}
CLEAN_TARGETS = {"good": 0.9, "rough": 0.1}
