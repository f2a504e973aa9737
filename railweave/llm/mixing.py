"""Mixing sources to target shares of tokens, with soft membership.

A naive Bayes classifier over hashed words, learnt from all labelled documents by counting, gives each
document its posterior over the sources.  Documents of one label whose posteriors are alike make a cell; the
documents' tokens and the tokens by posterior are summed per cell in one aggregation, and non-negative rates
(how often a cell's documents are drawn, at most their source's cap) are fitted to these sums by projected
gradient steps, so that the *expected* tokens per source match the targets.  Last, rates become whole copies
by a hashed threshold per document, and one factor per source, found by histograms of the factors at which
documents gain a copy, makes the drawn tokens meet the shares by label too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.llm.encode import TOKENIZERS, encoder, shipped
from railweave.scale import cut, lookup_join, spread

#: Buckets of hashed words; the most sources; how far posteriors are softened; trust in a label.
BUCKETS, MAX_SOURCES, SOFTNESS, TRUST = 1 << 14, 100, 24.0, 0.9
#: Steps of a posterior in a cell, the most gradient steps, and the part of all tokens by which the fit may miss.
LEVELS, PASSES, CLOSE = 16, 500, 1e-4
#: Histograms that set a source's factor (each of so many steps), and the factors between which it is looked for.
ROUNDS, STEPS, FACTORS = 3, 256, (1.0 / 1024, 1024.0)
#: Words a task remembers, and documents whose words are weighed at once.
REMEMBERED, TOGETHER = 500_000, 512

#: Marks around a word that aren't part of it.
_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»“”‘’…–—"


class WordBuckets:
    """The buckets of words, by a hash that is the same in every process; words that come again are remembered."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets, self.known = buckets, {}

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all words of ``texts`` in order, and how many words each text has."""
        import xxhash

        words = [t.lower().split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        # marks are taken off a word when it is first seen, and its hash is looked up from then on
        for w in set().union(*words).difference(self.known):
            self.known[w] = xxhash.xxh32_intdigest(w.strip(_MARKS) or w) % self.buckets
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.array(list(map(self.known.__getitem__, chain.from_iterable(words))), np.int64), sizes


def learn_words(labelled: DataFrame, n_labels: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(log_prior, log_likelihood)`` from all rows of ``labelled(label int, text)``; the counts are added up before the shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, docs, own = np.zeros(n_labels * buckets), np.zeros(n_labels), WordBuckets(buckets)
        for batch in batches:
            if len(batch):
                label = batch["label"].to_numpy()
                found, sizes = own.of(batch["text"])
                sums += np.bincount(np.repeat(label, sizes) * buckets + found, minlength=len(sums))
                docs += np.bincount(label, minlength=n_labels)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"label": np.r_[at // buckets, np.arange(n_labels)], "bucket": np.r_[at % buckets, np.full(n_labels, -1)], "n": np.r_[sums[at], docs]})

    total = labelled.mapInPandas(counted, "label int, bucket int, n double").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most labels x buckets rows
    sums, docs = np.zeros((n_labels, buckets)), np.zeros(n_labels)
    words = total[total["bucket"] >= 0]
    sums[words["label"], words["bucket"]] = words["n"]
    prior = total[total["bucket"] < 0]
    docs[prior["label"]] = prior["n"]
    smooth = sums + 0.1
    return np.log((docs + 1e-9) / max(docs.sum(), 1)), np.log(smooth / smooth.sum(axis=1, keepdims=True))


def posteriors(found: np.ndarray, sizes: np.ndarray, prior: np.ndarray, likelihood: np.ndarray, softness: float = SOFTNESS) -> np.ndarray:
    """The softened posterior of each text: words beyond ``softness`` count only in proportion, since they aren't independent."""
    out, ends = np.empty((len(sizes), len(prior))), np.r_[0, np.cumsum(sizes)]
    by_word = np.ascontiguousarray(likelihood.T)
    for k in range(0, len(sizes), TOGETHER):
        own = sizes[k : k + TOGETHER]
        some = by_word[found[ends[k] : ends[k + len(own)]]]
        sums = np.zeros((len(own), len(prior)))
        full = own > 0
        if full.any():
            sums[full] = np.add.reduceat(some, (np.cumsum(own) - own)[full], axis=0)
        score = prior + sums * np.minimum(1.0, softness / np.maximum(own, 1))[:, None]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        out[k : k + len(own)] = p / p.sum(axis=1, keepdims=True)
    return out


def members(df: DataFrame, key: str, text: str, source: str, names: Sequence[str], *, vocabulary: str, trust: float = TRUST) -> DataFrame:
    """``(key, label int, tokens long, p array<double>)``: label -1 for a source that isn't wanted, the likeliest for none given."""
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    label = F.when(F.col(source).isNull(), F.lit(-2)).otherwise(F.coalesce(F.try_element_at(index, F.col(source)), F.lit(-1)))
    shipped(df.sparkSession, vocabulary)
    rows = spread(df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), label.cast("int").alias("label")))
    prior, likelihood = learn_words(rows.where("label >= 0"), len(names))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_encoder, own_words = encoder(vocabulary), WordBuckets(likelihood.shape[1])
        for batch in batches:
            if not len(batch):
                continue
            tokens = own_encoder.count_batch(batch["text"])
            p = posteriors(*own_words.of(batch["text"]), prior, likelihood)
            given = batch["label"].to_numpy()
            own = np.where(given == -2, p.argmax(axis=1), given)
            known = given >= 0
            p[known] *= 1 - trust
            p[known, given[known]] += trust
            yield pd.DataFrame({key: batch[key], "label": own.astype("int32"), "tokens": np.array(tokens, "int64"), "p": list(p)})

    # sizes and posteriors come from one pass, so a task has one Python worker
    return cut(rows.where("label <> -1").mapInPandas(judged, f"`{key}` {df.schema[key].dataType.simpleString()}, label int, tokens long, p array<double>"))


def with_cells(table: DataFrame, k: int, levels: int = LEVELS) -> DataFrame:
    """``table`` with ``cell``: its label, the likeliest other source and how likely both are, in ``levels`` steps.

    There are at most k * k * levels * levels cells, so their sums fit the driver.
    """
    own = F.element_at("p", F.col("label") + 1)
    others = F.transform("p", lambda x, i: F.struct(F.when(i == F.col("label"), -1.0).otherwise(x).alias("x"), i.alias("i")))
    step = lambda x: F.least(F.floor(x * levels), F.lit(levels - 1)).cast("int")
    # the digits of the other one go on below those of the label's own share
    second = F.array_max(others)
    told = table.withColumn("_s", second).withColumn("_o", step(own))
    return told.withColumn("cell", ((F.col("label") * k + F.col("_s.i")) * levels + F.col("_o")) * levels + step(F.greatest(F.col("_s.x"), F.lit(0.0)))).drop("_s", "_o")


def fit_rates(label: np.ndarray, tokens: np.ndarray, by_source: np.ndarray, targets: np.ndarray, caps: np.ndarray, start: np.ndarray, passes: int = PASSES, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """``(rates, miss)``: projected gradient least squares over cells, so that ``rates @ by_source`` meets ``targets``.

    ``by_source`` are a cell's tokens times its documents' posteriors.  The gradient of a cell's rate is its
    posterior times the residual, scaled by the curvature of the cells that no bound holds.  ``miss`` is what
    is left, as a part of all tokens: if above ``close``, the caps don't allow the targets.
    """
    r, top = start[label].copy(), caps[label]
    p = by_source / np.maximum(tokens, 1e-300)[:, None]
    whole = max(float(targets.sum()), 1e-300)
    best, kept = np.inf, r
    for _ in range(passes):
        residual = r @ by_source - targets
        miss = float(np.sqrt((residual**2).sum())) / whole
        if miss < best:
            best, kept = miss, r
        if miss <= close:
            break
        free = (r > 1e-9) & (r < top - 1e-9) | (residual @ p.T > 0) & (r > 1e-9) | (residual @ p.T < 0) & (r < top - 1e-9)
        curve = (by_source * free[:, None]).T @ p
        step = np.linalg.solve(curve + np.eye(len(targets)) * max(np.trace(curve), 1e-9) * 1e-6, residual)
        r = np.clip(r - p @ step, 0, top)
    return kept, 0.0 if best == np.inf else best


def mix(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    targets: DataFrame,
    *,
    total_tokens: float | None = None,
    vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
    max_sources: int = MAX_SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """``(draws, shares)``: which documents to draw how often, and what share each source reaches.

    ``draws(key, source, tokens, rate, copies)`` holds the documents drawn at least once.  ``targets`` holds
    ``source, target_share, max_repeats``.  Without ``total_tokens`` the mix is as large as it can be with
    every source that has tokens meeting its share.  A source without tokens gets share 0 and the others
    keep their proportions; a source whose cap is too low for ``total_tokens`` is drawn up to the cap.
    Documents of sources that aren't wanted are left out; documents without a source belong to their
    likeliest one; null and empty texts have no tokens and don't matter.  ``shares`` also says what soft
    membership changes: ``expected_share`` counts each drawn token by its document's posteriors,
    ``label_share`` is what that would be if all documents of a label had one rate; ``fit_miss`` is what the
    fit leaves, as a part of all tokens.
    """
    wanted = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).orderBy("source").limit(max_sources + 1).collect()
    if len(wanted) > max_sources or not wanted:
        raise ValueError(f"there must be 1 to {max_sources} sources")
    names, share, caps = [r[0] for r in wanted], np.array([r[1] for r in wanted]), np.array([max(r[2], 0) for r in wanted], float)
    k = len(names)
    table = members(df, key, text, source, names, vocabulary=vocabulary).withColumn("u", F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 40)) / float(1 << 40))
    table = with_cells(table, k)
    sums = table.groupBy("cell", "label").agg(F.sum("tokens").cast("double").alias("t"), *[F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).toPandas()
    label, tokens, by_source = sums["label"].to_numpy(int), sums["t"].to_numpy(float), sums[[f"s{i}" for i in range(k)]].to_numpy(float).reshape(-1, k)
    held = np.bincount(label, tokens, k)
    there = (held > 0) & (caps > 0) & (share > 0)
    total = total_tokens or (float(np.min(caps[there] * held[there] / share[there])) if there.any() else 0.0)
    goal = np.where(there, np.minimum(share * total, caps * held), 0.0)
    start = np.where(there, np.minimum(goal / np.maximum(held, 1), caps), 0.0)
    top = np.where(there, caps, 0.0)
    rate, miss = fit_rates(label, tokens, by_source, goal, top, start)
    by_label, plain = np.bincount(label, rate * tokens, k), start[label] @ by_source
    # a label whose every rate the fit brought to 0 has nothing that a factor could raise
    rate = np.where(by_label[label] > 0, rate, start[label])

    spark = df.sparkSession
    cells = spark.createDataFrame([(int(c), float(r)) for c, r in zip(sums["cell"], rate)], "cell int, rate double")
    rated = lookup_join(table.select(key, "label", "tokens", "u", "cell", "p"), cells, ["cell"], "inner")
    by_label_ = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("label") + 1)
    rated = rated.withColumn("top", by_label_(top)).where("rate > 0 and top > 0 and tokens > 0")
    # a document gains its j-th copy at the factor (j - 1 + u) / rate, the first one just above u / rate
    gains = rated.select("label", "tokens", F.explode(F.transform(F.sequence(F.lit(1), F.col("top").cast("int")), lambda j: (j - 1 + F.col("u")) / F.col("rate"))).alias("at"))
    low, high = np.full(k, np.log(FACTORS[0])), np.full(k, np.log(FACTORS[1]))
    below = np.zeros(k)
    for turn in range(ROUNDS):
        width = (high - low) / STEPS
        place = F.floor((F.log(F.greatest("at", F.lit(1e-300))) - by_label_(low)) / by_label_(width))
        # a first copy at a factor below all is there from the start
        counted = gains.select("label", "tokens", F.least(F.greatest(place, F.lit(-1)), F.lit(STEPS)).alias("b")).groupBy("label", "b").agg(F.sum("tokens").alias("t")).toPandas()  # labels x steps rows
        grid = np.zeros((k, STEPS + 2))
        grid[counted["label"].to_numpy(int), counted["b"].to_numpy(int) + 1] = counted["t"]
        upto = np.cumsum(grid[:, : STEPS + 1], axis=1)  # tokens drawn at the left edge of each step
        at = np.clip((upto <= goal[:, None] * (1 + 1e-12)).sum(axis=1) - 1, 0, STEPS)
        nearer = np.where(at < STEPS, np.abs(upto[np.arange(k), np.minimum(at + 1, STEPS)] - goal) < np.abs(upto[np.arange(k), at] - goal), False)
        ends = low + width * at, low + width * np.minimum(at + 1, STEPS)
        factor = np.exp(np.where(nearer, ends[1], ends[0])) * (1 + 1e-12)
        low, high = ends[0], np.where(ends[1] > ends[0], ends[1], ends[0] + width)
    copies = F.least(F.floor(F.col("rate") * by_label_(factor) + 1 - F.col("u")), F.col("top")).cast("int")
    drawn = rated.withColumn("copies", copies)
    named = spark.createDataFrame([(i, n, float(s), int(c)) for i, (n, s, c) in enumerate(zip(names, share, caps))], "label int, source string, target_share double, max_repeats int")
    kept = drawn.where("copies > 0")
    final = F.round(F.least(F.col("rate") * by_label_(factor), F.col("top")), 9)
    draws = lookup_join(kept, named.select("label", "source"), ["label"], "inner", n_rows=k).select(key, "source", "tokens", final.alias("rate"), "copies")
    soft = F.array(*[F.sum(F.col("tokens") * F.col("copies") * F.col("p")[i]) for i in range(k)])
    counts = table.groupBy("label").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    taken = kept.groupBy("label").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    expected = kept.agg(soft.alias("e")).select(F.posexplode_outer("e").alias("label", "expected_tokens"))
    report = named.join(counts, "label", "left").join(taken, "label", "left").join(expected, "label", "left").fillna({"n_docs": 0, "available_tokens": 0, "drawn_tokens": 0, "most_copies": 0, "expected_tokens": 0.0})
    report = report.withColumn("all_tokens", F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0))))  # a row per source
    part = lambda c: F.round(F.when(F.col("all_tokens") > 0, F.col(c) / F.col("all_tokens")).otherwise(0.0), 6)
    told = F.round(by_label_(plain / max(plain.sum(), 1e-300)), 6)
    shares = report.select("source", "target_share", "max_repeats", "n_docs", "available_tokens", "drawn_tokens", "most_copies", part("drawn_tokens").alias("reached_share"), part("expected_tokens").alias("expected_share"), told.alias("label_share"), F.lit(round(miss, 9)).alias("fit_miss"))
    return draws, shares
