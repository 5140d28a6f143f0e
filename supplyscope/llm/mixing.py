"""Mixing sources to target weights by temperature.

Each source i has T_i tokens (words split at ASCII white space).  Its weight is T_i**alpha, normalised:
alpha 1 keeps the sources' own shares, 0 makes them equal.  The exponent is bisected, all sixteen cuts
of an interval in one aggregation a round, until it is the smallest one that keeps

* the largest repetition of a source within a limit (``repetition``), or
* the entropy of the weights, as a share of that of equal weights, within a limit (``entropy``).

With a budget of B tokens source i is repeated r_i = B w_i / T_i times.  Without one, B is the least
that uses every document at least once (r_i = 1 for the source that is repeated least).

The weights are realised as permutations: in epoch e a source's documents are ordered by a hash of
document, epoch and seed, cut into 1,024 blocks by the hash's first bits.  Whole epochs come as often as
r_i allows; of the last one come the first blocks, and of the block that the budget cuts the first
documents, as long as they fit: the realised tokens miss the quota by less than one document.
``position`` = (epoch + hash / 2**64) / r_i runs from 0 to 1 for every source, so ordering by it mixes
the sources by weight all along.

Defined results: a null source is a source of its own, a null or empty text has 0 tokens; a source
without tokens has no weight and comes once; rows that repeat in every column have one place in the
permutations and are taken together; an empty table gives an empty result.  Other columns pass through
``mix``; working columns have names that no column has.

Scale: the texts are read once and never shuffled; thin rows (source, hash, tokens) are pre-aggregated by
source and block.  The cut is found by refining blocks twice (1,024 by 1,024) with two sums of at most
1,024 rows a source, and then among one part in 2**20 of a source.  Whether a document is taken is a
comparison with its source's cut, so no source is gathered anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

#: No source is repeated more often than this, whatever the budget (unless an entropy is asked for).
REPETITION = 2.0
SEED = 20240
_CUTS = 16
_ROUNDS = 7  # 16**-7: the exponent's precision
_SPACE = "[ \\t-\\r]+"


def n_words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"^{_SPACE}|{_SPACE}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, _SPACE))).cast("long")


def _bisect(sources: DataFrame, repetition: float | None, entropy: float | None) -> float:
    """The smallest exponent from 0 to 1 that keeps the limit; ``sources``: tokens > 0 a source."""
    end = sources.agg(F.count("*").alias("n"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    if not end["n"] or end["hi"] == end["lo"]:
        return 1.0
    share = F.col("tokens") / F.lit(end["hi"])  # at most 1, so that powers can't overflow
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        cuts = [lo + (hi - lo) * i / _CUTS for i in range(_CUTS + 1)]
        # The repetition follows from the largest and the smallest source, the entropy from sums over all.
        sums = None if repetition is not None else sources.agg(
            *[F.sum(F.pow(share, F.lit(a))).alias(f"z{i}") for i, a in enumerate(cuts)],
            *[F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{i}") for i, a in enumerate(cuts)]).first()

        def kept(i: int) -> bool:
            if repetition is not None:
                return (end["hi"] / end["lo"]) ** (1 - cuts[i]) <= repetition * (1 + 1e-12)
            h = math.log(sums[f"z{i}"]) - cuts[i] * sums[f"l{i}"] / sums[f"z{i}"]
            return h <= entropy * math.log(end["n"]) * (1 + 1e-12)

        good = next((i for i in range(_CUTS + 1) if kept(i)), _CUTS)
        if good == 0:
            return cuts[0]
        lo, hi = cuts[good - 1], cuts[good]
    return hi


def _key(h: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's permutation, as a number from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(h, epoch.cast("long"), F.lit(seed).cast("long")), 1)


def plan(thin: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None,
         budget: float | None = None, seed: int = SEED) -> DataFrame:
    """A row for each source: s, tokens, weight, repeats, epochs (whole ones) and cut.

    ``thin``: stored rows (s, h, tokens) of documents.  Of the epoch after the whole ones the documents
    with keys below ``cut`` are taken.
    """
    sources = T.stored(thin.groupBy("s").agg(F.sum("tokens").alias("tokens")), "sources")
    counted = sources.where("tokens > 0")
    alpha = _bisect(counted, repetition if entropy is None else None, entropy)
    top = counted.agg(F.max("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(top), F.lit(alpha))
    z = counted.agg(F.sum(power)).first()[0] or 1.0
    # The least budget that uses every document: that of the largest source's own tokens.
    full = float(budget) if budget is not None else top * z
    if entropy is None and repetition is not None:
        # A budget beyond what the limit allows is lowered: the most repeated source is repeated as often as it may be.
        most = counted.agg(F.max(power / F.lit(z) / F.col("tokens"))).first()[0]
        full = min(full, repetition / most) if most else full
    repeats = F.when(F.col("tokens") > 0, F.lit(full) * power / F.lit(z) / F.col("tokens")).otherwise(F.lit(1.0))
    quota = (sources.withColumn("weight", F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(F.lit(0.0)))
             .withColumn("repeats", repeats)
             # Rounding must not cost a whole epoch.
             .withColumn("epochs", F.floor(F.col("repeats") + 1e-9))
             .withColumn("rest", F.greatest(F.lit(0.0), (F.col("repeats") - F.col("epochs")) * F.col("tokens"))))
    quota = T.stored(quota, "quota")

    # Refine the cut: of all blocks, of the parts of the block that is cut, then of its documents.
    state = quota.select("s", "epochs", "rest", F.lit(0).cast("long").alias("prefix"))
    rows = thin.join(quota.select("s", "epochs"), "s").select("s", "tokens", _key(F.col("h"), F.col("epochs"), seed).alias("key"))
    for bits in (10, 20):
        mine = rows.join(state, "s")
        if bits > 10:
            mine = mine.where(F.shiftright("key", 63 - bits + 10) == F.col("prefix"))
        block = F.shiftright("key", 63 - bits).alias("block")
        sums = mine.groupBy("s", "rest", "epochs", block).agg(F.sum("tokens").alias("tokens"))
        # At most 1,024 blocks a source.
        w = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        cut = (sums.withColumn("through", F.sum("tokens").over(w)).where("through > rest").groupBy("s")
               .agg(F.min("block").alias("block"), F.min("through").alias("through")))
        cut = cut.join(sums, ["s", "block"]).select(
            "s", "epochs", (F.col("rest") - (F.col("through") - F.col("tokens"))).alias("rest"), F.col("block").alias("prefix"))
        state = T.stored(cut, "cut")
    mine = rows.join(state, "s").where(F.shiftright("key", 43) == F.col("prefix"))
    w = Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = (mine.withColumn("through", F.sum("tokens").over(w)).where("through > rest")
            .groupBy("s").agg(F.min("key").alias("cut")))
    return T.stored(quota.join(last, "s", "left").select(
        "s", F.col("tokens").alias("source_tokens"), "weight", "repeats", "epochs",
        # Without a document that goes beyond the rest, all of the last epoch's fit; without a rest, none.
        F.when(F.col("rest") <= 0, F.lit(0).cast("long")).otherwise(F.coalesce("cut", F.lit(2**63 - 1))).alias("cut")), "plan")


def schedule(docs: DataFrame, source: str = "source", text: str = "text", **settings) -> DataFrame:
    """All columns of every copy to be used, and epoch, block, position, n_tokens under free names.

    Returns a frame with the columns of ``docs`` and a struct column ``mix`` (or ``_mix``, ...).
    """
    names = docs.columns
    free = lambda x: x if x not in names else "_" * max(map(len, names)) + x
    s, h, n, m = (free(x) for x in ("s", "h", "tokens", "mix"))
    own = F.col(f"`{source}`").cast("string")
    # A null source is told from any named one by its first character.
    marked = docs.withColumns({s: F.coalesce(F.concat(F.lit("="), own), F.lit("-")), h: F.xxhash64(*[F.col(f"`{c}`") for c in names]),
                               n: n_words(F.col(f"`{text}`"))})
    thin = T.stored(marked.select(F.col(s).alias("s"), F.col(h).alias("h"), F.col(n).alias("tokens")), "thin")
    seed = settings.get("seed", SEED)
    p = plan(thin, **settings).select(F.col("s").alias(s), F.struct("repeats", "epochs", "cut").alias(m))
    e = F.col(m)["epochs"]
    taken = _key(F.col(h), e, seed) < F.col(m)["cut"]
    copies = e + F.when(taken, 1).otherwise(0)
    each = (marked.join(p, s).where(copies > 0)
            .withColumn(m, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda i: F.struct(
                i.cast("int").alias("epoch"),
                F.shiftright(_key(F.col(h), i, seed), 53).cast("int").alias("block"),
                ((i + _key(F.col(h), i, seed) / F.lit(2.0**63)) / F.col(m)["repeats"]).alias("position"),
                F.col(n).alias("n_tokens"))))))
    return each.select(*[F.col(f"`{c}`") for c in names], m)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: every copy to be used, with the columns of ``docs``."""
    scheduled = schedule(docs, **settings)
    return scheduled.select(*[F.col(f"`{c}`") for c in docs.columns])
