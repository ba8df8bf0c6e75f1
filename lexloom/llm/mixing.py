"""Problem 7: a mix of sources with target shares of the total size.

Every document of a source gets the same rate of use: what the source should give over what it has. The whole
part of the rate is used as it is, the rest is the probability of one more use, drawn by the cube method so
that tokens and document numbers of each source come out as expected. The flight runs in blocks of bounded
size, then in blocks of what they left undecided, until at most two documents a source are left to land.

Rules for odd input, covered by tests: source names count without case and surrounding blanks; documents
without a source or without tokens are never used; target rows repeated for a source add up; shares are scaled
to add up to 1; a source without documents keeps its share in the report, with nothing reached; where a
source's cap of repeats is too small for its share, it is used up to the cap and the report shows the gap
(``keep_shares=True`` shrinks the whole mix instead, so that every share is kept); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.streaming.ingest import ensure_checkpoints

from .tokens import token_counts

BLOCK = 2048
ROUNDS = 3


def source_name(source: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit(""))


def plan(sizes: DataFrame, targets: DataFrame, *, keep_shares: bool = False) -> DataFrame:
    """(mix, source, target_share, max_repeats, docs, has, aim, rate) of every mix and source.

    sizes: (source, docs, has); targets: mix_targets. aim is the tokens the source should give.
    """
    wanted = targets.where("mix is not null and source is not null").groupBy("mix", source_name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"), F.max("size_factor").alias("size_factor")
    )
    everything = F.coalesce(sizes.agg(F.sum("has")).scalar(), F.lit(0))
    of_mix = wanted.groupBy("mix").agg(F.sum("share").alias("shares"))
    rows = wanted.join(sizes.where("source is not null"), "source", "left").join(of_mix, "mix").select(
        "mix", "source", (F.col("share") / F.col("shares")).alias("target_share"), "max_repeats",
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("has", F.lit(0)).alias("has"), (F.col("size_factor") * everything).alias("size"),
    )
    if keep_shares:
        most = rows.where("has > 0").groupBy("mix").agg(F.min(F.col("max_repeats") * F.col("has") / F.col("target_share")).alias("most"))
        rows = rows.join(most, "mix", "left").withColumn("size", F.least("size", F.coalesce("most", F.lit(0.0)))).drop("most")
    rows = rows.withColumn("aim", F.col("target_share") * F.col("size")).drop("size")
    return rows.withColumn("rate", F.when(F.col("has") > 0, F.least(F.col("max_repeats").cast("double"), F.col("aim") / F.col("has"))).otherwise(0.0))


def flight(chance: np.ndarray, tokens: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Chances moved to 0 or 1 along directions that change neither the expected tokens nor the number.

    Any three undecided units have such a direction; a step ends where the first of them is decided, and
    the two ways are drawn so that every chance stays what it was on average. At most two are left.
    """
    chance = chance.copy()
    active: list[int] = []
    for unit in np.flatnonzero((chance > 0) & (chance < 1)):
        active.append(unit)
        if len(active) < 3:
            continue
        i, j, k = active
        way = np.array([tokens[j] - tokens[k], tokens[k] - tokens[i], tokens[i] - tokens[j]], dtype=float)
        if not way.any():
            way = np.array([1.0, -1.0, 0.0])
        now = chance[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(way > 0, (1 - now) / way, np.where(way < 0, -now / way, np.inf)))
            down = np.min(np.where(way > 0, now / way, np.where(way < 0, (now - 1) / way, np.inf)))
        now = now + (up if draw.random() * (up + down) < down else -down) * way
        now[now < 1e-9], now[now > 1 - 1e-9] = 0.0, 1.0
        chance[active] = now
        active = [u for u in active if 0 < chance[u] < 1]
    return chance


def landing(chance: np.ndarray, tokens: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The few units left, decided so that their tokens come closest to what is expected; ties are drawn."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(left):
        return chance
    ways = ((np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1).astype(float)
    miss = np.abs((ways - chance[left]) @ tokens[left]) + 1e-6 * draw.random(len(ways))
    chance = chance.copy()
    chance[left] = ways[np.argmin(miss)]
    return chance


def _decide(last: bool, seed: int):
    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "id"], ignore_index=True)
        draw = np.random.default_rng([seed, abs(int(rows["order"].iloc[0]))])
        tokens = rows["tokens"].to_numpy(float)
        chance = flight(rows["chance"].to_numpy(), tokens, draw)
        rows["chance"] = landing(chance, tokens, draw) if last else chance
        return rows

    return decide


def sized_documents(docs: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, tokens) of every document, kept in a checkpoint: it is read several times and made by encoding."""
    ensure_checkpoints(docs.sparkSession)
    named = docs.withColumn("__source", source_name(F.col(source)))
    return token_counts(named, id=id, text=text, keep=("__source",)).select(F.col(id).alias("id"), F.col("__source").alias("source"), "tokens").checkpoint()


def select_mix(docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", keep_shares: bool = False, seed: int = 1, block: int = BLOCK, sized: DataFrame | None = None) -> DataFrame:
    """(mix, id, source, tokens, copies) of every document that is used, ``copies`` times."""
    sized = sized_documents(docs, id=id, source=source, text=text) if sized is None else sized
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("has"))
    aims = plan(sizes, targets, keep_shares=keep_shares).where("rate > 0").select("mix", "source", "rate", "docs")
    rows = sized.where("source is not null and tokens > 0").join(aims, "source")
    rows = rows.select(
        "mix", "id", "source", "tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"),
        F.xxhash64(F.lit(seed), "mix", "id").alias("order"), F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("long").alias("blocks"),
    )
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are small but much work
    done = rows.where("chance <= 0")
    rows = rows.where("chance > 0")
    for n in range(ROUNDS):
        last = n == ROUNDS - 1
        # a round leaves two of a block; blocks of the next round hold about as many units as those of the first
        blocks = F.lit(1).cast("long") if last else F.greatest(F.lit(1), F.ceil(F.col("blocks") / F.lit((block // 2) ** n))).cast("long")
        rows = rows.withColumn("part", F.pmod("order", blocks)).repartition(tasks, "mix", "source", "part").groupBy("mix", "source", "part").applyInPandas(_decide(last, seed), f"{schema}, part long").drop("part")
        if not last:
            rows = rows.checkpoint()  # it is read twice, and drawn
            done = done.unionByName(rows.where("chance <= 0 or chance >= 1"))
            rows = rows.where("chance > 0 and chance < 1")
    used = done.unionByName(rows).withColumn("copies", F.col("whole") + F.round("chance").cast("int"))
    return used.where("copies > 0").select("mix", F.col("id").alias(id), "source", "tokens", "copies")


def mix_report(docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", source: str = "source", text: str = "text", keep_shares: bool = False, seed: int = 1) -> DataFrame:
    """One row per mix and source: what was aimed at and what was reached, as a share of all that the mix reached
    (reached_share) and of the size that it was to have (share_of_size), and whether the source is used up to its cap
    (at_cap). Where sources at their cap fall short, the others' reached_share rises but not their share_of_size."""
    sized = sized_documents(docs, id=id, source=source, text=text)
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("has"))
    chosen = select_mix(docs, targets, id=id, source=source, text=text, keep_shares=keep_shares, seed=seed, sized=sized)
    reached = chosen.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    whole = reached.groupBy("mix").agg(F.sum("reached").alias("of_mix"))
    zero = F.coalesce(F.col("reached"), F.lit(0))
    return plan(sizes, targets, keep_shares=keep_shares).join(reached, ["mix", "source"], "left").join(whole, "mix", "left").select(
        "mix", "source", "target_share", F.coalesce(F.try_divide(zero, F.try_divide("aim", "target_share")), F.lit(0.0)).alias("share_of_size"),
        ((F.col("has") > 0) & (F.col("rate") >= F.col("max_repeats"))).alias("at_cap"), F.round("aim").cast("long").alias("aimed_tokens"), zero.alias("reached_tokens"),
        F.coalesce(zero / F.col("of_mix"), F.lit(0.0)).alias("reached_share"), F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", F.col("rate").alias("mean_uses"),
    )
