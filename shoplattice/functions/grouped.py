"""Skew-safe building blocks: percentiles, pair generation, salted joins, block matching.

Everything here avoids putting one hot key into one task: work is pre-aggregated
map-side, and where a group must be looked at row by row it is first split into
deterministic buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shoplattice.session import materialise

SLICES = 64
#: Rows of a tile of vectors at most, items of one matrix product, and queries of one.
TILE, STEP, QUERIES = 32_768, 2_048, 256
#: Item pairs of a task, about, and how often a pair should occur for combining before the shuffle to pay.
PAIR_ROWS, PAIR_REPEATS = 250_000, 8


def scalar(df: DataFrame, expr: Column) -> Column:
    """One global aggregate as an uncorrelated scalar subquery (no cross join)."""
    return df.agg(expr).scalar()


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
) -> DataFrame:
    """Exact linearly interpolated percentiles per group.

    1. collapse equal values to (key, value, count), combined map-side;
    2. cut every group's distinct values at approximate quantiles into coarse
       slices of about equal size, and each slice into equal widths; count the
       buckets, so that a prefix sum over at most SLICES * SLICES rows per group
       tells where each wanted rank lies;
    3. rank only the rows of the buckets that hold a wanted rank, per bucket.
    The quantiles only balance the buckets, so an outlier moves one slice's
    values together at most, and the result stays exact. They depend on the order
    in which partial sketches meet, so they are written once: steps 2 and 3 must
    see the same buckets.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull())
    if not keys:
        base, keys_ = base.withColumn("_g", F.lit(1)), ["_g"]
    else:
        keys_ = keys
    counts = base.groupBy(*keys_, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    span = counts.groupBy(*keys_).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"),
        F.percentile_approx("_v", [i / SLICES for i in range(1, SLICES)], 1000).alias("_e"))
    edges = F.concat(F.array("_lo"), F.col("_e"), F.array("_hi"))
    span = materialise(span.withColumn("_e", edges), "percentile-edges")
    slotted = _null_safe_join(counts, span, keys_)
    slotted = slotted.withColumn("_s", F.greatest(F.size(F.filter("_e", lambda e: e < F.col("_v"))), F.lit(1)))
    low, high = F.element_at("_e", F.col("_s")), F.element_at("_e", F.least(F.col("_s") + 1, F.lit(SLICES + 1)))
    inside = F.when(high > low, F.least(F.floor((F.col("_v") - low) / (high - low) * SLICES), F.lit(SLICES - 1))).otherwise(0)
    slotted = slotted.withColumn("_b", (F.col("_s") * SLICES + inside).cast("int")).drop("_e", "_s")
    per_bucket = slotted.groupBy(*keys_, "_b").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
    w = W.partitionBy(*keys_).orderBy("_b")
    before = F.coalesce(F.sum("_bc").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # wanted zero-based ranks: floor and ceil of p * (n - 1)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"))
        for name, p in probs.items()
    ])
    ends = (
        per_bucket.withColumn("_before", before)
        .withColumn("_w", F.explode(wanted))
        .select(*keys_, "_b", "_bc", "_before", F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"))
        .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_bc")))
    )
    live = _null_safe_join(slotted, ends.select(*keys_, "_b").distinct(), [*keys_, "_b"], how="left_semi")
    wb = W.partitionBy(*keys_, "_b").orderBy("_v")
    ranked = live.select(
        *keys_, "_b", "_v", "_c", F.sum("_c").over(wb.rowsBetween(W.unboundedPreceding, 0)).alias("_cum"))
    hit = _null_safe_join(ends, ranked, [*keys_, "_b"]).where(
        (F.col("_r") - F.col("_before") < F.col("_cum"))
        & (F.col("_r") - F.col("_before") >= F.col("_cum") - F.col("_c")))
    frac = F.max("_pos") - F.floor(F.max("_pos"))
    per_name = hit.groupBy(*keys_, "_name").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), frac.alias("_f")).withColumn("_q", _between("_lo", "_hi", "_f"))
    out = per_name.groupBy(*keys_).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs])
    return out if keys else out.drop("_g")


def _between(low: str, high: str, share: str) -> Column:
    """low * (1 - share) + high * share as the SQL's engine computes it, the first product and the sum rounded together (a fused
    multiply-add), so that prices compare with a percentile alike on both sides. The product's error is had by splitting."""
    def split(x: Column) -> tuple[Column, Column]:
        head = x * 134217729.0 - (x * 134217729.0 - x)
        return head, x - head

    a, rest, other = F.col(low), 1.0 - F.col(share), F.col(high) * F.col(share)
    (a1, a2), (r1, r2) = split(a), split(rest)
    product = a * rest
    lost = ((a1 * r1 - product) + a1 * r2 + a2 * r1) + a2 * r2
    total = product + other
    back = total - product
    fused = total + (((product - (total - back)) + (other - back)) + lost)
    return F.when(F.col(share) == 0, a).when(F.abs(fused) < 1e290, fused).otherwise(total)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    cond = F.lit(True)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
        cond = cond & left[k].eqNullSafe(F.col(f"_r_{k}"))
    out = left.join(renamed, cond, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{k}" for k in keys])


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: str, salts: int = 16, how: str = "inner",
) -> DataFrame:
    """Equi-join for a big side with hot keys: rows of a key are spread over ``salts`` tasks.

    The small side is repeated per salt, so it is meant for the side with few rows per key.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copied, [*keys, "_salt"], how).drop("_salt")


def group_items(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct (group, item); whole groups are dealt into parts that follow from the rows, and no task holds more."""
    return df.select(group, item).repartition(max(1, -(-df.count() // PAIR_ROWS)), group).distinct()


def item_pairs(
    df: DataFrame, group: str, item: str, payload: Sequence[str] = (), block: int = 256,
) -> DataFrame:
    """Unordered item pairs of every group as (a, b, <payload>_a, <payload>_b), a < b.

    ``df`` must be unique on (group, item). A group larger than ``block`` items
    is cut into blocks by item hash and every pair of blocks becomes its own
    join key, so the largest group is spread over many tasks and no task sees
    more than two blocks of it. ``df`` is written first: from the pairs it holds
    follows the number of parts in which they are made. Where the items are so
    few that pairs must repeat, they are streamed into the caller's aggregation,
    which combines them map-side before any shuffle. Else, that would only hold
    them all, so they leave dealt by (a, b) into as many parts.
    """
    df = materialise(df.select(group, item, *payload), "pair-items")
    by_group = df.repartition(max(1, -(-df.count() // PAIR_ROWS)), group)
    sizes = by_group.groupBy(group).agg(F.count("*").alias("_size"))
    pairs = sizes.agg(F.sum(F.expr("_size * (_size - 1) div 2"))).first()[0] or 0
    items = df.agg(F.approx_count_distinct(item)).first()[0]
    parts = max(1, -(-pairs // PAIR_ROWS))
    blocks = F.ceil(F.col("_size") / F.lit(float(block))).cast("int")
    cut = (
        by_group.join(sizes, group)
        .withColumn("_nb", blocks)
        .withColumn("_blk", F.pmod(F.xxhash64(item), F.col("_nb").cast("long")).cast("int"))
    )
    left = cut.select(
        group, F.col("_blk").alias("_bi"), F.explode(F.sequence(F.col("_blk"), F.col("_nb") - 1)).alias("_bj"),
        F.col(item).alias("_l"), *[F.col(p).alias(f"_l_{p}") for p in payload])
    right = cut.select(
        group, F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_bi"), F.col("_blk").alias("_bj"),
        F.col(item).alias("_r"), *[F.col(p).alias(f"_r_{p}") for p in payload])
    dealt = lambda side: side.repartition(parts, group, "_bi", "_bj")
    joined = dealt(left).join(dealt(right), [group, "_bi", "_bj"]).where(
        (F.col("_bi") < F.col("_bj")) | (F.col("_l") < F.col("_r")))
    swap = F.col("_l") > F.col("_r")
    cols = [
        F.when(swap, F.col("_r")).otherwise(F.col("_l")).alias("a"),
        F.when(swap, F.col("_l")).otherwise(F.col("_r")).alias("b"),
    ]
    for p in payload:
        cols.append(F.when(swap, F.col(f"_r_{p}")).otherwise(F.col(f"_l_{p}")).alias(f"{p}_a"))
        cols.append(F.when(swap, F.col(f"_l_{p}")).otherwise(F.col(f"_r_{p}")).alias(f"{p}_b"))
    out = joined.select(*cols)
    return out if pairs > PAIR_REPEATS * items * items // 2 else out.repartition(parts, "a", "b")


def both_directions(pairs: DataFrame, *cols: str) -> DataFrame:
    """Edge list with every pair seen from both ends."""
    edge = F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(edge.alias("_e"), *cols).select("_e.src", "_e.dst", *cols)


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the rank filter is pushed below the shuffle by WindowGroupLimit."""
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def numbered(df: DataFrame, order: Sequence[Column], pos: str = "pos") -> DataFrame:
    """Rows with dense positions from 1 in the given total order.

    The rows are dealt by range, ranked inside each range and shifted by the rows of the ranges before; only the ranges'
    sizes meet in one task. The dealt rows are written first, so that a lost executor can't deal them anew.
    """
    placed = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_i", inside).join(sizes.select("_range", before.alias("_before")), "_range").withColumn(
        pos, F.col("_before") + F.col("_i")).drop("_range", "_i", "_before")


def best_unseen(ranking: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(user_id, product_id, pos, rank): the first ``k`` products of a shared ranking (product_id, pos) that a user hasn't
    seen. A user with s seen products finds them among the first k + s, so each user reads just that many."""
    known = seen.select("user_id", "product_id").distinct()
    depth = known.groupBy("user_id").agg(F.count("*").alias("_s"))
    reach = users.select("user_id").distinct().join(depth, "user_id", "left").select(
        "user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_s", F.lit(0)) + k)).alias("pos"))
    open_ = reach.join(ranking.select("product_id", "pos"), "pos").join(known, ["user_id", "product_id"], "left_anti")
    return top_k(open_, ["user_id"], [F.col("pos")], k)


def running_base(
    df: DataFrame, key: str, bucket: str, ts: str, tiebreak: str, gap_seconds: int,
) -> DataFrame:
    """Session numbering that survives a hot key.

    Rows are ordered only inside (key, bucket); what crosses buckets is one
    summary row per (key, bucket). Adds ``session_no`` counting from 1.
    """
    wb = W.partitionBy(key, bucket).orderBy(ts, tiebreak)
    gap = F.lit(gap_seconds * 1_000_000)
    local = (
        df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
        .withColumn("_prev", F.lag("_us").over(wb))
        .withColumn("_new", F.when(F.col("_us") - F.col("_prev") > gap, 1).otherwise(0))
        .withColumn("_cum", F.sum("_new").over(wb))
    )
    summary = local.groupBy(key, bucket).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.sum("_new").alias("_starts"))
    wk = W.partitionBy(key).orderBy(bucket)
    opens = F.when(F.lag("_last").over(wk).isNull() | (F.col("_first") - F.lag("_last").over(wk) > gap), 1).otherwise(0)
    stitched = summary.withColumn("_open", opens)
    total = F.col("_open") + F.col("_starts")
    base = F.coalesce(F.sum(total).over(wk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_open")
    stitched = stitched.select(key, bucket, base.alias("_base"))
    return (
        local.join(stitched, [key, bucket])
        .withColumn("session_no", F.col("_base") + F.col("_cum"))
        .drop("_us", "_prev", "_new", "_cum", "_base")
    )


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, ids and scores of each query's best ``k`` (by score to six digits, then id), and each query's least
    score, infinite if it has none. Items are met in steps; after the first only scores that may still enter are looked at."""
    rows, found, scores = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
    bar, least = np.full(len(q), -np.inf), np.full(len(q), np.inf)
    for at in range(0, len(c), STEP):
        some = ids[at:at + STEP]
        s = q @ c[at:at + STEP].T
        low = s.min(axis=1)
        least = np.minimum(least, low if np.isfinite(low).all() else np.where(np.isfinite(s), s, np.inf).min(axis=1))
        if not at and len(some) > k:
            open_ = np.isfinite(s) & (qids[:, None] != some) if exclude_self else np.isfinite(s)
            bar = np.round(np.partition(np.where(open_, s, -np.inf), len(some) - k, axis=1)[:, len(some) - k], 6) - 1e-6
        row, col = np.divmod(np.flatnonzero(s >= bar[:, None]), len(some))
        fits = np.isfinite(s[row, col])
        if exclude_self:
            fits &= qids[row] != some[col]
        row, col = row[fits], col[fits]
        rows, found, scores = np.concatenate([rows, row]), np.concatenate([found, some[col]]), np.concatenate([scores, s[row, col]])
        rounded = np.round(scores, 6)
        order = np.lexsort((found, -rounded, rows))
        rows, found, scores, rounded = rows[order], found[order], scores[order], rounded[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = nth == k - 1
        bar[rows[last]] = rounded[last] - 1e-6
        kept = nth < k
        rows, found, scores = rows[kept], found[kept], scores[kept]
    return rows, found, scores, least


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _side(rows: int) -> int:
    """Tiles along one side: of at most TILE rows, but some of them while there are rows enough for several tasks."""
    return max(1, -(-rows // TILE), min(-(-rows // STEP), 8))


def block_best(
    queries: DataFrame, catalogue: DataFrame, k: int, query_vec: str = "vector", item_vec: str = "vector",
    exclude_self: bool = False, group: str | None = None, least: bool = False, tiles: tuple[int, int] | None = None,
) -> DataFrame:
    """(query_id, id, score, own): each query's best ``k`` of every tile of the catalogue, for ``top_k``.

    Both sides are (id, vector) and are dealt into tiles by id; a task scores one tile of queries against one of the
    catalogue by small matrix products, and only the best ``k`` per query leave it, so the score matrix never becomes rows.
    A row is sent once for each tile of the other side, of which there are few. With ``group`` the best ``k`` of the query's
    own group are added (``own``), with ``least`` a row without id that holds the query's least score.
    """
    qb, cb = tiles or (_side(queries.count()), _side(catalogue.count()))
    extra = [F.col(group).cast("long").alias("grp")] if group else []
    tile = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("id").alias("qid"), F.col(query_vec).alias("vec"), *extra, tile(qb).alias("qb"), every(cb).alias("cb"))
    c = catalogue.select(F.col("id").alias("cid"), F.col(item_vec).alias("vec"), *extra, tile(cb).alias("cb"), every(qb).alias("qb"))

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(cs):
            ids, vectors, qids, asked = cs.cid.to_numpy(), _vectors(cs.vec), qs.qid.to_numpy(), _vectors(qs.vec)
            parts = [(False, np.arange(len(qids)), slice(None))]
            if group:
                mine, theirs = qs.grp.to_numpy(), cs.grp.to_numpy()
                parts += [(True, np.flatnonzero(mine == g), theirs == g) for g in pd.unique(mine) if not pd.isna(g)]
            for own, members, items in parts:
                known, against = ids[items], vectors[items]
                for at in range(0, len(members) if len(known) else 0, QUERIES):
                    some = members[at:at + QUERIES]
                    rows, found, scores, low = _best(qids[some], asked[some], known, against, k, exclude_self)
                    out.append(pd.DataFrame({"query_id": qids[some][rows], "id": found, "score": scores, "own": own}))
                    if least and not own:
                        seen = np.isfinite(low)
                        out.append(pd.DataFrame({"query_id": qids[some][seen], "id": pd.array([None] * int(seen.sum()), "Int64"), "score": low[seen], "own": own}))
        return pd.concat([o.astype({"id": "Int64"}) for o in out]) if out else pd.DataFrame({"query_id": [], "id": [], "score": [], "own": []})

    dealt = lambda df: df.repartition(qb * cb, "qb", "cb").groupBy("qb", "cb")
    return dealt(q).cogroup(dealt(c)).applyInPandas(score, "query_id long, id long, score double, own boolean")


def block_topk(
    queries: DataFrame, catalogue: DataFrame, k: int, query_vec: str = "vector", item_vec: str = "vector",
    block_rows: int | None = None, exclude_self: bool = False,
) -> DataFrame:
    """Exact inner-product top-k (query_id, id, score, rank) of every query against every catalogue vector; the tiles follow
    from the two row counts, or have about ``block_rows`` rows."""
    tiles = None
    if block_rows:
        tiles = (max(1, -(-queries.count() // block_rows)), max(1, -(-catalogue.count() // block_rows)))
    part = block_best(queries, catalogue, k, query_vec, item_vec, exclude_self, tiles=tiles).drop("own")
    return top_k(part, ["query_id"], [F.round("score", 6).desc(), F.col("id").asc()], k)
