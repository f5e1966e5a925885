"""K-means and silhouette for pages too large for one task, as joins and aggregates.

Every (page, k, restart) is part of the same DataFrame job, so all large pages and all candidate k
advance together. Points lie in packed blocks, centres are packed per (page, k); nothing of a page
meets in one task but its word list and its centres.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import vectors
from pagequarry.operators.keys import Keys, block_sizes, every_part, in_blocks, top_n
from pagequarry.session import cut, fresh_path

# Points of a block.
ROWS = 4096
# Seeds that a restart draws: as many as the largest k has clusters.
DRAWS = 9
PLACES = vectors.PLACES


def race(restarts: int, seed: int) -> Column:
    """Exponential draws of a row, one per restart and seed, from hashes of its place."""
    top = float(1 << 52)
    spot = lambda i: F.pmod(F.xxhash64("pos", i, F.lit(seed)), F.lit(1 << 52)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(restarts * DRAWS - 1)), lambda i: -F.log(spot(i) / top))


def sweep(rows: DataFrame, by: Keys, restarts: int, seed: int, rounds: int = 300, block: int = 512) -> DataFrame:
    """Same output as the in-task sweep, by the same steps."""
    keys = list(by)
    points = cut(rows)
    sizes = points.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(F.size("terms") > 0).alias("has_terms")
    )
    plain = sizes.where("n < 3 OR NOT has_terms").select(*by)
    usable = sizes.where("n >= 3 AND has_terms").select(*by, "n")
    labels = cut(_lloyd(points.join(usable, keys), by, restarts, seed, rounds))
    scored = cut(scores(points, labels, by, block))
    settled = labels.groupBy(*by).agg(F.bool_and("converged").alias("converged"))
    chosen = usable.select(*by).join(settled, keys).join(best_k(scored, by), keys, "left").withColumn(
        "optimal_k", F.coalesce("optimal_k", F.lit(2))
    )
    found = labels.drop("converged").join(chosen, keys).where("k = optimal_k")
    none = F.array().cast("array<struct<k:int,silhouette:double>>")
    one = points.join(plain, keys, "left_semi").select(
        *by, "pos", F.lit(0).alias("cluster"), F.lit(1).alias("optimal_k"),
        F.lit(None).cast("double").alias("silhouette"), none.alias("sweep"), F.lit(True).alias("converged"),
    )
    return found.select(
        *by, "pos", "cluster", "optimal_k", "silhouette", F.coalesce("sweep", none).alias("sweep"), "converged"
    ).unionByName(one)


def best_k(scored: DataFrame, by: Keys) -> DataFrame:
    """(page, optimal_k, silhouette, sweep): the largest silhouette wins, the smallest k of equals."""
    best = scored.where("silhouette IS NOT NULL").groupBy(*by).agg(
        F.max_by(F.struct("k", "silhouette"), F.struct(F.round("silhouette", PLACES), -F.col("k"))).alias("best"),
        F.sort_array(F.collect_list(F.struct("k", "silhouette"))).alias("sweep"),
    )
    return best.select(*by, F.col("best.k").alias("optimal_k"), "best.silhouette", "sweep")


def _seeds(norms: DataFrame, terms: DataFrame, by: Keys, restarts: int) -> DataFrame:
    """(page, restart, draw, pos): seeds drawn one after the other, all pages and restarts at once."""
    keys = [*by, "restart"]
    near = cut(
        norms.select(*by, "pos", "norm2", "race", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
        .withColumn("draws", F.slice("race", F.col("restart") * DRAWS + 1, F.lit(DRAWS)))
        .select(*keys, "pos", "norm2", "draws", F.lit(None).cast("double").alias("d2"))
    )
    found = None
    for draw in range(DRAWS):
        spin = F.get("draws", F.lit(draw))
        away = F.round("d2", PLACES)
        # Rows on a seed can't win, unless there are no others.
        place = F.struct(
            F.coalesce(away <= 0, F.lit(False)).alias("on_seed"),
            F.when(away > 0, spin / away).otherwise(spin).alias("score"), "pos",
        )
        picked = near.groupBy(*keys).agg(F.min(place).alias("p")).select(*keys, F.col("p.pos").alias("pos"))
        told = picked.withColumn("draw", F.lit(draw))
        found = told if found is None else found.unionByName(told)
        if draw + 1 == DRAWS:
            break
        own = picked.join(norms.select(*by, "pos", F.col("norm2").alias("s2")), [*by, "pos"]).select(*keys, "s2")
        spelled = picked.join(terms, [*by, "pos"]).select(*keys, "term", F.col("w").alias("sw"))
        dots = terms.join(spelled, [*by, "term"]).groupBy(*keys, "pos").agg(F.sum(F.col("w") * F.col("sw")).alias("dot"))
        new = F.greatest(F.lit(0.0), F.col("norm2") + F.col("s2") - 2 * F.coalesce("dot", F.lit(0.0)))
        new = F.when(F.col("pos") == F.col("seed"), 0.0).otherwise(new)
        near = cut(
            near.join(own.join(picked.withColumnRenamed("pos", "seed"), keys), keys)
            .join(dots, [*keys, "pos"], "left")
            .select(*keys, "pos", "norm2", "draws", F.least(F.coalesce("d2", new), new).alias("d2"))
        )
    return found


def _lloyd(points: DataFrame, by: Keys, restarts: int, seed: int, rounds: int, block: int = ROWS) -> DataFrame:
    """(page, pos, k, cluster, converged) of the cheapest restart per k, from drawn seeds."""
    terms = cut(
        points.select(*by, "pos", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ws").alias("w"))))
    )
    norms = cut(points.select(
        *by, "pos", "n", F.aggregate("ws", F.lit(0.0), lambda a, w: a + w * w).alias("norm2"),
        race(restarts, seed).alias("race"),
    ))
    drawn = _seeds(norms, terms, by, restarts).join(norms.select(*by, "pos", "n"), [*by, "pos"])
    ks = F.filter(
        F.sequence(F.lit(2), F.lit(9)), lambda k: (k > F.col("draw")) & (k < F.least(F.lit(10), F.col("n")))
    )
    seeds = drawn.select(*by, "pos", "restart", F.col("draw").alias("cluster"), F.explode(ks).alias("k"))
    return lloyd(points, seeds, by, rounds, block)


RUN_FIELDS = (
    "restart int, changed bigint, cost double, counts array<bigint>, labels array<int>, cluster array<int>, "
    "code array<int>, total array<double>, "
    "far array<struct<own double, pos bigint, cluster int, prev int, codes array<int>, ws array<double>>>, "
    "near array<struct<own double, pos bigint, cluster int>>"
)


def lloyd(points: DataFrame, seeds: DataFrame, by: Keys, rounds: int = 300, block: int = ROWS) -> DataFrame:
    """(page, pos, k, cluster, converged) of the cheapest restart per k, from given seeds.

    ``points`` has page, pos, terms, ws; ``seeds`` has page, k, restart, cluster (from 0), pos. A page's
    points lie in packed blocks, its terms numbered. In a round a block meets the centres of a
    (page, k), all its restarts packed in one row, assigns its points, and gives back its labels and
    mergeable partial sums: per restart the changes, the cost, and count and sum per cluster. Those
    are added up where they are before they are shuffled, and are the next round's centres. Empty
    clusters take the farthest rows, of which a block with an empty cluster names enough. Runs that
    have settled leave the loop. Clusters are numbered by their first rows in the end.
    """
    keys, unit = list(by), [*by, "k"]
    run = [*unit, "restart"]
    blocks = cut(coded(points, by, block))
    work = blocks.join(seeds.select(*unit).distinct(), keys)
    rows = blocks.select(*by, F.inline(F.arrays_zip("pos", "codes", "ws")))
    counts = seeds.select(*run, "cluster", F.lit(1).cast("bigint").alias("n"))
    totals = _spelled(seeds.join(rows, [*keys, "pos"]), run)
    done, before, moves = [], None, None
    for turn in range(rounds):
        path = fresh_path(points.sparkSession, f"round-{turn}")
        _step(work, totals, counts, before, moves, unit).write.parquet(path)
        now = points.sparkSession.read.parquet(path)
        told = now.select(*unit, "part", F.inline("runs"))
        summed = cut(told.groupBy(*run).agg(
            F.sum("changed").alias("changed"), F.sum("cost").alias("cost"),
            F.array(*[F.coalesce(F.sum(F.get("counts", F.lit(c))), F.lit(0)) for c in range(DRAWS)]).alias("counts"),
        ).withColumn("counts", F.slice("counts", 1, F.col("k"))))
        moves = _moves(told, summed.where(F.array_contains("counts", F.lit(0))), run)
        if moves is not None:
            summed = cut(_moved(summed, moves, run))
        settled = (F.col("changed") == 0) if turn else F.lit(False)
        ends = summed.where(settled) if turn + 1 < rounds else summed
        done.append((now, moves, ends.select(*run, "cost", settled.alias("converged"), F.lit(turn).alias("turn"))))
        active = summed.where(~settled)
        if turn + 1 == rounds or active.isEmpty():
            break
        counts = active.select(*run, F.posexplode("counts").alias("cluster", "n"))
        totals = told.join(active.select(*run), run, "left_semi").select(
            *run, F.inline(F.arrays_zip("cluster", "code", "total"))
        )
        if moves is not None:
            out = _spelled(moves.withColumn("cluster", F.col("raw")), run, -1.0)
            totals = totals.unionByName(out).unionByName(_spelled(moves, run))
        totals = totals.groupBy(*run, "cluster", "code").agg(F.sum("total").alias("total"))
        before = now
    return _numbered(done, by)


def coded(points: DataFrame, by: Keys, block: int = ROWS) -> DataFrame:
    """(page, part, size, pos, codes, ws): blocks of a page's points, terms as places in its word list.
    Terms that are numbers are such places already."""
    if points.schema["terms"].dataType.elementType.typeName() != "string":
        sizes = points.groupBy(*by).agg(
            F.ceil(F.count("*") / block).cast("int").alias("parts"), F.coalesce(F.max(F.array_max("terms")) + 1, F.lit(0)).alias("size")
        )
        packed = in_blocks(points, by, "pos", sizes).groupBy(*by, "part", "size").agg(
            F.array_sort(F.collect_list(F.struct("pos", "terms", "ws"))).alias("_r")
        )
        return packed.select(
            *by, "part", "size", F.col("_r.pos").alias("pos"), F.col("_r.terms").alias("codes"), F.col("_r.ws").alias("ws")
        )
    words = points.select(*by, F.explode("terms").alias("term")).groupBy(*by).agg(
        F.sort_array(F.collect_set("term")).alias("words")
    )
    packed = in_blocks(points, by, "pos", block_sizes(points, by, block)).groupBy(*by, "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "terms", "ws"))).alias("_r")
    )

    @F.pandas_udf("array<array<int>>")
    def codes(terms: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for page, listed in zip(terms, words):
            place = {w: n for n, w in enumerate(listed)}
            out.append([[place[t] for t in row] for row in page])
        return pd.Series(out, dtype=object)

    met = packed.join(words, list(by), "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return met.select(
        *by, "part", F.size("words").alias("size"), F.col("_r.pos").alias("pos"),
        codes(F.col("_r.terms"), F.col("words")).alias("codes"), F.col("_r.ws").alias("ws"),
    )


def _spelled(rows: DataFrame, run: list[str], sign: float = 1.0) -> DataFrame:
    """(run, cluster, code, total) of rows with codes and ws."""
    zipped = F.arrays_zip(F.col("codes").alias("code"), F.transform("ws", lambda w: w * sign).alias("total"))
    return rows.select(*run, "cluster", F.inline(zipped))


def _step(
    work: DataFrame, totals: DataFrame, counts: DataFrame, before: DataFrame | None, moves: DataFrame | None, unit: list[str]
) -> DataFrame:
    """(page, k, part, pos, runs): every block against the centres of its page and k."""
    held = counts.groupBy(*unit).agg(F.collect_list(F.struct("restart", "cluster", "n")).alias("held"))
    sums = totals.groupBy(*unit).agg(F.collect_list(F.struct("restart", "cluster", "code", "total")).alias("sums"))
    met = work.join(held.join(sums, unit, "left"), unit)
    none = F.lit(None).cast("array<struct<restart int, labels array<int>>>")
    if before is None:
        met = met.withColumn("last", none)
    else:
        last = F.transform("runs", lambda r: F.struct(r["restart"].alias("restart"), r["labels"].alias("labels")))
        met = met.join(before.select(*unit, "part", last.alias("last")), [*unit, "part"])
    if moves is None:
        met = met.withColumn("moves", F.lit(None).cast("array<struct<restart int, pos bigint, cluster int>>"))
    else:
        listed = moves.groupBy(*unit).agg(F.collect_list(F.struct("restart", "pos", "cluster")).alias("moves"))
        met = met.join(listed, unit, "left")

    @F.pandas_udf(f"array<struct<{RUN_FIELDS}>>")
    def assign(
        k: pd.Series, size: pd.Series, pos: pd.Series, codes: pd.Series, ws: pd.Series, h_run: pd.Series, h_cluster: pd.Series,
        h_n: pd.Series, s_run: pd.Series, s_cluster: pd.Series, s_code: pd.Series, s_total: pd.Series, last: pd.Series, moves: pd.Series,
    ) -> pd.Series:
        out = []
        for one in zip(k, size, pos, codes, ws, h_run, h_cluster, h_n, s_run, s_cluster, s_code, s_total, last, moves):
            out.append(vectors.lloyd_block(*one, most=2 * DRAWS))
        return pd.Series(out, dtype=object)

    runs = assign(
        "k", "size", "pos", "codes", "ws", F.col("held.restart"), F.col("held.cluster"), F.col("held.n"),
        F.col("sums.restart"), F.col("sums.cluster"), F.col("sums.code"), F.col("sums.total"), "last", "moves",
    )
    return met.select(*unit, "part", "pos", runs.alias("runs"))


def _moves(told: DataFrame, empty: DataFrame, run: list[str]) -> DataFrame | None:
    """(run, pos, cluster, raw, prev, own, codes, ws): the rows that empty clusters take. The farthest
    from their centres go, but none that is the nearest of its cluster."""
    if empty.isEmpty():
        return None
    gaps = empty.select(*run, F.posexplode(F.filter(
        F.transform("counts", lambda n, c: F.when(n == 0, c)), lambda c: c.isNotNull()
    )).alias("i", "cluster")).select(*run, (F.col("i") + 1).alias("nth"), F.col("cluster").cast("int").alias("cluster"))
    some = told.join(empty.select(*run), run, "left_semi")
    stay = some.select(*run, F.inline("near")).groupBy(*run, F.col("cluster").alias("raw")).agg(
        F.min(F.struct("own", (-F.col("pos")).alias("p"))).alias("stay")
    )
    far = some.select(*run, F.inline("far")).withColumnRenamed("cluster", "raw").join(stay, [*run, "raw"])
    able = far.where(F.col("pos") != -F.col("stay.p")).drop("stay")
    ranked = top_n(able, run, [F.col("own").desc(), F.col("pos")], DRAWS, "nth")
    return cut(ranked.join(gaps, [*run, "nth"]).drop("nth"))


def _moved(summed: DataFrame, moves: DataFrame, run: list[str]) -> DataFrame:
    """The runs' sums after the moves."""
    told = moves.groupBy(*run).agg(
        F.sum((F.col("cluster") != F.col("prev")).cast("int") - (F.col("raw") != F.col("prev")).cast("int")).alias("more"),
        F.sum("own").alias("spared"),
        F.collect_list(F.struct("cluster", "raw")).alias("swaps"),
    )
    swapped = F.transform("counts", lambda n, c: n + F.aggregate(
        "swaps", F.lit(0).cast("bigint"),
        lambda s, m: s + (m["cluster"] == c).cast("bigint") - (m["raw"] == c).cast("bigint"),
    ))
    return summed.join(told, run, "left").select(
        *run,
        (F.col("changed") + F.coalesce("more", F.lit(0))).alias("changed"),
        (F.col("cost") - F.coalesce("spared", F.lit(0.0))).alias("cost"),
        F.when(F.col("swaps").isNull(), F.col("counts")).otherwise(swapped).alias("counts"),
    )


def _numbered(done: list[tuple[DataFrame, DataFrame | None, DataFrame]], by: Keys) -> DataFrame:
    """The cheapest restart of every k, its clusters numbered by their first rows."""
    unit = [*by, "k"]
    ended = cut(reduce(DataFrame.unionByName, [ends for _now, _moves, ends in done]))
    best = cut(ended.groupBy(*unit).agg(
        F.min(F.struct(F.round("cost", PLACES).alias("cost"), "restart", "turn")).alias("b")
    ).select(*unit, F.col("b.restart").alias("restart"), F.col("b.turn").alias("turn")))
    # Whether a page settled counts all of its runs.
    settled = ended.groupBy(*by).agg(F.bool_and("converged").alias("converged"))
    found = []
    for turn, (now, moves, _ends) in enumerate(done):
        own = now.select(*unit, "pos", F.inline(F.transform("runs", lambda r: F.struct(r["restart"].alias("restart"), r["labels"].alias("cluster")))))
        own = own.join(best.where(F.col("turn") == turn), [*unit, "restart"], "left_semi")
        labelled = own.select(*unit, "restart", F.inline(F.arrays_zip("pos", "cluster")))
        if moves is not None:
            new = moves.select(*unit, "restart", "pos", F.col("cluster").alias("_new"))
            labelled = labelled.join(new, [*unit, "restart", "pos"], "left").withColumn("cluster", F.coalesce("_new", "cluster"))
        found.append(labelled.select(*unit, "pos", "cluster"))
    found = cut(reduce(DataFrame.unionByName, found))
    # There are nine clusters at most.
    firsts = found.groupBy(*unit, "cluster").agg(F.min("pos").alias("at"))
    numbered = firsts.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("at", "cluster"))).alias("o"))
    numbered = numbered.select(*unit, F.posexplode("o").alias("nth", "c")).select(
        *unit, F.col("c.cluster").alias("cluster"), "nth"
    )
    return found.join(numbered, [*unit, "cluster"]).join(settled, list(by)).select(
        *by, "pos", "k", F.col("nth").alias("cluster"), "converged"
    )


def scores(points: DataFrame, labels: DataFrame, by: Keys, block: int = 512) -> DataFrame:
    """(page, k, silhouette): exact mean, from distance sums that block pairs compute in place."""
    keys = list(by)
    tags = labels.groupBy(*by, "pos").agg(F.map_from_entries(F.collect_list(F.struct("k", "cluster"))).alias("tags"))
    rows = points.select(*by, "pos", "terms", "ws").join(tags, [*keys, "pos"])
    placed = in_blocks(rows, by, "pos", block_sizes(rows, by, block))
    blocks = placed.groupBy(*by, "parts", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "terms", "ws", F.map_entries("tags").alias("tags")))).alias("rows")
    )
    blocks = cut(blocks)
    others = blocks.drop("parts").withColumnsRenamed({"part": "other", "rows": "other_rows"})
    pairs = blocks.withColumn("other", every_part()).join(others, [*keys, "other"])

    @F.pandas_udf("array<struct<pos: bigint, k: int, own: int, cluster: int, total: double>>")
    def sums(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_block_sums(list(a), list(b)) for a, b in zip(left, right)])

    summed = (
        pairs.select(*by, F.inline(sums("rows", "other_rows")))
        .groupBy(*by, "pos", "k", "own", "cluster").agg(F.sum("total").alias("total"))
    )
    counts = labels.groupBy(*by, "k", "cluster").agg(F.count("*").alias("size"))
    means = summed.join(counts, [*keys, "k", "cluster"])
    own = F.col("own") == F.col("cluster")
    per_row = means.groupBy(*by, "pos", "k").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.col("total"))).alias("inside"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
        F.count("*").alias("clusters"),
    )
    a = F.col("inside") / F.greatest(F.col("size") - 1, F.lit(1))
    top = F.greatest(a, F.col("b"))
    value = F.when((F.col("size") > 1) & (top > 0), (F.col("b") - a) / top).otherwise(0.0)
    return per_row.groupBy(*by, "k").agg(
        F.when((F.max("clusters") >= 2) & (F.max("clusters") < F.count("*")), F.avg(value)).alias("silhouette")
    )


def _block_sums(left: list, right: list) -> list[dict]:
    both = vectors.gram([r["terms"] for r in left + right], [r["ws"] for r in left + right])
    n = len(left)
    diag = np.diag(both)
    dist = np.sqrt(np.maximum(diag[:n, None] + diag[None, n:] - 2 * both[:n, n:], 0))
    a_pos = np.array([r["pos"] for r in left])
    dist[a_pos[:, None] == np.array([r["pos"] for r in right])[None, :]] = 0
    a_tags = [{t["key"]: t["value"] for t in r["tags"]} for r in left]
    b_tags = [{t["key"]: t["value"] for t in r["tags"]} for r in right]
    out = []
    for k in sorted(a_tags[0]):
        codes = np.array([t[k] for t in b_tags])
        for c in np.unique(codes):
            total = dist[:, codes == c].sum(axis=1)
            out += [
                {"pos": int(p), "k": int(k), "own": int(t[k]), "cluster": int(c), "total": float(v)}
                for p, t, v in zip(a_pos, a_tags, total)
            ]
    return out
