"""The whole page report as one composition: segments in, one row per page out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import clean as C
from pagequarry.operators import entities as N
from pagequarry.operators import history as H
from pagequarry.operators import neardup as ND
from pagequarry.operators import segments as G
from pagequarry.operators import sentiment as S
from pagequarry.operators import terms as W
from pagequarry.operators import topics as K
from pagequarry.operators.keys import Keys
from pagequarry.session import cut, fresh_path

# Lines up to which a page is reported in its row.
PAGE_LINES = 2048


@dataclass(frozen=True)
class Stages:
    """Tables behind the report; each is a plain DataFrame keyed by page."""

    rows: DataFrame
    labelled: DataFrame
    named: DataFrame
    top_entities: DataFrame
    graph: DataFrame
    takeaways: DataFrame
    status: DataFrame


def stages(pages: DataFrame, segments: DataFrame, gazetteer: DataFrame, by: Keys, capitals: bool = True) -> Stages:
    """Run every stage once. What several later stages read is cut on shared storage, so that the
    near-duplicate search and the k-means sweep are not repeated for each reader."""
    kept = cut(ND.drop_near_duplicates(C.distinct_cleaned(segments, by), by))
    status = cut(G.page_status(pages, segments, kept, by))
    usable = status.where("status = 'ok'").select(*by)
    rows = cut(S.score(kept.join(usable, list(by), "left_semi")))
    labelled = cut(K.topics_of(rows, by))
    named = K.named_topics(labelled, K.names_of(labelled, by), by)
    found = cut(N.mentions(N.tagged(N.page_sentences(rows, by), gazetteer, by, capitals), by))
    chosen = N.top_nodes(N.nodes(found, by), by)
    graph = N.packed_graph(usable, chosen, N.top_edges(N.edges(found, chosen, by), by), by)
    # A page of one topic has no takeaways.
    several = labelled.where("optimal_k > 1").select(*by, "pos", "tfidf_score")
    dense = rows.select(*by, "pos", "text").join(several, [*by, "pos"])
    return Stages(
        rows, labelled, named, N.top_entities(found, by), graph, K.takeaways(dense, by), status
    )


def records(rows: DataFrame, named: DataFrame, by: Keys, *extra: str) -> DataFrame:
    """Result records: text, cluster, sentiment, cleaned."""
    topics = named.select(*by, "pos", "cluster", "cluster_name")
    return records_of(rows.join(topics, [*by, "pos"]), by, *extra)


def records_of(rows: DataFrame, by: Keys, *extra: str) -> DataFrame:
    """The same of scored rows that carry their topics."""
    return rows.select(*extra, *by, "pos", "text", "cluster", "cluster_name", "sentiment", "cleaned")


def report(s: Stages, by: Keys) -> DataFrame:
    """One row per page, rejected pages included with their status."""
    keys = list(by)
    basic = s.rows.groupBy(*by).agg(
        F.count("*").alias("total_items"), F.avg("subjectivity").alias("avg_subjectivity")
    ).withColumn("human_time_mins", H.reading_minutes(F.col("total_items")))

    def as_map(df: DataFrame, key: str, name: str) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct(key, "n")))
        return df.groupBy(*by).agg(F.map_from_entries(entries).alias(name))

    sentiment = as_map(S.label_counts(s.rows, by), "sentiment_label", "sentiment_counts")
    clusters = as_map(K.topic_counts(s.named, by), "cluster_name", "cluster_counts")
    sizes = s.labelled.groupBy(*by).agg(F.max("size").alias("size"))
    numbers = K.metrics_of(s.labelled, sizes, by).select(
        *by, F.struct("silhouette", "optimal_k", "vocab_size").alias("metrics")
    )
    picks = s.takeaways.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda t: t["text"]).alias("takeaways")
    )
    out = s.status.select(*by, "status")
    for part in (basic, sentiment, clusters, numbers, picks, _listed(s.top_entities, by), s.graph):
        out = out.join(part, keys, "left")
    return out.withColumn("takeaways", F.coalesce("takeaways", F.array().cast("array<string>")))


def _listed(top_entities: DataFrame, by: Keys) -> DataFrame:
    listed = top_entities.groupBy(*by, "category").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda e: F.struct(e["name"].alias("name"), e["n"].alias("n"))
        ).alias("names")
    )
    return listed.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "names")))).alias("entities"))


def report_of(pages: DataFrame, gazetteer: DataFrame, by: Keys, capitals: bool = True, body: str = "text", limit: int = PAGE_LINES) -> DataFrame:
    """:func:`report` of pages of lines. Those of up to ``limit`` lines that are the only row of their key are
    cleaned, scored and swept in their row; of these only names and finished rows are shuffled. What is left of
    them after cleaning is written once and read twice: for their sentences, and for all else."""
    keys, spark = list(by), pages.sparkSession
    missing = F.expr(" OR ".join(f"`{c}` IS NULL" for c in keys))
    held = C.page_lines(pages.where(~missing), by, body, limit=limit)
    kept = ND.kept_rows(held, by)
    status = G.status_of(F.col("n_lines"), F.size("_rows"))
    path = fresh_path(spark, "kept")
    kept.select(*by, status.alias("status"), F.when(status == "ok", F.col("_rows")).alias("_rows")).write.parquet(path)
    small = spark.read.parquet(path)
    usable = small.where("status = 'ok'")
    rows = C.Pages(usable.select(*by, "_rows"), None)
    found = cut(N.mentions(N.tagged(N.page_sentences(rows, by), gazetteer, by, capitals), by))
    chosen = N.top_nodes(N.nodes(found, by), by)
    graph = N.packed_graph(usable, chosen, N.top_edges(N.edges(found, chosen, by), by), by)
    out = small.select(*by, "status")
    for part in (_summaries(rows, by), _listed(N.top_entities(found, by), by), graph):
        out = out.join(part, keys, "left")
    out = out.withColumn("takeaways", F.coalesce("takeaways", F.array().cast("array<string>")))
    others = pages.where(missing).select(*by, body)
    others = cut(others if held.others is None else others.unionByName(held.others))
    if others.isEmpty():
        return out
    rest = report(stages(others, G.split_lines(others, by, body), gazetteer, by, capitals), by)
    return out.unionByName(rest.select(*out.columns))


def _summaries(rows: C.Pages, by: Keys) -> DataFrame:
    """What the report has of a page but its names, from its cleaned segments, in its row."""
    keys = list(by)

    def made(batch: pa.RecordBatch, terms: W.PageTerms) -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum(terms.held)])
        start, pages = pa.array(first[:-1]), len(terms.held)
        swept = dict(zip(K.SWEPT, K.swept_columns(terms, batch.column("pos").to_numpy())))
        ks, scores = swept["optimal_k"].take(start), swept["tfidf_score"].to_numpy()
        subjective = np.bincount(terms.page, batch.column("subjectivity").to_numpy(), pages) / terms.held
        label = batch.column("sentiment_label").dictionary_encode()
        names = label.dictionary.to_pylist()
        counts = [[] for _ in terms.held]
        for (page, code), n in zip(*_counted(terms.page, label.indices.to_numpy(zero_copy_only=False))):
            counts[page].append({"sentiment_label": names[code], "n": n})
        clusters, (spots, sizes, at) = [[] for _ in terms.held], _counted(terms.page, swept["cluster"].to_numpy(), True)
        for (page, cluster), n, top in zip(spots, sizes, swept["top"].take(pa.array(at)).to_pylist()):
            clusters[page].append({"cluster": cluster, "n": n, "top": top})
        texts, takeaways = batch.column("text"), []
        for p, k in enumerate(ks.to_pylist()):
            # A page of one topic has no takeaways.
            own = texts.slice(first[p], terms.held[p]).to_pylist() if k > 1 else []
            takeaways.append([own[i] for i in K.chosen(own, scores[first[p] : first[p + 1]])] if own else [])
        columns = [
            pa.array(terms.held.astype(np.int64)), pa.array(subjective),
            pa.array([sorted(c, key=lambda x: x["sentiment_label"]) for c in counts], pa.list_(pa.struct([("sentiment_label", pa.string()), ("n", pa.int64())]))),
            pa.array(clusters, pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("top", pa.list_(pa.string()))]))),
            ks, swept["silhouette"].take(start), swept["size"].take(start), pa.array(takeaways, pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(start) for c in keys], *columns], [*keys, *told])

    told = ["total_items", "avg_subjectivity", "labels", "clusters", "optimal_k", "silhouette", "size", "takeaways"]
    shape = (
        "total_items bigint, avg_subjectivity double, labels array<struct<sentiment_label:string,n:bigint>>, "
        "clusters array<struct<cluster:int,n:bigint,top:array<string>>>, optimal_k int, silhouette double, size bigint, takeaways array<string>"
    )
    found = W.over_pages(rows, by, made, shape, ["text", "sentiment_label", "subjectivity"], through=S.score)
    named = F.transform("clusters", lambda c: F.struct(
        F.when(F.col("optimal_k") == 1, K.GENERAL).otherwise(K.topic_name(c["cluster"], c["top"])).alias("cluster_name"), c["n"].alias("n")
    ))
    return found.select(
        *by, "total_items", "avg_subjectivity", H.reading_minutes(F.col("total_items")).alias("human_time_mins"),
        F.map_from_entries("labels").alias("sentiment_counts"), F.map_from_entries(F.sort_array(named)).alias("cluster_counts"),
        F.struct(*K.metric_columns()).alias("metrics"), "takeaways",
    )


def _counted(page: np.ndarray, code: np.ndarray, places: bool = False) -> tuple:
    """The pairs of page and code that occur, in their order, how often, and where first."""
    width = int(code.max(initial=0)) + 1
    spots, at, n = np.unique(page * width + code, return_index=True, return_counts=True)
    pairs = list(zip((spots // width).tolist(), (spots % width).tolist()))
    return (pairs, n.tolist(), at) if places else (pairs, n.tolist())
