"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.functions import filters, scalars, scoring
from nearmark.functions.distance import distance, norm
from nearmark.operators import balls, bitmaps, corpus, flat, intervals, ivf, oplog, quantise, report, selection, sketches, splits
from nearmark.operators.knn import Match, attach_neighbours, knn, neighbour_lists, rerank, search
from nearmark.operators.postings import knn_by_postings
from nearmark.plans import fixtures as fx
from nearmark.plans.evaluate import score_results, summary
from nearmark.schema import COSINE, DOTPRODUCT, EUCLIDEAN, METRICS, VectorDataset
from nearmark.session import scratch_path, stored
from nearmark.sources import datasets, synth, tables
from nearmark.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Timestamps in the tables carry no zone; read them as UTC throughout.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(value: Column | str, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(col) < 0.5 * 10**-places, F.lit(0.0)).otherwise(F.round(col, places))


def _shown(neighbours: DataFrame, *extra: str) -> DataFrame:
    return neighbours.select(*extra, "query_id", "rank", "id", rounded("distance").alias("distance"))


def _rounded_all(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[rounded(c).alias(c) for c in df.columns if c not in keep])


# Neighbour joins -----------------------------------------------------------


def _exact(metric: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(knn(fx.records(spark, sf_dir), fx.queries(spark, sf_dir), metric))


@registered
def knn_cosine(spark, sf_dir):
    return _exact(COSINE, spark, sf_dir)


@registered
def knn_euclidean(spark, sf_dir):
    return _exact(EUCLIDEAN, spark, sf_dir)


@registered
def knn_dotproduct(spark, sf_dir):
    return _exact(DOTPRODUCT, spark, sf_dir)


@registered
def knn_variable_k(spark, sf_dir):
    queries = fx.queries(spark, sf_dir, 5 + F.col("vec_id") % 7)
    return _shown(knn(fx.records(spark, sf_dir), queries, EUCLIDEAN))


@registered
def knn_bounded(spark, sf_dir):
    """Same rows as knn_euclidean, emitting only pairs within a known limit."""
    records = fx.records(spark, sf_dir)
    part = records.where(F.col("label") == 0)
    return _shown(knn(records, fx.queries(spark, sf_dir), EUCLIDEAN, bound_from=part))


@registered
def knn_grid(spark, sf_dir):
    """Same rows as knn_cosine, by blocks of both sides meeting in tasks."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    return _shown(knn(records, queries, COSINE, strategy="grid", block_bytes=256 << 10))


@registered
def knn_filtered(spark, sf_dir):
    queries = filters.with_required(fx.queries(spark, sf_dir))
    return _shown(knn(fx.records(spark, sf_dir), queries, EUCLIDEAN, Match(tags=True)))


@registered
def knn_filtered_postings(spark, sf_dir):
    queries = filters.with_required(fx.queries(spark, sf_dir))
    return _shown(knn_by_postings(fx.records(spark, sf_dir), queries, EUCLIDEAN))


@registered
def knn_filtered_bitmaps(spark, sf_dir):
    queries = filters.with_required(fx.queries(spark, sf_dir))
    rows = bitmaps.numbered(fx.records(spark, sf_dir))
    return _shown(bitmaps.knn_by_bitmaps(rows, bitmaps.bitmap_index(rows), queries, EUCLIDEAN))


@registered
def tag_bitmaps(spark, sf_dir):
    """Records that hold each set of tags which some query requires, read off the bitmaps."""
    queries = filters.with_required(fx.queries(spark, sf_dir))
    found = bitmaps.matching(bitmaps.bitmap_index(bitmaps.numbered(fx.records(spark, sf_dir))), queries)
    return found.groupBy(F.array_join("need", ",").alias("tags")).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("records"))


@registered
def knn_pq_rerank(spark, sf_dir):
    """Every record is a candidate, so the answer is exact."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    books = quantise.fit_codebooks(records, EUCLIDEAN)
    codes = stored(quantise.encode(records.select("id", "values"), books, EUCLIDEAN), "codes")
    times = -(-records.count() // fx.TOP_K)
    return _shown(quantise.pq_search(records, codes, books, queries, EUCLIDEAN, times))


@registered
def knn_pq_recall(spark, sf_dir):
    """Share of true neighbours among four and forty times as many candidates, rounded to yes or no."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    books = quantise.fit_codebooks(records, COSINE, parts=32)
    codes = stored(quantise.encode(records.select("id", "values"), books, COSINE), "codes")
    truth = stored(knn(records, queries, COSINE).select("query_id", "id"), "truth")
    out = None
    for times in (4, 40):
        some = quantise.candidates(codes, books, queries, COSINE, times)
        share = some.join(truth, ["query_id", "id"]).count() / max(1, truth.count())
        row = spark.range(1).select(F.lit(times).alias("times"), F.lit(share >= 0.9).alias("recall_reached"))
        out = row if out is None else out.unionByName(row)
    return out


@registered
def knn_filtered_deep(spark, sf_dir):
    """A top_k beyond the number of matching records returns them all."""
    queries = filters.with_required(fx.queries(spark, sf_dir, F.lit(100)))
    found = knn(fx.records(spark, sf_dir), queries, COSINE, Match(tags=True))
    sizes = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return queries.join(sizes, "query_id", "left").select(
        "query_id", F.coalesce("found", F.lit(0)).cast("bigint").alias("found")
    )


@registered
def knn_stepped(spark, sf_dir):
    records = splits.assign_steps(fx.records(spark, sf_dir), "id", 4)
    queries = splits.assign_steps(fx.queries(spark, sf_dir), "query_id", 4)
    return _shown(knn(records, queries, COSINE, Match(step=True)))


@registered
def knn_namespaced(spark, sf_dir):
    found = knn(fx.records(spark, sf_dir), fx.queries(spark, sf_dir), EUCLIDEAN, Match(by=("namespace",)))
    return _shown(found)


@registered
def knn_overfetch(spark, sf_dir):
    """Twice top_k candidates by Euclidean distance, ranked again by cosine."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    wide = queries.withColumn("top_k", (F.col("top_k") * 2).cast("int"))
    return _shown(rerank(knn(records, wide, EUCLIDEAN), records, queries, COSINE))


@registered
def distance_columns(spark, sf_dir):
    """Distances between columns: each record and the mean of its label."""
    means = _centroids(spark, sf_dir).select(F.col("list_id").alias("label"), F.col("values").alias("mean"))
    pairs = fx.records(spark, sf_dir).join(means, "label")
    return pairs.select(
        "id", rounded(norm("values")).alias("length"),
        *[rounded(distance(m, "values", "mean")).alias(m) for m in METRICS],
    )


def _centroids(spark, sf_dir) -> DataFrame:
    return stored(ivf.mean_centroids(fx.records(spark, sf_dir), "label"), "centroids")


@registered
def ivf_assignment(spark, sf_dir):
    assigned = ivf.assign_lists(fx.records(spark, sf_dir), _centroids(spark, sf_dir), EUCLIDEAN)
    return assigned.select("id", "list_id")


@registered
def knn_ivf_fixed_centroids(spark, sf_dir):
    centroids = _centroids(spark, sf_dir)
    assigned = ivf.assign_lists(fx.records(spark, sf_dir), centroids, EUCLIDEAN)
    return _shown(ivf.ivf_search(assigned, centroids, fx.queries(spark, sf_dir), EUCLIDEAN, 3))


@registered
def knn_ivf_trained(spark, sf_dir):
    records = fx.records(spark, sf_dir)
    lists = max(8, ivf.default_lists(records.count()))
    centroids = ivf.fit_centroids(records, lists, EUCLIDEAN, seed=7)
    assigned = ivf.assign_lists(records, centroids, EUCLIDEAN)
    probes = ivf.default_probes(lists)
    return _shown(ivf.ivf_search(assigned, centroids, fx.queries(spark, sf_dir), EUCLIDEAN, probes))


@registered
def knn_ivf_every_list(spark, sf_dir):
    """A trained index that probes all its lists is exact."""
    records = fx.records(spark, sf_dir)
    centroids = stored(ivf.fit_centroids(records, 8, EUCLIDEAN, seed=7), "centroids")
    assigned = ivf.assign_lists(records, centroids, EUCLIDEAN)
    return _shown(ivf.ivf_search(assigned, centroids, fx.queries(spark, sf_dir), EUCLIDEAN, 8))


@registered
def neighbours_attached(spark, sf_dir):
    """Filtered ground truth as lists; queries that nothing matches have empty ones."""
    asked = filters.with_required(fx.queries(spark, sf_dir))
    found = attach_neighbours(asked, knn(fx.records(spark, sf_dir), asked, EUCLIDEAN, Match(tags=True)))
    return found.select("query_id", F.size("neighbors").cast("bigint").alias("found"), F.try_element_at("neighbors", F.lit(1)).alias("best"))


def _balls(spark, sf_dir, metric):
    records = fx.records(spark, sf_dir)
    centroids = stored(ivf.fit_centroids(records, 12, metric, seed=7), "centroids")
    return balls.build(records, centroids, metric, scratch_path(spark, "balls"))


@registered
def knn_balls_euclidean(spark, sf_dir):
    return _shown(balls.ball_search(_balls(spark, sf_dir, EUCLIDEAN), fx.queries(spark, sf_dir)))


@registered
def knn_balls_dotproduct(spark, sf_dir):
    return _shown(balls.ball_search(_balls(spark, sf_dir, DOTPRODUCT), fx.queries(spark, sf_dir)))


@registered
def knn_balls_filtered(spark, sf_dir):
    """Filters keep some queries below ``top_k``; those read every list."""
    queries = filters.with_required(fx.queries(spark, sf_dir))
    return _shown(balls.ball_search(_balls(spark, sf_dir, EUCLIDEAN), queries, Match(tags=True)))


@registered
def dataset_round_trip(spark, sf_dir):
    """A dataset written in its layout, read by name, refused a second writing, and described."""
    root = scratch_path(spark, "datasets")
    asked = fx.queries(spark, sf_dir).select(
        "query_id", "values", "top_k", F.struct(F.array("query_id").alias("neighbors"), "top_k").alias("blob")
    )
    wide = _json_records(spark, sf_dir).withColumn("sparse_values", F.lit(None).cast("string")).withColumn("unread", F.lit("x"))
    out = []
    for name, metric in (("one", COSINE), ("two", EUCLIDEAN)):
        wide.write.parquet(f"{root}/{name}/passages")
        wide.write.parquet(f"{root}/{name}/documents")
        asked.withColumnRenamed("query_id", "id").write.parquet(f"{root}/{name}/queries")
        about = spark.range(1).select(F.lit(name).alias("name"), F.lit(metric).alias("metric"), F.lit(64).alias("dimension"))
        about.coalesce(1).write.json(f"{root}/{name}/about")
    for name in ("one", "two"):
        known = spark.read.json(f"{root}/{name}/about").first()
        out.append(datasets.read_dataset(spark, root, name, known["metric"], known["dimension"]))
    documents = datasets.read_table(spark, root, "one", "documents").agg(F.count("id").alias("documents"))
    try:
        wide.write.mode("errorifexists").parquet(f"{root}/one/passages")
        refused = False
    except AnalysisException:
        refused = True
    return datasets.describe_all(out).crossJoin(documents).withColumn("refused", F.lit(refused))


@registered
def dataset_catalogue(spark, sf_dir):
    """Descriptions written beside several datasets, found again below their root."""
    root = scratch_path(spark, "catalogue")
    for name, count in (("documents", "doc_id"), ("pages", "page_id"), ("embeddings", "vec_id")):
        rows = fx.table(spark, sf_dir, name).agg(F.count(count)).first()[0]
        tables.write_description(spark, f"{root}/sets/{name}", name=name, records=rows, metric=COSINE)
    return datasets.catalogue(spark, root).select("name", F.col("records").cast("bigint").alias("records"), "metric")


@registered
def overwrite_guard(spark, sf_dir):
    """A second writing is refused, and the data stays; told to, it replaces them."""
    path, records = scratch_path(spark, "guard"), fx.records(spark, sf_dir).select("id", "namespace")
    tables.write_namespaced(records, path)
    try:
        tables.write_namespaced(records.limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    kept = stored(tables.read_namespaced(spark, path).groupBy("namespace").agg(F.count("id").alias("kept")), "kept")
    tables.write_namespaced(records.where("id % 2 = 0"), path, overwrite=True)
    after = tables.read_namespaced(spark, path).groupBy("namespace").agg(F.count("id").alias("replaced"))
    return kept.join(after, "namespace", "left").select(
        F.col("namespace").cast("int").alias("namespace"), "kept", F.coalesce("replaced", F.lit(0).cast("bigint")).alias("replaced"), F.lit(refused).alias("refused")
    )


@registered
def score_registered(spark, sf_dir):
    """A metric of the user's own beside the known ones."""
    scoring.register("first_hit", lambda actual, expected: F.coalesce(F.array_position(actual, F.get(expected, F.lit(0))), F.lit(0)).cast("double"))
    try:
        scored = _scored(spark, sf_dir)
        return _rounded_all(scored.select("query_id", "recall", "first_hit"), ["query_id"])
    finally:
        del scoring.METRICS["first_hit"]


@registered
def ivf_probe_sweep(spark, sf_dir):
    """Share of the true neighbours found at each probe count."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    assigned = ivf.assign_lists(records, centroids, EUCLIDEAN)
    swept = ivf.probe_sweep(assigned, centroids, queries, EUCLIDEAN, [1, 3, 10])
    truth = stored(knn(records, queries, EUCLIDEAN).select("query_id", "id"), "truth")
    hits = swept.join(truth, ["query_id", "id"], "left_semi").groupBy("probes").agg(F.count(F.lit(1)).alias("hits"))
    total = truth.agg(F.count(F.lit(1)).alias("total"))
    return hits.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select(
        "probes", "hits", rounded(F.col("hits") / F.col("total")).alias("recall")
    )


def _changing(spark, sf_dir):
    """States of records with the time they hold for, and searches with their moment."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    base = F.col("embedding").cast("array<double>")
    log = fx.operations(spark, sf_dir)
    # The narrow states are looked at several times; vectors travel as they are stored.
    states = stored(oplog.validity(log).select("id", "valid_from", "valid_to"), "states").join(vectors, "id")
    version = 1 + F.col("valid_from") % 5
    states = states.select(
        F.struct("id", "valid_from").alias("id"), "valid_from", "valid_to",
        F.transform(base, lambda x: x * version).alias("values"),
    )
    asked = log.where(F.col("op") == "search").join(vectors, "id")
    asked = asked.select(
        F.col("seq").alias("query_id"), base.alias("values"), F.lit(5).alias("top_k"),
        F.col("seq").alias("at"),
    )
    return states, asked


def _shown_states(found):
    return found.select(
        "query_id", "rank", F.col("id.id").alias("id"), F.col("id.valid_from").alias("valid_from"),
        rounded("distance").alias("distance"),
    )


@registered
def knn_as_of(spark, sf_dir):
    """Searches over a changing table, each against the table of its moment."""
    states, asked = _changing(spark, sf_dir)
    return _shown_states(knn(states, asked, DOTPRODUCT, Match(as_of=True)))


@registered
def knn_as_of_tiles(spark, sf_dir):
    """The same by tiles of time: a search meets the states of its moment alone."""
    states, asked = intervals.rooted(*_changing(spark, sf_dir))
    return _shown_states(knn(states, asked, DOTPRODUCT, Match(by=("root",), lists=True, nested=True)))


@registered
def log_alive_at(spark, sf_dir):
    """How many states hold at each search, by an equi-join on tiles."""
    log = fx.operations(spark, sf_dir)
    asked = log.where(F.col("op") == "search").select(F.col("seq").alias("query_id"), F.col("seq").alias("at"))
    states, asked = intervals.tiled(oplog.validity(log).select("id", "valid_from", "valid_to"), asked)
    counted = states.select(F.explode("list_id").alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    met = asked.select("query_id", F.explode("lists").alias("tile")).join(counted, "tile", "left")
    return met.groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("alive"))


# Scores --------------------------------------------------------------------


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results by dot product, truth by Euclidean distance (longer than top_k)."""
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    wide = queries.withColumn("top_k", (F.col("top_k") + 3).cast("int"))
    return knn(records, queries, DOTPRODUCT), knn(records, wide, EUCLIDEAN), queries


def _scored(spark, sf_dir) -> DataFrame:
    actual, truth, queries = _results(spark, sf_dir)
    return score_results(actual, queries.join(neighbour_lists(truth), "query_id"))


@registered
def score_wide(spark, sf_dir):
    return _rounded_all(_scored(spark, sf_dir).select("query_id", *scoring.METRICS), ["query_id"])


@registered
def score_long(spark, sf_dir):
    long = scoring.score_long(_scored(spark, sf_dir), ["query_id"])
    return long.select("query_id", "metric", rounded("value").alias("value"))


@registered
def score_flat(spark, sf_dir):
    actual, truth, queries = _results(spark, sf_dir)
    return _rounded_all(flat.score_flat(actual, truth, queries), ["query_id"])


@registered
def recall_at_min(spark, sf_dir):
    actual, truth, _ = _results(spark, sf_dir)
    both = neighbour_lists(actual, "actual").join(neighbour_lists(truth), "query_id")
    value = scoring.recall_at_min(F.col("actual"), F.col("neighbors"))
    return both.select("query_id", rounded(value).alias("recall"))


@registered
def evaluation_summary(spark, sf_dir):
    """Neighbour join, scores and their distribution in one plan."""
    return _rounded_all(summary(_scored(spark, sf_dir)), ["request_type", "metric", "count"])


@registered
def recall_gate(spark, sf_dir):
    gated = report.recall_gate(summary(_scored(spark, sf_dir)), 0.1)
    return gated.select("request_type", rounded("reached").alias("reached"), "passed")


# Corpus splits -------------------------------------------------------------


def _relevant(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    records, queries = fx.records(spark, sf_dir), fx.queries(spark, sf_dir)
    found = knn(records, queries, DOTPRODUCT)
    return records, stored(found.select("id").distinct(), "relevant")


@registered
def corpus_holes(spark, sf_dir):
    return corpus.holes(*_relevant(spark, sf_dir)).select("id", "label")


@registered
def corpus_cheese(spark, sf_dir):
    return corpus.cheese(*_relevant(spark, sf_dir)).select("id", "label")


@registered
def drift_sequence(spark, sf_dir):
    """Neighbours once the holes are filled: all queries run in step 1."""
    stepped = corpus.drift_records(*_relevant(spark, sf_dir))
    asked = corpus.drift_queries(fx.queries(spark, sf_dir))
    found = knn(stepped, asked, COSINE, Match(step=True))
    per_step = stepped.select("id", "step").join(found, "id", "left")
    return per_step.groupBy("step").agg(
        F.countDistinct("id").alias("records"), F.count("query_id").alias("answers")
    )


@registered
def id_suffix(spark, sf_dir):
    records = fx.records(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "label")
    return records.unionByName(splits.suffix_ids(records, "_2"))


# Splits and batches --------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


@registered
def chunk_split(spark, sf_dir):
    return splits.with_chunk(_orders(spark, sf_dir), "o_orderkey", 7)


@registered
def batch_fixed(spark, sf_dir):
    return splits.batch_fixed(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 100, 3)


@registered
def batch_balanced(spark, sf_dir):
    return splits.batch_balanced(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 128, 3)


@registered
def batch_per_file(spark, sf_dir):
    keyed = _orders(spark, sf_dir).select("o_orderkey")
    return splits.batch_per_file(keyed, "o_orderkey", 256).select("o_orderkey", "batch")


@registered
def cumulative_counts(spark, sf_dir):
    stepped = splits.assign_steps(_orders(spark, sf_dir), "o_orderkey", 7)
    counted = splits.cumulative_counts(stepped)
    return splits.chunk_offsets(counted, "step", "rows", "rows_before")


# Filters and metadata ------------------------------------------------------


@registered
def filter_tags(spark, sf_dir):
    parsed = filters.with_required(fx.queries(spark, sf_dir))
    return parsed.select("query_id", F.explode("required").alias("tag"))


def _json_records(spark, sf_dir) -> DataFrame:
    named = F.when(F.col("tags").isNotNull(), F.to_json(F.struct("tags", "label")))
    return fx.records(spark, sf_dir).select("id", "values", named.alias("metadata"))


@registered
def filter_predicate(spark, sf_dir):
    text = '{"$and": [{"tags": "3"}, {"$and": [{"tags": "m1"}, {"tags": "3"}]}]}'
    held = filters.filter_predicate(text, F.col("metadata"))
    return _json_records(spark, sf_dir).where(held).select("id")


@registered
def filter_errors(spark, sf_dir):
    """Filters built from the labels, some of them malformed."""
    label = F.col("label").cast("string")
    tag = F.concat(F.lit('{"tags": "'), label, F.lit('"}'))
    text = (
        F.when(F.col("label") % 4 == 0, tag)
        .when(F.col("label") % 4 == 1, F.concat(F.lit('{"$and": ['), tag, F.lit("]}")))
        .when(F.col("label") % 4 == 2, F.concat(F.lit('{"label": "'), label, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"$and": ['), tag, F.lit(", "), tag, F.lit("]}")))
    )
    asked = fx.records(spark, sf_dir).select(F.col("id").alias("query_id"), text.alias("filter"))
    parsed = filters.with_required(asked, on_error="keep")
    return parsed.select(
        "query_id",
        F.col("filter_error").isNotNull().alias("rejected"),
        F.when(F.col("required").isNotNull(), F.size("required")).cast("bigint").alias("tags"),
    )


@registered
def metadata_decode(spark, sf_dir):
    raw = _json_records(spark, sf_dir)
    typed = datasets.decode_metadata(raw, "tags array<string>, label int")
    return typed.select(
        "id", F.col("metadata.label").alias("label"), F.element_at("metadata.tags", 2).alias("second_tag")
    )


@registered
def metadata_clean(spark, sf_dir):
    """Event properties without falsy values; an event left with none is null."""
    cleaned = datasets.clean_metadata(fx.table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return cleaned.select(
        "event_id", F.col("props").isNull().alias("empty"), F.col("props")["k"].cast("bigint").alias("k")
    )


# Tables --------------------------------------------------------------------


@registered
def dataset_profile(spark, sf_dir):
    dataset = VectorDataset("embeddings", fx.records(spark, sf_dir), fx.queries(spark, sf_dir), 64, COSINE)
    return datasets.describe(dataset)


@registered
def contract_check(spark, sf_dir):
    return tables.contract(fx.records(spark, sf_dir), 64, COSINE)


@registered
def completeness(spark, sf_dir):
    return tables.completeness(fx.table(spark, sf_dir, "orders"), 1500)


@registered
def drop_null_columns(spark, sf_dir):
    wide = fx.records(spark, sf_dir).select(
        "id", "label", F.lit(None).cast("string").alias("sparse_values"), F.col("tags")[0].alias("first_tag")
    )
    return datasets.drop_null_columns(wide)


@registered
def head_rows(spark, sf_dir):
    return datasets.head(_orders(spark, sf_dir), 100, "o_orderkey")


@registered
def records_gate(spark, sf_dir):
    wide = _json_records(spark, sf_dir).withColumn("unread", F.lit("x"))
    return datasets.select_records(wide).select("id", F.size("values").cast("bigint").alias("dims"), "metadata")


@registered
def queries_gate(spark, sf_dir):
    """Queries as stored - ``vector`` and ``blob`` - to their flat form."""
    stored = fx.queries(spark, sf_dir).select(
        F.col("query_id").alias("id"), F.col("values").alias("vector"), "top_k", "filter",
        F.struct(F.array("query_id").alias("neighbors"), (F.col("top_k") + 1).alias("top_k")).alias("blob"),
    )
    flat_queries = datasets.unnest_blob(datasets.select_queries(stored))
    return flat_queries.select(
        "id", F.size("values").cast("bigint").alias("dims"), "top_k", "filter",
        F.element_at("neighbors", 1).alias("best"),
    )


@registered
def namespaces(spark, sf_dir):
    """Records stored by namespace; one namespace read back."""
    path = scratch_path(spark, "namespaces")
    tables.write_namespaced(fx.records(spark, sf_dir).select("id", "label", "namespace"), path)
    return tables.read_namespaced(spark, path, 1).select("id", "label")


@registered
def layout_rewrite(spark, sf_dir):
    path = scratch_path(spark, "layout")
    tables.rewrite_layout(_orders(spark, sf_dir), path, 4000, 500)
    written = spark.read.parquet(path)
    return written.groupBy((F.col("o_custkey") % 10).alias("slot")).agg(F.count(F.lit(1)).alias("orders"))


# Operation log -------------------------------------------------------------


def _writes(spark, sf_dir, op: str) -> DataFrame:
    return fx.operations(spark, sf_dir).where(F.col("op") == op).drop("op")


def _base(spark, sf_dir) -> DataFrame:
    return oplog.latest(_writes(spark, sf_dir, "insert"))


@registered
def log_insert_conflicts(spark, sf_dir):
    stored = _base(spark, sf_dir)
    return oplog.insert_conflicts(stored, _writes(spark, sf_dir, "update").select("id", "value"))


@registered
def log_upsert(spark, sf_dir):
    return oplog.upsert(_base(spark, sf_dir), _writes(spark, sf_dir, "update"))


@registered
def log_update(spark, sf_dir):
    return oplog.update(_base(spark, sf_dir), _writes(spark, sf_dir, "update"))


@registered
def log_delete(spark, sf_dir):
    return oplog.delete(_base(spark, sf_dir), _writes(spark, sf_dir, "delete").where(F.col("value") > 100))


@registered
def log_fetch(spark, sf_dir):
    stored = _base(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string"))
    return oplog.fetch(stored, _writes(spark, sf_dir, "search").where(F.col("value") > 50))


def _looked_up(spark, sf_dir, least: int) -> DataFrame:
    path = scratch_path(spark, "keyed")
    tables.write_keyed(_base(spark, sf_dir), path, 16, rows_per_group=100)
    return tables.lookup(spark, path, _writes(spark, sf_dir, "search").where(F.col("value") > least)).select("id", "value")


@registered
def log_fetch_keyed(spark, sf_dir):
    """Fetches from a table stored by key: many keys."""
    return _looked_up(spark, sf_dir, 50)


@registered
def log_fetch_named(spark, sf_dir):
    """Fetches from a table stored by key: those of the slowest searches."""
    return _looked_up(spark, sf_dir, 200)


@registered
def log_replay(spark, sf_dir):
    return oplog.replay(fx.operations(spark, sf_dir))


@registered
def log_replay_upsert(spark, sf_dir):
    return oplog.replay(fx.operations(spark, sf_dir), update_inserts=True)


@registered
def log_as_of(spark, sf_dir):
    log = fx.operations(spark, sf_dir)
    middle = log.agg(F.max("seq")).first()[0] // 2
    return oplog.replay(log, as_of=middle)


@registered
def log_live_count(spark, sf_dir):
    return oplog.live_counts(fx.operations(spark, sf_dir))


@registered
def log_versions(spark, sf_dir):
    return oplog.versions(fx.operations(spark, sf_dir)).select("seq", "id", "op", "version")


@registered
def log_validity(spark, sf_dir):
    return oplog.validity(fx.operations(spark, sf_dir)).select("id", "valid_from", "valid_to")


# Reports -------------------------------------------------------------------


@registered
def op_summary(spark, sf_dir):
    done = report.operation_summary(fx.requests(spark, sf_dir))
    return _rounded_all(done, ["request_type", "requests", "failures"])


@registered
def counter_totals(spark, sf_dir):
    return report.counters(fx.requests(spark, sf_dir))


@registered
def latency_summary(spark, sf_dir):
    return _rounded_all(report.latency_summary(fx.requests(spark, sf_dir)), ["request_type"])


@registered
def metric_histogram(spark, sf_dir):
    """Histograms of two halves of the run, merged."""
    long = report.long_metrics(fx.requests(spark, sf_dir), ("request_type", "user_id"))
    keys = ("request_type", "metric")
    halves = [report.histogram(long.where(F.col("user_id") % 2 == i), keys) for i in (0, 1)]
    return report.merge_histograms(*halves)


@registered
def metric_percentiles(spark, sf_dir):
    done = report.metric_summary(fx.requests(spark, sf_dir))
    return _rounded_all(done, ["request_type", "metric", "count"])


@registered
def metric_sketches(spark, sf_dir):
    """Percentiles of two runs' stored sketches, merged: is each one's true rank within the stated error."""
    log = fx.requests(spark, sf_dir).select("request_type", "user_id", F.col("response_time").alias("value"))
    runs = [stored(sketches.sketch(log.where(F.col("user_id") % 2 == i), ("request_type",)), "sketches") for i in (0, 1)]
    shares = {"p10": 100, "p50": 500, "p95": 950, "p99": 990}
    found = sketches.percentiles(sketches.merge(*runs), shares)
    # Three times the error of 99 runs in 100, and half a row for rounding.
    slack = 3 * sketches.rank_error() * F.col("requests") + 1
    counted = log.join(found, "request_type").groupBy("request_type").agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in shares],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in shares],
        F.max((F.col("count"))).alias("sketched"),
        (F.min("value") == F.max("min")).alias("least"),
        (F.max("value") == F.max("max")).alias("most"),
    )
    held = F.col("least") & F.col("most") & (F.col("sketched") == F.col("requests"))
    for name, share in shares.items():
        rank = F.col("requests") * (share / 1000.0)
        held = held & (F.col(f"{name}_below") <= rank + slack) & (F.col(f"{name}_upto") >= rank - slack)
    return counted.select("request_type", "requests", held.alias("within"))


@registered
def metrics_summary(spark, sf_dir):
    done = report.metrics_summary(fx.requests(spark, sf_dir))
    return _rounded_all(done, ["operation", "section", "metric"])


@registered
def report_nested(spark, sf_dir):
    """The nested report, read back at a few of its paths."""
    done = report.report(fx.requests(spark, sf_dir))
    recall = F.col("metrics")["recall"]
    return done.select(
        "request_type", "requests",
        rounded(recall["mean"]).alias("recall_mean"),
        rounded(recall["percentiles"]["99.9"]).alias("recall_p99_9"),
        F.col("counters")["requests"].alias("counted"),
    )


@registered
def report_rollup(spark, sf_dir):
    log = fx.requests(spark, sf_dir).withColumn("step", F.dayofmonth("ts"))
    done = report.rollup_summary(log)
    return done.select(
        "request_type", "step", "all_steps", "requests", "failures",
        rounded("mean_response_time", 9).alias("mean_response_time"),
    )


@registered
def request_labels(spark, sf_dir):
    log = fx.requests(spark, sf_dir)
    workload = F.concat(F.lit("day"), F.dayofmonth("ts").cast("string"))
    labelled = log.withColumn("label", splits.request_label(F.col("request_type"), workload, 30))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("requests"))


@registered
def phase_durations(spark, sf_dir):
    """A phase per day; its first event starts it, its last one ends it."""
    days = fx.events(spark, sf_dir).groupBy(F.dayofmonth("ts").alias("phase")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    marks = days.unpivot(["phase"], ["start", "end"], "kind", "ts")
    return report.phase_durations(marks).select("phase", rounded("seconds").alias("seconds"), "never_started")


@registered
def gap_stats(spark, sf_dir):
    done = report.gap_stats(fx.requests(spark, sf_dir), tie="seq")
    return done.select(
        "user_id", "requests", rounded("rate", 8).alias("rate"),
        *[rounded(c, 3).alias(c) for c in ("gap_mean", "gap_stddev", "gap_change_mean")],
    )


def _trailing(spark, sf_dir, seconds: int) -> DataFrame:
    done = report.trailing(fx.requests(spark, sf_dir), seconds)
    return done.select(
        "seq", "request_type", "requests", rounded("requests_per_s").alias("requests_per_s"), "latency_p50", "latency_p95"
    )


@registered
def trailing_10s(spark, sf_dir):
    return _trailing(spark, sf_dir, 10)


@registered
def trailing_hour(spark, sf_dir):
    return _trailing(spark, sf_dir, 3600)


@registered
def trailing_all(spark, sf_dir):
    """Rate over all operations together."""
    done = report.trailing(fx.requests(spark, sf_dir), 10, keys=())
    return done.select("seq", "requests", rounded("requests_per_s").alias("requests_per_s"))


# Streams -------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    raw = live.file_stream(spark, sf_dir, schema, "events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@registered
def knn_damaged(spark, sf_dir):
    """Two thirds of the records have a NaN element: their distances are NaN and rank last."""
    last = F.when(F.col("id") % 3 == 0, F.element_at("values", -1)).otherwise(F.lit(float("nan")))
    damaged = fx.records(spark, sf_dir).withColumn("values", F.concat(F.slice("values", 1, F.size("values") - 1), F.array(last)))
    asked = fx.queries(spark, sf_dir)
    # As many as there are sound records, and five more.
    asked = asked.withColumn("top_k", F.lit(damaged.where("id % 3 = 0").count() + 5))
    named = lambda m: knn(damaged, asked, m).withColumn("metric", F.lit(m))
    found = named(COSINE).unionByName(named(EUCLIDEAN)).unionByName(named(DOTPRODUCT))
    lost = F.isnan("distance")
    return found.groupBy("metric", "query_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(lost).alias("damaged"),
        F.min(F.when(lost, F.col("rank"))).cast("bigint").alias("first_damaged"),
        F.max(F.when(lost, F.col("id"))).alias("last_damaged"), F.sum(F.when(~lost, F.col("id"))).alias("sound_ids"),
        rounded(F.sum(F.when(~lost, F.col("distance")))).alias("sound_distance"),
    )


@registered
def stream_window_metrics(spark, sf_dir):
    stream, log = fx.as_requests(_event_stream(spark, sf_dir)), fx.requests(spark, sf_dir)
    counts, _ = live.run_windows(stream, log, "windows")
    return live.window_metrics(counts).select(
        F.unix_seconds("w.start").alias("window_start"), "request_type", "requests", "latency_p50", "latency_p95"
    )


@registered
def stream_window_rate(spark, sf_dir):
    """Requests per second over all operations together."""
    stream, log = fx.as_requests(_event_stream(spark, sf_dir)), fx.requests(spark, sf_dir)
    counts, _ = live.run_windows(stream, log, "windows")
    done = live.window_metrics(counts, keys=())
    return done.select(F.unix_seconds("w.start").alias("window_start"), "requests", rounded("requests_per_s").alias("requests_per_s"))


@registered
def stream_late_rows(spark, sf_dir):
    """Requests that came after the watermark; in one file none does."""
    stream, log = fx.as_requests(_event_stream(spark, sf_dir)), fx.requests(spark, sf_dir)
    counts, late = live.run_windows(stream, log, "windows")
    return counts.agg(F.sum("n").alias("counted")).crossJoin(late)


@registered
def stream_late_half(spark, sf_dir):
    """The last requests come first; of the earlier half, which comes last, only what ends in the last minute is in time.

    A batch is held to the watermark that the batch before it began with, so there are three.
    """
    log, folder = fx.events(spark, sf_dir), scratch_path(spark, "late")
    ends = log.agg(F.expr("(min(event_id) + max(event_id)) div 2").alias("middle"), F.max("event_id").alias("last")).first()
    middle, late = ends["middle"], F.col("event_id") > (ends["middle"] + ends["last"]) // 2
    for part in (late, ~late & (F.col("event_id") >= middle), F.col("event_id") < middle):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = live.file_stream(spark, f"{folder}/events.parquet", log.schema, files_per_batch=1)
    counts, late = live.run_windows(fx.as_requests(stream), fx.as_requests(log), "late")
    return counts.agg(F.sum("n").alias("counted")).crossJoin(late)


@registered
def stream_totals(spark, sf_dir):
    log = fx.as_requests(_event_stream(spark, sf_dir))
    return live.run_update(live.totals(log), "totals", ["request_type"])


@registered
def stream_metric_totals(spark, sf_dir):
    log = fx.as_requests(_event_stream(spark, sf_dir))
    counts = live.run_update(live.metric_counts(log), "metrics", ["request_type", "metric", "value"])
    return live.metric_totals(counts).withColumn("mean", rounded("mean"))


@registered
def stream_score(spark, sf_dir):
    actual, truth, queries = _results(spark, sf_dir)
    path = scratch_path(spark, "results")
    results = neighbour_lists(actual, "actual")
    results.write.parquet(path)
    # A stream joins its static side anew in every micro-batch.
    truth = stored(queries.join(neighbour_lists(truth), "query_id"), "truth")
    stream = live.file_stream(spark, path, results.schema, files_per_batch=4)
    scored = live.score_stream(stream, truth).select("query_id", *scoring.METRICS)
    return _rounded_all(live.run_append(scored, "scores"), ["query_id"])


@registered
def stream_upsert(spark, sf_dir):
    log = fx.as_operations(_event_stream(spark, sf_dir))
    return live.alive(live.run_update(live.live_table(log), "table", ["id"]))


@registered
def stream_sessions(spark, sf_dir):
    stream, log = _event_stream(spark, sf_dir).select("user_id", "ts"), fx.events(spark, sf_dir).select("user_id", "ts")
    done = live.run_sessions(stream, log, "sessions", "6 hours", ["user_id"], "1 minute")
    return done.select(
        "user_id", "requests", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us")
    )


# Generated tables ----------------------------------------------------------


def _generated(spark, sf_dir, **options) -> DataFrame:
    """A record per document, of the same key."""
    keys = fx.table(spark, sf_dir, "documents").select("doc_id")
    return synth.generate(keys, 32, COSINE, seed=11, id_column="doc_id", **options)


@registered
def synth_records(spark, sf_dir):
    return _generated(spark, sf_dir, distribution="normal").select("id", "version", "values")


@registered
def synth_metadata(spark, sf_dir):
    template = ["shard:3n", "in_stock:b", "city:11s", "labels:4s2l", "on_sale:b"]
    made = _generated(spark, sf_dir, template=template)
    decoded = datasets.decode_metadata(made, synth.template_schema(template))
    return decoded.select("id", "metadata.*")


@registered
def synth_queries(spark, sf_dir):
    """A Zipf-picked query per customer, over generated records."""
    made = stored(_generated(spark, sf_dir), "corpus")
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    picks = synth.zipf_picks(asked, made.count(), 5, "query_id")
    return synth.query_set(made, picks, COSINE, 10).select("query_id", "pick", "neighbors")


@registered
def synth_runbook(spark, sf_dir):
    made = _generated(spark, sf_dir).withColumn("id", F.col("id").cast("bigint"))
    made = stored(made, "corpus")
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    picks = synth.uniform_picks(asked, made.count(), 5, "query_id")
    queries = stored(synth.query_set(made, picks, COSINE, 10, ground_truth=False), "asked")
    records, queries = synth.runbook(made, queries, 4)
    return knn(records, queries, COSINE, Match(step=True))


@registered
def synth_sample(spark, sf_dir):
    made = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return synth.sample_without_replacement(made, 50, 3)


@registered
def synth_record_shapes(spark, sf_dir):
    """What holds for every generated record: key, dimensions, range."""
    made = synth.generate(fx.table(spark, sf_dir, "documents").select("doc_id"), 32, EUCLIDEAN, seed=11, id_column="doc_id")
    inside = F.forall("values", lambda x: (x >= 0) & (x <= 255))
    return made.select(F.col("id").cast("bigint").alias("id"), F.size("values").cast("bigint").alias("dims"), inside.alias("inside"), "version")


@registered
def synth_metadata_shapes(spark, sf_dir):
    template = ["shard:3n", "in_stock:b", "city:11s", "labels:4s2l"]
    decoded = datasets.decode_metadata(_generated(spark, sf_dir, template=template), synth.template_schema(template))
    m = F.col("metadata")
    return decoded.select(
        F.col("id").cast("bigint").alias("id"), F.length(m["city"]).cast("bigint").alias("city"), m["shard"].between(0, 999).alias("shard"),
        F.array_join(F.transform(m["labels"], lambda x: F.length(x).cast("string")), ",").alias("labels"), m["in_stock"].isNotNull().alias("flag"),
    )


@registered
def synth_query_shapes(spark, sf_dir):
    """Every customer asks for one record, and that is the nearest to itself."""
    found = synth_queries(spark, sf_dir)
    return found.select(
        "query_id", F.size("neighbors").cast("bigint").alias("found"),
        (F.element_at("neighbors", 1) == F.col("pick").cast("string")).alias("itself"),
    )


@registered
def synth_runbook_shapes(spark, sf_dir):
    """Each query finds ten records, none of a later step than its own."""
    made = stored(_generated(spark, sf_dir).withColumn("id", F.col("id").cast("bigint")), "corpus")
    asked = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    queries = stored(synth.query_set(made, synth.uniform_picks(asked, made.count(), 5, "query_id"), COSINE, 10, ground_truth=False), "asked")
    records, queries = synth.runbook(made, queries, 4)
    found = knn(records, queries, COSINE, Match(step=True))
    seen = found.join(records.select("id", F.col("step").alias("r")), "id").join(queries.select("query_id", "step"), "query_id")
    return seen.groupBy("query_id", F.col("step").cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("r") > F.col("step")).alias("later"))


@registered
def synth_sample_shape(spark, sf_dir):
    """Fifty different documents, or all there are."""
    made = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    picked = synth.sample_without_replacement(made, 50, 3)
    return picked.join(made.distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


@registered
def head_large(spark, sf_dir):
    """A limit of three quarters of the line items' keys, digit by digit and not in one task."""
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey")
    n = lines.count() * 3 // 4
    first = selection.smallest(lines, n, F.col("l_orderkey"), "l_orderkey", few=1)
    return first.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@registered
def synth_pick_counts(spark, sf_dir):
    """Picks per record: index 0 most often, all inside the table."""
    asked = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    picks = synth.zipf_picks(asked, 100, 7).groupBy("pick").agg(F.count(F.lit(1)).alias("n"))
    return picks.agg(
        F.sum("n").alias("rows"), F.count_if((F.col("pick") < 0) | (F.col("pick") > 99)).alias("outside"),
        F.max_by("pick", "n").alias("likeliest"), F.min("pick").alias("least"),
    )


@registered
def default_lists(spark, sf_dir):
    """Index size the record count of each namespace asks for."""
    counts = fx.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("records"))
    return counts.select("l_returnflag", "records", scalars.lists_for(F.col("records")).alias("lists"))


# Single searches, unscored queries, report sink ----------------------------


@registered
def search_one(spark, sf_dir):
    """One literal query under a filter: the first embedding's vector."""
    records = _json_records(spark, sf_dir)
    asked = records.orderBy("id").first()["values"]
    held = filters.filter_predicate('{"tags": "m1"}', F.col("metadata"))
    found = search(records, asked, 20, EUCLIDEAN, held)
    return found.select("id", rounded("distance").alias("distance"))


@registered
def score_unavailable(spark, sf_dir):
    """Queries of one namespace have no ground truth, hence no score."""
    actual, truth, queries = _results(spark, sf_dir)
    known = queries.join(neighbour_lists(truth), "query_id")
    known = known.withColumn("neighbors", F.when(F.col("namespace") == 0, F.col("neighbors")))
    scored = score_results(actual, known).select("query_id", *scoring.METRICS)
    return _rounded_all(scored, ["query_id"])


@registered
def report_sink(spark, sf_dir):
    """The nested report written as JSON, and read back."""
    path = scratch_path(spark, "report")
    tables.write_report(report.report(fx.requests(spark, sf_dir)), path)
    read = spark.read.schema("request_type string, requests bigint, failures bigint").json(path)
    return read.select("request_type", "requests", "failures")


@registered
def log_namespaced(spark, sf_dir):
    """Replay of a log whose keys live in namespaces; an id may be in several."""
    log = fx.operations(spark, sf_dir).withColumn("namespace", F.col("seq") % 3)
    return oplog.replay(log, key=("namespace", "id"))


@registered
def tag_matches(spark, sf_dir):
    """One-tag matches, filter containment and tag unions on whole tables."""
    asked = filters.with_required(fx.queries(spark, sf_dir)).select(F.col("query_id").alias("id"), "required")
    both = fx.records(spark, sf_dir).join(asked, "id")
    return both.select(
        "id",
        filters.has_tag(F.col("tags"), "m1").alias("has_m1"),
        filters.tags_satisfy(F.col("tags"), F.col("required")).alias("satisfied"),
        F.size(filters.union_tags(F.coalesce("tags", F.array().cast("array<string>")),
                                  F.coalesce("required", F.array().cast("array<string>")))).cast("bigint").alias("united"),
    )
