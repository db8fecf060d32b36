"""From a table of search requests to a table of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.images import Decoder, decode_base64_images
from glyphlake.functions.text import format_hit, report_title, strip_data_uri
from glyphlake.operators.encoders import embed_image, embed_svg, embed_text, text_postings
from glyphlake.operators.fused import fused_page, fused_scan
from glyphlake.operators.joins import lookup_join
from glyphlake.operators.knn import check_k, knn, knn_multi_field
from glyphlake.operators.ranking import format_result, fuse, rank_page, total_hits
from glyphlake.operators.sparse import sparse_page, sparse_scores_of
from glyphlake.schema import (
    KNN_K, NUM_CANDIDATES, PAGE_SIZE, SPARSE_FIELD, TEXT_DIMS, TEXT_FIELD, VISUAL_DIMS, VISUAL_FIELDS,
)
from glyphlake.session import cut_lineage
from glyphlake.sources.requests import validate_requests


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def resolve_fields(fields: Column | str = "fields", icon_type: Column | str = "icon_type") -> Column:
    """Visual fields a request searches: its valid ones in its order, else those of its type, else all."""
    asked = F.col(fields) if isinstance(fields, str) else fields
    kind = F.col(icon_type) if isinstance(icon_type, str) else icon_type
    everything = _names(VISUAL_FIELDS)
    valid = F.filter(asked, lambda f: F.array_contains(everything, f))
    of_type = F.when(
        kind.isin("icon", "token"), F.filter(everything, lambda f: F.startswith(f, F.concat(kind, F.lit("_"))))
    ).otherwise(everything)
    chosen = F.when(F.size(asked) > 0, valid).otherwise(of_type)
    return F.when(F.size(chosen) > 0, chosen).otherwise(everything)


def resolve_fields_agent(kind: str, fields: Column | str = "fields", icon_type: Column | str = "icon_type") -> Column:
    """Agent default: the one svg or image field of the type, icon unless token is asked."""
    asked = F.col(fields) if isinstance(fields, str) else fields
    wanted = F.col(icon_type) if isinstance(icon_type, str) else icon_type
    default = F.when(wanted == "token", F.lit(f"token_{kind}_embedding")).otherwise(F.lit(f"icon_{kind}_embedding"))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(default))


def choose_branch(kind: Column | str = "type", sparse_size: Column | str = "sparse_size") -> Column:
    """hybrid for text with sparse tokens, visual for image and svg, dense for the rest."""
    asked = F.col(kind) if isinstance(kind, str) else kind
    tokens = F.col(sparse_size) if isinstance(sparse_size, str) else sparse_size
    return (
        F.when((asked == "text") & (tokens > 0), F.lit("hybrid"))
        .when(asked.isin("image", "svg"), F.lit("visual"))
        .otherwise(F.lit("dense"))
    )


def hybrid_search(
    index: DataFrame,
    queries: DataFrame,
    query_postings: DataFrame,
    field: str = TEXT_FIELD,
    sparse_field: str = SPARSE_FIELD,
    k: int = KNN_K,
    num_candidates: int = NUM_CANDIDATES,
    size: int = PAGE_SIZE,
    group_col: str | None = None,
    **limits: int,
) -> DataFrame:
    """Dense top k and every token match, fused by summing: ``query_id, doc_id, score, rank, total``.

    Only ``size`` token matches per query are carried on. That is exact: a document outside of the
    dense top k keeps its sparse score, and the documents before it in the sparse order can only
    gain from a dense part, which is never negative. Dense hits get their own sparse score.
    ``group_col``, a column of ``index``, ``queries`` and ``query_postings``, is respected by both
    sides (null in a query: no filter). Requests that fit a broadcast take one scan of the index.
    """
    check_k(k, num_candidates)
    found = fused_scan(index, queries, query_postings, field, sparse_field, k, size, group_col, **_bounds(limits))
    if found is not None:
        return fused_page(found, k, size)
    return _hybrid_by_parts(index, queries, query_postings, field, sparse_field, k, num_candidates, size, group_col, **limits)


def _bounds(limits: dict[str, int]) -> dict[str, int]:
    return {name: limits[name] for name in ("max_queries",) if name in limits}


def _hybrid_by_parts(
    index, queries, query_postings, field, sparse_field, k, num_candidates, size, group_col, **limits
) -> DataFrame:
    """The same for any number of requests, branch by branch."""
    dense = cut_lineage(knn(index, queries, field, k, num_candidates, group_col=group_col, **limits).drop("rank"))
    matched = cut_lineage(sparse_page(index, query_postings, sparse_field, size, group_col))
    of_dense = cut_lineage(sparse_scores_of(index, dense, query_postings, sparse_field))
    others = matched.select("query_id", "doc_id", "score").join(dense, ["query_id", "doc_id"], "left_anti")
    ranked = rank_page(fuse(dense, of_dense, others), size)
    unmatched = dense.join(of_dense, ["query_id", "doc_id"], "left_anti").select("query_id", F.lit(1).alias("total"))
    totals = matched.select("query_id", "total").distinct().unionByName(unmatched)
    return ranked.join(totals.groupBy("query_id").agg(F.sum("total").alias("total")), "query_id")


def _no_decoder(data: bytes):
    raise ValueError("image requests need a decoder")


def encode_queries(
    queries: DataFrame, text_dims: int = TEXT_DIMS, visual_dims: int = VISUAL_DIMS, decoder: Decoder | None = None
) -> DataFrame:
    """Adds ``vector`` and ``error`` to valid requests of any type with the default encoders.

    ``decoder`` reads the image files of image requests; without one they have an error.
    """
    good = validate_requests(queries)
    text = embed_text(good.where("valid AND type = 'text'"), "query", "vector", text_dims)
    svg = embed_svg(good.where("valid AND type = 'svg'"), "query", "vector", visual_dims)
    pictures = good.where("valid AND type = 'image'").withColumn("__payload", strip_data_uri("query"))
    image = embed_image(decode_base64_images(pictures, "__payload", decoder or _no_decoder, "__image"), "__image", "vector", visual_dims)
    columns = [*queries.columns, "vector", "error"]
    parts = [
        text.withColumn("error", F.lit(None).cast("string")).select(*columns),
        svg.withColumnRenamed("vector_error", "error").select(*columns),
        image.withColumnRenamed("vector_error", "error").select(*columns),
        good.where("NOT valid")
        .withColumn("vector", F.lit(None).cast("array<float>"))
        .withColumn("error", F.col("reason"))
        .select(*columns),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search(
    index: DataFrame,
    encoded: DataFrame,
    query_sparse: DataFrame | None = None,
    k: int = KNN_K,
    num_candidates: int = NUM_CANDIDATES,
    size: int = PAGE_SIZE,
    **limits: int,
) -> DataFrame:
    """Answer all requests: ``query_id, rank, doc_id, icon_name, score, descriptions, release_tag,
    icon_type, total``.

    ``encoded`` is the output of ``encode_queries`` or the same columns with vectors of the user's
    encoders; ``query_sparse`` holds ``query_id, token, weight`` (default: hashed words). Requests
    without a vector get no rows. Every branch of the dispatcher only sees its own requests.
    """
    check_k(k, num_candidates)
    asked = cut_lineage(encoded.where(F.col("vector").isNotNull()))
    text = asked.where("type = 'text'")
    if query_sparse is None:
        query_sparse = text_postings(text, "query", "query_id")
    sparse = query_sparse.join(text.select("query_id", "icon_type"), "query_id")
    visual = asked.where("type IN ('image', 'svg')").withColumn("fields", resolve_fields())
    found = fused_scan(
        index, text, sparse, TEXT_FIELD, SPARSE_FIELD, k, size, "icon_type", visual, VISUAL_FIELDS, **_bounds(limits)
    )
    if found is not None:
        return attach(cut_lineage(fused_page(found, k, size)), index)
    hybrid = _hybrid_by_parts(index, text, sparse, TEXT_FIELD, SPARSE_FIELD, k, num_candidates, size, "icon_type", **limits)
    # At most k rows per request and field; read twice, for the page and for the total.
    pictured = cut_lineage(knn_multi_field(index, visual, VISUAL_FIELDS, k, query_fields="fields", **limits))
    pictured = rank_page(pictured, size).join(total_hits(pictured), "query_id")
    ranked = cut_lineage(hybrid.unionByName(pictured))
    return attach(ranked, index)


def attach(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Result rows with their document's display columns; payloads and vectors are not read."""
    shown = index.select("doc_id", "icon_name", "descriptions", "release_tag", "icon_type")
    hits = lookup_join(shown, ranked, "doc_id", spread="doc_id")
    columns = ["query_id", "rank", "doc_id", "icon_name", "score", "descriptions", "release_tag", "icon_type", "total"]
    return format_result(hits).select(*columns)


def search_report(results: DataFrame, queries: DataFrame, max_results: int = 10) -> DataFrame:
    """``query_id, report``: the text answer of each request, at most ``max_results`` hits long."""
    shown = results.where(F.col("rank") <= max_results)
    block = format_hit("rank", "icon_name", "score", "icon_type", "release_tag", "descriptions")
    bodies = shown.groupBy("query_id").agg(
        F.max("total").alias("total"),
        F.count("*").alias("shown"),
        F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("hits"),
    )
    total, count = F.coalesce("total", F.lit(0)), F.coalesce("shown", F.lit(0))
    text = F.array_join(F.transform("hits", lambda h: F.concat(h["text"], F.lit("\n"))), "\n")
    return (
        queries.select("query_id")
        .join(bodies, "query_id", "left")
        .select("query_id", F.concat_ws("\n\n", report_title(total, count), text).alias("report"))
    )
