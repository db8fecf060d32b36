"""The batch indexing job: files and name map in, new index state and run results out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.svg import extract_svg
from glyphlake.functions.text import doc_id
from glyphlake.operators.catalog import (
    limit_after_match, match_files, missing_files, reverse_map, to_process, unmatched_files,
)
from glyphlake.operators.encoders import embed_image, embed_svg
from glyphlake.operators.runs import TOKEN_TYPE, process_icons, run_summary
from glyphlake.operators.upsert import upsert
from glyphlake.schema import DOC_SCHEMA, VISUAL_DIMS
from glyphlake.session import cut_lineage
from glyphlake.sources.index_store import write_version


@dataclass
class IndexRun:
    """Everything one run yields; all but the flag are tables. ``index`` is the new state, written or not."""

    up_to_date: bool
    index: DataFrame
    results: DataFrame
    summary: DataFrame
    unmatched: DataFrame
    missing: DataFrame


def index_release(
    files: DataFrame,
    name_map: DataFrame,
    index: DataFrame,
    release_tag: str,
    rendered: DataFrame | None = None,
    bookmark: str | None = None,
    skip_tokens: bool = False,
    force: bool = False,
    limit: int | None = None,
    dims: int = VISUAL_DIMS,
    write_to: str | None = None,
    version: int = 1,
) -> IndexRun:
    """Index the matched files of a release.

    ``files`` holds ``path, filename, svg_content``; ``rendered`` holds one row per icon with
    ``icon_name, icon_image, token_image`` (image structs) and ``token_svg_content``. An icon
    without a rendering gets the errors of a missing one and is still indexed with what it has.

    With ``write_to`` the new state is written below that folder as ``version`` before results are
    told: an icon counts as indexed when its document is found there. Without it the run is dry.
    ``limit`` takes the first files that need work, so that limited runs get on with a release.
    """
    reversed_map = reverse_map(name_map)
    matched = match_files(files, reversed_map)
    todo = cut_lineage(to_process(matched, index, release_tag, bookmark, skip_tokens, force))
    payloads = limit_after_match(todo, limit)
    payloads = payloads if rendered is None else payloads.join(rendered, "icon_name", "left")
    image = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
    for name, kind in (("icon_image", image), ("token_image", image), ("token_svg_content", "string")):
        if name not in payloads.columns or skip_tokens and name.startswith("token"):
            payloads = payloads.withColumn(name, F.lit(None).cast(kind))
    encoded = embed_svg(payloads, "svg_content", "icon_svg_embedding", dims)
    encoded = embed_svg(encoded.withColumn("__token_svg", extract_svg("token_svg_content")), "__token_svg", "token_svg_embedding", dims)
    for name in ("icon", "token"):
        encoded = embed_image(encoded, f"{name}_image", f"{name}_image_embedding", dims)
    encoded = cut_lineage(
        encoded.withColumn("icon_image", F.col("icon_image.data"))
        .withColumn("token_image", F.col("token_image.data"))
        .withColumn("doc_id", doc_id("icon_name", F.lit(release_tag)))
        .withColumn("release_tag", F.lit(release_tag))
        .withColumn("token_type", F.lit(None if skip_tokens else TOKEN_TYPE).cast("string"))
    )
    names = [c for c in DOC_SCHEMA.fieldNames() if c in encoded.columns and c != "doc_id"]
    # Several files may carry one icon name: the last path in order gives the document.
    state = upsert(index, encoded.select("doc_id", "path", *names), order_by="path")
    if write_to is None:
        results = process_icons(encoded, skip_tokens)
    else:
        state = files.sparkSession.read.parquet(write_version(state, write_to, version))
        ids = state.where(F.col("release_tag") == release_tag).select("doc_id").withColumn("written", F.lit(True))
        results = process_icons(encoded.join(ids, "doc_id", "left"), skip_tokens, index_ok="written")
    return IndexRun(
        up_to_date=todo.isEmpty(),
        index=state,
        results=results,
        summary=run_summary(results),
        unmatched=unmatched_files(files, reversed_map),
        missing=missing_files(name_map, files),
    )
