"""Document identity: fingerprints, titles, papers, versions and stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import keyed
from evidentia.session import cut_lineage


def content_fingerprint(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """sha256 per document and the first document with the same content."""
    hashed = docs.select(key, F.sha2(F.col(content), 256).alias("content_sha256"))
    groups = hashed.groupBy("content_sha256").agg(
        F.min(key).alias("keeper"), F.count("*").alias("copies")
    )
    return hashed.join(groups, "content_sha256").withColumn(
        "is_duplicate", F.col(key) != F.col("keeper")
    )


def resolve_title(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Title of each document and the rule that gave it.

    ``docs``: doc_id and the nullable columns option_title, metadata_title,
    file_stem; ``units``: doc_id, page_number, ordinal, unit_type, text.
    """
    first_page = units.where((F.col("page_number") == 1) & F.col("text").isNotNull())
    headings = (
        first_page.where((F.col("unit_type") == "HEADING") & (F.col("text") != ""))
        .groupBy("doc_id")
        .agg(F.min_by("text", "ordinal").alias("heading"))
    )
    usable = first_page.where(F.length("text").between(12, 300)).select(
        "doc_id", F.struct("ordinal", "text").alias("item")
    )
    longest = keyed.top_k_items(usable, ["doc_id"], "item", 5).select(
        "doc_id",
        F.element_at(
            F.array_sort(
                F.transform(
                    "items",
                    lambda u: F.struct(
                        (-F.length(u["text"])).alias("n"), u["ordinal"].alias("o"), u["text"].alias("text")
                    ),
                )
            ),
            1,
        )["text"].alias("longest"),
    )
    joined = docs.join(headings, "doc_id", "left").join(longest, "doc_id", "left")
    metadata = F.nullif(F.trim("metadata_title"), F.lit(""))
    title = F.coalesce(
        F.nullif("option_title", F.lit("")),
        metadata,
        X.squeeze(F.col("heading")),
        X.squeeze(F.col("longest")),
        F.col("file_stem"),
    )
    rule = (
        F.when(F.nullif("option_title", F.lit("")).isNotNull(), "option")
        .when(metadata.isNotNull(), "metadata")
        .when(F.col("heading").isNotNull(), "heading")
        .when(F.col("longest").isNotNull(), "longest_unit")
        .otherwise("file_stem")
    )
    return joined.select("doc_id", title.alias("title"), rule.alias("title_rule"))


def first_matches(offers: DataFrame) -> DataFrame:
    """Greedy matching of DOIs and titles in order of arrival: doi, title, arrival.

    ``offers``: doi, title, arrival (distinct pairs). A pair matches if neither side matched
    earlier. In each round every pair that is the earliest left of both its sides is taken
    and the other pairs of these sides go, until none is left; rounds grow with the length
    of the longest chain of pairs that wait for each other.
    """
    def marked(pairs: DataFrame) -> DataFrame:
        by_doi = pairs.groupBy("doi").agg(F.min("arrival").alias("first_of_doi"))
        by_title = pairs.groupBy("title").agg(F.min("arrival").alias("first_of_title"))
        first = (F.col("arrival") == F.col("first_of_doi")) & (F.col("arrival") == F.col("first_of_title"))
        return cut_lineage(
            pairs.join(by_doi, "doi").join(by_title, "title").select("doi", "title", "arrival", first.alias("first"))
        )

    now = marked(offers)
    taken = now.where("first")
    while now.where("NOT first").head(1):
        chosen = now.where("first")
        left = now.where("NOT first").join(chosen.select("doi"), "doi", "left_anti")
        now = marked(left.join(chosen.select("title"), "title", "left_anti").select("doi", "title", "arrival"))
        taken = taken.unionByName(now.where("first"))
    return taken.select("doi", "title", "arrival")


def resolve_papers(docs: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Paper of each document by DOI, else by normalized title, else a new one.

    ``docs``: doc_id (arrival order), title, doi; stored ``papers``: paper_id, doi,
    normalized_title. As if documents arrived one by one: a paper takes the first DOI it
    meets and keeps it, so a document that joins a paper by title does not give that paper
    a second DOI, and a later one with its DOI alone may open a paper of its own.
    """
    named = docs.select("doc_id", "doi", X.normalize_title(F.col("title")).alias("normalized_title"))
    offers = (
        named.where(F.col("doi").isNotNull())
        .groupBy("doi", F.col("normalized_title").alias("title"))
        .agg(F.min("doc_id").alias("arrival"))
    )
    if papers is not None:
        # A stored DOI is found at once, and a stored title that has one takes no other.
        with_doi = papers.where(F.col("doi").isNotNull())
        offers = offers.join(with_doi.select("doi"), "doi", "left_anti").join(
            with_doi.select(F.col("normalized_title").alias("title")), "title", "left_anti"
        )
    owners = first_matches(offers).select("doi", F.col("title").alias("doi_title"), F.col("arrival").alias("doi_since"))
    keyed = named.join(owners, "doi", "left").withColumn(
        "work_title", F.when(F.col("doi_since") < F.col("doc_id"), F.col("doi_title")).otherwise(F.col("normalized_title"))
    )
    if papers is not None:
        by_doi = papers.where(F.col("doi").isNotNull()).groupBy("doi").agg(
            F.min("paper_id").alias("doi_paper")
        )
        by_title = papers.groupBy(F.col("normalized_title").alias("work_title")).agg(
            F.min("paper_id").alias("title_paper")
        )
        keyed = keyed.join(by_doi, "doi", "left").join(by_title, "work_title", "left")
    else:
        keyed = keyed.withColumn("doi_paper", F.lit(None).cast("string")).withColumn(
            "title_paper", F.lit(None).cast("string")
        )
    known = F.coalesce("doi_paper", "title_paper")
    return keyed.select(
        "doc_id",
        "doi",
        "normalized_title",
        F.coalesce(
            known, F.concat(F.lit("pap_"), F.substring(F.sha2("work_title", 256), 1, 32))
        ).alias("paper_id"),
        F.when(F.col("doi_paper").isNotNull(), "doi")
        .when(F.col("title_paper").isNotNull(), "title")
        .otherwise("batch")
        .alias("matched_by"),
    )


def paper_dois(resolved: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """DOI per paper: a stored one stays, an empty one takes the first that arrived."""
    offered = (
        resolved.where(F.col("doi").isNotNull())
        .groupBy("paper_id")
        .agg(F.min_by("doi", "doc_id").alias("offered"))
    )
    if papers is None:
        return offered.withColumnRenamed("offered", "doi")
    return papers.select("paper_id", "doi").join(offered, "paper_id", "full_outer").select(
        "paper_id", F.coalesce("doi", "offered").alias("doi")
    )


def version_labels(
    arrivals: DataFrame, existing: DataFrame | None = None, bucket: Column | None = None
) -> DataFrame:
    """Next free v1, v2, ... label for each new version of a paper, in arrival order.

    ``arrivals``: paper_id, arrival (``bucket`` rises with it; sampled ranges if left out);
    ``existing``: paper_id, version_label. Numbering starts after the stored version count, as the store does, and skips taken labels.
    """
    numbered = keyed.number_in_key(arrivals, ["paper_id"], ["arrival"], bucket, "k")
    if existing is None:
        return numbered.select(
            "paper_id", "arrival", F.concat(F.lit("v"), F.col("k")).alias("version_label")
        )
    numbers = existing.select(
        "paper_id", F.regexp_extract("version_label", r"^v(\d+)$", 1).alias("n")
    )
    stored = numbers.groupBy("paper_id").agg(F.count("*").cast("int").alias("stored"))
    # Only labels above the stored count are in the way; each becomes the number of
    # free labels below it, so the k-th free label needs one count per row.
    ahead = (
        numbers.where("n <> ''")
        .select("paper_id", F.col("n").cast("int").alias("n"))
        .distinct()
        .join(stored, "paper_id")
        .where("n > stored")
        .groupBy("paper_id")
        .agg(F.array_sort(F.collect_list(F.col("n") - F.col("stored"))).alias("taken"))
        .select("paper_id", F.transform("taken", lambda x, i: x - i - 1).alias("free_below"))
    )
    joined = numbered.join(stored, "paper_id", "left").join(ahead, "paper_id", "left")
    passed = F.size(
        F.filter(F.coalesce("free_below", F.array().cast("array<int>")), lambda x: x < F.col("k"))
    )
    return joined.select(
        "paper_id",
        "arrival",
        F.concat(F.lit("v"), F.coalesce("stored", F.lit(0)) + F.col("k") + passed).alias("version_label"),
    )


def import_items(batch: DataFrame, versions: DataFrame) -> DataFrame:
    """State of each import item: a known hash, or a repeat inside the batch, is a duplicate."""
    known = versions.select("content_sha256", "paper_version_id").dropDuplicates(["content_sha256"])
    first = batch.where(F.col("error_code").isNull()).groupBy("sha256").agg(
        F.min("item_id").alias("first_item")
    )
    joined = batch.join(first, "sha256", "left").join(
        known, F.col("sha256") == F.col("content_sha256"), "left"
    )
    state = (
        F.when(F.col("paper_version_id").isNotNull(), "DUPLICATE")
        .when(F.col("error_code").startswith("DISPATCH"), "RETRYABLE")
        .when(F.col("error_code").isNotNull(), "FAILED")
        .when(F.col("item_id") != F.col("first_item"), "DUPLICATE")
        .otherwise("IMPORTED")
    )
    return joined.select("item_id", "batch_id", "sha256", "size_bytes", "error_code", state.alias("state"))


def import_report(items: DataFrame) -> DataFrame:
    """Totals per batch and state."""
    return items.groupBy("batch_id").agg(
        F.count("*").alias("items"),
        *[
            F.count_if(F.col("state") == s).alias(s.lower())
            for s in ("IMPORTED", "DUPLICATE", "FAILED", "RETRYABLE")
        ],
        F.sum("size_bytes").alias("bytes"),
    )


def failed_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("state") == "FAILED")


def content_dedup_report(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Asset totals and bytes of stored files that no asset names."""
    stray = inventory.join(assets.select("storage_key"), "storage_key", "left_anti")
    files = stray.agg(F.count("*")).scalar()
    size = stray.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).scalar()
    totals = assets.agg(F.count("*").alias("assets_total"), F.sum("size_bytes").alias("assets_bytes"))
    return (
        totals.withColumn("duplicate_objects", files)
        .withColumn("duplicate_bytes", size)
        .withColumn("dedup_effective", F.col("duplicate_bytes") == 0)
    )


OBJECT_KEY = r"^[a-z_]+/sha256/([0-9a-f]{2})/(\1[0-9a-f]{62})$"


def integrity_check(inventory: DataFrame, assets: DataFrame, versions: DataFrame) -> DataFrame:
    """Compare stored objects with asset and version hashes.

    ``inventory``: storage_key, actual_sha256 (recomputed from content).
    """
    linked = versions.select(
        "asset_id", F.col("content_sha256").alias("version_sha256")
    ).dropDuplicates(["asset_id", "version_sha256"])
    joined = (
        assets.select("asset_id", "storage_key", F.col("sha256").alias("asset_sha256"))
        .join(inventory, "storage_key", "full_outer")
        .join(linked, "asset_id", "left")
    )
    status = (
        F.when(F.col("asset_id").isNull(), "UNKNOWN_OBJECT")
        .when(~F.col("storage_key").rlike(OBJECT_KEY), "BAD_KEY")
        .when(F.col("actual_sha256").isNull(), "MISSING_OBJECT")
        .when(F.col("actual_sha256") != F.col("asset_sha256"), "OBJECT_MISMATCH")
        .when(F.col("version_sha256") != F.col("asset_sha256"), "VERSION_MISMATCH")
        .otherwise("OK")
    )
    return joined.select("storage_key", "asset_id", status.alias("status"))


def task_keys(tasks: DataFrame, dimensions: list[str], kind: str = "task_type") -> DataFrame:
    """Idempotency key per task: its type and 40 hex digits over the dimensions."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions])
    return tasks.withColumn(
        "idempotency_key", F.concat(kind, F.lit(":"), F.substring(F.sha2(joined, 256), 1, 40))
    )


def first_dispatch(tasks: DataFrame, order: list[str]) -> DataFrame:
    """The first task per idempotency key and how many later ones reuse it."""
    return tasks.groupBy("idempotency_key").agg(
        F.min(F.struct(*order)).alias("first"), (F.count("*") - 1).alias("reused")
    )
