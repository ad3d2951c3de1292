"""Listings that come in pages: pages followed by their tokens, and repositories of hosts in one form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import cut

#: After so many repositories, or board items, no further page is asked for; the last one counts whole.
MOST_REPOSITORIES = 500
MOST_ITEMS = 1000
#: Of a host's repository, where the name, the full name, the description, the default branch and the address are.
HOSTED = {
    "github": ("$.name", "$.full_name", "$.description", "$.default_branch", "$.clone_url"),
    "gitlab": ("$.name", "$.path_with_namespace", "$.description", "$.default_branch", "$.http_url_to_repo"),
    "bitbucket": ("$.name", "$.full_name", "$.description", "$.mainbranch.name", "$.links.clone[0].href"),
}
REPO_FIELDS = ("name", "full_name", "description", "default_branch", "clone_url")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(listing, token, payload) of page documents, one JSON file a page: folder/listing/token.json; the first page's token is `first`."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    part = lambda k: F.url_decode(F.element_at(F.split("path", "/"), k))
    token = F.regexp_replace(part(-1), "\\.json$", "")
    return files.select(part(-2).alias("listing"), F.when(token == "first", "").otherwise(token).alias("token"), "payload")


def followed(pages: DataFrame, most: int = MOST_REPOSITORIES) -> DataFrame:
    """(listing, place, item) of all items of each listing, in the order in which its pages lead to each other from the one with an empty token.

    pages (listing, token, payload); a payload is {"items": [...], "next": token or null}.  A listing ends with a page that names no next one,
    that is broken, missing or without items, or once `most` items have come.  A page is read once, though pages lead back to it; of pages
    with one token the least payload counts.  Listings are followed side by side, a page each a round.
    """
    read = F.from_json("payload", "items array<string>, next string")
    parsed = cut(pages.groupBy("listing", F.coalesce("token", F.lit("")).alias("token")).agg(F.min("payload").alias("payload")).select("listing", "token", read.alias("p")).select("listing", "token", "p.items", "p.next"))
    front = cut(parsed.filter("token = ''").select("listing", "token", F.lit(0).alias("before")))
    seen = [front]
    while not front.isEmpty():
        on = front.join(parsed, ["listing", "token"]).filter("size(items) > 0 AND coalesce(next, '') <> ''")
        on = on.select("listing", F.col("next").alias("token"), (F.col("before") + F.size("items")).alias("before")).filter(F.col("before") < most)
        known = reduce(DataFrame.union, seen).select("listing", "token").hint("merge")  # a union has no hint of its own and would be broadcast, some MB each round
        front = cut(on.join(known, ["listing", "token"], "left_anti"))
        seen.append(front)
    came = reduce(DataFrame.union, seen).join(parsed.select("listing", "token", "items"), ["listing", "token"])
    return came.select("listing", "before", F.posexplode("items").alias("k", "item")).select("listing", (F.col("before") + F.col("k")).alias("place"), "item")


def repositories(items: DataFrame, host: str) -> DataFrame:
    """listing, place and REPO_FIELDS of items (listing, place, item: JSON of a repository as the host gives it); what is missing is empty."""
    fields = [F.coalesce(F.get_json_object("item", path), F.lit("")).alias(name) for name, path in zip(REPO_FIELDS, HOSTED[host], strict=True)]
    return items.select("listing", "place", *fields)
