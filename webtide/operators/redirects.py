"""Redirect resolution over an edge table.

The gate (scheme, IPv4 / IPv6 literal) and the relative-location resolution
depend only on the URLs, so both are computed once per edge and once per
start URL in narrow passes. The edges are then followed by pointer doubling:
a round joins each edge's target with the edges, so its length doubles, and
seven redirects need three rounds and one join with the starts. A cycle grows
past the limit like any long chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.urls import canonical_host, normalize_url, resolve_url, strip_brackets, url_parts
from ..session import cut_lineage
from .gates import resolved_gate, scheme_gate_message, with_address_blocked

TOO_MANY = "Too many redirects"


def with_hop_gate(df: DataFrame, url: str, out: str = "_gate") -> DataFrame:
    """Adds the gate message of each URL (scheme, IPv4 / IPv6 literal);
    host and address are materialised once as columns."""
    df = df.withColumn("_host", strip_brackets(canonical_host(url_parts(F.col(url))["host"])))
    df = with_address_blocked(df, "_host", "_blk")
    return df.withColumn(
        out, F.coalesce(scheme_gate_message(F.col(url)), F.when(F.col("_blk"), F.lit("SSRF blocked")))
    ).drop("_host", "_blk")


def with_full_gate(df: DataFrame, url: str, out: str, resolved: DataFrame | None) -> DataFrame:
    """Literal-host gates (B7–B9), then — when a (host, address) table is
    given — the resolved-address gate (B10) for hostnames."""
    g = with_hop_gate(df, url, out)
    if resolved is None:
        return g
    r = resolved_gate(g, resolved, url=url).drop("n_addresses", "host")
    return r.withColumn(out, F.coalesce(F.col(out), F.col("resolve_message"))).drop("resolve_message")


def prepare_edges(edges: DataFrame, src: str = "src_url", location: str = "location",
                  resolved: DataFrame | None = None, latest: tuple[str, ...] = ()) -> DataFrame:
    """(from, next URL, gate of next URL), one row for each source URL: an
    edge that was recorded several times, or with different targets, counts
    once. ``latest`` names the columns that say which record is the newest
    (such as time and id); without them the least target is taken, so that
    reruns agree."""
    e = edges.select(normalize_url(F.col(src)).alias("_from"), normalize_url(resolve_url(F.col(src), F.col(location))).alias("_next"), *latest)
    one = F.max_by("_next", F.struct(*latest, "_next")) if latest else F.min("_next")
    e = e.where("_from is not null and _next is not null").groupBy("_from").agg(one.alias("_next"))
    return with_full_gate(e, "_next", "_next_gate", resolved)


def double(hops: DataFrame) -> DataFrame:
    """Edges of up to n hops → of up to 2n: (_from, _next, hops, _next_gate).
    A gated URL ends a chain: ``hops`` is then the first gated hop."""
    on = hops.select(F.col("_from").alias("_at"), F.col("_next").alias("_to"), F.col("hops").alias("_more"), F.col("_next_gate").alias("_then"))
    j = hops.join(on, F.col("_next_gate").isNull() & (F.col("_next") == F.col("_at")), "left")
    return j.select(
        "_from", F.coalesce("_to", "_next").alias("_next"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
        F.coalesce("_next_gate", "_then").alias("_next_gate"),
    )


def resolve_redirects(starts: DataFrame, edges: DataFrame, max_redirects: int = DEFAULTS.max_redirects,
                      key: str = "page_id", url: str = "url", src: str = "src_url", location: str = "location",
                      resolved: DataFrame | None = None, latest: tuple[str, ...] = ()) -> DataFrame:
    """(key, final_url, hops, error_message): follow ``location`` edges
    (relative locations resolve against the current URL) until a URL has no
    edge. A redirect seen after ``max_redirects`` hops fails with 'Too many
    redirects'; a gated URL fails with the gate message. With ``resolved``
    (host, address) every hop also passes the resolved-address gate.

    The prepared edges and each round but the last are written once to the
    shared checkpoint folder, so no round is computed twice and a lost
    executor costs one round."""
    e = cut_lineage(prepare_edges(edges, src, location, resolved, latest).withColumn("hops", F.lit(1)).select("_from", "_next", "hops", "_next_gate"))
    reach = 1
    while reach < max_redirects + 1:
        e, reach = double(e), 2 * reach
        if reach < max_redirects + 1:
            e = cut_lineage(e)
    first = with_full_gate(starts.select(F.col(key), normalize_url(F.col(url)).alias("_cur")), "_cur", "_gate", resolved)
    j = first.join(e, F.col("_gate").isNull() & (F.col("_cur") == F.col("_from")), "left").withColumn("_n", F.coalesce("hops", F.lit(0)))
    many = F.col("_n") > max_redirects
    failed = F.coalesce("_gate", F.when(many, F.lit(TOO_MANY)), "_next_gate")
    return j.select(
        key,
        F.when(failed.isNull(), F.coalesce("_next", "_cur")).alias("final_url"),
        F.least("_n", F.lit(max_redirects)).cast("int").alias("hops"),
        failed.alias("error_message"),
    )
