"""From fetched mentions to stored mentions, candidates and their side tables.

Input frames follow MENTION_SCHEMA plus ``source_id`` and ``arrival``; arrival is the
explicit order that "first" and "last" rules refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from advisorylake.functions.hashing import content_hash
from advisorylake.functions.identifiers import (
    extract_from_list, extract_identifiers, is_recognized, primary_cve, primary_native, values_of,
)
from advisorylake.functions.text import strip
from advisorylake.operators.stages import compute_once

FLAG_COLUMNS = ["in_kev", "kev_date", "kev_source", "has_public_poc"]
REFERENCE_CAP = 50


def mention_fanout(entries: DataFrame) -> DataFrame:
    """title, summary, url, seen_at -> one mention per CVE, or one on the first other id.

    A single CVE keeps the other ids as aliases; several CVEs are different
    vulnerabilities and never share one mention.
    """
    ids = entries.withColumn(
        "ids", extract_identifiers(F.col("title"), F.col("summary"))).withColumns(
        {"cves": values_of(F.col("ids"), True), "others": values_of(F.col("ids"), False)})
    none = F.lit(None)

    def item(cve: Column, native: Column, extra: Column) -> Column:
        return F.struct(cve.cast("string").alias("cve_id"), native.cast("string").alias("native_id"),
                        F.when(F.size(extra) > 0, extra).alias("extra_ids"))

    no_ids = F.array().cast("array<string>")
    others = F.col("others")
    one = F.array(item(F.get("cves", F.lit(0)), none, others))
    many = F.transform("cves", lambda c: item(c, none, no_ids))
    native_only = F.array(item(none, F.get("others", F.lit(0)),
                               F.slice("others", 2, F.size("others"))))
    fan = (F.when(F.size("cves") == 1, one).when(F.size("cves") > 1, many)
           .when(F.size("others") > 0, native_only))
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    kept = [c for c in entries.columns if c not in ("title", "summary")]
    return ids.select(
        *kept, F.left(title, F.lit(200)).alias("title"),
        F.left(F.concat(title, F.lit(" | "), summary), F.lit(2000)).alias("snippet"),
        F.explode(fan).alias("m")).select(*kept, "title", "snippet", "m.*")


def declared_identity(mentions: DataFrame) -> DataFrame:
    """Adds ``ids`` and ``text_ids``: the declared ids, else only the first id of the text.

    Each text is searched once whatever filters follow.
    """
    declared = extract_from_list(F.col("extra_ids"), F.col("cve_id"), F.col("native_id"))
    in_text = extract_identifiers(F.col("title"), F.col("snippet"), F.col("url"))
    if "whole_text_ids" in mentions.columns:  # read by a scan before it cut the text
        in_text = F.array_union(in_text, F.coalesce("whole_text_ids", F.array().cast(mentions.schema["whole_text_ids"].dataType)))
    found = compute_once(mentions, declared=declared, text_ids=in_text)
    return found.withColumn(
        "ids", F.when(F.size("declared") > 0, F.col("declared"))
        .otherwise(F.slice("text_ids", 1, 1))).drop("declared")


def recognized_gate(identified: DataFrame) -> DataFrame:
    return identified.where(is_recognized(F.col("ids")))


def with_content_hash(identified: DataFrame) -> DataFrame:
    cve = F.coalesce(primary_cve(F.col("ids")), F.upper(strip(F.col("cve_id"))))
    native = F.coalesce(primary_native(F.col("ids")), strip(F.col("native_id")))
    return (identified.withColumn("extracted_cve", cve).withColumn("extracted_native", native)
            .withColumn("content_hash", content_hash(
                cve=F.col("extracted_cve"), native=F.col("extracted_native"),
                title=F.col("title"), snippet=F.col("snippet"), url=F.col("url"))))


def prepare(mentions: DataFrame) -> DataFrame:
    """Identity, gate and hash in one pass over the text."""
    return with_content_hash(recognized_gate(declared_identity(mentions)))


def mention_dedup(prepared: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First arrival per (source, hash), minus what is already stored.

    Only the row is dropped: ids, flags and products are taken from all rows by the
    callers, because a repeat may add an alias or a flag.
    """
    first = W.partitionBy("source_id", "content_hash").orderBy("arrival")
    rows = prepared.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    if stored is None:
        return rows
    return rows.join(stored.select("source_id", "content_hash"),
                     ["source_id", "content_hash"], "left_anti")


def attach_candidate(prepared: DataFrame, identifiers: DataFrame) -> DataFrame:
    """candidate_id of each mention through its first id; a hot id stays distributed."""
    from advisorylake.operators.resolve import node_key

    keyed = prepared.withColumn(
        "anchor", node_key(F.get("ids", F.lit(0))["scheme"], F.get("ids", F.lit(0))["value"]))
    one = identifiers.select(node_key(F.col("scheme"), F.col("value")).alias("anchor"),
                             "candidate_id")
    return keyed.join(one, "anchor", "left").drop("anchor")


def apply_flags(rows: DataFrame) -> DataFrame:
    """Last non-null value of each allowed flag per candidate."""
    def last_known(name: str) -> Column:
        value = F.col(f"flags.{name}")
        return F.max_by(value, F.when(value.isNotNull(), F.col("arrival"))).alias(name)

    return (rows.where(F.col("flags").isNotNull()).groupBy("candidate_id")
            .agg(*[last_known(c) for c in FLAG_COLUMNS]))


def list_values(rows: DataFrame, column: str) -> DataFrame:
    """candidate_id, value, first_use: the ordered union of a list column in long form.

    Uncapped lists stay in this form; ordering by ``first_use`` gives the stored order.
    """
    return (rows.select("candidate_id", "arrival", F.posexplode(column).alias("pos", "value"))
            .groupBy("candidate_id", "value")
            .agg(F.min(F.struct("arrival", "pos")).alias("first_use")))


def capped_list(rows: DataFrame, column: str, cap: int | None) -> DataFrame:
    """candidate_id and the first ``cap`` distinct values (None: all); the rank limit prunes on the
    map side, so no task sees more than ``cap`` values of a candidate per input task."""
    order = W.partitionBy("candidate_id").orderBy("first_use", "value")
    kept = list_values(rows, column).withColumn("position", F.row_number().over(order))
    if cap is not None:
        kept = kept.where(F.col("position") <= cap)
    return (kept.groupBy("candidate_id")
            .agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("r"))
            .select("candidate_id", F.transform("r", lambda x: x["value"]).alias(column)))


def candidate_updates(rows: DataFrame, stored: DataFrame | None = None, cap: int | None = REFERENCE_CAP) -> DataFrame:
    """Reference list, CWE ids and last declared withdrawal per candidate.

    Lists of ``stored`` (candidate_id, reference_urls, cwe_ids) come first, then those of the batch in the order of arrival,
    each value once. The reference list keeps ``cap`` values, the rule of the stored column (None: all).
    """
    kept = ["candidate_id", "reference_urls", "cwe_ids"]
    lists = rows.select("arrival", *[c if c in rows.columns else F.lit(None).cast("array<string>").alias(c) for c in kept])
    if stored is not None:
        touched = stored.join(rows.select("candidate_id").distinct(), "candidate_id", "left_semi")
        lists = lists.unionByName(touched.select(F.lit(None).cast(rows.schema["arrival"].dataType).alias("arrival"), *kept))
    last = rows.groupBy("candidate_id").agg(
        F.max_by("withdrawn", F.when(F.col("withdrawn").isNotNull(), F.col("arrival")))
        .alias("withdrawn"))
    return (last.join(capped_list(lists, "reference_urls", cap), "candidate_id", "left")
            .join(capped_list(lists, "cwe_ids", None), "candidate_id", "left"))


def soft_references(stored: DataFrame) -> DataFrame:
    """CVEs of the prose that are not the mention's own anchor, one row each."""
    def cves(ids: str) -> Column:
        return F.transform(F.filter(ids, lambda i: i["scheme"] == "CVE"), lambda i: i["value"])

    context = F.left(F.coalesce(F.when(F.col("title") != "", F.col("title")),
                                F.when(F.col("snippet") != "", F.col("snippet"))), F.lit(500))
    carried = [c for c in ("mention_id", "arrival", "source_id", "candidate_id")
               if c in stored.columns]
    return stored.select(*carried, context.alias("context"),
                         F.explode(F.array_except(cves("text_ids"), cves("ids"))).alias("cve_id"))


def raw_archive(prepared: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """Raw payloads not archived yet, one per (source, hash)."""
    rows = mention_dedup(prepared.where(F.col("raw_html") != ""), archived)
    return rows.select("source_id", "content_hash", "raw_html")


def ingest(mentions: DataFrame, identifiers: DataFrame | None = None,
           candidates: DataFrame | None = None, stored: DataFrame | None = None
           ) -> dict[str, DataFrame]:
    """A whole batch: identifiers, merges, new mentions and per-candidate side frames."""
    from advisorylake.operators.resolve import resolve_identifiers
    from advisorylake.session import cut_lineage

    prepared = cut_lineage(prepare(mentions))
    ids, merges = resolve_identifiers(prepared.select("ids"), identifiers, candidates)
    ids = cut_lineage(ids)
    owned = attach_candidate(prepared, ids)
    new_rows = mention_dedup(owned, stored)
    return {
        "identifiers": ids, "merges": merges, "mentions": new_rows,
        "soft_references": soft_references(new_rows), "flags": apply_flags(owned),
        "updates": candidate_updates(owned),
    }
