"""Registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.llm.clusters import labelled_clusters, labelled_members
from engrava.llm.leakage import leaks
from engrava.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from engrava.llm.packing import containers
from engrava.llm.patterns import frequent_chains
from engrava.llm.personal import find_personal, redact_personal
from engrava.llm.posting_lists import nearest_neighbours
from engrava.llm.shared_spans import shared_share, shared_spans
from engrava.llm.vectors import usable_vectors
from engrava.session import table

#: An aligned pair counts as an edited copy from this share of the best possible score.
EDITED_SHARE = 0.6


#: Key of the pseudonyms in the registered query; a deployment passes its own.
DEMO_KEY = b"registered-query-key"


def p1_found(spark, d):
    chains = frequent_chains(table(spark, d, "access_log"), 0.10, 3)
    return chains.select(F.array_join(F.transform("pattern", lambda x: x.cast("string")), ">").alias("pattern"))


def p1_support(spark, d):
    """Every frequent chain of one or more items with the number of tenants that follow it."""
    chains = frequent_chains(table(spark, d, "access_log"), 0.10, 1)
    return chains.select(F.array_join(F.transform("pattern", lambda x: x.cast("string")), ">").alias("pattern"), F.size("pattern").alias("n_items"), "support")


def _texts(spark, d):
    return table(spark, d, "memories").select("seq", "text").unionByName(table(spark, d, "messages").select("seq", "text"))


def p4_found(spark, d):
    return find_personal(_texts(spark, d), table(spark, d, "people")).withColumnRenamed("id", "seq")


def p4_redacted(spark, d):
    """Each record once, with typed pseudonyms in place of what was found."""
    return redact_personal(_texts(spark, d).dropDuplicates(["seq"]), table(spark, d, "people"), DEMO_KEY).withColumnRenamed("id", "seq")


def p5_found(spark, d):
    members = labelled_members(table(spark, d, "memories"))
    return members.select("cluster_label", F.col("id").alias("mem_id"))


def p5_profiles(spark, d):
    """Size, label, Markov clusters and most typical members of each cluster."""
    _, profiles = labelled_clusters(table(spark, d, "memories"))
    return profiles.select("cluster", "cluster_label", "size", "parts", "typical")


def p6_found(spark, d):
    pairs = near_duplicate_pairs(table(spark, d, "memories"), 0.6, 3, "mem_id", "text")
    return pairs.toDF("mem_id_a", "mem_id_b")


def p6_groups(spark, d):
    """Class, copies, links and group of each memory at five words and a similarity of 0.8."""
    return near_duplicate_groups(table(spark, d, "memories"), 0.8, 5, "mem_id", "text").withColumnRenamed("id", "mem_id")


def p7_found(spark, d):
    near = nearest_neighbours(usable_vectors(table(spark, d, "memories"), "mem_id", "vec", "tenant"), 5)
    return near.select(F.least("id", "neighbour").alias("mem_id_a"), F.greatest("id", "neighbour").alias("mem_id_b")).distinct()


def p7_neighbours(spark, d):
    """The five most similar memories of the same tenant, with their cosine, for every usable memory."""
    near = nearest_neighbours(usable_vectors(table(spark, d, "memories"), "mem_id", "vec", "tenant"), 5)
    return near.select(F.col("id").alias("mem_id"), "neighbour", F.round("cosine", 6).alias("cosine"))


def p8_containers(spark, d):
    return containers(table(spark, d, "documents"), 2048)


def p8_fill(spark, d):
    """How full the containers are, by tenth of their capacity."""
    full = containers(table(spark, d, "documents"), 2048)
    return full.groupBy(F.floor(F.col("fill") * 10 / 2048).cast("int").alias("tenth")).agg(F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens"))


def p9_found(spark, d):
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("longest_run >= 12").select("doc_id", "item_id")


def p9_leaked_items(spark, d):
    """Per leaked item: documents with a whole passage, and with an edited copy."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), share=EDITED_SHARE)
    share = F.col("score") / (2 * F.col("item_words"))
    return (
        found.withColumn("exact", F.col("longest_run") >= 12)
        .withColumn("edited", ~F.col("exact") & (share >= EDITED_SHARE))
        .filter("exact or edited")
        .groupBy("item_id")
        .agg(F.count_if("exact").alias("n_exact"), F.count_if("edited").alias("n_edited"), F.max(share).alias("best_share"))
    )


def p10_found(spark, d):
    return shared_spans(table(spark, d, "documents"))


def p10_shared_share(spark, d):
    return shared_share(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_support, p4_found, p4_redacted, p5_found, p5_profiles, p6_found, p6_groups, p7_found, p7_neighbours, p8_containers, p8_fill, p9_found, p9_leaked_items, p10_found, p10_shared_share)}
