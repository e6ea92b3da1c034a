"""Link probes: where links lead and whether anything is there, by a bounded chain of joins with a table of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import urls
from tidemill.sources.ports import Port
from tidemill.sources.storage import written

HOPS = 4


def probed(links: DataFrame, fetch: Port, resolve: Port | None = None, hops: int = HOPS) -> DataFrame:
    """(url, state, detail, final_url, status, hops) of distinct links (url): alive, dead or needs_review, after hops requests at most.

    fetch adds status, location and error to rows (url, method); resolve adds addresses to rows (name), if names are to be looked up. Each
    hop tests where it goes before it asks: an unsafe start or redirect, an answer of private addresses, no response, a status of 400
    or more but 404 and 410, and a chain that doesn't end (a loop doesn't either) need a review. The first request is a HEAD; a server that
    refuses those is asked again. Links are made distinct first, so that one that many rows name is followed once; a hop joins only what is still on its way, a table of the shared folder.
    """
    way = written(links.select("url").where("url IS NOT NULL").distinct().select("url", F.col("url").alias("at")), "way")
    ended = []
    for hop in range(hops):
        unsafe = F.concat(F.lit("unsafe_probe:"), urls.unsafe_target(F.col("at")))
        told = written(way.withColumn("detail", unsafe), "told")
        if resolve is not None:
            host = urls.host_text(F.col("at"))
            named = told.withColumn("name", F.when(F.col("detail").isNull() & urls.address(host).isNull(), host))
            answers = resolve(named.select("name").where("name IS NOT NULL").distinct()).select("name", F.concat(F.lit("unsafe_probe:"), urls.unsafe_answers(F.col("addresses"))).alias("answered"))
            told = named.join(answers, "name", "left").withColumn("detail", F.coalesce("detail", "answered")).drop("name", "answered")
        asked = fetch(told.where("detail IS NULL").select(F.col("at").alias("url"), F.lit("HEAD" if hop == 0 else "GET").alias("method")).distinct())
        back = told.join(asked.select(F.col("url").alias("at"), "status", "location", "error"), "at", "left")
        target = F.when(F.col("status").between(300, 399), urls.resolved(F.col("at"), F.nullif("location", F.lit(""))))
        back = back.withColumn("next", F.when(F.col("detail").isNull(), target))
        refused = F.col("status").isin(405, 501) if hop == 0 else F.lit(False)
        reason = urls.unsafe_target(F.col("next"))
        fetched = F.col("detail").isNull() & F.col("status").isNotNull()
        state = (
            F.when(F.col("detail").isNotNull() | F.col("status").isNull(), "needs_review").when(F.col("next").isNotNull(), F.when(reason.isNotNull(), "needs_review"))
            .when(refused, None).when(F.col("status").isin(404, 410), "dead").when(F.col("status") >= 400, "needs_review").otherwise("alive")
        )
        detail = (
            F.when(F.col("detail").isNotNull(), F.col("detail")).when(F.col("status").isNull(), F.concat(F.lit("probe_error:"), F.coalesce("error", F.lit("no response"))))
            .when(reason.isNotNull() & F.col("next").isNotNull(), F.concat(F.lit("unsafe_redirect:"), reason)).when(F.col("status").isin(404, 410), F.concat(F.lit("HTTP "), F.col("status"), F.lit(" for "), F.col("at")))
            .when(F.col("status") >= 400, F.concat(F.lit("probe_status:"), F.col("status"))).otherwise("")
        )
        back = written(back.select("url", "at", "next", state.alias("state"), detail.alias("detail"), F.when(fetched, F.col("status")).cast("int").alias("status")), "back")
        final = F.when(F.col("status").isNotNull() & F.col("next").isNull(), F.col("at"))
        ended.append(back.where("state IS NOT NULL").select("url", "state", "detail", final.alias("final_url"), "status", F.lit(hop + 1).alias("hops")))
        way = back.where("state IS NULL").select("url", F.coalesce("next", "at").alias("at"))
    none = F.lit(None)
    out = way.select("url", F.lit("needs_review").alias("state"), F.lit("redirect_limit").alias("detail"), none.cast("string").alias("final_url"), none.cast("int").alias("status"), F.lit(hops).alias("hops"))
    for part in ended:
        out = out.unionByName(part)
    return out
