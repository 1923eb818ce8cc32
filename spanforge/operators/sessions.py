"""Resolving, listing and viewing sessions; routing events to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spanforge.operators.pairing import POST_MORTEM_PREFIX
from spanforge.operators.scan import chunk_of, with_position, with_running

# Spark's default spark.sql.optimizer.windowGroupLimitThreshold


def resolve_refs(sessions: DataFrame, refs: list[str]) -> DataFrame:
    """Session each user-typed reference means, null when none fits.

    The newest directory containing the text, else the newest with that full id,
    else an exact name (latest start, then directory).  All references are
    answered by one aggregation over the catalog.
    """
    key, sid = F.col("session_key"), F.lower(F.replace("session_id", F.lit("-"), F.lit("")))
    picks = []
    for i, ref in enumerate(refs):
        plain = ref.replace("-", "").lower()
        level = F.when(key.contains(ref), 3)
        if len(plain) == 32 and all(c in "0123456789abcdef" for c in plain):
            level = level.when(sid == plain, 2)
        level = level.when(F.col("name") == ref, 1)
        order = F.struct(level, F.when(level == 1, F.col("started_rfc3339")).otherwise(""), key)
        picks.append(F.max_by(key, F.when(level.isNotNull(), order)).alias(f"r{i}"))
    pairs = F.array(*[F.struct(F.lit(ref).alias("ref"), F.col(f"r{i}").alias("session_key"))
                      for i, ref in enumerate(refs)])
    return sessions.agg(*picks).select(F.inline(pairs))


def latest_session(sessions: DataFrame) -> DataFrame:
    """Newest non-ambient session (unknown kind counts as one), else the newest."""
    ambient = F.coalesce(F.col("kind") == "Ambient", F.lit(False))
    return sessions.agg(F.max_by("session_key", F.struct(~ambient, F.col("session_key"))).alias("session_key"))


def default_session(sessions: DataFrame, *, prefer_post_mortem: bool = True,
                    include_ambient: bool = False) -> DataFrame:
    """Newest post-mortem unless a scoped session started later; else newest scoped; else newest."""
    key, started = F.col("session_key"), F.col("started_rfc3339")
    pm = key.startswith(POST_MORTEM_PREFIX)
    scoped = F.coalesce(F.col("kind") == "Scoped", F.lit(False))
    picks = sessions.agg(
        F.max_by(F.struct("session_key", "started_rfc3339"), F.when(pm, key)).alias("pm"),
        F.max_by(started, F.when(scoped & ~pm, key)).alias("scoped_started"),
        F.max(F.when(scoped, key)).alias("scoped"), F.max(key).alias("newest"))
    stale = F.coalesce(F.col("pm.started_rfc3339") < F.col("scoped_started"), F.lit(False))
    first = F.when(F.lit(prefer_post_mortem) & ~stale, F.col("pm.session_key"))
    rest = F.col("newest") if include_ambient else F.coalesce("scoped", "newest")
    return picks.select(F.coalesce(first, rest).alias("session_key"))


def live_session(sessions: DataFrame) -> DataFrame:
    """Newest session without an end, else the newest with live = false."""
    live = F.col("ended_rfc3339").isNull()
    pick = sessions.agg(F.max_by(F.struct("session_key", live.alias("live")),
                                 F.struct(live, F.col("started_rfc3339"), F.col("session_key"))).alias("s"))
    return pick.select("s.*")


def list_sessions(sessions: DataFrame, counts: DataFrame, root_causes: DataFrame, *,
                  include_empty: bool = False, min_events: int = 20) -> DataFrame:
    """Sessions with event count and root-cause title; near-empty ones are hidden."""
    out = (sessions.join(counts, "session_key", "left").join(root_causes, "session_key", "left")
           .withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("bigint")))
           .withColumn("short_id", F.left("session_id", F.lit(8))))
    return out if include_empty else out.where(F.col("event_count") >= min_events)


def session_view(sessions: DataFrame, events: DataFrame, view: str, findings: DataFrame | None = None) -> DataFrame:
    """One of the views full (metadata and events), metadata or summary (metadata, event count and findings, a row each)."""
    if view == "metadata":
        return sessions
    if view == "full":
        return sessions.select("session_key", F.struct(*sessions.columns).alias("metadata")).join(events, "session_key")
    if view == "summary":
        if findings is None:
            raise ValueError("the summary view needs the sessions' findings")
        counts = events.groupBy("session_key").agg(F.count(F.lit(1)).alias("event_count"))
        return sessions.join(counts, "session_key", "left").join(findings, "session_key", "left")
    raise ValueError(f"unknown view {view!r}")


def session_set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sessions that appeared or vanished between two catalog snapshots."""
    a, b = before.select("session_key"), after.select("session_key")
    return (b.exceptAll(a).withColumn("change", F.lit("added"))
            .unionByName(a.exceptAll(b).withColumn("change", F.lit("removed"))))


def route_events(events: DataFrame, attachments: DataFrame, *, ambient_key: str,
                 order: str = "event_ord") -> DataFrame:
    """Session each incoming event belongs to.

    Token match first, then pid, then (marks only) the scoped session attached
    last and still open, else the ambient session.  The first two rules are one running
    'latest attach or detach' over the merged log of keys, so no event meets more than
    its own keys' latest state.
    """
    att = attachments
    keyed = lambda token, pid: F.array_compact(F.array(
        F.when(token.isNotNull(), F.struct(F.lit(0).alias("prio"), F.concat(F.lit("t:"), token.cast("string")).alias("k"))),
        F.when(pid.isNotNull(), F.struct(F.lit(1).alias("prio"), F.concat(F.lit("p:"), pid.cast("string")).alias("k")))))
    on = F.struct(F.col("attach_ord").alias("o"), F.lit(1).alias("side"), F.col("session_key").alias("s"))
    off = F.when(F.col("detach_ord").isNotNull(), F.struct(F.col("detach_ord").alias("o"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("s")))
    changes = (att.select(keyed(F.col("scope_token"), F.col("pid")).alias("_keys"), F.explode(F.array_compact(F.array(on, off))).alias("c"))
               .select(F.explode("_keys.k").alias("_k"), F.col("c.o").alias("_o"), F.col("c.side").alias("_side"), F.col("c.s").alias("_sess"),
                       F.lit(None).cast("bigint").alias("_rid"), F.lit(None).cast("int").alias("_prio")))
    base = events.withColumn("_rid", F.col(order))
    asks = base.select("_rid", F.inline(keyed(F.col("scope_token"), F.col("pid")))).select(
        F.col("k").alias("_k"), F.col("_rid").alias("_o"), F.lit(2).alias("_side"), F.lit(None).cast("string").alias("_sess"), "_rid", F.col("prio").alias("_prio"))
    # one merged scan for both rules; an event's answers then meet by its position
    merged = with_running(changes.unionByName(asks), ["_k"], ["_o", "_side"],
                          {"_st": ("last", F.when(F.col("_rid").isNull(), F.struct(F.col("_sess").alias("s"))))}, chunk=chunk_of("_o"))
    known = F.when(F.col("_st.s").isNotNull(), F.struct("_prio", F.col("_st.s").alias("s")))
    found = merged.where(F.col("_rid").isNotNull()).groupBy("_rid").agg(F.min(known)["s"].alias("_by_key"))
    out = base.join(found, "_rid", "left")
    from spanforge.operators.stab import stab_join

    spans = att.select(F.lit(0).alias("_g"), "attach_ord", F.col("session_key").alias("scoped"),
                       (F.coalesce("detach_ord", F.lit(1 << 62)) - 1).alias("_end"))
    marks = stab_join(base.where(F.col("source") == "Mark").select("_rid", F.lit(0).alias("_g")).withColumn("_at", F.col("_rid")),
                      spans, by=["_g"], ts="_at", lo="attach_ord", hi="_end",
                      prefer=F.col("attach_ord"), keep=["scoped"], cell=1024, levels=13)
    out = out.join(marks.select("_rid", F.col("win.scoped").alias("_by_mark")), "_rid", "left")
    return out.withColumn("routed_to", F.coalesce("_by_key", "_by_mark", F.lit(ambient_key))
                          ).drop("_rid", "_by_key", "_by_mark")


def recent(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, ranked latest first.

    Up to Spark's group-limit threshold older rows drop before the shuffle; a
    larger ``n`` first finds each group's cut-off from positions counted in
    chunks, so that only ``n`` rows of a group ever meet.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        chunk = chunk_of(order)
        total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        df = (with_position(df, keys, [order], "_pos", chunk=chunk).join(total, keys)
              .where(F.col("_pos") > F.col("_total") - n).drop("_pos", "_total"))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
