"""Ranking, top-k, quotas, and set operations over candidates and assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.functions.similarity import title_tier, token_score, tokens
from verseline.functions.textnorm import normalize_text
from verseline.operators.ordered import group_total, row_index, running_sum, salted_lookup, scan


def score_candidates(cands: DataFrame) -> DataFrame:
    """Score columns of a candidate (keyword, title, artist, album, body, priority) against its query keyword."""
    fields = ("title", "artist", "album", "body")
    s = cands.withColumns({f"__{c}": normalize_text(F.col(c)) for c in ("keyword", *fields)})
    s = s.withColumns({f"__{c}_t": tokens(F.col(f"__{c}")) for c in ("keyword", *fields)})
    s = s.withColumns({f"{c}_score": token_score(F.col("__keyword"), F.col(f"__{c}"), F.col("__keyword_t"), F.col(f"__{c}_t")) for c in fields})
    s = s.withColumn("tier", title_tier(F.col("keyword"), F.col("title"), F.col("title_score")))
    s = s.drop(*[f"__{c}" for c in ("keyword", *fields)], *[f"__{c}_t" for c in ("keyword", *fields)])
    show = F.col("title_score") * 0.55 + F.col("artist_score") * 0.25 + F.col("album_score") * 0.12 + F.col("body_score") * 0.08 + F.col("priority") / 20
    fields = [("title_score", 4), ("artist_score", 3), ("album_score", 2), ("body_score", 1)]
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("s"), F.lit(o).alias("o"), F.lit(c[:-6]).alias("f")) for c, o in fields]))
    return s.withColumns({"display_score": F.round(show, 1), "best_field": best["f"]})


def rank_candidates(cands: DataFrame) -> DataFrame:
    """1-based rank of each candidate of a query: title tier, variant, position, source priority, then the scores.

    A query with very many candidates is ranked in blocks of (tier, variant, position).
    """
    s = score_candidates(cands).withColumns(
        {
            "__t": -F.col("tier"), "__p": -F.col("priority"), "__a": -F.col("title_score"), "__b": -F.col("artist_score"),
            "__c": -F.col("album_score"), "__d": -F.col("body_score"),
        }
    )
    order = ["__t", "variant", "position", "__p", "__a", "__b", "__c", "__d", "candidate_id"]
    block = (F.col("__t") + 4) * 2**40 + F.col("variant") * 2**32 + F.floor(F.col("position") / 4096)
    return scan(s, by=["query_id"], order=order, block=block, rank=row_index()).drop("__t", "__p", "__a", "__b", "__c", "__d")


def page_results(ranked: DataFrame, *, limit: int, page: int) -> DataFrame:
    """One page of each query's ranking with the overflow flag."""
    lo = page * limit
    w = ranked.where((F.col("rank") > lo) & (F.col("rank") <= lo + limit + 1))
    more = w.groupBy("query_id").agg((F.max("rank") > lo + limit).alias("has_more"))
    return w.where(F.col("rank") <= lo + limit).join(more, "query_id")


def best_variant(formats: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """One format per key: the largest size, the later one of equals."""
    return formats.groupBy(*key).agg(F.max(F.struct("size", "seq")).alias("b")).select(*key, F.col("b.size").alias("size"), F.col("b.seq").alias("seq"))


def best_audio(formats: DataFrame, *, by: Sequence[str], prefer: str | None = None) -> DataFrame:
    """Best audio-only format: the preferred kind when there is one, then bit rates and size."""
    liked = (F.col("ext") == prefer).cast("int") if prefer else F.lit(0)
    return formats.where("audio_only").groupBy(*by).agg(F.max(F.struct(liked.alias("l"), "abr", "tbr", "size", "seq")).alias("b")).select(
        *by, F.col("b.seq").alias("seq"), F.col("b.abr").alias("abr")
    )


def top_per_key(df: DataFrame, *, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; every task keeps at most ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def round_robin(assets: DataFrame, *, source: str, score: str, avoid: str | None = None) -> DataFrame:
    """Turn of each clip inside its source (best first) and the size of the source; order by (late, turn, -size, source)."""
    late = F.col(avoid) if avoid else F.lit(False)
    s = assets.withColumns({"late": late, "__s": -F.col(score)})
    ranked = scan(
        s, by=["late", source], order=["__s", "asset_id"], block=F.floor(F.col("__s") * 16), turn=row_index(), source_size=group_total(F.lit(1).cast("long"))
    )
    return ranked.select(*assets.columns, "late", "turn", "source_size")


def quota_interleave(assets: DataFrame, *, n: int, prefer: Sequence[str] | str = ("user", "web", "video"), by: Sequence[str] = ("track_id",)) -> DataFrame:
    """All assets of each track in a new order (place, origin_rank, pool_no): ``n`` picked by origin quota and spread, the rest behind.

    Quotas fill the preferred origins first, or (``"even"``) go by share with left-overs to the largest remainder. Picks have places
    between 0 and 1, and inside an origin the pool order is kept; the rest has place 2 and the pool order. A track with one origin,
    or no quota, keeps its pool order. Needs origin and pool_no.
    """
    by = list(by)
    counts = assets.groupBy(*by, "origin").agg(F.count("*").alias("m"), F.min("pool_no").alias("__first"))
    w = Window.partitionBy(*by)
    total = F.least(F.lit(n), F.sum("m").over(w))
    if prefer == "even":
        want = F.bround(F.lit(1.0) * total * F.col("m") / F.sum("m").over(w)).cast("long")
        c = counts.withColumns({"__n": total, "__q": F.least(want, "m")})
        rest = F.col("__n") - F.sum("__q").over(w)
        c = c.withColumn("__gap", F.row_number().over(w.orderBy((F.col("m") - F.col("__q")).desc(), "__first")))
        quota = F.col("__q") + F.when(F.col("__gap") <= rest, 1).otherwise(0)
    else:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in prefer]), F.col("origin")), F.lit(0))
        c = counts.withColumns({"__n": total, "__r": F.when(rank == 0, 99).otherwise(rank)})
        before = F.coalesce(F.sum("m").over(w.orderBy("__r", "origin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        quota = F.greatest(F.least(F.col("m"), F.col("__n") - before), F.lit(0))
    alone = (F.count("*").over(w) == 1) | F.lit(n <= 0)
    quotas = c.withColumn("quota", quota).select(*by, "origin", F.when(alone, F.col("m")).otherwise(F.col("quota")).alias("quota"), F.row_number().over(w.orderBy("__first")).alias("origin_rank"))
    numbered = scan(assets, by=[*by, "origin"], order=["pool_no"], block=F.floor(F.col("pool_no") / 65536), j=row_index())
    j = salted_lookup(numbered, quotas, [*by, "origin"])
    chosen = F.col("j") <= F.col("quota")
    place = F.when(F.lit(n <= 0), 2.0).when(chosen, F.round((F.col("j") - 0.5) / F.col("quota"), 6)).otherwise(2.0)
    return j.select(*assets.columns, place.alias("place"), F.when(chosen & F.lit(n > 0), F.col("origin_rank")).otherwise(0).alias("origin_rank"))


def even_sample(df: DataFrame, *, n: int, by: Sequence[str], order: str, block: Column) -> DataFrame:
    """``n`` rows at positions floor(k * m / n) of each group's m rows (all of them when m <= n)."""
    s = scan(df, by=by, order=[order], block=block, __i=row_index(), __m=group_total(F.lit(1).cast("long")))
    i, m = F.col("__i") - 1, F.col("__m")
    k = F.floor((i * n + m - 1) / m)
    return s.where((m <= n) | ((F.floor(k * m / n) == i) & (k < n))).select(*df.columns)


def keep_recent(df: DataFrame, *, by: Sequence[str], order: Sequence[Column], n: int, locked: Column) -> DataFrame:
    """The newest ``n`` unlocked rows of each kind, and every locked row."""
    fresh = top_per_key(df.where(~locked), by=by, order=order, n=n, name="__k").drop("__k")
    return df.where(locked).unionByName(fresh)


def pool_by_origin(shots: DataFrame) -> DataFrame:
    why = F.col("why")
    return shots.groupBy("origin").agg(
        F.count_if(why.isin("new", "pin")).alias("used"), F.count_if(why == "missing").alias("missing"),
        F.count_if(why == "fallback").alias("fallback"), F.count_if(why == "repeat").alias("repeats"),
    )


def credits(assets: DataFrame) -> DataFrame:
    """Distinct sources with their first asset; the time part of a link is ignored."""
    link = F.regexp_replace(F.regexp_replace("url", r"([?&])t=[^&]*&?", "$1"), r"[?&]$", "")
    return assets.groupBy(link.alias("link")).agg(F.min("asset_id").alias("first_asset"), F.count("*").alias("uses"))


def duration_mismatch(a: DataFrame, z: DataFrame, *, limit_ms: int) -> DataFrame:
    d = F.abs(F.col("duration_a") - F.col("duration_b"))
    return a.join(z, "track_id").where(d > limit_ms).select("track_id", d.alias("difference_ms"))


# ------------------------------------------------------------------ sets
def union_sources(*frames: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    from verseline.operators.catalogue import first_of

    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return first_of(out, list(key), list(order))


def exclude_ids(pool: DataFrame, *removed: DataFrame, key: str = "asset_id") -> DataFrame:
    for r in removed:
        pool = pool.join(r.select(key), key, "left_anti")
    return pool


def version_signatures(versions: DataFrame) -> DataFrame:
    """Structure and content signature of each version row (text with its stamps stripped / whole)."""
    from verseline.functions.timetext import ANY_STAMP

    return versions.select(
        "doc_id", F.sha2(F.regexp_replace("content", ANY_STAMP, ""), 256).alias("structure"), F.sha2("content", 256).alias("content_sig")
    )


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``same``, ``timing`` (only stamps changed), ``text``, ``added`` or ``removed``."""
    o = version_signatures(old).select("doc_id", F.col("structure").alias("os"), F.col("content_sig").alias("oc"))
    n = version_signatures(new).select("doc_id", F.col("structure").alias("ns"), F.col("content_sig").alias("nc"))
    kind = (
        F.when(F.col("os").isNull(), "added").when(F.col("ns").isNull(), "removed").when(F.col("oc") == F.col("nc"), "same")
        .when(F.col("os") == F.col("ns"), "timing").otherwise("text")
    )
    return o.join(n, "doc_id", "full").select("doc_id", kind.alias("change"))


def annotation_digest(chars: DataFrame, *, lines_per_block: int = 1024) -> DataFrame:
    """Digest of a track's text, beats, pauses and readings (times left out), built as a tree: characters of a line, lines
    of a block, blocks of a track; no step holds more than one block."""
    item = F.concat_ws("/", "ch", F.col("check_count").cast("string"), F.col("release_ms").isNotNull().cast("string"), F.array_join("parts", "+"))
    glue = lambda n, v: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, v))), lambda x: x[v]), "|"), 256)
    line = chars.withColumn("__v", item).groupBy("track_id", "line_no").agg(glue("char_no", "__v").alias("__v"))
    blocks = line.groupBy("track_id", F.floor(F.col("line_no") / lines_per_block).alias("block_no")).agg(glue("line_no", "__v").alias("__v"))
    return blocks.groupBy("track_id").agg(glue("block_no", "__v").alias("digest"))


def pending_units(chars: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per track: characters without a reading, characters without a model token, and whether the plan is complete."""
    need = chars.where(F.trim("ch") != "")
    no_reading = F.size("parts") == 0
    missing = need.join(tokens.select("track_id", "line_no", "char_no", F.lit(True).alias("__t")), ["track_id", "line_no", "char_no"], "left")
    return missing.groupBy("track_id").agg(
        F.count_if(no_reading).alias("no_reading"), F.count_if(F.col("__t").isNull()).alias("no_token"), (F.count_if(no_reading | F.col("__t").isNull()) == 0).alias("complete")
    )


# ------------------------------------------------------------------ shot planning
def energy_sections(blocks: DataFrame) -> DataFrame:
    """Verse blocks whose mean energy is at or above the 70th of 100 ranks become choruses (needs kind and energy)."""
    v = blocks.where((F.col("kind") == "verse") & (F.col("energy") > 0))
    counts = v.groupBy("track_id", "energy").agg(F.count("*").alias("n"))
    s = scan(counts, by=["track_id"], order=["energy"], block=F.floor(F.col("energy") / 16), cum=running_sum(F.col("n")), total=group_total(F.col("n")))
    at = F.greatest(F.lit(0), F.floor(F.col("total") * 0.7) - F.when(F.col("total") > 1, 0).otherwise(1))
    limit = s.groupBy("track_id").agg(F.min(F.when(F.col("cum") > at, F.col("energy"))).alias("__limit"))
    j = salted_lookup(blocks, limit, ["track_id"], how="left")
    up = (F.col("kind") == "verse") & (F.col("energy") > 0) & (F.col("energy") >= F.col("__limit"))
    return j.select(*[F.when(up, "chorus").otherwise(F.col("kind")).alias("kind") if c == "kind" else F.col(c) for c in blocks.columns])


def plan_cuts(bars: DataFrame, *, every: int = 2) -> DataFrame:
    """Shot starts on a bar grid: forced bars always, otherwise every k-th bar since the last forced one.

    ``bars``: track_id, bar_no, t_ms, forced, energy, pace. k = ``every`` x (half when loud, twice when quiet) x pace.
    """
    from verseline.operators.ordered import running_max

    s = scan(bars, by=["track_id"], order=["bar_no"], block=F.floor(F.col("bar_no") / 4096), __from=running_max(F.when(F.col("forced") | (F.col("bar_no") == 0), F.col("bar_no"))))
    k = F.greatest(F.lit(1), F.floor(F.lit(every) * F.when(F.col("energy") > 0.72, 0.5).when(F.col("energy") < 0.28, 2.0).otherwise(1.0) * F.col("pace") + 0.5))
    since = F.col("bar_no") - F.col("__from")
    return s.where((since == 0) | (F.pmod(since, k) == 0)).select("track_id", "bar_no", "t_ms", "forced")


def assign_assets(shots: DataFrame, assets: DataFrame, pins: DataFrame) -> DataFrame:
    """Asset of every shot: a pin wins; the other shots take the pool in order, and wrap around when it is used up.

    ``shots``: track_id, shot_no; ``assets``: track_id, asset_id, place (pool order); ``pins``: track_id, shot_no, pinned.
    """
    pool = assets.join(pins.select("track_id", F.col("pinned").alias("asset_id")), ["track_id", "asset_id"], "left_anti")
    pool = scan(pool, by=["track_id"], order=["place", "asset_id"], block=F.floor(F.col("place") * 1024), slot=row_index(), size=group_total(F.lit(1).cast("long")))
    j = shots.join(pins, ["track_id", "shot_no"], "left")
    free = scan(
        j, by=["track_id"], order=["shot_no"], block=F.floor(F.col("shot_no") / 65536), nth=running_sum(F.when(F.col("pinned").isNull(), 1).otherwise(0).cast("long"))
    )
    sizes = pool.groupBy("track_id").agg(F.max("size").alias("__size"))
    free = salted_lookup(free, sizes, ["track_id"], how="left")
    free = free.withColumn("slot", F.when(F.col("pinned").isNull(), F.pmod(F.col("nth") - 1, F.col("__size")) + 1))
    taken = free.join(pool.select("track_id", "slot", F.col("asset_id").alias("__asset")), ["track_id", "slot"], "left")
    why = F.when(F.col("pinned").isNotNull(), "pin").when(F.col("__asset").isNull(), "missing").when(F.col("nth") > F.col("__size"), "fallback").otherwise("new")
    return taken.select("track_id", "shot_no", F.coalesce("pinned", "__asset").alias("asset_id"), why.alias("why"))
