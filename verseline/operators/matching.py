"""Similarity and alignment joins between texts, and offsets between two timings of one song."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.functions.bits import hamming
from verseline.functions.similarity import char_ngrams
from verseline.operators.alignment import text_groups, whole_groups
from verseline.operators.chains import best_chain, small_chain
from verseline.operators.intervals import asof_join, interval_join
from verseline.operators.ordered import following_row, islands_after, multiplied, previous_row, running_max, salted_lookup, scan
from verseline.operators.stats import exact_percentiles


# ------------------------------------------------------------------ near-identical pictures
def near_duplicates(assets: DataFrame, *, max_bits: int = 6, bands: int = 9, bits: int = 64) -> DataFrame:
    """Ids of pictures that have an earlier picture (lower ``asset_id``) within ``max_bits`` of their ``ahash``.

    Equal hashes are first reduced to their earliest picture. For the rest, a hash cut into ``bands`` pieces agrees with
    any hash within ``max_bits`` on at least ``bands - max_bits`` of them, so equal combinations of that many pieces find
    every partner. The semi join stops at the first earlier partner and never writes pairs.
    """
    if bands <= max_bits:
        raise ValueError("bands must exceed max_bits")
    first = assets.groupBy("ahash").agg(F.min("asset_id").alias("first_id"))
    copies = assets.join(first, "ahash").where(F.col("asset_id") > F.col("first_id")).select("asset_id")
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    piece = lambda i: F.shiftright("ahash", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))
    picks = list(combinations(range(bands), bands - max_bits))
    choice = F.expr("array(" + ", ".join("array(" + ", ".join(map(str, c)) + ")" for c in picks) + ")")
    pieces = first.withColumn("__pieces", F.array(*[piece(i) for i in range(bands)]))
    keyed = pieces.select("ahash", "first_id", "__pieces", F.posexplode(choice).alias("n", "__c")).select(
        "ahash", "first_id", "n", F.transform("__c", lambda i: F.get("__pieces", i)).alias("key")
    )
    older = keyed.select(F.col("ahash").alias("h2"), F.col("first_id").alias("id2"), F.col("n").alias("n2"), F.col("key").alias("key2"))
    near = keyed.join(
        multiplied(older),
        (F.col("n") == F.col("n2")) & (F.col("key") == F.col("key2")) & (F.col("id2") < F.col("first_id")) & (hamming(F.col("ahash"), F.col("h2")) <= max_bits),
        "left_semi",
    )
    return copies.union(near.select("first_id").distinct())


# ------------------------------------------------------------------ n-gram joins
def ngram_join(
    left: DataFrame, right: DataFrame, *, left_id: Sequence[str], right_id: Sequence[str], by: Sequence[str] = (), n: int = 3, min_score: float, measure: str = "share"
) -> DataFrame:
    """Pairs of texts whose shared n-grams reach ``min_score``: ``share`` of the left text's grams, or ``dice`` of both.

    Both sides: ids, ``by`` and ``text``. Exact: a pair that qualifies must share most of the left text's rarest grams
    (all but the number it can afford to miss), so only those are joined and frequent grams hardly ever are. The
    candidates are then scored on whole gram sets.
    """
    by, left_id, right_id = list(by), list(left_id), list(right_id)
    grams = char_ngrams(F.col("text"), n)
    rrows = right.select(*by, *right_id, F.explode(grams).alias("gram"))
    freq = rrows.groupBy(*by, "gram").agg(F.count("*").alias("df"))
    lg = left.select(*by, *left_id, grams.alias("lg")).select(*by, *left_id, F.size("lg").alias("nl"), F.explode("lg").alias("gram"))
    rare = Window.partitionBy(*by, *left_id).orderBy(F.coalesce("df", F.lit(0)), "gram")
    need = F.lit(min_score) if measure == "share" else F.lit(min_score / (2 - min_score))
    # a qualifying pair misses at most ``spare`` of the left grams, so of any ``looked`` grams it shares all but that many
    spare = F.col("nl") - F.ceil(F.round(need * F.col("nl"), 9))
    looked = F.least(F.col("nl"), 2 * spare + 3)
    probes = lg.join(freq, [*by, "gram"], "left").withColumns({"__r": F.row_number().over(rare), "__least": looked - spare})
    probes = probes.where((F.col("__r") <= looked) & F.col("df").isNotNull()).select(*by, *left_id, "gram", "__least")
    hits = probes.join(rrows, [*by, "gram"]).groupBy(*by, *left_id, *right_id).agg(F.count("*").alias("__n"), F.first("__least").alias("__least"))
    pairs = hits.where(F.col("__n") >= F.col("__least")).select(*by, *left_id, *right_id)
    # whole gram sets of the candidates, counted one gram per row
    shared = pairs.join(lg, [*by, *left_id]).join(rrows, [*by, *right_id, "gram"]).groupBy(*by, *left_id, *right_id, "nl").agg(F.count("*").cast("int").alias("shared"))
    if measure == "share":
        scored = shared.withColumn("score", F.col("shared") / F.col("nl"))
    else:
        sizes = rrows.groupBy(*by, *right_id).agg(F.count("*").alias("nr"))
        scored = shared.join(sizes, [*by, *right_id]).withColumn("score", 2 * F.col("shared") / (F.col("nl") + F.col("nr")))
    return scored.select(*by, *left_id, *right_id, "shared", "score").where(F.round("score", 9) >= min_score)


def best_hits(pairs: DataFrame, *, line: Sequence[str], order: str, top: int) -> DataFrame:
    w = Window.partitionBy(*line).orderBy(F.col("score").desc(), F.col(order))
    return pairs.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= top)


def gram_search(left: DataFrame, right: DataFrame, *, left_id: Sequence[str], right_id: str, n: int = 3, min_score: float, top: int, most_letters: int = 8_000_000) -> DataFrame:
    """(left_id, right_id, shared, score, hit): for every left text the ``top`` right texts that hold the largest share of its n-grams, at least
    ``min_score``; ties go to the smaller ``right_id`` (a long).

    The left texts are a query set: up to ``most_letters`` letters of different texts (counted first) they go to every task, and each right
    text is looked at once, where it lies; a task keeps the best ``top`` of every query only. A larger left side takes the n-gram join.
    """
    import numpy as np
    import pyarrow as pa

    left_id, n_top = list(left_id), top
    if not 1 <= n <= 3:
        raise ValueError("three letters fit a key")
    texts = left.where("text <> ''").select("text").distinct()
    if (texts.agg(F.sum(F.length("text"))).first()[0] or 0) > most_letters:
        return best_hits(ngram_join(left.where("text <> ''"), right, left_id=left_id, right_id=[right_id], n=n, min_score=min_score), line=left_id, order=right_id, top=top)
    queries = sorted(r["text"] for r in texts.collect())

    def keys(text: str) -> np.ndarray:
        """Distinct n-grams as numbers, 21 bits a letter; a shorter text is one gram."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        if len(c) < n:
            c = np.concatenate([c, np.zeros(n - len(c), dtype=np.int64)])
        out = c[: len(c) - n + 1].copy()
        for k in range(1, n):
            out = (out << 21) | c[k : len(c) - n + 1 + k]
        return np.unique(out)

    own = [keys(t) for t in queries]
    sizes = np.array([len(k) for k in own], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if own else sizes
    grams, flat = np.unique(np.concatenate(own), return_inverse=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def best(found):
        q, d, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < n_top
        return q[keep], d[keep], s[keep]

    def run(parts):
        found, held = [], 0
        for b in parts:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or not len(grams):
                    continue
                mine = keys(text)
                at = np.minimum(np.searchsorted(mine, grams), len(mine) - 1)
                shared = np.add.reduceat((mine[at] == grams)[flat], starts, dtype=np.int64)
                q = np.nonzero(np.round(shared / sizes, 9) >= min_score)[0]
                found.append((q, np.full(len(q), name, dtype=np.int64), shared[q]))
                held += len(q)
                if held > 500_000:
                    found = [best(found)]
                    held = len(found[0][0])
        if found:
            q, d, s = best(found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int32())], ["__q", right_id, "shared"])

    hits = right.select(F.col(right_id).cast("long").alias(right_id), "text").mapInArrow(run, f"__q int, `{right_id}` long, shared int")
    rank = Window.partitionBy("__q").orderBy(F.col("shared").desc(), F.col(right_id))
    hits = hits.withColumn("hit", F.row_number().over(rank)).where(F.col("hit") <= top)
    names = left.sparkSession.createDataFrame([(i, t, int(k)) for i, (t, k) in enumerate(zip(queries, sizes))], "__q int, text string, __n int")
    named = left.select(*left_id, "text").join(names, "text").select(*left_id, "__q", "__n")
    return named.join(hits, "__q").select(*left_id, right_id, "shared", (F.col("shared") / F.col("__n")).alias("score"), "hit")


def ordered_hits(pairs: DataFrame, *, by: Sequence[str], line: str, at: str) -> DataFrame:
    """The pairs of each group's heaviest chain: every line at most once, along the lines at ever higher places (``at``).

    Scores count by millionths, so that sums are exact.
    """
    hits = pairs.select(*by, F.col(line).alias("line"), F.col(at).alias("start"), F.col(at).alias("end"), F.floor(F.col("score") * 1_000_000 + 0.5).alias("weight"))
    chain = best_chain(hits, by=by).select(*by, F.col("line").alias(line), F.col("start").alias(at))
    return pairs.join(chain, [*by, line, at])


def _line_grams(texts: list[str], n: int):
    """Distinct (line, n-gram) pairs of texts as numbers, line by line, and the bits of a gram; shorter texts are one gram."""
    import numpy as np

    codes = np.frombuffer("".join(t.ljust(n, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    real, sizes = (np.fromiter(x, dtype=np.int64, count=len(texts)) for x in (map(len, texts), (max(len(t), n) for t in texts)))
    starts = np.cumsum(sizes) - sizes
    line = np.repeat(np.arange(len(texts)), sizes)
    own = np.zeros(0x110000, dtype=np.int64)
    own[np.unique(codes)] = 1
    letter = np.cumsum(own)[codes]  # from 1 on
    letter[np.arange(len(codes)) - starts[line] >= real[line]] = 0  # filling
    bits = max(1, int(own.sum()).bit_length())
    at = np.nonzero(np.arange(len(codes)) - starts[line] <= sizes[line] - n)[0]
    gram = np.zeros(len(at), dtype=np.int64)
    for k in range(n):
        gram = (gram << bits) | letter[at + k]
    if n * bits + len(texts).bit_length() > 62:
        gram = np.unique(gram, return_inverse=True)[1].astype(np.int64)
        bits = len(gram).bit_length()
    else:
        bits *= n
    pairs = np.unique((line[at] << bits) | gram)
    return pairs >> bits, pairs & ((1 << bits) - 1), bits


def _dice_pairs(left: list[str], left_group, right: list[str], right_group, n: int, min_score: float, most: int = 1 << 22):
    """(left, right, score) of the lines of one group that reach ``min_score``, the group of each line given in ascending order."""
    import numpy as np

    line, gram, _ = _line_grams([*left, *right], n)
    group = np.concatenate([left_group, right_group])
    size = np.bincount(line, minlength=len(group))
    _, gram = np.unique(gram, return_inverse=True)
    key = group[line] * (int(gram.max(initial=0)) + 1) + gram
    cut = int(np.searchsorted(line, len(left)))
    order = np.argsort(key[cut:], kind="stable")
    keys, owner = key[cut:][order], line[cut:][order] - len(left)
    first = np.searchsorted(keys, key[:cut])
    count = np.searchsorted(keys, key[:cut], side="right") - first
    # places for every pair of a left line with the right lines of its group
    r0 = np.searchsorted(right_group, left_group)
    width = np.searchsorted(right_group, left_group, side="right") - r0
    base = np.append(0, np.cumsum(width))
    work = np.append(0, np.cumsum(np.bincount(line[:cut], weights=count, minlength=len(left)).astype(np.int64) + width))
    line_at = np.searchsorted(line[:cut], np.arange(len(left) + 1))
    lo, out = 0, []
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + most, side="right")) - 1)
        a, z = line_at[lo], line_at[hi]
        c = count[a:z]
        met = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[a:z], c)
        mine = np.repeat(line[a:z], c)
        shared = np.bincount(base[mine] - base[lo] + owner[met] - r0[mine], minlength=1)
        at = np.nonzero(shared)[0]
        one = np.searchsorted(base[lo : hi + 1], at + base[lo], side="right") - 1 + lo
        other = at + base[lo] - base[one] + r0[one]
        score = 2 * shared[at] / (size[one] + size[other + len(left)])
        good = np.round(score, 9) >= min_score
        out.append((one[good], other[good], score[good]))
        lo = hi
    return (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def map_lines(lines: DataFrame, reference: DataFrame, *, by: Sequence[str], min_score: float, n: int = 3, most_lines: int = 2000) -> DataFrame:
    """(by, line_no, ref_no, score): ``ordered_hits`` of the lines' pairs whose n-grams reach ``min_score`` (dice).

    Both sides: by, line_no (a long), text; empty texts are left out. Groups of up to ``most_lines`` lines a side (and ``alignment.MOST`` letters) are
    shuffled as text and settled in one task each, many at a time; larger ones (counted first) go through ``ngram_join`` and ``ordered_hits``.
    """
    import numpy as np
    import pyarrow as pa

    by = list(by)
    lines, reference = lines.where("text <> ''"), reference.where("text <> ''")
    both, large = text_groups(lines, reference, by, most_lines=most_lines)

    def run(parts):
        for rows, group in whole_groups(parts, by):
            side, no, texts = rows.column("__side").to_numpy(), rows.column("line_no").to_numpy(), rows.column("text").to_pylist()
            a, z = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            one, other, score = _dice_pairs([texts[i] for i in a.tolist()], group[a], [texts[i] for i in z.tolist()], group[z], n, min_score)
            weight = np.floor(score * 1_000_000 + 0.5).astype(np.int64)
            line, at, of = no[a[one]], no[z[other]], group[a[one]]
            got = []
            edges = np.nonzero(np.append(True, of[1:] != of[:-1]))[0].tolist() if len(of) else []
            for lo, hi in zip(edges, [*edges[1:], len(of)]):
                place = {(x, y): i for i, (x, y) in enumerate(zip(line[lo:hi].tolist(), at[lo:hi].tolist()), lo)}
                got += [place[x] for x in small_chain(zip(line[lo:hi].tolist(), at[lo:hi].tolist(), weight[lo:hi].tolist()))]
            got = np.array(got, dtype=np.int64)
            named = {c: rows.column(c).take(pa.array(a[one[got]])) for c in by}
            yield from pa.table({**named, "line_no": pa.array(line[got]), "ref_no": pa.array(at[got]), "score": pa.array(score[got])}).to_batches()

    kind = dict(lines.dtypes)
    out = both.mapInArrow(run, "".join(f"`{c}` {kind[c]}, " for c in by) + "line_no long, ref_no long, score double")
    if large is None:
        return out
    rest, ref = lines.join(large, by, "left_semi"), reference.join(large, by, "left_semi").withColumnRenamed("line_no", "ref_no")
    pairs = ngram_join(rest, ref, left_id=["line_no"], right_id=["ref_no"], by=by, n=n, min_score=min_score, measure="dice")
    return out.unionByName(ordered_hits(pairs, by=by, line="line_no", at="ref_no").select(*by, "line_no", "ref_no", "score"))


# ------------------------------------------------------------------ offsets between timings
def word_offset(words: DataFrame, heard: DataFrame, *, max_shift_ms: int = 60_000, bin_ms: int = 100, refine_ms: int = 300) -> DataFrame:
    """Offset of a recording: the fullest bin (neighbours at half) of all differences between equal words, then the median
    of the differences near it. ``agree`` is the share of words with a difference near the result.

    Equal words are counted per millisecond before they meet, and meet only inside ``max_shift_ms``.
    """
    side = lambda df, t, n: df.groupBy("track_id", "word", F.col("start_ms").alias(t)).agg(F.count("*").alias(n))
    a, z = side(words, "ta", "na"), side(heard, "tb", "nb")
    cell = lambda c: F.floor(F.col(c) / max_shift_ms)
    wide = a.withColumn("cell", F.explode(F.array(cell("ta") - 1, cell("ta"), cell("ta") + 1)))
    z = z.withColumn("cell", cell("tb"))
    d = (
        multiplied(wide).join(z, ["track_id", "word", "cell"])
        .withColumns({"d": F.col("tb") - F.col("ta"), "n": F.col("na") * F.col("nb")})
        .where(F.abs("d") < max_shift_ms)
        .groupBy("track_id", "d")
        .agg(F.sum("n").alias("n"))
    )
    bins = d.groupBy("track_id", F.floor(F.col("d") / bin_ms + 0.5).alias("b")).agg(F.sum("n").alias("n"))
    spread = bins.select("track_id", F.explode(F.array(*[F.struct((F.col("b") + k).alias("b"), (F.col("n") * w).alias("s")) for k, w in ((-1, 0.5), (0, 1.0), (1, 0.5))])).alias("x"))
    score = spread.groupBy("track_id", "x.b").agg(F.sum("x.s").alias("s"))
    mode = score.groupBy("track_id").agg(F.max(F.struct("s", (-F.abs("b")).alias("near"), "b")).alias("m")).select("track_id", (F.col("m.b") * bin_ms).alias("mode"))
    close = d.join(mode, "track_id").where(F.abs(F.col("d") - F.col("mode")) <= refine_ms)
    med = _weighted_median(close)
    near_mode = salted_lookup(multiplied(a), mode, ["track_id"])
    hit = near_mode.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(F.lit(-refine_ms), F.lit(0), F.lit(refine_ms)), lambda k: F.floor((F.col("ta") + F.col("mode") + k) / max_shift_ms)))))
    agreed = multiplied(hit).join(z, ["track_id", "word", "cell"]).where(F.abs(F.col("tb") - F.col("ta") - F.col("mode")) <= refine_ms).select("track_id", "word", "ta", "na").distinct()
    share = agreed.groupBy("track_id").agg(F.sum("na").alias("hits"))
    total = words.groupBy("track_id").agg(F.count("*").alias("words"))
    return med.join(share, "track_id", "left").join(total, "track_id").select("track_id", "offset_ms", F.round(F.coalesce("hits", F.lit(0)) / F.col("words"), 4).alias("agree"))


def _weighted_median(d: DataFrame) -> DataFrame:
    """Median of ``d`` with counts ``n`` per track; the values lie in one narrow window, so they are few."""
    w = Window.partitionBy("track_id").orderBy("d")
    s = d.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("track_id"))})
    lo, hi = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    g = s.groupBy("track_id").agg(F.min(F.when(F.col("cum") > lo, F.col("d"))).alias("a"), F.min(F.when(F.col("cum") > hi, F.col("d"))).alias("z"))
    return g.select("track_id", ((F.col("a") + F.col("z")) / 2).alias("offset_ms"))


def warp_times(points: DataFrame, knots: DataFrame, *, tol_ms: int = 200, min_words: int = 8, min_agree: float = 0.4) -> DataFrame:
    """Move times along knots (src_ms -> dst_ms) of a second timing.

    The constant offset is the median of dst - src; knots further than ``tol_ms`` from it move to the second timing,
    the rest stay; times between knots follow piecewise linearly. A track with too few or too few agreeing knots is
    left alone. A knot whose target is not past all earlier ones by 30 ms is ignored.
    """
    k = knots.withColumn("__d", (F.col("dst_ms") - F.col("src_ms")).cast("double"))
    off = exact_percentiles(k, by=["track_id"], value="__d", off=0.5)
    k = salted_lookup(k, off, ["track_id"])
    agree = k.groupBy("track_id").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("__d") - F.col("off")) <= tol_ms).cast("double")).alias("agree"))
    usable = agree.where((F.col("n") >= min_words) & (F.col("agree") >= min_agree)).select("track_id")
    target = F.when(F.abs(F.col("__d") - F.col("off")) > tol_ms, F.floor(F.col("dst_ms") - F.col("off"))).otherwise(F.col("src_ms"))
    k = k.select("track_id", "src_ms", target.cast("long").alias("to_ms")).join(usable, "track_id", "left_semi")
    k = scan(k, by=["track_id"], order=["src_ms", "to_ms"], block=F.floor(F.col("src_ms") / 60000), wide=True, __hi=running_max(F.col("to_ms"), inclusive=False))
    k = k.where(F.col("__hi").isNull() | (F.col("to_ms") > F.col("__hi") + 30)).select("track_id", "src_ms", "to_ms")
    k = k.select("track_id", "src_ms", F.col("src_ms").alias("k"), F.col("to_ms").alias("v"))
    j = asof_join(points, k, by=["track_id"], left_t="t_ms", right_t="src_ms", payload=["k", "v"], direction="both", wide=True)
    t = F.col("t_ms")
    inside = F.col("v") + F.floor((t - F.col("k")) * (F.col("next_v") - F.col("v")) / (F.col("next_k") - F.col("k")))
    new = (
        F.when(F.col("k").isNull(), t + F.coalesce(F.col("next_v") - F.col("next_k"), F.lit(0)))
        .when(F.col("next_k").isNull(), t + F.col("v") - F.col("k"))
        .otherwise(inside)
    )
    return j.select(*points.columns, F.greatest(new, F.lit(0)).cast("long").alias("warped_ms"))


def fuse_estimates(matches: DataFrame, durations: DataFrame, *, jump_ms: int = 3000) -> DataFrame:
    """Time of each line from recognition and from a timed reference.

    ``matches``: track_id, line_no, start_ms (recognised, null = none), score, ref_ms (null = unmapped), sim. Lines good in
    both are anchors; anchors fall into pieces where the offset jumps from one anchor to the next; single anchors
    between two agreeing pieces are dropped; mapped lines are predicted from the piece around them, else the nearest.
    Recognition wins unless it is more than 4 s off the prediction.
    """
    good = F.col("start_ms").isNotNull() & (F.col("score") >= 0.5)
    anchors = matches.where(good & F.col("ref_ms").isNotNull() & (F.col("sim") >= 0.8)).select("track_id", "line_no", "ref_ms", (F.col("start_ms") - F.col("ref_ms")).cast("double").alias("off"))
    block = F.floor(F.col("line_no") / 65536)
    pieces = islands_after(anchors, by=["track_id"], order=["line_no"], block=block, cols=["off"], starts=lambda p, c: F.abs(c["off"] - p["off"]) > jump_ms, name="piece")
    info = pieces.groupBy("track_id", "piece").agg(F.min("ref_ms").alias("lo"), F.max("ref_ms").alias("hi"), F.count("*").alias("n"))
    info = info.join(exact_percentiles(pieces, by=["track_id", "piece"], value="off", med=0.5), ["track_id", "piece"])
    near = scan(info, by=["track_id"], order=["piece"], block=F.floor(F.col("piece") / 4096), p=previous_row("med"), q=following_row("med"))
    lonely = (F.col("n") == 1) & F.col("p").isNotNull() & F.col("q").isNotNull() & (F.abs(F.col("p.med") - F.col("q.med")) <= jump_ms)
    info = near.where(~F.coalesce(lonely, F.lit(False))).select("track_id", "piece", "lo", "hi", "med")
    mapped = matches.where(F.col("ref_ms").isNotNull()).select("track_id", "line_no", "ref_ms")
    inside = interval_join(mapped, info.select("track_id", F.col("lo") - 500, F.col("hi") + 500, "piece", F.col("med").alias("in_med")).toDF("track_id", "__a", "__z", "piece", "in_med"), by=["track_id"], t="ref_ms", start="__a", end="__z", closed="both")
    inside = inside.groupBy("track_id", "line_no").agg(F.min_by("in_med", "piece").alias("in_med"))
    ends = info.select("track_id", "piece", "med", F.explode(F.array("lo", "hi")).alias("edge")).select("track_id", "edge", F.col("med").alias("edge_med"), "piece")
    by_edge = asof_join(mapped, ends, by=["track_id"], left_t="ref_ms", right_t="edge", payload=["edge_med"], direction="nearest", tie="piece")
    j = matches.join(inside, ["track_id", "line_no"], "left").join(by_edge.select("track_id", "line_no", "edge_med"), ["track_id", "line_no"], "left")
    j = j.join(durations, "track_id")
    pred = F.floor(F.col("ref_ms") + F.coalesce("in_med", "edge_med") + 0.5)
    asr = F.when(good, F.col("start_ms"))
    use = pred.isNotNull() & (asr.isNull() | (F.abs(asr - pred) > 4000)) & pred.between(F.lit(0), F.col("duration_ms"))
    return j.select("track_id", "line_no", F.when(use, pred).otherwise(asr).alias("est_ms"), F.when(use, "lrc").when(asr.isNotNull(), "asr").alias("source"))


def place_words(words: DataFrame, heard: DataFrame, *, gap_ms: int = 50) -> DataFrame:
    """Start of every lyric word of a line: the k-th same word heard in that line, the rest between their neighbours, in order.

    Both: track_id, seg_no, word_no, word; ``heard`` with start_ms. Everything happens inside one line.
    """
    key = ["track_id", "seg_no"]
    w = Window.partitionBy(*key, "__w").orderBy("word_no")
    tag = lambda df: df.withColumn("__w", F.lower("word")).withColumn("__k", F.row_number().over(w))
    j = tag(words).join(tag(heard).select(*key, "__w", "__k", F.col("start_ms").alias("__t")), [*key, "__w", "__k"], "left")
    fwd = Window.partitionBy(*key).orderBy("word_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bwd = Window.partitionBy(*key).orderBy(F.col("word_no").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("__t").isNotNull(), F.struct(F.col("__t").alias("t"), F.col("word_no").alias("i")))
    j = j.withColumns({"__p": F.last(known, True).over(fwd), "__n": F.last(known, True).over(bwd)})
    p, n, i = F.col("__p"), F.col("__n"), F.col("word_no")
    mid = p["t"] + F.floor((n["t"] - p["t"]) * (i - p["i"]) / (n["i"] - p["i"]))
    guess = F.when(p.isNull(), n["t"] - (n["i"] - i) * gap_ms).when(n.isNull(), p["t"] + (i - p["i"]) * gap_ms).otherwise(mid)
    j = j.withColumn("__s", F.coalesce("__t", guess))
    ordered = F.max(F.col("__s") - i * gap_ms).over(fwd) + i * gap_ms
    return j.withColumn("placed_ms", ordered).select(*words.columns, F.col("__t").isNotNull().alias("matched"), "placed_ms")


# ------------------------------------------------------------------ dictionary over text
def dictionary_hits(lines: DataFrame, words: DataFrame, *, lengths: Sequence[int]) -> DataFrame:
    """Every place where a dictionary word stands in a line: (line ids, first, last, word, reading, rank).

    ``lengths``: the word lengths the dictionary holds. All substrings of those lengths meet the words in one equi join.
    """
    keep = [c for c in lines.columns if c != "text"]
    subs = None
    for n in lengths:
        grams = lines.where(F.length("text") >= n).select(*keep, F.posexplode(_sliding(F.col("text"), n)).alias("first", "word"))
        subs = grams if subs is None else subs.unionByName(grams)
    j = subs.join(words, "word")
    return j.select(*keep, F.col("first").cast("long").alias("first"), (F.col("first") + F.length("word") - 1).cast("long").alias("last"), "word", "reading", "rank")


def _sliding(text: Column, n: int) -> Column:
    """All substrings of length n in order: a look-ahead capture at every position."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def greedy_cover(hits: DataFrame, *, line: Sequence[str]) -> DataFrame:
    """Longest words first, then by rank and place, skipping any that touches an accepted one. One line of text per group."""
    rest = [c for c in hits.columns if c not in (*line, "first", "last", "rank")]
    one = F.struct((F.col("first") - F.col("last")).alias("__n"), "rank", "first", "last", *rest)
    own = hits.groupBy(*line).agg(F.array_sort(F.collect_list(one)).alias("__h"))
    touches = lambda x: lambda t: (t["first"] <= x["last"]) & (t["last"] >= x["first"])
    taken = F.aggregate("__h", F.slice("__h", 1, 0), lambda t, x: F.when(F.exists(t, touches(x)), t).otherwise(F.concat(t, F.array(x))))
    return own.select(*line, F.explode(taken).alias("__x")).select(*[F.col(c) if c in line else F.col(f"__x.{c}").alias(c) for c in hits.columns])


# ------------------------------------------------------------------ reading spans
def active_spans_for_line(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Reading spans that hold for a line: owned by it, global (0, 0), or overlapping its time, and the base stands in its text.

    ``lines``: track_id, line_no, text, start_ms, end_ms. ``spans``: track_id, span_no, base, reading, from_ms, to_ms, owner.
    """
    owned = lines.join(spans.where(F.col("owner").isNotNull()), (lines.track_id == spans.track_id) & (F.col("owner") == F.col("line_no"))).drop(spans.track_id)
    free = spans.where(F.col("owner").isNull())
    everywhere = lines.join(free.where((F.col("from_ms") == 0) & (F.col("to_ms") == 0)), "track_id")
    from verseline.operators.intervals import overlap_join

    timed = overlap_join(
        lines, free.where((F.col("from_ms") != 0) | (F.col("to_ms") != 0)), by=["track_id"], left_span=("start_ms", "end_ms"), right_span=("from_ms", "to_ms"), bucket=16_000
    )
    cols = ["track_id", "line_no", "span_no", "reading"]
    texts = [x.where(F.contains("text", F.col("base"))).select(*cols) for x in (owned, everywhere, timed)]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])
