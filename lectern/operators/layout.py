"""Reading order of word boxes: orderings, lines, gaps, and how well an order keeps the true one."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boxes(display: DataFrame, per_line: int = 6, lines: int = 20, columns: int = 2) -> DataFrame:
    """page_id, seq, text, x0, y0, x1, y1 of display tokens set in columns of lines; seq is the true order within the page."""
    size = per_line * lines * columns
    i = F.col("disp_idx") % size
    line, column = F.floor(i / per_line) % lines, F.floor(i / (per_line * lines))
    x0 = column * 320.0 + (i % per_line) * 50.0
    y0 = line * 14.0 + (F.col("disp_idx") * 7 % 3)
    page = F.concat_ws("-", F.col("clip_id").cast("string"), F.floor(F.col("disp_idx") / size).cast("string"))
    return display.select(page.alias("page_id"), i.cast("int").alias("seq"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("text") * 5.0, F.lit(46.0))).alias("x1"), (y0 + 10.0).alias("y1"))


def band_order(rows: DataFrame) -> DataFrame:
    """rows with place: by bands of 0.6 of the page's median height (1 at least), then from left to right."""
    # The median by a window, not by a join: the rows are made once and shuffled once.
    mid = F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("band", F.greatest(mid * 0.6, F.lit(1.0)))
    b = F.bround((F.col("y0") + F.col("y1")) / 2 / F.col("band"))
    w = Window.partitionBy("page_id").orderBy("b", "x0", "seq")
    return rows.withColumn("b", b).withColumn("place", F.row_number().over(w) - 1).drop("b", "band")


def widest_gap(rows: DataFrame, low: str, high: str) -> DataFrame:
    """page_id, at, gap: the widest stretch along an axis that no box covers, the first of equal ones."""
    reach = F.max(high).over(Window.partitionBy("page_id").orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))
    gaps = rows.withColumn("gap", F.round(F.col(low) - reach, 6)).where("gap > 0")
    return gaps.groupBy("page_id").agg(F.max_by(F.struct(F.col(low).alias("at"), "gap"), F.struct("gap", -F.col(low))).alias("x")).select("page_id", "x.*")


def emitted_lines(ordered: DataFrame, unit: float = 10.0) -> DataFrame:
    """ordered rows with line: a new one where the row changes (by 0.6 of the unit) or x doesn't advance."""
    w = Window.partitionBy("page_id").orderBy("place")
    new = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > 0.6 * unit) | (F.col("x0") <= F.lag("x0").over(w)), F.lit(True))
    return ordered.withColumn("new", new.cast("int")).withColumn("line", F.sum("new").over(w)).drop("new")


def order_confidence(ordered: DataFrame, unit: float = 10.0) -> DataFrame:
    """page_id, confidence: share of boxes outside lines whose widest gap passes 1.5 times the page's median height."""
    w = Window.partitionBy("page_id", "line").orderBy("place")
    rows = emitted_lines(ordered, unit)
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(w), F.lit(0.0))
    mid = rows.groupBy("page_id").agg(F.median(F.col("y1") - F.col("y0")).alias("mid"))
    lines = rows.withColumn("gap", gap).groupBy("page_id", "line").agg(F.max("gap").alias("gap"), F.count("*").alias("n")).join(mid, "page_id")
    wide = F.col("gap") > 1.5 * F.col("mid")
    return lines.groupBy("page_id").agg(F.round(F.sum(F.when(wide, 0).otherwise(F.col("n"))) / F.sum("n"), 6).alias("confidence"))


def adjacency(ordered: DataFrame) -> DataFrame:
    """page_id, n, adjacent_pct: neighbours in the emitted order that are neighbours in the true one."""
    w = Window.partitionBy("page_id").orderBy("place")
    next_ = F.lead("seq").over(w)
    return ordered.withColumn("ok", F.when(next_.isNotNull(), (next_ == F.col("seq") + 1).cast("int"))).groupBy("page_id").agg(F.count("*").alias("n"), F.round(100.0 * F.coalesce(F.avg("ok"), F.lit(1.0)), 4).alias("adjacent_pct"))


def _gathered(rows: DataFrame, key: str, value: str) -> DataFrame:
    """page_id and, for each page, its keys in order and their values, as arrays of those names; a page is a bounded group and travels as one row."""
    cells = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(key, value))).alias("x"))
    return cells.select("page_id", F.col(f"x.{key}").alias(key), F.col(f"x.{value}").alias(value))


def order_scores(ordered: DataFrame) -> DataFrame:
    """page_id, n, lis, inversions, concordance of each page's emitted order; a page is a bounded group."""

    @F.arrow_udf("struct<lis:bigint,inversions:bigint>")
    def score(pages: pa.Array) -> pa.Array:
        lis, inversions = [], []
        for page in pages.to_pylist():
            tails: list[int] = []
            seen: list[int] = []
            inv = 0
            for x in page:
                at = bisect_left(tails, x)
                tails[at : at + 1] = [x]
                at = bisect_right(seen, x)
                inv += len(seen) - at
                seen.insert(at, x)
            lis.append(len(tails))
            inversions.append(inv)
        return pa.StructArray.from_arrays([pa.array(lis, pa.int64()), pa.array(inversions, pa.int64())], names=["lis", "inversions"])

    n = F.size("seq").cast("long")
    scored = _gathered(ordered, "place", "seq").select("page_id", n.alias("n"), score("seq").alias("x")).select("page_id", "n", "x.*")
    share = 1 - 2 * F.col("inversions") / (F.col("n") * (F.col("n") - 1))
    return scored.withColumn("concordance", F.when(F.col("n") > 1, F.round(share, 6)).otherwise(1.0))


def nearest_assigned(rows: DataFrame) -> DataFrame:
    """rows with the assigned true index before and after each one in the emitted order."""
    w = Window.partitionBy("page_id").orderBy("place")
    before = F.last("assigned", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("assigned", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("after", after)


def furniture_runs(rows: DataFrame) -> DataFrame:
    """page_id, run, tokens, inline: consecutive furniture tokens; inline where the true indexes around them lie at most 3 apart."""
    w = Window.partitionBy("page_id").orderBy("place")
    near = nearest_assigned(rows)
    island = near.withColumn("g", F.sum((~F.col("furniture")).cast("int")).over(w)).where("furniture")
    agg = island.groupBy("page_id", F.col("g").alias("run")).agg(F.count("*").alias("tokens"), F.max("before").alias("before"), F.min("after").alias("after"))
    step = F.col("after") - F.col("before")
    return agg.select("page_id", "run", "tokens", F.coalesce((step > 0) & (step <= 3), F.lit(False)).alias("inline"))


def _matcher(most: int) -> Callable[[list[str], list[str]], Iterator[tuple[int, int, int]]]:
    """A function of a page's folds, said and meant, that gives (i, j, k): what is said at i is written like the k meant from j on."""

    def matches(said: list[str], meant: list[str]) -> Iterator[tuple[int, int, int]]:
        at: dict[str, list[int]] = {}
        for i, f in enumerate(said):
            at.setdefault(f, []).append(i)
        longest = max(map(len, at), default=0)
        for j in range(len(meant)):
            run = ""
            for k, f in enumerate(meant[j : j + most], 1):
                run += f
                if len(run) > longest:
                    break
                for i in at.get(run, ()):
                    yield i, j, k

    return matches


def _both(output: DataFrame, truth: DataFrame) -> DataFrame:
    """A row for each page of both: place and said, seq and meant, in order."""
    return _gathered(output, "place", "f").withColumnRenamed("f", "said").join(_gathered(truth, "seq", "f").withColumnRenamed("f", "meant"), "page_id")


def assign(output: DataFrame, truth: DataFrame, most: int = 8) -> DataFrame:
    """Candidates of each output token (page_id, place, f) among a page's true tokens (page_id, seq, f), order left out: equal folds, or a run of 2 to most true tokens written as one."""

    matches = _matcher(most)

    @F.arrow_udf("array<struct<place:int,seq:int,k:int>>")
    def found(place: pa.Array, said: pa.Array, seq: pa.Array, meant: pa.Array) -> pa.Array:
        out: tuple[list[int], list[int], list[int]] = [], [], []
        ends = [0]
        for p, o, s, t in zip(*(x.to_pylist() for x in (place, said, seq, meant)), strict=True):
            for i, j, k in matches(o, t):
                out[0].append(p[i])
                out[1].append(s[j])
                out[2].append(k)
            ends.append(len(out[0]))
        cells = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in out], names=["place", "seq", "k"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    return _both(output, truth).select("page_id", F.inline(found("place", "said", "seq", "meant")))


#: Weights of the neighbours on either side, by their distance.
WEIGHTS = {1: 4, 2: 2, 3: 1}


def resolved(output: DataFrame, truth: DataFrame, most: int = 8) -> DataFrame:
    """resolve() of all that assign() finds, page by page: candidates are weighed where they are found, and none travels."""

    matches, weights = _matcher(most), list(WEIGHTS.items())

    @F.arrow_udf("array<struct<place:int,seq:int>>")
    def choose(place: pa.Array, said: pa.Array, seq: pa.Array, meant: pa.Array) -> pa.Array:
        places, seqs, ends = [], [], [0]
        for p, o, s, t in zip(*(x.to_pylist() for x in (place, said, seq, meant)), strict=True):
            edge = len(weights)
            # Nothing equals what lies outside the page: its edges differ on the two sides.
            a, b = [0] * edge + o + [0] * edge, [1] * edge + t + [1] * edge
            best: dict[int, tuple[int, int | None]] = {}
            for i, j, _ in matches(o, t):
                score = sum(w * ((a[edge + i - d] == b[edge + j - d]) + (a[edge + i + d] == b[edge + j + d])) for d, w in weights)
                top = best.get(i)
                if top is None or score > top[0]:
                    best[i] = score, s[j]
                elif score == top[0]:
                    best[i] = score, None
            places += [p[i] for i in best]
            seqs += [x for _, x in best.values()]
            ends.append(len(places))
        cells = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(seqs, pa.int32())], names=["place", "seq"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)

    return _both(output, truth).select("page_id", F.inline(choose("place", "said", "seq", "meant")))


def resolve(candidates: DataFrame, output: DataFrame, truth: DataFrame) -> DataFrame:
    """page_id, place, seq: each output token's candidate with most agreement among the three neighbours on either side (weights 4, 2, 1); a tie leaves it unassigned (null)."""
    weights = WEIGHTS
    cells = lambda df, key: [F.lag("f", d).over(Window.partitionBy("page_id").orderBy(key)).alias(f"{key}_b{d}") for d in weights] + [F.lead("f", d).over(Window.partitionBy("page_id").orderBy(key)).alias(f"{key}_a{d}") for d in weights]
    o, t = output.select("page_id", "place", *cells(output, "place")), truth.select("page_id", "seq", *cells(truth, "seq"))
    score: Column = F.lit(0)
    for d, weight in weights.items():
        for side in "ba":
            score = score + F.when(F.col(f"place_{side}{d}") == F.col(f"seq_{side}{d}"), weight).otherwise(0)
    scored = candidates.join(o, ["page_id", "place"]).join(t, ["page_id", "seq"]).withColumn("score", score)
    best = F.max("score").over(Window.partitionBy("page_id", "place"))
    top = scored.withColumn("best", best).where("score = best").groupBy("page_id", "place").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    return top.select("page_id", "place", F.when(F.col("n") == 1, F.col("seq")).alias("seq"))


def unique_radius(rows: DataFrame, most: int = 4) -> DataFrame:
    """page_id, radius: the least k up to most at which all runs of 2k + 1 folds are different; null where none is."""
    # A page is a bounded group: its folds travel once, its runs are made and told apart in its row.
    pages = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "f"))), lambda x: x["f"]).alias("f"))
    edge = F.array_repeat(F.lit(""), most)
    pages = pages.select("page_id", F.size("f").alias("n"), F.concat(edge, "f", edge).alias("f"))
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice("f", i + (most - k), 2 * k + 1), "\0"))
    return pages.select("page_id", F.coalesce(*[F.when(F.size(F.array_distinct(runs(k))) == F.col("n"), k) for k in range(1, most + 1)]).alias("radius"))


def layout_fold(tokens: DataFrame) -> DataFrame:
    """Distinct tokens (text) with the layout fold: compatibility forms taken apart, marks and signs dropped, lower case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [unicodedata.normalize("NFKD", x) for x in b.text]
            yield pd.DataFrame({"text": b.text, "f": ["".join(c for c in x if not unicodedata.combining(c) and (c.isalnum() or c in "_'")).lower() for x in flat]})

    return tokens.select("text").distinct().mapInPandas(run, "text string, f string")


def tally(scores: DataFrame, bar: float) -> DataFrame:
    """Pages that pass an adjacency bar, by medium and engine with subtotals."""
    return scores.cube("medium", "engine").agg(F.count("*").alias("pages"), F.count_if(F.col("adjacent_pct") >= bar).alias("passed"), F.min("adjacent_pct").alias("low"), F.max("adjacent_pct").alias("high"))


def separability(scores: DataFrame) -> DataFrame:
    """For each engine the bands of a signal over good and bad pages; it separates where the least good one passes the most bad one."""
    of = lambda f, good: f(F.when(F.col("good") == good, F.col("signal")))
    agg = scores.groupBy("engine").agg(of(F.min, True).alias("good_min"), of(F.max, True).alias("good_max"), of(F.min, False).alias("bad_min"), of(F.max, False).alias("bad_max"))
    return agg.withColumn("separates", F.col("good_min") > F.col("bad_max"))
