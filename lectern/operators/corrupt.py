"""Corruptions of a page's token order and text, how a page scores after each, and the gate that every corruption must pass."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold

# Each corruption's expectations (metric, least, most), the verdict it must get (null: none), and whether it needs two columns.
EXPECTED = {
    "identity": ([("order", 0.999, None), ("adjacency", 0.999, None), ("recall", 0.999, None)], True, False),
    "interleave_lines": ([("order", 0.42, 0.62), ("recall", 0.98, None)], False, True),
    "column_swap": ([("order", 0.42, 0.62), ("recall", 0.98, None)], False, True),
    "reverse_all": ([("order", None, 0.10)], False, False),
    "shuffle_lines": ([("order", None, 0.45)], False, False),
    "shuffle_paragraphs": ([("order", None, 0.70)], False, False),
    "drop_column": ([("order", 0.99, None), ("recall", 0.35, 0.68)], False, True),
    "duplicate_column": ([("order", None, 0.85), ("recall", 0.98, None)], False, False),
    "char_noise": ([("order", 0.99, None), ("recall", 0.80, 0.95)], False, False),
    "swap_adjacent": ([("order", 0.97, None), ("adjacency", None, 0.97)], None, False),
    "swap_adjacent_heavy": ([("adjacency", None, 0.92)], False, False),
    "furniture_inline": ([("furniture_inline", 3, None), ("order", 0.98, None)], False, False),
    "hyphen_split": ([("recall", 0.96, 0.995), ("order", 0.98, None)], None, False),
    "hyphen_split_heavy": ([("recall", None, 0.95), ("order", 0.97, None)], False, False),
    "title_last": ([("order", 0.90, None)], None, False),
}
#: Least order, adjacency and recall of a page that passes, and least tokens for its order to count.
BARS, LEAST_N = {"order": 0.98, "adjacency": 0.95, "recall": 0.98}, 50
_LETTERS = "aeiounmrl"


def _drawn(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that follows from the seed and the parts: the same on any cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _swaps(name: str, rate: float) -> tuple[Column, Column]:
    """(whether a token changes places with the next one, how far along its stretch of tokens that would it is): of such a stretch every other token, beginning with the first."""
    w = Window.partitionBy("page_id").orderBy("seq")
    would = (F.col(name) < int(rate * (1 << 32))) & (F.col("seq") < F.col("n") - 1)
    last_no = F.max(F.when(~would, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return would, F.col("seq") - F.coalesce(last_no, F.lit(-1))


#: The corruption of each place that packed() gives: two take a token twice, for col1 again and for the second halves of split words.
SLOTS = [
    "identity", "interleave_lines", "column_swap", "reverse_all", "shuffle_lines", "shuffle_paragraphs", "drop_column", "duplicate_column", "duplicate_column", "char_noise", "swap_adjacent",
    "swap_adjacent_heavy", "furniture_inline", "title_last", "hyphen_split", "hyphen_split", "hyphen_split_heavy", "hyphen_split_heavy",
]
_NOISE, _HALVES, NAMES = SLOTS.index("char_noise"), (14, 15, 16, 17), sorted(set(SLOTS))


def packed(body: DataFrame, furniture: DataFrame) -> DataFrame:
    """page_id, seq, text, n, noise, h12, h3, places: each token with its place under the corruption of each of SLOTS (null: not there), its text with noise (null: none), and whether it is split.

    body: page_id, seq (0, 1, ... in the true order), text, block (title, col1 or col2) and line (its number on the page);
    furniture: page_id, idx, text, for pages of body. Draws follow from hashes of page and place. Places follow from counts within
    the page, so that no token is sorted once for each corruption; rows stay with their page. An array of places alone keeps the
    code that Spark makes small: of arrays of whole rows it was too long for the JVM to compile.
    """
    page = Window.partitionBy("page_id")
    w = page.orderBy("seq")
    text, seq, block = F.col("text"), F.col("seq"), F.col("block")
    rows = body.select("page_id", "seq", "text", "block", "line")
    draws = {"d_noise": (7, seq), "d_at": (8, seq), "d_letter": (9, seq), "light": (13, seq), "heavy": (17, seq), "d_line": (11, F.col("line"))}
    rows = rows.withColumns({name: _drawn(seed, F.col("page_id"), x) for name, (seed, x) in draws.items()})
    rows = rows.withColumn("n", F.count("*").over(page).cast("int"))
    i = (2 + F.col("d_at") % (F.length(text) - 2)).cast("int")
    letter = F.substr(F.lit(_LETTERS), (1 + F.col("d_letter") % len(_LETTERS)).cast("int"), F.lit(1))
    noisy = (F.length(text) > 3) & (F.col("d_noise") < int(0.10 * (1 << 32)))
    rows = rows.withColumn("noise", F.when(noisy, F.concat(F.substr(text, F.lit(1), i - 1), letter, F.substr(text, i + 1)))).drop("d_noise", "d_at", "d_letter")
    rows = rows.withColumn("li", F.dense_rank().over(Window.partitionBy("page_id", "block").orderBy("line")) - 1)
    # A paragraph ends with a line that ends in a stop or colon, unless it is the paragraph's only one.
    ends = F.last("text").over(Window.partitionBy("page_id", "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).rlike("[.:]$")
    rows = rows.withColumn("ends", ends).withColumn("ln", F.dense_rank().over(page.orderBy("line")))
    last_open = F.max(F.when(~F.col("ends"), F.col("ln"))).over(page.orderBy("line").rangeBetween(Window.unboundedPreceding, 0))
    nth = F.col("ln") - F.coalesce(last_open, F.lit(1))  # without an open line before it, the page's first line can't end a paragraph
    rows = rows.withColumn("closes", F.col("ends") & (nth % 2 == 1))
    rows = rows.withColumn("par", F.coalesce(F.max(F.when(F.col("closes"), F.col("ln"))).over(page.orderBy("line").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("rest", F.col("ln") - 1 - F.max(F.when(block == "title", F.col("ln")).otherwise(0)).over(page))
    rows = rows.withColumn("d_par", _drawn(29, F.col("page_id"), F.col("par")))
    title, two = block == "title", block == "col2"
    woven = F.when(title, -1).otherwise(2 * F.col("li") + F.when(two, 1).otherwise(0))
    for name, key in (("woven", woven), ("lines", F.col("d_line")), ("pars", F.col("d_par"))):
        rows = rows.withColumn(name, F.row_number().over(page.orderBy(key, "seq")) - 1)
    rows = rows.select("page_id", "seq", "text", "block", "n", "noise", "rest", "light", "heavy", "woven", "lines", "pars")
    for name, rate in (("light", 0.03), ("heavy", 0.12)):
        would, nth = _swaps(name, rate)
        starts = would & (nth % 2 == 1)
        rows = rows.withColumn(f"s_{name}", starts).withColumn(f"s_{name}", F.col("seq") + F.when(F.col(f"s_{name}"), 1).when(F.coalesce(F.lag(f"s_{name}").over(w), F.lit(False)), -1).otherwise(0))
    # Of each group of tokens, how many a page has and how many lie before this one.
    early = ~title & (F.col("rest") < 6)
    split = {12: (F.length(text) >= 9) & (seq % 12 == 0), 3: (F.length(text) >= 7) & (seq % 3 == 0)}
    groups = {"t": title, "1": ~title & ~two, "2": two, "e": early, "l": ~title & ~early, "h12": split[12], "h3": split[3]}
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"k_{g}": F.count_if(c).over(before).cast("int") for g, c in groups.items()} | {f"n_{g}": F.count_if(c).over(page).cast("int") for g, c in groups.items()})
    rows = rows.withColumns({"h12": split[12], "h3": split[3]})
    c, third = F.col, F.floor(F.col("n") / 3)
    places = [
        seq,
        c("woven"),
        F.when(title, c("k_t")).when(two, c("n_t") + c("k_2")).otherwise(c("n_t") + c("n_2") + c("k_1")),
        c("n") - 1 - seq,
        c("lines"),
        c("pars"),
        F.when(~two, seq - c("k_2")),
        F.when(title, c("k_t")).when(two, c("n_t") + 2 * c("n_1") + c("k_2")).otherwise(c("n_t") + c("k_1")),
        F.when(~title & ~two, c("n_t") + c("n_1") + c("k_1")),
        seq,
        c("s_light"),
        c("s_heavy"),
        seq + F.when(seq < third, 0).otherwise(F.coalesce("extras", F.lit(0))),
        F.when(title, c("n_e") + c("k_t")).when(early, c("k_e")).otherwise(c("n_e") + c("n_t") + c("k_l")),
        seq + c("k_h12"),
        F.when(c("h12"), seq + c("k_h12") + 1),
        seq + c("k_h3"),
        F.when(c("h3"), seq + c("k_h3") + 1),
    ]
    extras = furniture.groupBy("page_id").agg(F.count("*").cast("int").alias("extras"))
    rows = rows.join(extras.hint("shuffle_hash"), "page_id", "left")
    return rows.select("page_id", "seq", "text", "n", "noise", "h12", "h3", F.array(*[x.cast("int") for x in places]).alias("places"))


def corrupt(body: DataFrame, furniture: DataFrame) -> DataFrame:
    """page_id, mutation, place, text, seq and furniture of every page under every corruption, of a body and furniture as packed() takes them.

    seq stays null where a text isn't the page's token any more.
    """
    rows = packed(body, furniture)
    each = rows.select("page_id", "seq", "text", "noise", "h12", "h3", F.posexplode("places").alias("slot", "place")).where("place is not null")
    slot, text, half = F.col("slot"), F.col("text"), F.floor(F.length("text") / 2).cast("int")
    first = ((slot == _HALVES[0]) & F.col("h12")) | ((slot == _HALVES[2]) & F.col("h3"))
    second, noisy = slot.isin(_HALVES[1], _HALVES[3]), (slot == _NOISE) & F.col("noise").isNotNull()
    said = F.when(noisy, F.col("noise")).when(first, F.concat(F.substr(text, F.lit(1), half), F.lit("-"))).when(second, F.substr(text, half + 1)).otherwise(text)
    true = F.when(~(first | second | (noisy & (F.col("noise") != text))), F.col("seq")).cast("int")
    out = each.select("page_id", F.get(F.array(*map(F.lit, SLOTS)), slot).alias("mutation"), "place", said.alias("text"), true.alias("seq"), F.lit(False).alias("furniture"))
    return out.unionByName(_inline(body, furniture).select("page_id", F.lit("furniture_inline").alias("mutation"), "place", "text", F.lit(None).cast("int").alias("seq"), F.lit(True).alias("furniture")))


def _inline(body: DataFrame, furniture: DataFrame) -> DataFrame:
    """page_id, place, text: furniture where it stands in the text, after a third of the page's tokens."""
    third = body.groupBy("page_id").agg(F.floor(F.count("*") / 3).cast("int").alias("third"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("idx", "text")) - 1
    return furniture.select("page_id", "text", nth.alias("nth")).join(third, "page_id").select(F.col("page_id").alias("page_id"), (F.col("third") + F.col("nth")).alias("place"), "text")


_SCORED = "page_id string, mutation string, digest string, n long, lis long, adjacent long, there long, furniture_inline long"


def _scorer():
    """Functions of a page's rows, packed and one by one, that give its row for each corruption, _SCORED without ratios."""

    def score(page: str, names: list[str], m: np.ndarray, place: np.ndarray, seq: np.ndarray, extra: np.ndarray, text: np.ndarray) -> pa.Table:
        order = np.lexsort((place, m))
        m, seq, extra, said, out = m[order], seq[order], extra[order], text[order].tolist(), []
        cuts = np.searchsorted(m, np.arange(len(names) + 1))
        for name, a, b in zip(names, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = seq[a:b]
            true = mine[mine >= 0]
            if not len(true):
                continue
            tails: list[int] = []  # the longest strictly increasing run of true numbers
            for x in true.tolist():
                if not tails or x > tails[-1]:
                    tails.append(x)
                else:
                    tails[bisect.bisect_left(tails, x)] = x
            # Furniture whose neighbours in the text are at most three true tokens apart.
            inline = 0
            for i in np.flatnonzero(extra[a:b]).tolist():
                before, after = mine[:i][mine[:i] >= 0], mine[i + 1 :][mine[i + 1 :] >= 0]
                inline += bool(len(before) and len(after) and 0 < after[0] - before[-1] <= 3)
            digest = hashlib.sha256(" ".join(x for x in said[a:b] if x is not None).encode()).hexdigest()
            out.append((page, name, digest, len(true), len(tails), int((true[1:] == true[:-1] + 1).sum()), len(np.unique(true)), inline))
        types = [pa.string()] * 3 + [pa.int64()] * 5
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SCORED.split(", ")])

    def ints(column: pa.Array) -> np.ndarray:
        return column.fill_null(-1).to_numpy(zero_copy_only=False)

    codes = np.array([NAMES.index(x) for x in SLOTS])

    def of_packed(key: tuple, rows: pa.Table, extra: pa.Table) -> pa.Table:
        if not len(rows):
            return score(key[0].as_py(), NAMES, *[np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=bool), np.zeros(0, dtype=object))
        place = ints(pc.list_flatten(rows.column("places").combine_chunks())).reshape(len(rows), len(SLOTS))
        word, noise = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("text", "noise"))
        said, seq = np.repeat(word[:, None], len(SLOTS), axis=1), np.repeat(ints(rows.column("seq").combine_chunks())[:, None], len(SLOTS), axis=1)
        for i in np.flatnonzero(noise != None).tolist():  # noqa: E711: of each element
            said[i, _NOISE] = noise[i]
            if noise[i] != word[i]:
                seq[i, _NOISE] = -1
        for c, (a, b) in (("h12", _HALVES[:2]), ("h3", _HALVES[2:])):
            for i in np.flatnonzero(rows.column(c).to_numpy()).tolist():
                half = len(word[i]) // 2
                said[i, a], said[i, b] = word[i][:half] + "-", word[i][half:]
                seq[i, a] = seq[i, b] = -1
        there = place >= 0
        more = len(extra)
        m = np.concatenate([np.broadcast_to(codes, place.shape)[there], np.full(more, NAMES.index("furniture_inline"))])
        own = np.arange(len(m)) >= len(m) - more
        return score(key[0].as_py(), NAMES, m, np.concatenate([place[there], ints(extra.column("place").combine_chunks())]), np.concatenate([seq[there], np.full(more, -1)]), own, np.concatenate([said[there], np.array(extra.column("text").to_pylist(), dtype=object)]))

    def of_rows(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, m = np.unique(rows.column("mutation").to_pylist(), return_inverse=True)
        place, seq, extra, text = (rows.column(c).combine_chunks() for c in ("place", "seq", "furniture", "text"))
        return score(key[0].as_py(), names.tolist(), m, ints(place), ints(seq), extra.to_numpy(zero_copy_only=False), np.array(text.to_pylist(), dtype=object))

    return of_packed, of_rows


def _ratios(scored: DataFrame, body: DataFrame) -> DataFrame:
    total = body.groupBy("page_id").agg(F.count("*").alias("tokens"), F.bool_or(F.col("block") == "col2").alias("two_columns"))
    return scored.join(total, "page_id").select(
        "page_id", "mutation", "two_columns", "digest", "n", (F.col("lis") / F.col("n")).alias("order"), F.when(F.col("n") > 1, F.col("adjacent") / (F.col("n") - 1)).alias("adjacency"),
        (F.col("there") / F.col("tokens")).alias("recall"), "furniture_inline",
    )


def scores(corrupted: DataFrame, body: DataFrame) -> DataFrame:
    """page_id, mutation, digest, n, order, adjacency, recall and furniture_inline: share of the longest run in order, of true neighbours, of true tokens that are there, and furniture that breaks into the text. A page's tokens are a bounded group."""
    return _ratios(corrupted.select("page_id", "mutation", "place", "text", "seq", "furniture").groupBy("page_id").applyInArrow(_scorer()[1], _SCORED), body)


def packed_scores(body: DataFrame, furniture: DataFrame) -> DataFrame:
    """scores() of corrupt(), with no row for each token and corruption: a page's tokens meet with their places only in the task that scores it."""
    rows = packed(body, furniture).select("page_id", "seq", "text", "noise", "h12", "h3", "places")
    return _ratios(rows.groupBy("page_id").cogroup(_inline(body, furniture).groupBy("page_id")).applyInArrow(_scorer()[0], _SCORED), body)


def passes(bars: dict[str, float] = BARS, least: int = LEAST_N) -> Column:
    """Whether a row of scores() passes all bars: an order of too few tokens doesn't, nor does any furniture inside the text."""
    ok = (F.col("n") >= least) & (F.col("furniture_inline") == 0)
    for name, bar in bars.items():
        ok = ok & (F.col(name) >= bar)
    return F.coalesce(ok, F.lit(False))


def mutation_gate(scored: DataFrame) -> DataFrame:
    """scored with status, verdict, detail and held for each page and corruption.

    not_applicable: it needs a second column, which is no failure; no_op: the page came out as it was, which always is one, for
    such a corruption tests nothing; failed: a metric is outside its band, or the verdict isn't the one expected; held.
    """
    base = scored.where("mutation = 'identity'").select("page_id", F.col("digest").alias("plain"))
    rows = scored.join(base, "page_id").withColumn("verdict", passes())
    detail, needs = F.lit(None).cast("string"), F.lit(False)
    for name, (bands, verdict, two) in EXPECTED.items():
        mine = F.col("mutation") == name
        faults = [F.when(F.coalesce((F.col(m) < low) if high is None else (F.col(m) > high) if low is None else ~F.col(m).between(low, high), F.lit(True)), F.lit(f"{m} outside its band")) for m, low, high in bands]
        if verdict is not None:
            faults.append(F.when(F.col("verdict") != verdict, F.lit("verdict not as expected")))
        detail = F.when(mine, F.coalesce(*faults, F.lit(None).cast("string"))).otherwise(detail)
        needs = needs | (mine & F.lit(two))
    rows = rows.withColumn("detail", detail)
    status = F.when(needs & ~F.col("two_columns"), "not_applicable").when((F.col("mutation") != "identity") & (F.col("digest") == F.col("plain")), "no_op").when(F.col("detail").isNotNull(), "failed").otherwise("held")
    rows = rows.withColumn("status", status).withColumn("held", F.col("status").isin("held", "not_applicable"))
    return rows.withColumn("detail", F.when(F.col("status") == "failed", F.col("detail"))).drop("digest", "plain", "two_columns")


def recall_by_kind(output: DataFrame, truth: DataFrame, accented: Column, strict: Column) -> DataFrame:
    """page_id, recall, space_loss and accent_recall of output (page_id, place, text, seq, k: the first true token that it is and how many it runs together) against truth (page_id, seq, text).

    accented: of a true text, whether it has a letter with an accent; strict: the fold of a text that keeps accents.
    """
    total = truth.groupBy("page_id").agg(F.count("*").alias("tokens"), F.count_if(accented).alias("accents"))
    spans = output.where("seq is not null").select("page_id", "k", strict.alias("said"), F.explode(F.sequence("seq", F.col("seq") + F.col("k") - 1)).alias("seq"))
    met = spans.join(truth.select("page_id", "seq", accented.alias("accent"), strict.alias("meant")), ["page_id", "seq"])
    got = met.groupBy("page_id").agg(F.count_distinct("seq").alias("there"), F.count_if(F.col("k") > 1).alias("merged"), F.count_if((F.col("k") == 1) & F.col("accent") & (F.col("said") == F.col("meant"))).alias("hits"))
    both = total.join(got, "page_id", "left").na.fill(0, ["there", "merged", "hits"])
    return both.select("page_id", F.round(F.col("there") / F.col("tokens"), 6).alias("recall"), F.round(F.col("merged") / F.col("tokens"), 6).alias("space_loss"), F.round(F.when(F.col("accents") > 0, F.col("hits") / F.col("accents")), 6).alias("accent_recall"))


def of_page(boxes: DataFrame, per_line: int = 6, lines: int = 20) -> DataFrame:
    """boxes (page_id, seq, text) as a body: the first line is the title, each column has `lines` lines of `per_line` tokens."""
    line = F.floor(F.col("seq") / per_line).cast("int")
    block = F.when(line == 0, "title").when(line < lines, "col1").otherwise("col2")
    return boxes.where(fold(F.col("text")) != "").select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1).alias("seq"), "text", block.alias("block"), line.alias("line"))
