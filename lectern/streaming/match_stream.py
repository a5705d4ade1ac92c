"""The matcher over a stream of words, and a monitor of the match contract."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.spoken import normalized
from lectern.operators.contracts import contract_violations
from lectern.operators.matcher import MATCHED, Follower, Page, Word, sides

_COLUMNS = [c.split()[0] for c in MATCHED.split(", ")]


class ClipMatcher(StatefulProcessor):
    """A clip's page, and where its matcher stands: cursor, held and waiting words, running numbers. A clip ends with its last word, or when no word has come for idle_ms."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "page string")
        self.state = handle.getValueState("state", "state string")

    def _rows(self, key, words: list[Word], last: bool) -> Iterator[pd.DataFrame]:
        index, fold, loose, digits, more = json.loads(self.page.get()[0]) if self.page.exists() else ([], [], [], [], {})
        page = Page(index, fold, loose, digits, {int(j): m for j, m in more.items()})
        follower = Follower(page)
        if self.state.exists():
            follower.at, follower.held, follower.first, follower.jumped, follower.seq, queue = json.loads(self.state.get()[0])
            follower.queue = [Word(*w) for w in queue]
        rows = list(follower.feed(words, last))
        if last:
            self.page.clear()
            self.state.clear()
        else:
            self.state.update((json.dumps([follower.at, follower.held, follower.first, follower.jumped, follower.seq, follower.queue]),))
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=_COLUMNS).astype({c: "Int32" for c in ("disp_idx", "from_disp", "to_disp")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values(["s", "w"])
        pages = all_rows["page"].dropna()
        if len(pages) and not self.page.exists():
            self.page.update((pages.iloc[0],))
        last = bool(all_rows["last"].any())
        said = all_rows[all_rows["f"] != ""]
        if self.idle_ms is not None:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            if not last:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._rows(key, [Word(*w) for w in said[["f", "l", "n", "s", "e", "w"]].itertuples(index=False)], last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(key, [], True)

    def close(self) -> None:
        pass


def pages(display: DataFrame, lang: str = "en") -> DataFrame:
    """clip_id and page: a row for each clip, its tokens and their forms as JSON, which a stream of words is joined to once."""
    d, _ = sides(display, display.select("clip_id", F.lit("").alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e")), lang)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("disp_idx").reset_index(drop=True)
        plain = lambda x: [list(s) for s in x]
        more = {j: [plain(m), plain(b)] for j, (m, b) in enumerate(zip(rows["more"], rows["more_loose"], strict=True)) if m is not None}
        return pd.DataFrame([(key[0], json.dumps([rows["disp_idx"].tolist(), rows["f"].tolist(), rows["l"].tolist(), rows["n"].tolist(), more]))], columns=["clip_id", "page"])

    return d.groupBy("clip_id").applyInPandas(pack, "clip_id long, page string")


def stream_match(words: DataFrame, display_pages: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Rows of matcher.match_tokens() as the words of a stream decide them.

    words: clip_id, w, s, e, first and last; a clip's words come in order of their starts, its first one is marked first and its
    last one last. Only the first one meets the clip's page, which stays in the state until the clip ends. However the stream
    is cut into batches, the rows are those of the whole. The session needs the RocksDB state store.
    """
    said = normalized(words, "w").alias("a")
    page = display_pages.alias("p")
    # A clip's first word fetches its page; pages are as many as clips, so the join is by key.
    joined = said.join(page, (F.col("a.clip_id") == F.col("p.clip_id")) & F.col("a.first"), "left")
    rows = joined.select("a.clip_id", "a.w", "a.s", "a.e", "a.f", "a.l", "a.n", "a.last", "p.page")
    mode = "ProcessingTime" if idle_ms is not None else "None"
    return rows.groupBy("clip_id").transformWithStateInPandas(ClipMatcher(idle_ms), MATCHED, "Append", mode)


def monitor_contract(display: DataFrame, to: str, bound: float, floor: float):
    """What foreachBatch calls: the contract violations of each batch of whole clips, written once under the batch's number.

    A batch that is delivered again after a restart overwrites what its first delivery wrote, so every violation is there once.
    placed rows: clip_id, lang, disp_idx, text, cs, ce, w, s, e, asr_conf, match_conf.
    """

    def run(placed: DataFrame, batch: int) -> None:
        seen = placed.persist()
        mine = display.join(seen.select("clip_id").distinct(), "clip_id", "left_semi")
        contract_violations(mine, seen, bound, floor).write.mode("overwrite").parquet(f"{to}/batch={batch}")
        seen.unpersist()

    return run


def violation_counts(spark, at: str) -> DataFrame:
    """invariant, violations and clips of all that a monitor has written."""
    rows = spark.read.parquet(at)
    return rows.groupBy("invariant").agg(F.count("*").alias("violations"), F.countDistinct("clip_id").alias("clips"))
