"""Packing pages into chunks and sampling them.

Packing is a fold over a site's pages in order. A site may hold any share of the rows, so it is cut into segments by range
partitioning. Each segment is summed up as a function of the fill it is entered with (how many pieces still fit, and where the
chunks then start); the functions are composed along each site, and the segments are packed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_blank, is_english_hint, strip
from quern.session import cut


def pieces_of(length: int, size: int) -> list[int]:
    return [size] * (length // size) + ([length % size] if length % size else [])


def pack(lengths: np.ndarray, size: int, fill: int = 0) -> tuple[np.ndarray, int]:
    """(chunk of each piece counted from the entered one as 0, fill at the end); a piece that doesn't fit opens a chunk."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(len(lengths), np.int64)
    at = int(np.searchsorted(total, size - fill, "right")) - 1 if fill else 0
    at = max(at, 0)
    if at >= len(lengths):
        return out, fill + int(total[-1])
    number = 1 if fill else 0
    while True:
        stop = int(np.searchsorted(total, total[at] + size, "right")) - 1
        out[at:stop] = number
        if stop >= len(lengths):
            return out, int(total[-1] - total[at])
        at, number = stop, number + 1


def exits(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(chunks opened, fill at the end) when a chunk starts at each piece, in one pass from the end."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    after = np.searchsorted(total, total[:-1] + size, "right") - 1
    chunks, fills = np.ones(n, np.int64), total[-1] - total[:-1]
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            chunks[i], fills[i] = chunks[j] + 1, fills[j]
    return chunks, fills


def packed_pages(pages: DataFrame, size: int, site: str = "site", order: str = "page_ord", tie: str = "page_id", text: str = "text", keep_white: bool = False) -> DataFrame:
    """Rows (site, page_ord, page_id, piece_no, start, length, chunk_no) of the non-blank pages of each site packed in order.

    A page is sliced from its own start into pieces of at most size characters; a chunk takes pieces while they fit and none is
    split to fill a gap. Chunks and pieces count from 1. Blank and null texts give none; repeated rows are pages of their own.
    """
    body = F.col(text) if keep_white else strip(F.col(text))
    rows = pages.where(~is_blank(F.col(text))).select(F.coalesce(site, F.lit("")).alias("site"), F.col(order).alias("ord"), F.col(tie).alias("tie"), F.length(body).alias("n"))
    rows = cut(rows.repartitionByRange("site", "ord", "tie").sortWithinPartitions("site", "ord", "tie").withColumn("part", F.spark_partition_id()))
    limit = size

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(frames)
        if not whole:
            return
        frame = pd.concat(whole)
        for (name, part), own in frame.groupby(["site", "part"], sort=False):
            lengths = np.array([p for n in own.n for p in pieces_of(n, limit)], np.int64)
            total = np.concatenate([[0], np.cumsum(lengths)])
            chunks, fills = exits(lengths, limit)
            # where a chunk entered from before may end: within the first `size` characters
            entries = int(np.searchsorted(total[: len(lengths)], limit, "right"))
            yield pd.DataFrame({"site": [name], "part": [part], "total": [int(total[-1])], "heads": [total[:entries].tolist()], "chunks": [chunks[:entries].tolist()], "fills": [fills[:entries].tolist()]})

    segments = rows.mapInPandas(sums, "site string, part int, total long, heads array<long>, chunks array<long>, fills array<long>")

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        fill, number, out = 0, 0, []
        for row in frame.sort_values("part").itertuples():
            out.append((row.site, row.part, fill, number))
            heads = np.asarray(row.heads)
            if fill and fill + row.total <= limit:
                fill += row.total
                continue
            i = int(np.searchsorted(heads, limit - fill, "right")) - 1 if fill else 0
            number += int(row.chunks[i])
            fill = int(row.fills[i])
        return pd.DataFrame(out, columns=["site", "part", "fill", "before"])

    entered = segments.groupBy("site").applyInPandas(chain, "site string, part int, fill long, before long")
    # one row for each site and partition it reaches into
    joined = rows.join(entered, ["site", "part"]).sortWithinPartitions("site", "part", "ord", "tie")

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "tie"], kind="stable")
        of, no, starts, lengths = [], [], [], []
        for k, n in enumerate(frame.n):
            for j, p in enumerate(pieces_of(n, limit)):
                of.append(k)
                no.append(j + 1)
                starts.append(j * limit)
                lengths.append(p)
        fill, before = int(frame.fill.iloc[0]), int(frame.before.iloc[0])
        chunk, _ = pack(np.array(lengths, np.int64), limit, fill)
        own = frame.iloc[of]
        return pd.DataFrame({"site": own.site.values, "page_ord": own.ord.values, "page_id": own.tie.values, "piece_no": no, "start": starts, "length": lengths, "chunk_no": chunk + before + (0 if fill else 1)})

    schema = f"site string, page_ord {dict(pages.dtypes)[order]}, page_id {dict(pages.dtypes)[tie]}, piece_no int, start long, length long, chunk_no long"
    return joined.groupBy("site", "part").applyInPandas(place, schema)


def balanced_shares(pages: DataFrame, budget: int, site: str = "site", order: str = "page_ord", tie: str = "page_id", text: str = "text") -> DataFrame:
    """Rows (site, page_ord, page_id, n_chars, taken): equal shares of a budget over a site's pages, what short pages leave going to the others.

    The level is found on the counts of each length, so no site's pages meet in one task; the characters left over after the
    level go one each to the first longer pages in order.
    """
    rows = pages.where(~is_blank(F.col(text))).select(F.coalesce(site, F.lit("")).alias("site"), F.col(order).alias("page_ord"), F.col(tie).alias("page_id"), F.length(strip(F.col(text))).cast("long").alias("n_chars"))
    counts = rows.groupBy("site", "n_chars").agg(F.count("*").alias("m"))
    up = Window.partitionBy("site").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("site")
    below = counts.select("site", "n_chars", "m", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("k"), F.coalesce(F.sum(F.col("m") * F.col("n_chars")).over(up), F.lit(0)).alias("s"), F.sum("m").over(all_of).alias("pages"), F.sum(F.col("m") * F.col("n_chars")).over(all_of).alias("chars"))
    share = F.floor((F.lit(budget) - F.col("s")) / (F.col("pages") - F.col("k")))
    level = below.where("chars > " + str(budget)).withColumn("share", share).where("n_chars > share").groupBy("site").agg(F.min_by("share", "n_chars").alias("level"))
    sums = counts.join(level, "site").groupBy("site").agg(F.first("level").alias("level"), (F.lit(budget) - F.sum(F.col("m") * F.least("n_chars", "level"))).alias("left"))
    # the first `left` pages above the level; left is below the budget, so the rank filter keeps no more of a site in any task
    longer = rows.join(sums, "site").where("n_chars > level")
    rank = F.row_number().over(Window.partitionBy("site").orderBy("page_ord", "page_id"))
    extra = longer.withColumn("rank", rank).where(F.col("rank") <= budget).where("rank <= left").select("site", "page_ord", "page_id", F.lit(1).alias("extra"))
    taken = F.when(F.col("level").isNull(), F.col("n_chars")).otherwise(F.least("n_chars", "level") + F.coalesce("extra", F.lit(0)))
    out = rows.join(sums, "site", "left").join(extra, ["site", "page_ord", "page_id"], "left")
    return out.select("site", "page_ord", "page_id", "n_chars", taken.cast("long").alias("taken")).where("taken > 0")


def spaced_index(position: Column, total: Column, selected: Column) -> Column:
    """The position-th (from 0) of selected evenly spaced indices among total, halves to the even; the middle if one is selected."""
    exact = position * (total - 1) / F.greatest(selected - 1, F.lit(1))
    return F.when(selected == 1, F.floor(total / 2)).otherwise(F.rint(exact)).cast("long")


def selected_chunks(chunks: DataFrame, percentage: float | None = None, most: int = 0) -> DataFrame:
    """Rows (site, chunk_no, strategy, total) of the chunks that stand for each site.

    All if the count reaches the total, else a balanced one (all its numbers), else evenly spaced ones.
    """
    if percentage is not None and not 0 < percentage <= 100 or percentage is not None and most:
        raise ValueError("needs a percentage above 0 and up to 100, or a number of chunks")
    totals = chunks.groupBy("site").agg(F.max("chunk_no").alias("total"))
    count = F.ceil(F.col("total") * F.lit(percentage) / 100) if percentage is not None else F.lit(most) if most else F.col("total")
    totals = totals.withColumn("selected", F.least("total", count).cast("long"))
    strategy = F.when(F.col("selected") == F.col("total"), "all_chunks").when(F.col("selected") == 1, "balanced_across_pages").otherwise("evenly_spaced_chunks")
    every = F.sequence(F.lit(1).cast("long"), F.col("total"))
    spaced = F.transform(F.sequence(F.lit(0).cast("long"), F.col("selected") - 1), lambda i: spaced_index(i, F.col("total"), F.col("selected")) + 1)
    out = totals.withColumn("strategy", strategy).withColumn("chunk_no", F.explode(F.when(F.col("strategy") == "evenly_spaced_chunks", spaced).otherwise(every)))
    return out.select("site", "chunk_no", "strategy", "total")


def translation_plan(packed: DataFrame, pages: DataFrame, mode: str = "auto") -> DataFrame:
    """Rows (site, requests, characters): chunks with a page to translate and their characters; auto leaves English hints out."""
    if mode not in ("auto", "all"):
        raise ValueError("mode must be auto or all")
    hints = pages.select("page_id", "language_hint")
    todo = packed.join(hints, "page_id").where(~is_english_hint(F.col("language_hint")) if mode == "auto" else F.lit(True))
    return todo.groupBy("site", "chunk_no").agg(F.sum("length").alias("n")).groupBy("site").agg(F.count("*").alias("requests"), F.sum("n").alias("characters"))


def chunk_texts(packed: DataFrame, pages: DataFrame, text: str = "text", keep_white: bool = False) -> DataFrame:
    """Rows (site, chunk_no, pages, urls, n_chars) of the chunks that packed_pages laid out, with their texts cut from pages.

    pages of a chunk: (url, language_hint, text) in order; urls are its distinct urls in the order of first sight. A chunk holds
    no more characters than it was packed for, so no group is unbounded. page_id must be unique in pages.
    """
    body = F.col(text) if keep_white else strip(F.col(text))
    texts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("language_hint", F.lit("")).alias("language_hint"), body.alias("body"))
    piece = F.substring(F.col("body"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    rows = packed.join(texts, "page_id").select("site", "chunk_no", F.struct("page_ord", "page_id", "piece_no", "url", "language_hint", piece.alias("text")).alias("p"))
    return _gathered(rows.groupBy("site", "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("p")), "site", "chunk_no")


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    own = F.transform("p", lambda p: F.struct(p["url"].alias("url"), p["language_hint"].alias("language_hint"), p["text"].alias("text")))
    urls = F.array_distinct(F.transform("p", lambda p: p["url"]))
    return rows.select(*keys, own.alias("pages"), urls.alias("urls"), F.length(F.array_join(F.transform("p", lambda p: p["text"]), "")).cast("long").alias("n_chars"))


def balanced_texts(pages: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Rows (site, pages, urls, n_chars): one chunk for each site with equal shares of its pages, at most budget characters."""
    shares = balanced_shares(pages, budget, text=text)
    texts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("language_hint", F.lit("")).alias("language_hint"), strip(F.col(text)).alias("body"))
    rows = shares.join(texts, "page_id").select("site", F.struct("page_ord", "page_id", "url", "language_hint", F.substring(F.col("body"), F.lit(1), F.col("taken").cast("int")).alias("text")).alias("p"))
    return _gathered(rows.groupBy("site").agg(F.array_sort(F.collect_list("p")).alias("p")), "site")


def selected_texts(pages: DataFrame, size: int, percentage: float | None = None, most: int = 0, keep_white: bool = False) -> DataFrame:
    """Rows (site, request, source_chunk, strategy, total, pages, urls, n_chars): the chunks to classify, with their texts.

    request counts a site's chunks from 1; source_chunk is null for the balanced one. Sites without text have no rows.
    """
    packed = cut(packed_pages(pages, size, keep_white=keep_white))
    chosen = selected_chunks(packed, percentage, most)
    spaced = chosen.where("strategy <> 'balanced_across_pages'")
    own = chunk_texts(packed.join(spaced.select("site", "chunk_no"), ["site", "chunk_no"], "left_semi"), pages, keep_white=keep_white)
    number = F.row_number().over(Window.partitionBy("site").orderBy("chunk_no"))
    # a site's numbers are ranked, not its texts
    ranked = spaced.withColumn("request", number)
    rows = own.join(ranked, ["site", "chunk_no"]).select("site", "request", F.col("chunk_no").alias("source_chunk"), "strategy", "total", "pages", "urls", "n_chars")
    one = chosen.where("strategy = 'balanced_across_pages'").groupBy("site").agg(F.first("strategy").alias("strategy"), F.first("total").alias("total"))
    balanced = balanced_texts(pages.join(one.select("site"), "site", "left_semi"), size)
    return rows.unionByName(balanced.join(one, "site").select("site", F.lit(1).alias("request"), F.lit(None).cast("long").alias("source_chunk"), "strategy", "total", "pages", "urls", "n_chars"))


def evidence_identity(pages: DataFrame) -> DataFrame:
    """Rows (site, n_pages, identity): what a site's pages are, whatever their order in the table; a changed text changes it.

    The sum of the first 60 bits of each page's SHA-256, which is added up before the shuffle.
    """
    page = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_ord").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("language_hint", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    bits = F.conv(F.substring(page, 1, 15), 16, 10).cast("decimal(38,0)")
    return pages.groupBy(F.coalesce("site", F.lit("")).alias("site")).agg(F.count("*").alias("n_pages"), F.sum(bits).cast("string").alias("identity"))


def plans(chunks: DataFrame, mode: str = "off") -> DataFrame:
    """Rows (site, strategy, total_chunks, requests, translation_requests, translation_characters) of selected_texts.

    mode off translates nothing, auto the pages not hinted English, all every page.
    """
    if mode not in ("off", "auto", "all"):
        raise ValueError("mode must be off, auto or all")
    wanted = F.filter("pages", lambda p: F.lit(mode == "all") | (F.lit(mode == "auto") & ~is_english_hint(p["language_hint"])))
    chars = F.aggregate(wanted, F.lit(0).cast("long"), lambda x, p: x + F.length(p["text"]))
    rows = chunks.select("site", "strategy", "total", F.size(wanted).alias("n"), chars.alias("chars"))
    return rows.groupBy("site").agg(F.first("strategy").alias("strategy"), F.first("total").alias("total_chunks"), F.count("*").alias("requests"), F.count_if(F.col("n") > 0).alias("translation_requests"), F.sum("chars").alias("translation_characters"))
