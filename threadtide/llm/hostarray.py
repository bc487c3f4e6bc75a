"""Main text of web pages, by the markup and a suffix array per host.

Blocks in an article or main element can be the text, blocks in marked elements (menus, adverts, notices and
the like) can not. On pages without an article the other, open blocks can. The word streams of the open and
marked blocks of all pages of a host are put into suffix arrays, chunk by chunk; runs of RUN words that stand
on PAGES distinct texts of the host and on a SHARE of all its distinct texts are boilerplate, wherever a page
has them, and the other runs are kept. Articles lose such a run where as many articles have it: quotations and
copies are no boilerplate, nor are headlines that menus of other pages repeat.
Chunks split the pages of a host, so counts add up over them and a large host is no large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadtide.llm import markup, textkit
from threadtide.llm.shared import keep, partitions
from threadtide.llm.urlfilter import with_parts

RUN = 8
PAGES = 2
#: Menus stand on a share of a host's texts, passages that a few pages have in common do not.
SHARE = 0.1
#: Words in one suffix array.
CHUNK_WORDS = 400_000
#: Parts that the pages of one host are dealt to.
SALTS = 64
#: Runs of all hosts that go to the pages by broadcast; more of them are joined.
BROADCAST_RUNS = 2_000_000


def suffix_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix of a word sequence by its first `length` words (prefix doubling); equal beginnings, equal ranks."""
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    known = 1
    while known < length:
        step = min(known, length - known)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] if step < len(rank) else 0
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        known += step
    return rank


def repeated_runs(streams: list[np.ndarray], length: int, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk: the first place (in the joined streams) of each distinct run, and on how many of `pages`, one per stream, it stands."""
    joined = np.concatenate(streams) if streams else np.zeros(0, np.uint64)
    page = np.repeat(pages, [len(s) for s in streams])
    ends = np.repeat(np.cumsum([len(s) for s in streams]), [len(s) for s in streams])
    whole = np.flatnonzero(np.arange(len(joined)) + length <= ends)  # runs stay within one stream
    if not len(whole):
        return whole, whole
    rank = suffix_ranks(joined, length)[whole]
    order = np.lexsort((page[whole], rank))
    rank, owner = rank[order], page[whole][order]
    new_rank = np.concatenate(([True], rank[1:] != rank[:-1]))
    new_page = new_rank | np.concatenate(([True], owner[1:] != owner[:-1]))
    first = np.flatnonzero(new_rank)
    return whole[order][first], np.add.reduceat(new_page.astype(np.int64), first)


def run_hashes(stream: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words."""
    if len(stream) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(stream) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = textkit.mix64(out + stream[k : k + len(out)])
    return out


def unique_runs(texts: list[str], covered: set[int], length: int) -> list[str]:
    """Blocks without the words that a repeated run covers; `covered` are the starts of such runs in the joined words."""
    gone = {i + k for i in covered for k in range(length)}
    out, at = [], 0
    for text in texts:
        words = text.split()
        out.append(" ".join(w for k, w in enumerate(words, at) if k not in gone))
        at += len(words)
    return out


def _own_texts(found: list[tuple[str, str]]) -> list[str]:
    """The blocks that can be a page's main text: those of its article or, without one, the open ones."""
    return [t for k, t in found if k == markup.CONTENT] or [t for k, t in found if k == markup.OPEN]


def page_streams(pages: DataFrame) -> DataFrame:
    """mark, host, alike (hash of the unmarked words), open and marked (word hashes of these blocks) of every page (mark, host, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, 100):
            found = [markup.blocks(p) for p in batch.column("html").to_pylist()]
            parts = [[" ".join(t for k, t in f if k in kinds) for f in found] for kinds in ((markup.CONTENT, markup.OPEN), (markup.OPEN,), (markup.BOILERPLATE,))]
            whole, *lists = (textkit.words(pa.array(p, pa.string()), lower=False) for p in parts)
            streams = [pa.ListArray.from_arrays(pa.array(w.rows, pa.int32()), pa.array(w.hashes.view(np.int64))) for w in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("mark"), batch.column("host"), pa.array([_alike(whole.row(i)) for i in range(batch.num_rows)], pa.int64()), *streams],
                ["mark", "host", "alike", "open", "marked"],
            )

    return pages.mapInArrow(run, "mark long, host string, alike long, open array<long>, marked array<long>")


def _alike(words: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        placed = textkit.mix64(words + textkit.mix64(np.arange(len(words), dtype=np.uint64)))
        return int(textkit.mix64(placed.sum(dtype=np.uint64)).view(np.int64))


def run_pages(streams: DataFrame, length: int = RUN) -> DataFrame:
    """host, run (hash), pages: on how many pages of its host every run of words stands, in open or in marked blocks."""
    def pack(host: str, chunk: list[np.ndarray]) -> pa.RecordBatch:
        first, pages = repeated_runs(chunk, length, np.arange(len(chunk)) // 2)
        joined = np.concatenate(chunk)
        hashes = run_hashes(joined, length)[first] if len(first) else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array([host] * len(first), pa.string()), pa.array(hashes.view(np.int64)), pa.array(pages.astype(np.int64))], ["host", "run", "pages"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, chunk, held = None, [], 0
        for batch in batches:
            hosts, lists = batch.column("host").to_pylist(), [batch.column(c) for c in ("open", "marked")]
            for i, name in enumerate(hosts):
                own = [c[i].values.to_numpy().view(np.uint64) for c in lists]
                size = sum(map(len, own))
                if chunk and (name != host or held + size > CHUNK_WORDS):
                    yield pack(host, chunk)
                    chunk, held = [], 0
                host = name
                chunk += own
                held += size
        if chunk:
            yield pack(host, chunk)

    placed = streams.repartition(partitions(streams.sparkSession), "host", F.pmod(F.xxhash64("mark"), F.lit(SALTS))).sortWithinPartitions("host")
    return placed.mapInArrow(run, "host string, run long, pages long").groupBy("host", "run").agg(F.sum("pages").alias("pages"))


def _frequent(counted: DataFrame, totals: DataFrame, pages: int, share: float) -> DataFrame:
    """host, run of the runs that stand on `pages` distinct texts of their host and on a share of them all."""
    met = counted.where(F.col("pages") >= pages).join(totals, "host")
    return met.where(F.col("pages") >= share * F.col("total")).select("host", "run")


def searched(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """id, url, mark, host, alike, article, texts (the blocks that can be the text), places (place and run of the host's `runs` in them) of every page.

    The share bounds the runs of a host by some times the words of a page. Up to BROADCAST_RUNS of them go to the pages; more
    are joined, with the pages of a host dealt to SALTS parts.
    """
    place = pa.struct([("place", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, 100):
            found = [markup.blocks(p) for p in batch.column("html").to_pylist()]
            own = [_own_texts(f) for f in found]
            unmarked = [" ".join(t for k, t in f if k != markup.BOILERPLATE) for f in found]
            words, whole = (textkit.words(pa.array(t, pa.string()), lower=False) for t in ([" ".join(o) for o in own], unmarked))
            places, known = [], batch.column("runs")
            for i in range(batch.num_rows):
                mine = run_hashes(words.row(i), RUN).view(np.int64) if known[i].is_valid else np.zeros(0, np.int64)
                met = np.flatnonzero(np.isin(mine, known[i].values.to_numpy())) if len(mine) else ()
                places.append([{"place": int(j), "run": int(mine[j])} for j in met])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "url", "mark", "host")), pa.array([_alike(whole.row(i)) for i in range(len(own))], pa.int64()),
                 pa.array([any(k == markup.CONTENT for k, _ in f) for f in found], pa.bool_()), pa.array(own, pa.list_(pa.string())), pa.array(places, pa.list_(place))],
                ["id", "url", "mark", "host", "alike", "article", "texts", "places"],
            )

    listed, asked = runs.groupBy("host").agg(F.collect_list("run").alias("runs")), rows.select("host", "id", "url", "mark", "html")
    if runs.count() <= BROADCAST_RUNS:
        placed = asked.join(F.broadcast(listed), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        placed = asked.withColumn("salt", F.pmod(F.xxhash64("mark"), F.lit(SALTS)).cast("int")).join(listed.select("host", "runs", salts), ["host", "salt"], "left")
    kind = rows.schema["id"].dataType.simpleString()
    return placed.select("id", "url", "mark", "host", "html", "runs").mapInArrow(
        run, f"id {kind}, url string, mark long, host string, alike long, article boolean, texts array<string>, places array<struct<place int, run long>>"
    )


def extract(frame: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every row; blocks are joined by line breaks.

    A null or empty page has an empty text. The blocks of an article or main element, without marked elements, or on a page
    without one the open blocks are the text, without the boilerplate of the host: runs of RUN words that stand in open or
    marked blocks of PAGES distinct texts and of a SHARE of the distinct texts of the host. Articles lose such a run where
    as many of the host's articles have it, so a headline that other pages announce stays. Copies of a page are one text.
    Every page takes part, and every page is searched for these runs. Other columns are not read.
    """
    textkit.limit_batches(frame.sparkSession)
    rows = with_parts(frame.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")), "url").drop("path")
    rows = rows.withColumn("mark", F.xxhash64("id", "url", "html"))
    first = F.min_by(F.struct("mark", "open", "marked"), "mark").alias("page")  # pages of a host with equal unmarked words count once
    texts = keep(page_streams(rows.select("mark", "host", "html")).groupBy("host", "alike").agg(first).select("host", "page.*"))
    totals = texts.groupBy("host").agg(F.count("*").alias("total"))
    pages = keep(searched(rows, keep(_frequent(run_pages(texts), totals, PAGES, SHARE))), compression="zstd")

    met = pages.where(F.size("places") > 0)
    inside = met.where("article").select("host", "alike", F.explode("places.run").alias("run")).distinct()
    common = _frequent(inside.groupBy("host", "run").agg(F.count("*").alias("pages")), totals, PAGES, SHARE)
    held = met.where("article").select("mark", "host", F.explode("places").alias("p")).select("mark", "host", "p.*").distinct()
    gone = held.join(common, ["host", "run"]).groupBy("mark").agg(F.collect_list("place").alias("gone"))
    pending = met.join(gone, "mark", "left").select("id", "url", "texts", F.when(F.col("article"), F.col("gone")).otherwise(F.col("places.place")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, covered = batch.column("texts").to_pylist(), batch.column("gone").to_pylist()
            left = ["\n".join(filter(None, unique_runs(b, set(g or ()), RUN))) for b, g in zip(blocks, covered)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(left, pa.string())], ["id", "url", "text"])

    kind = frame.schema[key].dataType.simpleString()
    out = pages.where(F.size("places") == 0).select("id", "url", F.array_join("texts", "\n").alias("text"))
    out = out.unionByName(pending.mapInArrow(cut, f"id {kind}, url string, text string"))
    return out.select(F.col("id").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
