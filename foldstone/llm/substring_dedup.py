"""Substring deduplication (operator 7): words of windows that also start in an earlier document are removed.

Every window of 13 words has an anchor, the least hash of its runs of five words. Equal windows have equal anchors, so
the corpus falls into shards by anchor and each shard has an FM-index of its own. Documents are streamed through the
shards as fragments: the words of neighbouring windows with one anchor. Only fragments whose anchor occurs in at least two
different texts are sent, and equal fragments are sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.fm_index import FmIndex
from foldstone.llm.native import blocked_filter, possible_hits
from foldstone.llm.words import Words, lists, runs, slices, sliding_min
from foldstone.session import stage

WINDOW = 13
RUN = 5
# Fragments that one FM-index holds at most, about; more of one anchor are split over several indexes.
SHARD_FRAGMENTS = 20_000
LAST = 2**63 - 1
EMPTY = hashlib.sha256(b"").hexdigest()

PROFILE = "doc_id long, raw long, text_sha string, n_words long, anchors array<long>"
FRAGMENT = "place long, text_sha string, anchor long, start int, fragment string"
KEPT = "place long, text_sha string, n_removed long, kept_sha256 string"


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of the window at every word, whether there is a window, and whether it begins a run of windows of one anchor."""
    total = len(words.starts)
    anchor, valid, begins = np.zeros(total, np.int64), np.zeros(total, bool), np.zeros(total, bool)
    least = sliding_min(runs(words.hashes(), RUN), window - RUN + 1).view(np.int64)
    anchor[: len(least)] = least
    valid[:] = np.arange(total) + window <= words.last_word()
    begins[0:1] = valid[0:1]
    begins[1:] = valid[1:] & (~valid[:-1] | (anchor[1:] != anchor[:-1]))
    begins[words.first[:-1][words.counts > 0]] = valid[words.first[:-1][words.counts > 0]]
    return anchor, valid, begins


def _profiles(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            anchor, _, begins = _anchors(words, window)
            at = np.flatnonzero(begins)
            counts = np.diff(np.searchsorted(at, words.first))
            shas = [hashlib.sha256(b" ".join(words.bytes_of(t).split())).hexdigest() for t in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(shas), pa.array(words.counts, pa.int64()), lists(anchor[at], counts, pa.int64())], ["doc_id", "raw", "text_sha", "n_words", "anchors"])

    return of


def _fragments(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            anchor, valid, begins = _anchors(words, window)
            places, shas, wanted = batch.column("place").to_pylist(), batch.column("text_sha").to_pylist(), batch.column("anchors")
            out: list[tuple] = []
            for t in range(batch.num_rows):
                split = words.bytes_of(t).split()
                first, last = words.first[t], words.first[t + 1]
                shared = np.isin(anchor[first:last], wanted[t].values.to_numpy()) & valid[first:last]
                runs_at = np.flatnonzero(begins[first:last])
                ends = np.append(runs_at[1:], max(0, last - first - window + 1))
                for begin, end in zip(runs_at[shared[runs_at]].tolist(), ends[shared[runs_at]].tolist()):
                    for start in range(begin, end, window - RUN + 1):
                        stop = min(start + window - RUN + 1, end)
                        out.append((places[t], shas[t], int(anchor[first + start]), start, b" ".join(split[start : stop + window - 1]).decode("utf-8", "replace")))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["place", "text_sha", "anchor", "start", "fragment"])

    return of


def _shard(window: int):
    """Fragments of a shard: those marked ``indexed`` go into the index, those marked ``asked`` are looked up."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        indexed, asked = rows[rows["indexed"]], rows[rows["asked"]]
        numbers: dict[str, int] = {}
        parts, owner = [np.zeros(1, np.int64)], [np.full(1, LAST, np.int64)]
        for fragment, place in zip(indexed["fragment"], indexed["place"]):
            ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in fragment.split(" ")], np.int64)
            parts += [ids, np.zeros(1, np.int64)]
            owner.append(np.full(len(ids) + 1, place, np.int64))
        index, owners = FmIndex(np.concatenate(parts)), np.concatenate(owner)
        windows, counts = [], []
        for fragment in asked["fragment"]:
            ids = np.array([numbers.get(w, -1) for w in fragment.split(" ")], np.int32)
            windows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            counts.append(len(ids) - window + 1)
        found = np.full(sum(counts), LAST, np.int64)
        if windows:
            rows_of, inverse = np.unique(np.ascontiguousarray(np.concatenate(windows)).view([("", np.int32)] * window).ravel(), return_inverse=True)
            patterns = rows_of.view(np.int32).reshape(-1, window).astype(np.int64)
            low, high, matched = index.search(patterns)
            whole = np.flatnonzero(matched == window)
            least = np.full(len(patterns), LAST, np.int64)
            if len(whole):
                in_order = whole[np.argsort(low[whole])]
                bounds = np.stack([low[in_order], high[in_order]], 1).ravel()
                least[in_order] = np.minimum.reduceat(np.append(owners[index.rows], LAST), bounds)[::2]
            found = least[inverse.ravel()]
        ends = np.cumsum(counts)
        return pd.DataFrame({"anchor": asked["anchor"].to_numpy(), "fragment_hash": asked["fragment_hash"].to_numpy(), "firsts": pd.Series([found[e - c : e] for e, c in zip(ends, counts)], dtype=object)})

    return of


def _removed(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            places, shas, hits = batch.column("place").to_pylist(), batch.column("text_sha").to_pylist(), batch.column("windows")
            out: list[tuple] = []
            for t in range(batch.num_rows):
                split = words.bytes_of(t).split()
                cover = np.zeros(len(split) + 1, np.int64)
                at = hits[t].values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, np.minimum(at + window, len(split)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([w for w, g in zip(split, gone.tolist()) if not g])
                out.append((places[t], shas[t], int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.string()])], ["place", "text_sha", "n_removed", "kept_sha256"])

    return of


def _placed(documents: DataFrame) -> DataFrame:
    """Rows are known by their id, null as the last, and a hash of their text."""
    return documents.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("place"), F.xxhash64("text").alias("raw"), "text")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (place, raw, ...) with their texts; only rows that may be wanted are moved."""
    bits = blocked_filter(wanted.select(F.xxhash64("place", "raw").alias("h")), "h")
    return possible_hits(_placed(documents), F.xxhash64("place", "raw"), bits).join(wanted, ["place", "raw"]).dropDuplicates(["place", "raw"])


def meeting_shards(sizes: DataFrame, shard_fragments: int, least: int) -> int:
    """Groups for all meetings: a fragment is in one for each chunk of its anchor, and in a second one for each other chunk."""
    rows = sizes.agg(F.sum(F.col("fragments") * (2 * F.col("chunks") - 1))).first()[0] or 0
    return max(1, rows // shard_fragments, least)


def remove_repeats(documents: DataFrame, window: int = WINDOW, shard_fragments: int = SHARD_FRAGMENTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs outside ``[\\x20\\x09-\\x0D]``. A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller doc_id. Null ids come last; null and empty texts have no words; texts shorter than a window
    lose nothing; rows that repeat doc_id and text give equal rows; documents of one doc_id do not remove each other's
    words; an empty table gives an empty result; other columns are ignored.
    """
    profiles = stage(documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("raw"), "text").mapInArrow(_profiles(window), PROFILE))
    # Copies: all words of all but the first go, and only the first takes part in what follows.
    firsts = stage(profiles.groupBy("text_sha").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("place"), "raw")).alias("first")).select("text_sha", "first.*"))
    anchors = profiles.select("text_sha", F.explode("anchors").alias("anchor"))
    several = anchors.groupBy("anchor").agg(F.min(F.xxhash64("text_sha")).alias("a"), F.max(F.xxhash64("text_sha")).alias("b")).where("a <> b").select("anchor")
    shared = anchors.join(stage(several), "anchor", "left_semi").groupBy("text_sha").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(shared.join(firsts, "text_sha").select("place", "raw", "text_sha", "anchors"))
    pieces = stage(_texts(documents, wanted).select("place", "text_sha", "anchors", "text").mapInArrow(_fragments(window), FRAGMENT).withColumn("fragment_hash", F.xxhash64("fragment")))
    distinct = stage(pieces.groupBy("anchor", "fragment_hash", "fragment").agg(F.min("place").alias("place")))
    sizes = distinct.groupBy("anchor").agg(F.ceil(F.count("*") / shard_fragments).cast("int").alias("chunks"), F.count("*").alias("fragments"))
    split = distinct.join(sizes.drop("fragments"), "anchor").withColumn("own", F.pmod("fragment_hash", F.col("chunks")).cast("int"))
    # Fragments of a hot anchor meet in pairs of chunks, so no index and no set of questions grows with the anchor.
    ask = split.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    sides = F.array(F.struct(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("indexed"), (F.col("own") == F.col("other")).alias("asked")), F.when(F.col("own") != F.col("other"), F.struct(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("indexed"), F.lit(True).alias("asked"))))
    meeting = ask.select("anchor", "fragment_hash", "fragment", "place", F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("anchor", "fragment_hash", "fragment", "place", "s.*")
    shards = meeting_shards(sizes, shard_fragments, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = meeting.withColumn("shard", F.pmod(F.xxhash64("anchor", "i", "j"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(window), "anchor long, fragment_hash long, firsts array<long>")
    answers = stage(answers)
    met = pieces.select("place", "text_sha", "anchor", "fragment_hash", "start").join(answers, ["anchor", "fragment_hash"])
    hits = F.filter(F.transform("firsts", lambda d, k: F.when(d < F.col("place"), F.col("start") + k)), lambda s: s.isNotNull())
    windows = met.select("place", "text_sha", hits.alias("w")).where(F.size("w") > 0).groupBy("place", "text_sha").agg(F.flatten(F.collect_list("w")).alias("windows"))
    hit = stage(windows.join(firsts, ["place", "text_sha"]))
    cut = stage(_texts(documents, hit).select("place", "text_sha", "windows", "text").mapInArrow(_removed(window), KEPT))
    owned = profiles.select("doc_id", "text_sha", "n_words").join(firsts.select("text_sha", F.col("place").alias("first")), "text_sha")
    copy = (F.col("n_words") >= window) & (F.col("first") < F.coalesce("doc_id", F.lit(LAST)))
    place = F.when(~copy, F.coalesce("doc_id", F.lit(LAST)))
    joined = owned.withColumn("copy", copy).withColumn("place", place).join(cut, ["place", "text_sha"], "left")
    return joined.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "text_sha")).alias("kept_sha256"),
    )
