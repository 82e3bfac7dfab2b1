"""N-gram Jaccard join (operator 6): prefix filtering finds blocks of documents, a trie joins the sets of each block.

The n-grams of a document are a set of 64-bit hashes. Two sets of the wanted similarity lack few of each other's n-grams,
so each of them must find enough of its smallest n-grams in other sets; what does not is left out early. The rest falls
into cells: sets of two neighbouring size classes that n-grams of their prefixes connect, in an order that puts frequent
n-grams last. The sets of a cell are compared, large cells in chunks: sets ordered by falling frequency are stored in a
trie, and one walk carries the overlaps of all asking sets along shared paths. Sets travel as texts where these are short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.components import components
from foldstone.llm.native import blocked_filter, possible_hits, unused, with_hits
from foldstone.llm.words import Words, lists, mix, runs, slices
from foldstone.session import stage

LAST = 2**63 - 1
# Null ids get numbers of their own in the last 2^40, by text.
NULL_IDS = LAST - (1 << 40)
# N-grams that one chunk of a cell holds, about; a task holds two chunks. A set counts as so many n-grams at least, which
# bounds the sets of a chunk, too.
CHUNK_NGRAMS, SET_COST = 400_000, 20
# Quarters of a prefix that the second look takes.
CLOSER = 16
# A set is kept as its text if that has so many bytes for each n-gram at most: texts are compressed, hashes can't be.
TEXT_BYTES = 16
# An n-gram counts as frequent from so many sets on; the filter of frequent n-grams has so many blocks of 64 bits.
FREQUENT, FREQUENT_BLOCKS = 64, 1 << 16

PROFILE = "place long, raw long, row long, doc_id long, n long, a long, b long, prefix array<long>"
MEMBER = "place long, n long, copies long, text binary, grams binary, leads array<long>"


def _place():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_IDS) + F.pmod(F.xxhash64("text"), F.lit(1 << 40)))


def prefix_length(n, percent: int):
    """Elements of which one at least is shared: a linked set lacks at most n - ceiling(percent * n / 100) of n. Numbers or columns."""
    return (n * (100 - percent) - n * (100 - percent) % 100) / 100 + 1


def looked_at(n: int, percent: int, quarters: int = 5) -> int:
    """Elements that are looked at, in quarters of a prefix."""
    prefix = n * (100 - percent) // 100 + 1
    return min(n, prefix * quarters // 4)


def needed(n: Column, percent: int, quarters: int = 5) -> Column:
    """How many of the elements that are looked at must be shared with the part of a linked set, whatever its size.

    Sets of n and m elements that link share at least t. Elements that only one of the two has may all come first, so their
    parts share no less than t minus what either part lacks to the whole set. The least over all sizes m that can link counts.
    """

    def offered(m: Column) -> Column:
        shared = F.ceil(percent * (n + m) / (100 + percent))
        return F.least(shared, *[shared - (size - F.least(size, F.floor(prefix_length(size, percent) * quarters / 4))) for size in (n, m)])

    return F.array_min(F.transform(F.sequence(F.ceil(n * percent / 100), F.floor(n * 100 / percent)), offered))


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of every text, sorted; texts of fewer words have their whole sequence as one."""
    split = Words(batch.column("text"), lower=True)
    hashes = split.hashes()
    grams = runs(hashes, words)
    for t in range(batch.num_rows):
        first, count = int(split.first[t]), int(split.counts[t])
        if count >= words:
            yield np.unique(grams[first : first + count - words + 1])
        elif count:
            yield runs(hashes[first : first + count], count) ^ np.uint64(count)
        else:
            yield np.zeros(0, np.uint64)


def _profiles(words: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, a, b, prefixes = [], [], [], []
            for grams in _sets(batch, words):
                size = len(grams)
                n.append(size)
                a.append(int(mix(grams).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                prefixes.append(grams[: looked_at(size, percent)].view(np.int64))
            counts = [len(p) for p in prefixes]
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            own = [batch.column(c) for c in ("place", "raw", "row", "doc_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists(flat, counts, pa.int64())], ["place", "raw", "row", "doc_id", "n", "a", "b", "prefix"])

    return of


def _passes(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The test of ``native.blocked_filter`` on an array: may the n-grams be in the filter?"""
    key = grams.view(np.int64)
    mask = np.zeros(len(key), np.int64)
    for shift in (28, 36, 44, 52):
        mask |= np.int64(1) << ((key >> np.int64(shift)) & np.int64(63))
    return bits[key & np.int64(len(bits) - 1)] & mask == mask


def _members(words: int, percent: int, bits: np.ndarray):
    """Whole sets, as texts or n-grams, and their prefixes with frequent n-grams put last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text").cast(pa.binary())
            sets, leads = [], []
            for grams, size in zip(_sets(batch, words), pc.binary_length(text).to_pylist()):
                frequent = _passes(grams, bits)
                ordered = np.concatenate([grams[~frequent], grams[frequent]])
                leads.append(ordered[: len(grams) * (100 - percent) // 100 + 1].view(np.int64))
                sets.append(grams.tobytes() if size > TEXT_BYTES * len(grams) else None)
            flat = np.concatenate(leads) if leads else np.zeros(0, np.int64)
            keep = [batch.column(c) for c in ("place", "n", "copies")]
            grams = pa.array(sets, pa.binary())
            text = text.take(pa.array([k if g is None else None for k, g in enumerate(sets)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*keep, text, grams, lists(flat, [len(x) for x in leads], pa.int64())], ["place", "n", "copies", "text", "grams", "leads"])

    return of


def _kept_sets(text: pa.Array, grams: pa.Array, words: int) -> list[np.ndarray]:
    """The sets that ``_members`` has made."""
    both = pa.RecordBatch.from_arrays([text.cast(pa.large_binary()).view(pa.large_string()), grams], ["text", "grams"])
    return [np.frombuffer(g.as_buffer(), np.uint64) if g.is_valid else own for part in slices(iter([both])) for own, g in zip(_sets(part, words), part.column("grams"))]


def _closer(words: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _kept_sets(batch.column("text"), batch.column("grams"), words)
            parts = [g[: looked_at(len(g), percent, CLOSER)].view(np.int64) for g in sets]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("place"), lists(flat, [len(p) for p in parts], pa.int64())], ["place", "part"])

    return of


class Trie:
    """Radix trie of ordered sets: a node has a run of elements that all sets below it share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.nodes = sets, []
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        stack = [(0, len(order), 0, -1)]
        sizes = np.array([len(sets[i]) for i in order])
        while stack:
            low, high, depth, parent = stack.pop()
            first, last = sets[order[low]], sets[order[high - 1]]
            limit = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:limit] != last[depth:limit])
            end = depth + int(differ[0]) if len(differ) else limit
            begin = low
            while begin < high and len(sets[order[begin]]) == end:
                begin += 1
            me = len(self.nodes)
            self.nodes.append((parent, first[depth:end], end, int(sizes[low:high].min()), int(sizes[low:high].max()), order[low:begin]))
            while begin < high:
                head = sets[order[begin]][end]
                stop = begin + 1
                while stop < high and sets[order[stop]][end] == head:
                    stop += 1
                stack.append((begin, stop, end, me))
                begin = stop


def _counted(postings: list[np.ndarray], of: np.ndarray, total: int) -> np.ndarray:
    """How often each of the (ordered) sets stands in the postings."""
    flat = np.concatenate(postings)
    if 8 * len(flat) > total:
        return np.bincount(flat, minlength=total)[of]
    found, times = np.unique(flat, return_counts=True)
    out, at = np.zeros(len(of), np.int64), np.minimum(np.searchsorted(of, found), len(of) - 1)
    same = of[at] == found
    out[at[same]] = times[same]
    return out


def trie_join(indexed: list[np.ndarray], asking: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each indexed set the asking sets of Jaccard similarity at least percent / 100, by position.

    Elements are ordered by falling frequency, so that sets share long paths. A node's run is counted once for all sets
    that ask; a subtree is left as soon as no asking set can still reach the wanted similarity with the elements that remain.
    """
    flat = np.concatenate([*indexed, *asking])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    ranked, ends = rank[number.ravel()], np.cumsum([len(s) for s in [*indexed, *asking]])
    ordered = [np.sort(x) for x in np.split(ranked, ends[:-1])]
    keys, questions = ordered[: len(indexed)], ordered[len(indexed) :]
    size = np.array([len(q) for q in questions])
    holder = np.repeat(np.arange(len(questions)), size)
    elements = np.concatenate(questions)
    by = np.argsort(elements, kind="stable")
    holder, places = holder[by], np.searchsorted(elements[by], np.arange(len(count) + 1))
    # Nodes come depth first, so only the path to a node is kept, and on it only the sets that can still be reached.
    path = [(-1, np.arange(len(questions)), np.zeros(len(questions), np.int64))]
    for at, (parent, run, depth, smallest, largest, here) in enumerate(Trie(keys).nodes):
        while path[-1][0] > parent:
            path.pop()
        if path[-1][0] != parent:  # nothing was left there
            continue
        _, asking_here, above = path[-1]
        postings = [holder[places[e] : places[e + 1]] for e in run.tolist()]
        overlap = above + _counted(postings, asking_here, len(questions)) if postings else above
        own = size[asking_here]
        for i in here:
            yield i, asking_here[(100 + percent) * overlap >= percent * (depth + own)]
        reach = overlap + np.minimum(largest - depth, own - overlap)
        alive = ((100 + percent) * reach >= percent * (np.maximum(smallest, reach) + own)) & (100 * largest >= percent * own) & (100 * own >= percent * smallest)
        if alive.any():
            path.append((at, asking_here[alive], overlap[alive]))


def _joined(words: int, percent: int):
    """Links found in the meetings (cell, i, j) of a task: rows (u, v) of a spanning forest, and (u, links) counts.

    A cell has sets of one size class as natives and sets of the class below as guests; natives meet natives and guests.
    Chunks i and j of a cell meet in one task.
    """

    def meeting(rows: pd.DataFrame, out: list[tuple]) -> None:
        sets = _kept_sets(pa.array(rows["text"], pa.binary(), from_pandas=True), pa.array(rows["grams"], pa.binary(), from_pandas=True), words)
        place, copies = rows["place"].to_numpy(), rows["copies"].to_numpy()
        native, first = rows["native"].to_numpy(), (rows["own"] == rows["i"]).to_numpy()
        group, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)

        def compare(left: np.ndarray, right: np.ndarray, mutual: bool = False) -> None:
            if not len(left) or not len(right):
                return
            for i, found in trie_join([sets[k] for k in left], [sets[k] for k in right], percent):
                me, others = left[i], right[found]
                others = others[others != me]
                links[me] += copies[others].sum()
                if not mutual:  # else the others find this one, too
                    links[others] += copies[me]
                groups, one = np.unique(group[others], return_index=True)
                for g, o in zip(groups.tolist(), others[one].tolist()):
                    if g != group[me]:
                        out.append((int(place[me]), int(place[o]), None))
                        group[group == g] = group[me]

        if first.all():
            compare(np.flatnonzero(native), np.flatnonzero(native), mutual=True)
            compare(np.flatnonzero(native), np.flatnonzero(~native))
        else:
            compare(np.flatnonzero(native & first), np.flatnonzero(~first))
            compare(np.flatnonzero(native & ~first), np.flatnonzero(~native & first))
        out.extend((p, None, n) for p, n in zip(place.tolist(), links.tolist()) if n)

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (_, i, j), part in rows.groupby(["cell", "i", "j"], sort=False):
            if i == j or part["own"].nunique() == 2:
                meeting(part, out)
        return pd.DataFrame({"u": pd.array([o[0] for o in out], "Int64"), "v": pd.array([o[1] for o in out], "Int64"), "links": pd.array([o[2] for o in out], "Int64")})

    return of


def linked_sets(documents: DataFrame, words: int = 4, percent: int = 85, chunk_ngrams: int = CHUNK_NGRAMS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    A text's words are runs outside ``[\\x20\\x09-\\x0D]``, with A-Z lower-cased; its set has its distinct runs of ``words``
    words, or its whole sequence if it is shorter. Null, empty and blank texts have an empty set and are linked with
    nothing. Documents link when their sets have a Jaccard similarity of at least percent / 100; ``n_links`` counts a
    document's links, ``component_id`` is the smallest doc_id that links lead to. Rows of one doc_id count as one document
    for components; a null id stands after all others, and a component of null ids only has a null id. An empty table gives
    an empty result; other columns are ignored.
    """
    placed = documents.select(_place().alias("place"), F.xxhash64("text").alias("raw"), F.col("doc_id").cast("long"), "text")
    profiles = stage(placed.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_profiles(words, percent), PROFILE))
    sets = stage(profiles.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("place", "raw", "row")).alias("first"), F.count("*").alias("copies")).select("a", "b", "n", "first.*", "copies"))
    edges, links = _links(placed, profiles, sets, words, percent, chunk_ngrams)
    found = stage(components(edges))
    of_set = sets.join(found.withColumnRenamed("node", "place"), "place", "left").join(links, "place", "left")
    of_set = stage(of_set.select("a", "b", "n", F.coalesce("component", "place").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    joined = profiles.select("doc_id", "place", "n", "a", "b").join(of_set, ["a", "b", "n"], "left")
    component = F.coalesce("component", "place")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(component < NULL_IDS, component).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _links(placed: DataFrame, profiles: DataFrame, sets: DataFrame, words: int, percent: int, chunk_ngrams: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) between first documents of linked sets, a spanning forest of each cell, and their numbers of links."""
    # One row of each set is counted. A copy that the filter lets pass by chance only has more sets looked at.
    firsts = possible_hits(profiles, F.xxhash64("row"), blocked_filter(sets.select(F.xxhash64("row").alias("h")), "h"))
    several = stage(firsts.select(F.explode("prefix").alias("gram")).groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"))
    # Most n-grams are in one set only; the filter keeps those from being shuffled again.
    repeated = possible_hits(profiles.select("place", F.explode("prefix").alias("gram")), F.col("gram"), blocked_filter(several, "gram"))
    enough = repeated.join(several.select("gram"), "gram").groupBy("place").count()
    near = stage(sets.join(enough, "place").where(F.col("count") >= needed(F.col("n"), percent)).select("place", "raw", "n", "copies"))
    # What many sets share, such as a common passage, comes last in the order, so it brings only sets together that have
    # little else. The filter has a fixed size; an n-gram that passes by chance is last for all sets alike.
    bits = np.zeros(FREQUENT_BLOCKS, np.int64)
    for block, found in blocked_filter(several.where(F.col("m") >= FREQUENT), "gram", FREQUENT_BLOCKS).collect():
        bits[block] = found
    known = blocked_filter(near.select(F.xxhash64("place", "raw").alias("h")), "h")
    texts = possible_hits(placed.drop("doc_id"), F.xxhash64("place", "raw"), known).join(near, ["place", "raw"]).dropDuplicates(["place", "raw"])
    held = stage(texts.select("place", "n", "copies", "text").mapInArrow(_members(words, percent, bits), MEMBER))
    # The few sets that are left are looked at more closely, among themselves. A set has an n-gram once, so the rows of one
    # n-gram are as many as the sets at most.
    grams = held.select("place", "text", "grams").mapInArrow(_closer(words, percent), "place long, part array<long>").select("place", F.explode("part").alias("gram"))
    same = Window.partitionBy("gram")
    enough = grams.select("place", F.min("place").over(same).alias("x"), F.max("place").over(same).alias("y")).where("x <> y").groupBy("place").count()
    solid = stage(held.select("place", "n").join(enough, "place").where(F.col("count") >= needed(F.col("n"), percent, CLOSER)).select("place", "n"))
    placed_in = stage(_cells(held, solid, percent))
    dealt = stage(_dealt(placed_in, chunk_ngrams))
    moved = possible_hits(held.select("place", "copies", "text", "grams"), F.xxhash64("place"), blocked_filter(dealt.select(F.xxhash64("place").alias("h")), "h"))
    other = moved.join(dealt, "place").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    meetings = other.select("place", "copies", "cell", "native", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "text", "grams")
    total = dealt.agg(F.sum(F.col("cost") * F.col("meets"))).first()[0] or 0
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // chunk_ngrams + 1)
    found = meetings.withColumn("task", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(tasks))).groupBy("task").applyInPandas(_joined(words, percent), "u long, v long, links long")
    found = stage(found)
    return found.where("v IS NOT NULL").select("u", "v"), found.where("links IS NOT NULL").groupBy(F.col("u").alias("place")).agg(F.sum("links").alias("links"))


def _cells(held: DataFrame, solid: DataFrame, percent: int) -> DataFrame:
    """The cells of each set: place, n, cell, native.

    Sizes of linked sets differ by less than a class is wide (a little more than the similarity allows), so they meet in
    the class of the larger one, where the class below are guests. Only sets of one class and its guests are connected: over
    all sizes, n-grams of passages that a few sets share connect ever more of the sets as these become more.
    """
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    size_class = F.floor(F.log("n") / width)
    classes = F.explode(F.array(F.struct(size_class.alias("q"), F.lit(True).alias("native")), F.struct((size_class + 1).alias("q"), F.lit(False).alias("native"))))
    leads = held.select("place", "n", "leads").join(solid.select("place"), "place", "left_semi").select("place", "leads", classes.alias("c")).select("place", "c.q", "c.native", F.explode("leads").alias("gram"))
    heads = leads.groupBy("gram", "q").agg(F.min("place").alias("head"), F.max("place").alias("other"), F.bool_or("native").alias("met"))
    heads = stage(heads.where("head <> other AND met").select("gram", "q", "head"))
    # A set is a node in each of its classes.
    cells = stage(components(leads.join(heads, ["gram", "q"]).select(F.xxhash64("place", "q").alias("u"), F.xxhash64("head", "q").alias("v"))))
    nodes = solid.select("place", "n", classes.alias("c")).select("place", "n", "c.native", F.xxhash64("place", "c.q").alias("node"))
    return nodes.join(cells, "node").select("place", "n", F.col("component").alias("cell"), "native")


def _dealt(placed_in: DataFrame, chunk_ngrams: int) -> DataFrame:
    """The sets that meet others: place, cell, native, cost, own chunk, and with the chunks of how many first numbers it meets.

    A cell that is too large for one chunk has its natives in chunks 0 to k - 1 and its guests in those behind. Guests meet
    natives only, so they are sent once for each chunk of natives.
    """
    cost = F.greatest("n", F.lit(SET_COST))
    placed_in = placed_in.withColumn("cost", cost)
    sizes = placed_in.groupBy("cell").agg(F.sum("cost").alias("total"), F.sum(F.when(F.col("native"), F.col("cost"))).alias("of_natives"), F.count("*").alias("m")).where("of_natives > 0 and m > 1")
    chunks = lambda n: F.ceil(F.col(n) / chunk_ngrams).cast("int")
    one = F.col("total") <= chunk_ngrams
    sizes = sizes.withColumn("rest", F.col("total") - F.col("of_natives"))
    sizes = sizes.select("cell", F.when(one, 1).otherwise(chunks("of_natives")).alias("natives"), F.when(one, 0).otherwise(chunks("rest")).alias("guests"))
    number = lambda n: F.pmod(F.xxhash64("place"), F.greatest(F.col(n), F.lit(1))).cast("int")
    own = F.when(F.col("native"), number("natives")).when(F.col("guests") == 0, 0).otherwise(F.col("natives") + number("guests"))
    meets = F.when(F.col("native"), F.col("natives") + F.col("guests")).otherwise(F.col("natives"))
    return placed_in.join(sizes, "cell").select("place", "cell", "native", "cost", own.alias("own"), meets.alias("meets"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when one of each component of linked documents stays, with all their columns.

    The one with the smallest doc_id stays; rows that repeat it stay with it. Only rows that may go are moved.
    """
    found = linked_sets(documents, words, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull())
    flag, left = unused(documents, "__maybe", "__gone")
    gone = stage(found.select(F.col("doc_id").alias(left)).distinct())
    flagged = with_hits(documents, F.xxhash64(F.col("doc_id").cast("long")), blocked_filter(gone.select(F.xxhash64(left).alias("h")), "h"), flag)
    kept = flagged.where(F.col(flag)).join(gone, F.col("doc_id") == F.col(left), "left_anti")
    return kept.unionByName(flagged.where(~F.col(flag))).drop(flag)
