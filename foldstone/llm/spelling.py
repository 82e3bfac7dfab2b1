"""Spelling variants (operator 12): words of a corpus, their near words, and the form that each is probably a variant of.

Near words differ by one code point. Of every word the rarest bigrams are its prefix, and two of them that don't overlap
are its pivots: one edit can't spoil both. So of two near words one has a pivot that the other has in its prefix, at a
place and a length that one edit can explain. Pivots and prefixes meet by (bigram, place, length); what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.native import lower_ascii, whole_text
from foldstone.session import cut_lineage, stage

# Fixed value: what words are made of.
LETTERS = r"[A-Za-zÀ-ÿ]"
GRAM, PREFIX, PIVOTS = 2, 3, 2  # one edit spoils at most GRAM bigrams, so of GRAM + 1 one is left
# (places, code points) by which a pivot's word may be shorter than where its bigram is found: replaced; inserted after or
# before; deleted after or before.
SHIFTS = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one code point, where ``every`` divides the crc32 of ``<doc_id>:<run>``; else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def word_counts(documents: DataFrame, shortest: int = 6, least: int = 5, every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z lower-cased, of at least ``shortest`` code points and ``least``
    occurrences. ``every`` makes one in so many (document, run) pairs a misspelt one, by its hash."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(whole_text(), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run")).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = runs.select((damaged(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pivots(prefix: list[tuple[int, str, int]], count: int = PIVOTS) -> list[tuple[int, str, int]]:
    """Of some grams (frequency, gram, place) ``count`` that don't overlap, with the least frequencies in sum.

    best[k] has the cheapest choice of k grams among the places so far; a gram extends the choices that end before it.
    """
    ordered = sorted(prefix, key=lambda g: g[2])
    best: list[list[tuple[int, list]]] = [[(0, [])] for _ in ordered] + [[(0, [])]]
    for i, gram in enumerate(ordered):
        earlier = max((j + 1 for j in range(i) if ordered[j][2] + GRAM <= gram[2]), default=0)
        row = [(0, [])]
        for k in range(1, count + 1):
            choices = [best[i][k]] if len(best[i]) > k else []
            if len(best[earlier]) >= k:
                cost, chosen = best[earlier][k - 1]
                choices.append((cost + gram[0], [*chosen, gram]))
            if not choices:
                break
            row.append(min(choices, key=lambda c: c[0]))
        best[i + 1] = row
    return best[-1][count][1]


def signature(word: str, frequency: dict[str, int]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Prefix and pivots of a word. The prefix has all places of its last gram, so that gram's place doesn't decide."""
    grams = sorted((frequency[word[p : p + GRAM]], word[p : p + GRAM], p) for p in range(len(word) - GRAM + 1))
    last = grams[PREFIX - 1][:2]
    return [g for g in grams if g[:2] <= last], pivots(grams[:PREFIX])


def _signatures(frequency: dict[str, int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column("word").to_pylist():
                prefix, chosen = signature(word, frequency)
                last = f"{prefix[-1][0]:020d}{prefix[-1][1]}"
                out += [(word, gram, place, len(word), False, last) for _, gram, place in prefix]
                out += [(word, gram, place, len(word), True, last) for _, gram, place in chosen]
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "gram", "place", "size", "pivot", "last"])

    return of


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near) in both directions: words that differ by one inserted, deleted or replaced code point.

    ``words`` has distinct words of at least six code points in its column word. The frequencies of bigrams reach the driver;
    there are at most as many as pairs of letters (8,100).
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda p: F.substr("word", p, F.lit(GRAM)))).alias("gram"))
    frequency = {gram: n for gram, n in grams.groupBy("gram").count().collect()}
    signed = stage(words.select("word").mapInArrow(_signatures(frequency), "word string, gram string, place int, size int, pivot boolean, last string"))
    shifted = F.explode(F.array(*[F.struct((F.col("place") + p).alias("place"), (F.col("size") + s).alias("size")) for p, s in SHIFTS])).alias("at")
    asking = signed.where("pivot").select(F.col("word").alias("a"), "gram", F.col("last").alias("last_a"), shifted).select("a", "gram", "last_a", "at.*")
    found = signed.where("NOT pivot").select(F.col("word").alias("b"), "gram", "place", "size", F.col("last").alias("last_b"))
    met = asking.join(found, ["gram", "place", "size"]).where("last_a <= last_b AND a <> b")
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("pair")).select("pair.*")


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds root to (word, form): from the word follow forms to the last. Each round doubles the steps that are followed.

    Counts rise at least fivefold along forms, so few rounds are needed whatever the number of words.
    """
    at = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(onward, "root", "left")
        if moved.where("next IS NOT NULL").isEmpty():
            return forms.join(at, "word")
        at = cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root")))


def variants(documents: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, every: int | None = None) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, of at least ``shortest`` (six or more) code points,
    that occur ``least`` times in all documents. A word's form is its near word of the largest count, the first in code point
    order among equals, if that count is at least ``ratio`` times its own; root is where forms lead to. ``every`` damages one in
    so many (document, run) pairs first, see ``damaged``; null ids count as empty there. Null and empty texts have
    no words. Repeated rows count again, an empty table gives an empty result, and other columns are ignored.
    """
    if shortest < GRAM * (PREFIX - 1) + GRAM:
        raise ValueError("words of fewer than six code points don't have enough bigrams")
    words = stage(word_counts(documents, shortest, least, every))
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near"))).alias("best"))
    with_best = words.join(best, "word", "left")
    is_form = -F.col("best.rank") >= ratio * F.col("n")
    forms = stage(with_best.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.rank")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
