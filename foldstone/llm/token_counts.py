"""Token counts (operator 8): whole documents are encoded once, and tokens are attributed to sections by their characters."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.llm.byte_bpe import merge_words, vocabulary_at
from foldstone.llm.words import Words, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The library's splitter overflows its stack on long runs of white space; runs from this length on are encoded apart.
LONG_SPACE = re.compile(r"\s{10000,}")
SECTIONS = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str, pattern: str):
    """The tokenizer, and the number of bytes of every token."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, vocabulary: str, pattern: str) -> np.ndarray:
    """The tokens of a text. A match always ends where white space begins; of a run before other signs all but the last
    character are one match."""
    encoding, _ = _encoding(vocabulary, pattern)
    parts, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts.append(np.asarray(encoding.encode_ordinary(text[at : run.start()]), np.int64))
        parts.append(merge_words([text[run.start() : end].encode("utf-8")], vocabulary_at(vocabulary))[0])
        at = end
    parts.append(np.asarray(encoding.encode_ordinary(text[at:] if at else text), np.int64))
    return np.concatenate(parts)


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses a boundary. Both give ends of spans that cover the same characters.

    The rule: a token belongs to the section that holds most of its characters, and of equal parts to the earliest. A token
    without a whole character (one of several for a character) belongs where the character is that it ends in.
    """
    starts = np.concatenate([[0], token_ends])[:-1].astype(np.int64)
    low = np.searchsorted(section_ends, starts, side="right")
    high = np.maximum(low, np.searchsorted(section_ends, token_ends, side="left"))
    low, high = np.minimum(low, len(section_ends) - 1), np.minimum(high, len(section_ends) - 1)
    owner, crossing = low.copy(), high > low
    begins = np.concatenate([[0], section_ends[:-1]])
    for t in np.flatnonzero(crossing).tolist():
        sections = np.arange(low[t], high[t] + 1)
        part = np.minimum(token_ends[t], section_ends[sections]) - np.maximum(starts[t], begins[sections])
        owner[t] = sections[int(part.argmax())]
    return owner, crossing


def _sections(vocabulary: str, pattern: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes = _encoding(vocabulary, pattern)
        for batch in slices(batches):
            raw, out = Words(batch.column("text")), []
            for t in range(batch.num_rows):
                text = raw.bytes_of(t)
                data = np.frombuffer(text, np.uint8)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                ends = chars[np.append(np.flatnonzero(data[:-1] == 10) + 1, len(data))] if len(data) else np.zeros(1, np.int64)
                tokens = encode(text.decode("utf-8"), vocabulary, pattern)
                owner, crossing = attribute(chars[np.cumsum(sizes[tokens])], ends)
                count = len(ends)
                begins = np.concatenate([[0], ends[:-1]])
                out.append((np.full(count, t), np.arange(count), begins, ends, np.bincount(owner, minlength=count), np.bincount(owner[crossing], minlength=count)))
            columns = [np.concatenate(c) for c in zip(*out)]
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return of


def section_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per section of each document: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    Sections are lines with their line ends; they cover the whole text. Each document is encoded once as a whole, so the
    counts of its sections add up to its number of tokens; ``attribute`` states to whom a token across a boundary goes, and
    ``n_crossing`` counts those a section got. A null or empty text has one empty section without tokens. Repeated rows
    count apart, an empty table gives an empty result, and other columns are ignored. The vocabulary file must be at the
    same path on all machines.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_sections(vocabulary, pattern), SECTIONS)
