"""Tokens of whole documents, attributed to their fields or lines by character spans."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.frames import text_of
from moodtide.session import bounded_batches

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging. Fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in long runs, which the matcher of the pattern cannot take back step by step.
LONG_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")
MAX_RANKS_BYTES = 64 << 20
SECTIONS = "array<struct<section:int,begin:int,end:int,n_tokens:int,n_crossing:int>>"


class Tokenizer:
    """The ranks of a vocabulary, shared once with all tasks (at most MAX_RANKS_BYTES)."""

    def __init__(self, spark: SparkSession, path: str = RANKS_PATH, pattern: str = PATTERN) -> None:
        with open(path, "rb") as file:
            data = file.read(MAX_RANKS_BYTES + 1)
        if len(data) > MAX_RANKS_BYTES:
            raise ValueError(f"{path} has more than {MAX_RANKS_BYTES} bytes")
        self.data = bounded_batches(spark).sparkContext.broadcast(data)
        self.pattern = pattern

    def load(self) -> tuple[tiktoken.Encoding, np.ndarray]:
        """The encoding, and the bytes of each token."""
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.value.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(a) for a in ranks]
        return tiktoken.Encoding("shared", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a whole text.

    By PATTERN a run of white space is one part up to its last character, which goes with what
    follows, or the whole run where the text ends. Long runs are merged as that part by themselves,
    so the tokens are those of the text encoded at once. Other patterns are left to the encoding.
    """
    out: list[int] = []
    at = 0
    for run in LONG_BLANKS.finditer(text) if encoding._pat_str == PATTERN else ():
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:] if at else text)


def char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in characters of tokens that have ``sizes`` bytes one after the other.

    A character whose bytes lie in several tokens is in the span of each of them.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return begins, ends
    char_at = np.cumsum((data & 0xC0) != 0x80) - 1
    return char_at[begins], char_at[ends - 1] + 1


def attribute(begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Section starts, their tokens, and those of them that cross into other sections.

    Sections have ``lengths`` characters and ``gap`` characters between them. A token belongs to
    the section it has the most characters of, the earlier one if equal; a token with characters of
    a gap only, or that touches one section and gaps, to the section at or before its begin, unless
    it begins in a gap and ends in the next section, which then has it.
    """
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + gap)]).astype(np.int64)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    home, crossing = first.copy(), np.zeros(len(begins), bool)
    for t in np.flatnonzero(first != last):
        spanned = np.arange(first[t], last[t] + 1)
        shared = np.minimum(ends[t], starts[spanned] + lengths[spanned]) - np.maximum(begins[t], starts[spanned])
        home[t] = spanned[int(np.argmax(np.maximum(shared, 0)))]
        crossing[t] = (shared > 0).sum() > 1
    n = len(lengths)
    return starts, np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)


def section_tokens(text: Column, lengths: Column, tokenizer: Tokenizer, gap: int) -> Column:
    @F.arrow_udf(SECTIONS)
    def counted(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoding, token_bytes = tokenizer.load()
        for texts, sections in parts:
            offsets, columns = [0], [[], [], [], [], []]
            for text, lengths in zip(texts, sections):
                text = text.as_py()
                lengths = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = token_bytes[encode(encoding, text)]
                starts, tokens, crossing = attribute(*char_spans(text, sizes), lengths, gap)
                for column, values in zip(columns, (np.arange(len(lengths)), starts, starts + lengths, tokens, crossing)):
                    column.append(values.astype(np.int32))
                offsets.append(offsets[-1] + len(lengths))
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int32), pa.int32()) for c in columns]
            structs = pa.StructArray.from_arrays(arrays, ["section", "begin", "end", "n_tokens", "n_crossing"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)

    return counted(text, lengths)


def count_tokens(text: Column, tokenizer: Tokenizer) -> Column:
    """Number of tokens of a whole text."""

    @F.arrow_udf("int")
    def counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding, _ = tokenizer.load()
        for texts in parts:
            yield pa.array([len(encode(encoding, t.as_py() or "")) for t in texts], pa.int32())

    return counted(text)


def line_tokens(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every line: doc_id, section, begin, end, n_tokens, n_crossing.

    A document is encoded once, as a whole. Lines are numbered from 0, and begin and end are
    characters of the text, the line break between them left out. The sum of n_tokens over the
    lines is the number of tokens of the document; n_crossing are the tokens a line was given of
    which other lines hold characters too. A null or empty text is one line without tokens.
    Repeated rows are counted each for itself.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    lengths = F.transform(F.split("text", "\n"), F.char_length)
    found = section_tokens(F.col("text"), lengths, tokenizer, 1)
    return rows.select("doc_id", found.alias("found")).select("doc_id", F.inline("found"))


def field_tokens(docs: DataFrame, fields: list[str], tokenizer: Tokenizer, separator: str = "\n\n", id_col: str = "doc_id") -> DataFrame:
    """Tokens of every field of records that are encoded as one text: doc_id, field, n_tokens, n_crossing.

    The fields are joined by ``separator`` (not empty), null fields as empty ones, and its
    characters belong to no field; tokens that touch it are given away as ``attribute`` says.
    """
    if not separator:
        raise ValueError("fields need a separator")
    values = [text_of(f) for f in fields]
    whole = F.concat_ws(separator, *values)
    found = section_tokens(whole, F.array(*[F.char_length(v) for v in values]), tokenizer, len(separator))
    names = F.array(*[F.lit(f) for f in fields])
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).select(
        "doc_id", F.inline("found")
    ).select("doc_id", F.get(names, F.col("section")).alias("field"), "n_tokens", "n_crossing")
