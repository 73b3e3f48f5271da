"""Token ids of texts in Parquet files, in the order of their ids, and reading them back.

Files: one per range of ids, in order (the name's number is the range's). A row is a text: its id, shard (the range's number), n_tokens,
first (tokens before it in its file) and tokens, a list of ints. The list's values are dictionary pages (a vocabulary of 2^16 entries
fits one dictionary of 1 MB; where it does not, version-2 pages hold deltas instead), and so are the others; row groups hold
ROW_GROUP bytes and pages PAGE bytes at most, with column and offset indexes, so a reader of metadata skips the tokens, and a reader of few ids skips all but
their row groups and pages.

A null or empty text has the end id alone. Rows are ordered by id, nulls first, rows with equal ids by text; repeated rows are written each.
An empty table gives no rows. Columns of other names stay out of the files unless `keep` names them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import NUMBER, Known, char_classes, contractions, distinct_pieces
from .common import batches_by_bytes, prepare, q, table_path, texts_of

ROW_GROUP, PAGE, PAGE_ROWS = 8 << 20, 128 << 10, 2000
OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS), "parquet.page.write-checksum.enabled": "true",
}
LAST_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|\Z)")
NAMES = ("shard", "n_tokens", "first", "tokens")


@lru_cache(1)
def plain_characters() -> np.ndarray:
    """Code points whose class and lower case are beyond doubt and that compose with nothing: Latin letters, ASCII, common punctuation, tab, line feed, return, blank."""
    out = np.zeros(0x110000, bool)
    for first, last in ((0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E)):
        out[first : last + 1] = True
    out[[9, 10, 13]] = True
    return out


class WordEncoder:
    """Ids by the tokenizers library. For a tokenizer that composes, lower-cases, drops white space and merges within words (WORDS and NORMAL say how the file
    must put that) each distinct word is encoded once; for any other, each text goes to the library as it is.

    Texts of plain_characters() are lower-cased and cut into words for a whole batch at once, and distinct words go to the library's model many at a time; the
    model ends each word by a token that ends in `</w>`, which parts their ids again. Other texts are cut at blanks, line feeds and stops that part their
    words whatever stands around them: ASCII letters are lower-cased first, but not in texts with combining marks (there lower case before composition is not the same
    as after), and distinct runs go to the library with a special token between them; a run that might spell such a token goes alone, as ordinary text.
    A text that holds the string of a special token goes to the library whole. With `special` such a string is that token's id, as the library has it unless told
    otherwise; without, ordinary text.
    """

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, content: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.alone, self.joined = (Tokenizer.from_str(content) for _ in range(3))
        self.whole.encode_special_tokens = not special
        self.alone.encode_special_tokens = True  # their strings in a text are ordinary text
        self.specials = [t.content for t in self.joined.get_added_tokens_decoder().values()]
        parsed = json.loads(content)
        cut = [x for x in (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_words = (
            (parsed.get("normalizer") or {}).get("normalizers") == self.NORMAL and len(cut) == 2 and cut[0].get("pattern") == {"Regex": self.WORDS} and cut[0].get("invert") is True
            and cut[1].get("type") == "ByteLevel" and cut[1].get("use_regex") is False and parsed["model"].get("end_of_word_suffix") == "</w>" and parsed.get("post_processor") is None and bool(self.specials)
            and all(t.get("special") and not t.get("normalized") for t in parsed["added_tokens"])
        )
        if self.by_words:
            self.part_id, token = min(self.joined.get_added_tokens_decoder().items())
            self.part = token.content
            words = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, cut[1]]}
            self.model = Tokenizer.from_str(json.dumps(parsed | {"normalizer": None, "pre_tokenizer": words, "added_tokens": []}))
            vocabulary = self.model.get_vocab(False)
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self.known, self.words = Known(), Known()

    def alone_ids(self, text: str) -> list[int]:
        return self.alone.encode(text, add_special_tokens=False).ids

    def runs(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        if b"\xcc" not in raw and b"\xcd" not in raw:
            raw = LAST_STOP.sub(rb" \1", raw.lower())
        return raw.replace(b"\n", b" ").split(b" ")

    def add_runs(self, first: int) -> None:
        texts = [r.decode("utf-8") for r in self.known.fresh(first)]
        for at in range(0, len(texts), 1024):
            some = texts[at : at + 1024]
            odd = [i for i, t in enumerate(some) if self.part[:2] in t]
            own = {i: np.array(self.alone_ids(some[i]), np.int32) for i in odd}
            for i in odd:
                some[i] = ""
            ids = np.array([*self.joined.encode_batch_fast([self.part.join(some)], add_special_tokens=False)[0].ids, self.part_id], np.int32)
            sizes = np.diff(np.flatnonzero(ids == self.part_id), prepend=-1) - 1
            self.known.add(first + at + np.arange(len(some)), sizes, ids[ids != self.part_id])
            for i in odd:
                self.known.add(np.array([first + at + i]), np.array([len(own[i])]), own[i])

    def add_words(self, first: int) -> None:
        spelled = self.words.fresh(first)
        numbers = first + np.array([i for i, w in enumerate(spelled) if not w.isspace()], np.int64)  # white space has no ids
        words = [w.decode("utf-8") for w in spelled if not w.isspace()]
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(some):
                raise ValueError("the tokenizer ends some word by no word end")
            self.words.add(numbers[at : at + 4096], np.diff(ends, prepend=-1), ids)

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of plain characters, none empty."""
        if self.words.crowded():
            self.words.forget()
        whole = "".join(texts).lower()
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        kind, start = char_classes()[codes], np.ones(len(codes) + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[chars[1:]] = True
        contractions(codes, chars[1:], start)
        starts = np.flatnonzero(start[:-1])
        width = np.add.reduceat(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800), starts, dtype=np.int64)
        distinct, which = distinct_pieces(whole.encode("utf-8"), width.cumsum() - width)
        first = len(self.words.numbers)
        numbers = self.words.number(distinct)
        if len(self.words.numbers) > first:
            self.add_words(first)
        ids, at = self.words.ids(numbers[which])
        at = at[np.searchsorted(starts, chars)]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_runs(self, texts: list[str]) -> list[np.ndarray]:
        if self.known.crowded():
            self.known.forget()
        first = len(self.known.numbers)
        numbers = [self.known.number(self.runs(text)) for text in texts]
        if len(self.known.numbers) > first:
            self.add_runs(first)
        return [self.known.ids(index)[0] for index in numbers]

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [np.zeros(0, np.int32)] * len(texts)
        plain = plain_characters()
        way = [
            None if not t else self.encode_whole if not self.by_words or any(s in t for s in self.specials)
            else self.encode_plain if plain[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)].all() else self.encode_runs
            for t in texts
        ]
        for encode in (self.encode_whole, self.encode_plain, self.encode_runs):
            some = [i for i, w in enumerate(way) if w == encode]
            if some:
                for i, ids in zip(some, encode([texts[i] for i in some]), strict=True):
                    out[i] = ids
        return out


@lru_cache(2)
def encoder(content: str, special: bool = True) -> WordEncoder:
    return WordEncoder(content, special)


def write(df: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), special: bool = True) -> str:
    """Write the ids of df's texts, end_id after each, in ascending order of key; the folder written.

    Texts are dealt by ranges of key once, sorted and encoded on their way into the files; ids are not shuffled. With `special` the string of a special token in a text
    is that token's id (the library's default), without it is ordinary text.
    """
    spark = prepare(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    path = path or table_path(spark, "tokens")
    kept = [df.schema[c] for c in keep if c.lower() not in (key.lower(), *NAMES)]
    rows = df.select(q(key).alias(key), *(q(f.name) for f in kept), q(text).alias("_quill_text"))
    ranges = rows.repartitionByRange(q(key)).sortWithinPartitions(q(key), "_quill_text").withColumn("shard", F.spark_partition_id())
    order = [key, *(f.name for f in kept), "shard", "_quill_text"]
    ranges = ranges.select(*(q(c) for c in order))
    kind = T.StructType([*(ranges.schema[c] for c in order[:-1]), T.StructField("n_tokens", T.LongType()), T.StructField("first", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    end = np.array([end_id], np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = encoder(content, special), 0
        for batch in batches_by_bytes(batches, "_quill_text"):
            parts = [x for ids in words.encode(texts_of(batch.column("_quill_text"))) for x in (ids, end)]
            sizes = np.fromiter(map(len, parts[::2]), np.int64, batch.num_rows) + 1
            ends = np.cumsum(sizes)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), pa.array(first + ends - sizes), lists], [f.name for f in kind])
            first += int(ends[-1])

    ranges.mapInArrow(encode, kind).write.options(**OPTIONS).parquet(path)
    return path


def read(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """What write() wrote; naming columns, or filtering on the key, reads only their pages."""
    rows = prepare(spark).read.parquet(path)
    return rows if columns is None else rows.select(*(q(c) for c in columns))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """For each shard, how many tokens all shards before it hold: from metadata columns, a row for each file."""
    sums = read(spark, path, ("shard", "n_tokens")).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.selectExpr("shard AS at", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before")


def checksums(rows: DataFrame, tokens: str = "tokens", out: str = "ids_crc32") -> DataFrame:
    """rows with the crc32 of each list of tokens as unsigned 32-bit little-endian numbers."""
    prepare(rows.sparkSession)

    @F.arrow_udf(T.LongType())
    def crc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            yield pa.array(map(zlib.crc32, (values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)), repeat(0)), pa.int64())

    return rows.withColumn(out, crc(q(tokens)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with start: the tokens of all rows before."""
    offsets = starts(spark, path)
    return read(spark, path).join(offsets, F.col("shard") == F.col("at")).withColumn("start", F.col("before") + F.col("first")).drop("at", "before")
