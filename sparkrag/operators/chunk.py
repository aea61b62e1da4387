"""Fragmenting documents into overlapping token windows, in the JVM.

A token is a run of characters that aren't white space with the white space that follows it (or white space at the
start of a text): tokens put together are the text, so a window's text is the source's own, with exact offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FragmentationError
from ..functions.text import non_blank, word_count

TOKEN = r"\S+\s*|\s+"


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens at a stride of size - overlap, up to the first that reaches the end."""
    more = F.ceil((n - size) / F.lit(float(size - overlap)))
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(0), more) + 1).cast("int")


def tokens(content: Column | str) -> Column:
    return F.regexp_extract_all(F.col(content) if isinstance(content, str) else content, F.lit(TOKEN), F.lit(0))


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row. A projection's expression would be copied into each place that
    uses it, such as the body of a loop over windows, and into a filter below a generator; a generator's output isn't."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def token_windows(docs: DataFrame, size: int = 256, overlap: int = 64, source_id: str = "source_id", content: str = "content", keep: list[str] = ()) -> DataFrame:
    """Chunks of documents: source_id, chunk_index, content, start_char, end_char, token_count and the ``keep`` columns.

    Blank windows are dropped and don't count. Narrow: nothing is shuffled, since windows are numbered within their row.
    """
    check_window(size, overlap)
    stride = size - overlap
    rows = _settled(docs.select(F.col(source_id).alias("source_id"), *keep, F.col(content).alias("_c")), "_t", tokens("_c")).drop("_c")
    n = F.size("_t")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)
    piece = lambda i: F.slice(F.col("_t"), i * stride + 1, size)
    numbers = F.sequence(F.lit(0), n_windows(n, size, overlap) - 1)
    # characters of each stride, so that a window's offset is a sum over strides, not over tokens
    rows = _settled(rows.where(n > 0), "_p", F.transform(numbers, lambda i: total(F.transform(F.slice(F.col("_t"), i * stride + 1, stride), lambda x: F.char_length(x)))))
    window = F.transform(numbers, lambda i: F.struct(i.alias("i"), F.array_join(piece(i), "").alias("content"), F.size(piece(i)).alias("token_count"), total(F.slice(F.col("_p"), F.lit(1), i)).alias("start_char")))
    rows = _settled(rows, "_w", F.filter(window, lambda w: non_blank(w.content)))
    out = rows.select("source_id", *keep, F.posexplode("_w").alias("chunk_index", "_x"))
    return out.select("source_id", *keep, "chunk_index", F.col("_x.content").alias("content"), F.col("_x.start_char").alias("start_char"), (F.col("_x.start_char") + F.char_length("_x.content")).alias("end_char"), F.col("_x.token_count").alias("token_count"))


def windows_by(docs: DataFrame, encode, size: int = 256, overlap: int = 64, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """Windows over any tokenizer. ``encode()`` is called once a worker and gives a function text -> list of end offsets
    (in characters) of its tokens; ``tiktoken_offsets`` and ``bpe_offsets`` make such functions."""
    check_window(size, overlap)
    schema = pa.schema([("source_id", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("token_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = encode()
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends = ends_of(text or "")
                if not ends:
                    continue
                at = index = 0
                while True:
                    last = min(at + size, len(ends))
                    a, b = ends[at - 1] if at else 0, ends[last - 1]
                    if text[a:b].strip():
                        rows.append((name, index, text[a:b], a, b, last - at))
                        index += 1
                    if last == len(ends):
                        break
                    at += size - overlap
            yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col(source_id).cast("string"), F.col(content).cast("string")).mapInArrow(run, "source_id string, chunk_index int, content string, start_char int, end_char int, token_count int")


def bpe_offsets(path: str):
    """Token ends by a tokenizer file of the tokenizers library."""

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: [b for _, b in tokenizer.encode(text, add_special_tokens=False).offsets]

    return make


def tiktoken_offsets(path: str, pattern: str):
    """Token ends by a file of ranks (base64 token and rank a line) and the pattern that cuts texts first.

    A token can end inside a character; the character then counts to the token that completes it.
    """

    def make():
        import base64

        import tiktoken

        with open(path, encoding="ascii") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = {i: sum((b & 0xC0) != 0x80 for b in token) for token, i in ranks.items()}  # characters that begin in it

        def ends(text: str) -> list[int]:
            ids, out, at = encoding.encode_ordinary(text), [], 0
            for i in ids:
                at += sizes[i]
                out.append(at)
            return out

        return ends

    return make


def sentence_chunks(docs: DataFrame, max_chars: int = 1000, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """Whole sentences packed greedily into chunks of at most ``max_chars`` characters (a longer sentence is one chunk)."""
    parts = F.regexp_extract_all(F.col(content), F.lit(r"(?s).+?(?:[.!?\n]+\s*|$)"), F.lit(0))
    start = F.array().cast("array<string>")
    pack = lambda done, s: F.when((F.size(done) > 0) & (F.char_length(F.element_at(done, -1)) + F.char_length(s) <= max_chars), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), s)))).otherwise(F.concat(done, F.array(s)))
    split = _settled(docs.select(F.col(source_id).alias("source_id"), parts.alias("_s")), "_p", F.col("_s"))
    packed = _settled(split.select("source_id", "_p"), "_c", F.filter(F.aggregate("_p", start, pack), non_blank))
    return packed.select("source_id", F.posexplode("_c").alias("chunk_index", "content"))


def markdown_chunks(docs: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """A chunk for each section: a heading line and what follows it; ``section`` is the heading's text."""
    parts = F.split(F.col(content), r"\n(?=#{1,6} )")
    rows = _settled(docs.select(F.col(source_id).alias("source_id"), F.filter(parts, non_blank).alias("_s")), "_c", F.col("_s")).select("source_id", F.posexplode("_c").alias("chunk_index", "content"))
    return rows.withColumn("section", F.nullif(F.regexp_extract("content", r"^#{1,6} +([^\n]*)", 1), F.lit("")))


def to_nodes(chunks: DataFrame, metadata: Column | None = None, now: Column | None = None) -> DataFrame:
    """Chunks as nodes with the derived metadata: counts, language unless known, creation time; source keys get a prefix.

    Ids are hashes of source and place, so a task that runs again gives the same ids. ``now`` is a parameter for the
    same reason.
    """
    inherited = F.transform_keys(metadata, lambda k, v: F.concat(F.lit("source."), k)) if metadata is not None else F.create_map().cast("map<string,string>")
    own = F.create_map(F.lit("char_count"), F.char_length("content").cast("string"), F.lit("word_count"), word_count("content").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("token_count"), F.col("token_count").cast("string"))
    if now is not None:
        own = F.map_concat(own, F.create_map(F.lit("created_at"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    position = F.struct("start_char", "end_char", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"))
    return chunks.select(F.sha2(F.concat_ws(":", "source_id", F.col("chunk_index").cast("string")), 256).alias("node_id"), "source_id", "content", F.map_concat(own, inherited).alias("metadata"), position.alias("position"))


def fail_on_empty(docs: DataFrame, content: str = "content") -> DataFrame:
    bad = docs.where(~non_blank(content))
    if not bad.isEmpty():
        raise FragmentationError("a document has no tokens")
    return docs
