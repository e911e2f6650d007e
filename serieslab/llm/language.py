"""Language identification by compression: a text belongs to the language whose dictionary lets it be encoded in the fewest bytes.

A language's dictionary is raw content: whole texts of a bounded sample. A whole text is folded to lower-case words and encoded, in blocks of
one size and at one level whatever its length, with every dictionary. A prediction whose margin over the next language is narrow is not
accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes that are encoded at a time, and the compression level.
BLOCK, LEVEL = 2048, 12


def held_out(key: Column, folds: int) -> Column:
    """Whether the CRC-32 of the key as text is a multiple of folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def folded(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn_dictionaries(docs: DataFrame, texts: int = 256, most_bytes: int = 24_000, usual: int = 1500, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of docs. The sample of a language: whole texts, those of up to `usual` bytes in the order of a hash of
    their keys, then longer ones by length, as many as `texts` and `most_bytes` allow, one at least. Rows without language, text or key
    are not used; rows with equal language and key count once, with the least text."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0))
    order = Window.partitionBy("lang").orderBy("size", "h", "key")
    sizes = known.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.greatest(F.octet_length(text), F.lit(usual)).alias("size"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    first = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= texts)
    sums = first.withColumn("bytes", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.broadcast(sums.where((F.col("bytes") <= 4 * most_bytes) | (F.col("place") == 1)).select("lang", "key").distinct())  # at most `texts` rows for each language
    body = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("body")).join(wanted, ["lang", "key"])
    out: dict[str, bytes] = {}
    for r in body.groupBy("lang", "key").agg(F.min("body").alias("body")).orderBy("lang", F.greatest(F.octet_length("body"), F.lit(usual)), F.xxhash64(F.col("key").cast("string")), "key").collect():
        own, more = out.get(r["lang"], b""), folded(r["body"]).encode("utf-8", "replace")
        if not own or len(own) + len(more) < most_bytes:
            out[r["lang"]] = own + b" " + more
    return dict(sorted(out.items()))


class Encoder:
    """Bytes that texts take with one language's content."""

    def __init__(self, content: bytes):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def size(self, data: bytes) -> int:
        return sum(len(self.zstd.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.03, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, lang_pred, score and accepted.

    score is 1 - 2^(-m / margin), m being the share of bytes saved against the second best language, so 0.5 at the least margin that
    is accepted; with a single language it is 1. Null texts and texts without a letter, and all texts if there is no dictionary,
    are `und` with score 0, not accepted. Of equally short encodings the first language by name is taken. Repeated rows repeat; other
    columns are not read, whatever their names."""
    names = list(dictionaries)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]

    def predict(body: str | None, made: list) -> tuple[str, float]:
        if body is None or not any(c.isalpha() for c in body) or not made:
            return UNKNOWN, 0.0
        data = folded(body).encode("utf-8", "replace")
        sizes = [max(1, e.size(data)) for e in made]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        if len(order) == 1:
            return names[0], 1.0
        saved = 1 - sizes[order[0]] / sizes[order[1]]
        return names[order[0]], 1 - 2 ** (-saved / margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Encoder(dictionaries[n]) for n in names]
        for b in batches:
            got = [predict(t.as_py(), made) for t in b.column(1)]
            scores = [s for _, s in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.string()), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
