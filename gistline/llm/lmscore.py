"""Language-model scores by compression cross-entropy.

A document's size under zstandard with a dictionary is an upper bound of its cross-entropy under the dictionary's text. The score is
the difference between its size under a general dictionary and under an in-domain one, divided by the former: the higher,
the more the document is like the domain.

The dictionaries hold words with what separates them from the next, counted over every document of the corpus (general) and over
every document of the domain. A dictionary is filled, up to its size, with those that save most over the other
(occurrences times length times log ratio of the shares), the best at its end, where zstandard's offsets are shortest.
Its size grows with the square root of the corpus, about as vocabularies do, from LEAST_BYTES on; documents are joined with the
domain's ids by a shuffle, at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import column, drop, keyed, parts, ship, table

LEAST_BYTES, GROWTH, LEVEL = 112_640, 8, 3


def dictionary_bytes(corpus_bytes: int) -> int:
    """GROWTH times the square root of the corpus's bytes: 0.25 MB for 1 GB, 8 MB for 1 TB, 80 MB for 100 TB."""
    return max(LEAST_BYTES, int(GROWTH * corpus_bytes**0.5))


def _counts(batches):
    """Rows (seg, domain, total): each word with what follows it, by how often it occurs in the domain and in all; and two rows a
    batch for the sums, with a null (of words) and an empty seg (of bytes)."""
    for b in parts(batches, 1, 8 << 20):
        offsets, raw = words.buffers(b.column(1))
        start, _ = words.word_bounds(offsets, raw)
        if not len(start):
            continue
        doc = np.searchsorted(offsets, start, side="right") - 1
        end = np.append(start[1:], 0)
        end = np.where(np.append(doc[1:] != doc[:-1], True), offsets[doc + 1], end)
        h = words.span_hashes(raw, start, end)
        inside = b.column(2).to_numpy(zero_copy_only=False).astype(bool)[doc]
        order = np.argsort(h)
        h = h[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.diff(np.append(heads, len(h)))
        domain = np.add.reduceat(inside[order].astype(np.int64), heads)
        at = order[heads]
        size = end[at] - start[at]
        a = 0
        while a < len(at):  # a very long text's segments in pieces
            upto = np.concatenate([[0], np.cumsum(size[a : a + (1 << 20)])])
            z = a + max(1, int(np.searchsorted(upto, 64 << 20, side="right")) - 1)
            upto = upto[: z - a + 1]
            pick = np.repeat(start[at[a:z]] - upto[:-1], size[a:z]) + np.arange(upto[-1])
            seg = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(raw[pick].tobytes())])
            yield pa.RecordBatch.from_arrays([seg, pa.array(domain[a:z]), pa.array(total[a:z])], ["seg", "domain", "total"])
            a = z
        yield pa.RecordBatch.from_arrays([pa.array([None, b""], pa.binary()), pa.array([int(domain.sum()), int(domain @ size)]), pa.array([int(total.sum()), int(total @ size)])], ["seg", "domain", "total"])


def _dictionary(counts: DataFrame, by: str, other: str, share: float, size: int) -> bytes:
    """The segments that save most, until one doesn't fit; ties go to the lesser segment. share: all occurrences by the other's.
    Segments longer than the dictionary can't be in it.

    Bytes by bins of the logarithm of what is saved tell from where on a segment can be among them; only those reach the driver.
    """
    saves = F.col(by) * (F.length("seg") - 1) * F.log((F.col(by) + 0.5) / (F.col(other) + 0.5) / share)
    good = counts.filter((F.col(by) > 1) & F.length("seg").between(3, size)).select("seg", saves.alias("saves")).filter("saves > 0").withColumn("bin", F.floor(F.log("saves") * 64))
    least, room = None, size
    for r in good.groupBy("bin").agg(F.sum(F.length("seg")).alias("n")).orderBy(F.desc("bin")).collect():
        least, room = r.bin, room - r.n
        if room <= 0:
            break
    if least is None:
        return b""
    best = good.filter(F.col("bin") >= least).orderBy(F.desc("saves"), "seg").select("seg").toArrow().column(0).combine_chunks()
    n = int(np.searchsorted(np.cumsum(pc.binary_length(best).to_numpy(zero_copy_only=False)), size, side="right"))
    return b"".join(best.slice(0, n).to_pylist()[::-1])


def segments(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """seg, domain, total: how often each segment occurs in the domain (documents labelled quality 1) and in all documents.
    Two more rows have the sums: of occurrences, where seg is null, and of bytes, where it is empty."""
    ship(docs.sparkSession)
    good = labels.filter(column(labels, "quality") == 1).select(column(labels, "doc_id").cast("long").alias("key")).filter("key is not null").distinct().withColumn("good", F.lit(True))
    marked = keyed(docs).join(good.hint("merge"), "key", "left").select("key", "text", F.coalesce("good", F.lit(False)).alias("good"))
    return marked.mapInArrow(_counts, "seg binary, domain long, total long").groupBy("seg").agg(F.sum("domain").alias("domain"), F.sum("total").alias("total"))


def dictionaries(docs: DataFrame, labels: DataFrame, size: int | None = None) -> tuple[bytes, bytes]:
    """The domain's dictionary (of documents labelled quality 1) and the general one, each of at most that many bytes
    (by default, dictionary_bytes() of the corpus)."""
    counts = table(segments(docs, labels).filter("total > 1 or seg is null or length(seg) = 0"), "segments")
    sums = {r.seg is None: r for r in counts.filter("seg is null or length(seg) = 0").collect()}
    d, t = (sums[True].domain, sums[True].total) if sums else (0, 0)
    size = dictionary_bytes(sums[False].total if sums else 0) if size is None else size
    share = max(d, 1) / max(t, 1)
    out = _dictionary(counts, "domain", "total", share, size), _dictionary(counts, "total", "domain", 1 / share, size)
    drop(counts)
    return out


def _compressor(dictionary: bytes, level: int):
    import zstandard as z

    if len(dictionary) < 8:
        return z.ZstdCompressor(level=level)
    d = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return z.ZstdCompressor(level=level, dict_data=d)


def _sizes(domain: bytes, general: bytes, level: int):
    def run(batches):
        c, g = _compressor(domain, level), _compressor(general, level)
        for b in parts(batches):
            texts = [t.as_buffer() if t.is_valid else b"" for t in b.column(1).cast(pa.large_binary())]
            x, y = (np.array([len(z.compress(t)) for t in texts], np.int64) for z in (c, g))
            empty = np.array([len(t) == 0 for t in texts], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x), pa.array(y), pa.array(np.where(empty, 0.0, (y - x) / y))], ["doc_id", "domain_bytes", "general_bytes", "score"])

    return run


def scores(docs: DataFrame, dictionaries_: tuple[bytes, bytes], level: int = LEVEL) -> DataFrame:
    ship(docs.sparkSession)
    return keyed(docs).select("key", "text").mapInArrow(_sizes(*dictionaries_, level), "doc_id long, domain_bytes long, general_bytes long, score double")


def lm_scores(docs: DataFrame, labels: DataFrame, size: int | None = None, level: int = LEVEL) -> DataFrame:
    """doc_id, domain_bytes, general_bytes, score for each row of docs.

    Nulls and empty texts score 0. Very long texts are compressed whole. Repeated rows each count and are each scored; a document
    without doc_id goes by a negative number from its text's hash and is in no domain. Labels with nulls don't count; a
    document is in the domain if one of its labels says so. Without labels the domain's dictionary is empty. An empty table
    gives no rows; columns other than doc_id, text and quality don't matter.
    """
    return scores(docs, dictionaries(docs, labels, size), level)
