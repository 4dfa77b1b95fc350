"""What the operators share: the cluster's shared folder, keys and columns of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, mark, release, remove, scratch, shared_root, table  # noqa: F401
from ..ship import ship  # noqa: F401


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str):
    return df[quoted(name)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has such a column, in whatever case, already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id BIGINT and text STRING alone, whatever other columns there are."""
    return docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text"))


def key_of(doc_id, text):
    """A document's BIGINT key: its doc_id; without one, a negative number from a hash of its text."""
    return F.coalesce(doc_id, -(F.shiftrightunsigned(F.xxhash64(F.lit("no id"), text), 1)) - 1)


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def parts(batches, at: int = 1, most: int = 4 << 20):
    """The record batches, cut where the string column at that place exceeds so many bytes (a longer text stands alone)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        a, base = 0, 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(a, b - a)
            a, base = b, int(upto[b - 1])


def keyed(docs: DataFrame) -> DataFrame:
    """key BIGINT, text STRING, th INT: a row is known by its key and its text's hash, whatever other columns there are."""
    d = id_and_text(docs)
    return d.select(key_of(d.doc_id, d.text).alias("key"), d.text, F.hash(d.text).alias("th"))


def with_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the two columns by which keyed() knows a row, and their names, which docs had not."""
    k, th = fresh(docs, "row_key", "row_hash")
    doc_id, text = column(docs, "doc_id").cast("long"), column(docs, "text").cast("string")
    return docs.withColumns({k: key_of(doc_id, text), th: F.hash(text)}), k, th
