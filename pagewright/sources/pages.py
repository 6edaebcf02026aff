"""Pages from files and from model providers.

A provider is a function on batches of values; what it needs (a model, a key from the
environment) it loads when the first batch arrives on an executor. Without one, the
deterministic offline providers of pagewright.functions.vectors are used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits a file's bytes into page texts.
Splitter = Callable[[bytes], list[str]]
#: Makes the function that answers a batch of inputs; called once per executor process.
Loader = Callable[[], Callable[[list], list]]


def form_feed_pages(content: bytes) -> list[str]:
    """Pages of a plain text file, which form feeds part."""
    return content.decode("utf-8", "replace").split("\f")


def read_documents(spark: SparkSession, path: str, split: Splitter = form_feed_pages) -> DataFrame:
    """doc_id (the file's path), page_number (0-based), raw_text, loaded_at of every file under the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples(index=False):
                texts = split(file.content)
                yield pd.DataFrame({"doc_id": file.path, "page_number": range(len(texts)), "raw_text": texts, "loaded_at": file.modificationTime})

    return files.select("path", "content", "modificationTime").mapInPandas(pages, "doc_id string, page_number int, raw_text string, loaded_at timestamp")


#: What providers have loaded in this process, by provider.
_loaded: dict[str, Callable[[list], list]] = {}


def answers(key: str, load: Loader, batch: list) -> tuple[list, list]:
    """Values and errors of a batch: asked as a whole, and one by one only if that fails."""
    try:
        if key not in _loaded:
            _loaded[key] = load()
        answer = _loaded[key]
    except Exception as e:
        return [None] * len(batch), [str(e) or type(e).__name__] * len(batch)
    try:
        values = list(answer(batch))
        if len(values) == len(batch):
            return values, [None] * len(batch)
    except Exception:
        pass
    values, errors = [], []
    for x in batch:
        try:
            values += answer([x])
            errors.append(None)
        except Exception as e:
            values.append(None)
            errors.append(str(e) or type(e).__name__)
    return values, errors


def provider(load: Loader, returns: str) -> Callable[[Column], Column]:
    """A model as a column function with the result type struct<value, error>: a failure is kept as text beside the row.

    load is called once per executor process; a secret it needs is read there, from the
    environment, and never enters the plan. Model answers may differ between calls, so
    materialize what is read twice.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf(f"struct<value:{returns},error:string>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from pagewright.sources import pages

        for batch in batches:
            values, errors = pages.answers(key, load, batch.tolist())
            yield pd.DataFrame({"value": pd.Series(values, dtype="object"), "error": pd.Series(errors, dtype="object")})

    return call.asNondeterministic()


def embedder(load: Loader) -> Callable[[Column], Column]:
    """A provider of vectors for the operators that take one: array<float>, null where it failed."""
    call = provider(load, "array<float>")
    return lambda text: call(text)["value"]


def described_images(images: DataFrame, contents: DataFrame, ocr: Callable[[Column], Column], caption: Callable[[Column], Column], least: int = 100) -> DataFrame:
    """Images (doc_id, page_number, img_index, xref, width, height) with ocr_text, caption, error and extract_error.

    Bytes (contents: doc_id, xref, bytes) are fetched after the size filter, and only
    for images that pass it. The index counts the small ones too.
    """
    big = images.filter((F.col("width") >= least) & (F.col("height") >= least))
    held = big.join(contents.select("doc_id", "xref", "bytes"), ["doc_id", "xref"], "left")
    read = held.select("doc_id", "page_number", "img_index", "width", "height", F.col("bytes").isNull().alias("lost"), ocr(F.col("bytes")).alias("o"), caption(F.col("bytes")).alias("c"))
    return read.select(
        "doc_id", "page_number", "img_index", "width", "height", F.col("o.value").alias("ocr_text"), F.col("c.value").alias("caption"),
        F.when(~F.col("lost"), F.coalesce("o.error", "c.error")).alias("error"), F.when(F.col("lost"), "no such image").alias("extract_error"))
