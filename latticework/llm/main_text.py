"""Main text of HTML pages by a recurrent block labeller.

Null html counts as empty and gives an empty text, as does a page without main
blocks.  White space inside a block becomes one space, blocks are joined by one
line feed in page order; nothing else is dropped or cut, however long the page.
Repeated rows give repeated results, an empty table none; a block whose score
stands just at the limit is left out.  Only ``carry`` columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.block_labeller import Labeller, default_labeller
from latticework.llm.html_blocks import parse
from latticework.llm.runtime import table

#: Characters of html whose pages are labelled together; a longer page stands alone.
BATCH_CHARS = 2_000_000


def extract(pages: list[str], labeller: Labeller) -> list[str]:
    """Main text of each page."""
    blocks = [parse(p)[0] for p in pages]
    return ["\n".join(b.text for b, good in zip(bs, marks, strict=True) if good) for bs, marks in zip(blocks, labeller.label(blocks), strict=True)]


def main_text(df: DataFrame, labeller: Labeller, carry: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """``carry`` columns, text and n_chars for every page."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                pages, chars, first = [], 0, at
                while at < b.num_rows and (not pages or chars < BATCH_CHARS):
                    pages.append(b.column(0)[at].as_py())
                    chars += len(pages[-1])
                    at += 1
                texts = extract(pages, labeller)
                part = b.slice(first, len(pages))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*carry, "text", "n_chars"])

    html = F.coalesce(df[html_column].cast("string"), F.lit("")).alias("__html")
    return df.select(html, *[df[c] for c in carry]).mapInArrow(run, schema)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), default_labeller())


QUERIES = {"op7_main_text": op7_main_text}
SQL: dict[str, str] = {}
