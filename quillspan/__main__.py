"""Counts files and the files of folders: python -m quillspan INPUT... [--sheet all|first|NAME] [--flat] [--with-notes] [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.units import count_units, selected_units
from quillspan.sources.office import clean_layers, read_units


#: Characters that a title has at most.
MOST_TITLE = 80


def file_totals(units: DataFrame, sheet: str = "all", with_notes: bool = False) -> DataFrame:
    """Metrics, title, errors and pages without text of each file. The title is the stated one, else the first line of text that is no longer than a title; of archives there is none."""
    chosen = count_units(selected_units(units, sheet, with_notes), ["path"], "text")
    own = (F.col("member") == "") & (F.length("text") > 0)
    stated = F.min(F.when(own & (F.col("kind") == "title"), F.col("text")))
    first = F.min_by(F.col("text"), F.when(own & F.col("kind").isin("p", "cell") & (F.length("text") <= MOST_TITLE), F.col("seq")))
    state = units.groupBy("path").agg(F.coalesce(stated, first).alias("title"), F.min("error").alias("error"), F.count_if(F.col("kind") == "image").alias("image_pages"))
    return state.join(chosen, "path", "left").na.fill(0, T.TOTALS).select("path", "title", *T.TOTALS, "image_pages", "error")


def main() -> None:
    ask = argparse.ArgumentParser(prog="quillspan", description="Counts the text of files.")
    ask.add_argument("inputs", nargs="+", help="folders, files or patterns of them")
    ask.add_argument("--sheet", default="all", help="all, first, or the name of a sheet")
    ask.add_argument("--flat", action="store_true", help="leave out folders in the folder")
    ask.add_argument("--with-notes", action="store_true")
    ask.add_argument("--out", help="where rows are written as JSON, else they are printed")
    to = ask.parse_args()
    spark = SparkSession.builder.appName("quillspan").getOrCreate()
    totals = file_totals(clean_layers(read_units(spark, to.inputs, recursive=not to.flat)), to.sheet, to.with_notes)
    if to.out:
        totals.write.mode("overwrite").json(to.out)
    else:
        for row in totals.orderBy("path").toJSON().toLocalIterator():
            print(row)


if __name__ == "__main__":
    main()
