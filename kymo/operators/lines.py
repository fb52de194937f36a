"""Lines of screen words: words that lie side by side are put together where they are read, so a shuffle moves runs of words, not words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the words of a run. A word that holds it, like one without a text or a place, is a run of its own.
BETWEEN = "\x1f"


def _changed(column: pa.Array, by: int | None = None) -> np.ndarray:
    """Where a row doesn't follow the one before it: another value or a null; with ``by``, a value that isn't that much more."""
    before, here = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.equal(here, before if by is None else pc.add(before, by))
    return ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        image, line, at, text = b.columns[:4]
        odd = pc.fill_null(pc.match_substring(text, BETWEEN), True).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], _changed(image) | _changed(line) | _changed(at, 1) | odd[1:] | odd[:-1])))
        ends = np.append(starts[1:], b.num_rows)
        words = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), text)
        first, last = pa.array(starts), pa.array(ends - 1)
        columns = {"image_id": image.take(first), "line": line.take(first), "first": at.take(first), "last": at.take(last), "text": pc.binary_join(words, BETWEEN)}
        names = b.schema.names[4:]
        if "conf" in names:
            conf = b.column("conf")
            known = pc.is_valid(conf).to_numpy(zero_copy_only=False)
            columns["conf"] = pa.array(np.add.reduceat(np.where(known, pc.fill_null(conf, 0.0).to_numpy(zero_copy_only=False), 0.0), starts))
            columns["confs"] = pa.array(np.add.reduceat(known.astype(np.int64), starts))
        if "hit" in names:
            columns["hit"] = pa.array(np.logical_or.reduceat(b.column("hit").to_numpy(zero_copy_only=False), starts))
        yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def _each(run: Column) -> Column:
    """The words of a run, each with its place."""
    words = F.when(run["last"] > run["first"], F.split(run["text"], BETWEEN)).otherwise(F.array(run["text"]))
    return F.transform(words, lambda w, k: F.struct((run["first"] + k).alias("word_idx"), w.alias("text")))


def words_in_order(runs: Column) -> Column:
    """All words of a line's runs by place."""
    return F.array_sort(F.flatten(F.transform(runs, _each)))


def text_of(runs: Column) -> Column:
    """The words of a line by place, with spaces between them; null if none has a text."""
    clash = F.exists(F.sequence(F.lit(1), F.size(runs)), lambda k: (k > 1) & (F.get(runs, k - 1)["first"] <= F.get(runs, k - 2)["last"]))
    shown = F.transform(runs, lambda r: F.when(r["last"] > r["first"], F.translate(r["text"], BETWEEN, " ")).otherwise(r["text"]))
    every = F.when(F.coalesce(clash, F.lit(False)), F.transform(words_in_order(runs), lambda w: w["text"])).otherwise(shown)
    return F.when(F.exists(runs, lambda r: r["text"].isNotNull()), F.array_join(every, " "))


def lines(words: DataFrame, *by: str, conf: Column | None = None, hit: Column | None = None) -> DataFrame:
    """A row for each line of words (image_id, line, word_idx, text): ``runs``, in order of place, and if asked for the mean ``conf`` and whether any word is a ``hit``.

    Rows are dealt by ``by`` (the image and the line, if none is given), so work by these columns needs no other shuffle.
    """
    kinds = {f: words.schema[f].dataType.simpleString() for f in ("image_id", "line")}
    read = ["image_id", "line", F.col("word_idx").cast("long").alias("word_idx"), F.col("text")]
    schema = f"image_id {kinds['image_id']}, line {kinds['line']}, first long, last long, text string"
    found = [F.array_sort(F.collect_list(F.struct("first", "last", "text"))).alias("runs")]
    if conf is not None:
        read.append(conf.cast("double").alias("conf"))
        schema += ", conf double, confs long"
        found.append(F.try_divide(F.sum("conf"), F.sum("confs")).alias("conf"))
    if hit is not None:
        read.append(F.coalesce(hit, F.lit(False)).alias("hit"))
        schema += ", hit boolean"
        found.append(F.max("hit").alias("hit"))
    return words.select(*read).mapInArrow(_run, schema).repartition(*(by or ("image_id", "line"))).groupBy("image_id", "line").agg(*found)
