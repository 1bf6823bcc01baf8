"""Large GeoJSON feature collections in many tasks: Spark cuts the file at closing braces, and bracket depth outside strings tells the features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
#: Depth within the list of features: the collection's object and its list.
LIST = 2


def outside(text: str, inside: bool) -> tuple[str, bool]:
    """The text without what stands in strings, each of which becomes blanks; and whether it ends within one."""
    if inside:
        end = _REST.match(text)
        if end is None:
            return " " * len(text), True
        text = " " * end.end() + text[end.end() :]
    clean = _STRING.sub(lambda m: " " * len(m[0]), text)
    at = clean.find('"')
    return (clean, False) if at < 0 else (clean[:at] + " " * (len(clean) - at), True)


def rise(clean: str) -> int:
    return clean.count("{") + clean.count("[") - clean.count("}") - clean.count("]")


def ended(inside: bool, depth: int, text: str) -> tuple[bool, int]:
    """String state and depth after a piece of the text."""
    clean, now = outside(text, inside)
    return now, depth + rise(clean)


def begins(clean: str, depth: int) -> int | None:
    """Where an object opens in the list of features."""
    for m in re.finditer(r"[{}\[\]]", clean):
        if m[0] == "{" and depth == LIST:
            return m.start()
        depth += 1 if m[0] in "{[" else -1
    return None


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): the file's text up to each closing brace, in order within a block."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], str]]:
    """(file and block, text with its brace), in order. What follows a file's last brace gets one too, which closes nothing."""
    for pdf in batches:
        for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
            yield (file, int(block)), value + "}"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a block does to either state it may begin in."""
    found: dict[tuple[str, int], list[tuple[bool, int]]] = {}
    for at, text in _blocks(batches):
        found[at] = [ended(*state, text) for state in found.get(at, [(False, 0), (True, 0)])]
    yield pd.DataFrame([(*at, i, now, delta) for at, states in found.items() for i, (now, delta) in enumerate(states)], columns=["file", "block", "inside", "after", "rise"])


def feature_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, text): the objects in the list of features of collections of any size.

    Blocks are read twice. First each tells its depth and string state at its end for either state at its beginning, two rows a
    block that come to the driver and give all beginnings; then each gives out its features. One that crosses blocks comes in
    pieces, which meet by file and by the feature's place among those that cross.
    """
    pieces = _pieces(spark, path)
    told = pieces.mapInPandas(_summaries, "file string, block long, inside int, after boolean, rise long").collect()
    effects = {(r["file"], r["block"], bool(r["inside"])): (r["after"], r["rise"]) for r in told}
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    last, state = None, (False, 0)
    for file, block in sorted({(f, b) for f, b, _ in effects}):
        if file != last:
            last, state = file, (False, 0)
        starts[file, block] = state
        after, up = effects[file, block, state[0]]
        state = after, state[1] + up

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, inside, depth, held, begun = None, False, 0, [], False
        rows: list[tuple[str, int, bool, bool, str]] = []

        def left() -> None:
            if held:
                rows.append((*at, begun, False, "".join(held)))

        for here, text in _blocks(batches):
            if here != at:
                left()
                at, (inside, depth), held, begun = here, starts[here], [], False
            clean, after = outside(text, inside)
            if depth <= LIST:
                start = begins(clean, depth)
                if start is not None:
                    begun, held = True, [text[start:]]
            else:
                held.append(text)
            inside, depth = after, depth + rise(clean)
            if held and depth == LIST and not inside:
                rows.append((*at, begun, True, "".join(held)))
                held, begun = [], False
            if len(rows) >= 500:
                yield pd.DataFrame(rows, columns=["file", "block", "begun", "ended", "text"])
                rows.clear()
        left()
        yield pd.DataFrame(rows, columns=["file", "block", "begun", "ended", "text"])

    found = pieces.mapInPandas(run, "file string, block long, begun boolean, ended boolean, text string")
    whole = found.where("begun and ended").select("file", "text")
    parts = found.where("not (begun and ended)")
    # Only what crosses blocks is dealt out, two rows a block at most.
    order = Window.partitionBy("file").orderBy("block", "begun")
    parts = parts.withColumn("_n", F.sum(F.col("begun").cast("int")).over(order)).groupBy("file", "_n").agg(F.array_sort(F.collect_list(F.struct("block", "begun", "text"))).alias("p"))
    return whole.unionByName(parts.select("file", F.concat_ws("", "p.text").alias("text")))


def features(spark: SparkSession, path: str | list[str], properties: str) -> DataFrame:
    """(type, properties, kind, coordinates) of features, with the properties that the schema text tells; coordinates as text.

    Objects of another type, in other lists of the collection, are left out; one without a type counts if it has what a feature has.
    """
    schema = f"struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    f: Column = F.from_json("text", schema)
    return feature_texts(spark, path).select(f.alias("f")).where("f.type = 'Feature' or f.type is null and (f.properties is not null or f.geometry is not null)").select("f.type", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
