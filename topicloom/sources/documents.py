"""One large JSON document, read by many tasks: the elements of its lists and the members of its objects as rows.

A document ``{"faqs": [..], "synonyms": {..}, ..}`` is cut at commas, so a byte range of it goes to each task
whatever its lines are. A first pass tells for each range how it ends if it begins inside a string and if it
does not, and by how much it deepens in either case. A scan over the ranges (a row each) gives the state and
the depth that each really begins with. The second pass cuts out the elements two levels deep; those that
cross ranges are put together from their parts. A range and a single element fit into a task, documents need not.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.sources.splits import PLACE, _before, _in_order, _ranges, opened, pieces
from topicloom.store import staged

_REST = r'[^"\\]*(?:\\.[^"\\]*)*("?)'
_INSIDE, _TOKEN, _ESCAPE = re.compile(_REST, re.DOTALL), re.compile('"' + _REST + r"|[\[\]{},]", re.DOTALL), re.compile(r"\\.", re.DOTALL)


def _text(part: pa.RecordBatch, first: bool) -> str:
    """The text of a batch of pieces: each but the first of a file follows a comma."""
    return ("" if first else ",") + ",".join(part.column(3).to_pylist())


def deepened(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a text that begins inside a string or not ends so, and by how many levels it deepens."""
    runs = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
    out = runs[inside::2]  # what is between strings
    depth = sum(r.count("{") + r.count("[") - r.count("}") - r.count("]") for r in out)
    return inside ^ (len(runs) % 2 == 0), depth


class Cutter:
    """Cuts a range into ``(at, section, text, whole)``, an element or a part of one each.

    ``at`` numbers the elements that begin in the range and is -1 for what began before; ``section`` is the
    name that the list or object goes by, None if it was opened before the range.
    """

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.key = self.section = None
        self.at = -1 if depth >= 2 else None  # None between lists
        self.begun, self.held = 0, []

    def _ends(self, text: str):
        if self.at is None:
            return
        text = "".join([*self.held, text])
        if self.at < 0:
            if text:
                yield -1, None, text, False
        elif text.strip():
            yield self.at, self.section, text, True
        else:
            self.begun -= 1  # an empty list
        self.at, self.held = None, []

    def _begins(self):
        self.at, self.begun = self.begun, self.begun + 1

    def feed(self, text: str):
        start = at = 0  # start: of what belongs to the element that is open
        if self.inside:
            m = _INSIDE.match(text)
            at, self.inside = m.end(), not m.group(1)
            if self.inside:
                at = len(text)
        while m := _TOKEN.search(text, at):
            at, c = m.end(), text[m.start()]
            if c == '"':
                if not m.group(1):  # goes on in the next text
                    self.inside, self.key, at = True, None, len(text)
                elif self.depth == 1:
                    self.key = json.loads(m.group(), strict=False)
            elif c == ",":
                if self.depth == 2:
                    yield from self._ends(text[start : m.start()])
                    self._begins()
                    start = at
            elif c in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.section = self.key
                    self._begins()
                    start = at
            else:
                if self.depth == 2:
                    yield from self._ends(text[start : m.start()])
                self.depth -= 1
        if self.at is not None:
            self.held.append(text[start:])

    def close(self):
        """What the end of the range leaves open."""
        text = "".join(self.held)
        if self.at is not None and (self.at >= 0 or text):
            yield self.at, self.section if self.at >= 0 else None, text, False


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(no bigint, section string, text string)`` of JSON documents, one a file: an element of a list or ``"name": value`` of an object each.

    ``section`` is the name of the list or object in its document; ``no`` rises in the order of the files by
    name and of the places in them. Other values of a document, empty lists and objects give no rows; names
    with commas have the section null. Documents must be valid JSON in UTF-8.
    """
    cut = pieces(spark, path, ",")

    def ends(batches):
        for f, b, held in _ranges(batches):
            state, depth, first = [False, True], [0, 0], b == 0
            for part in held:
                text, first = _text(part, first), False
                for s in (0, 1):
                    state[s], more = deepened(text, state[s])
                    depth[s] += more
            row = [f, b, *map(int, state), *depth]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["f", "b", "e0", "e1", "d0", "d1"])

    found = opened(staged(cut.mapInArrow(ends, f"{PLACE}, e0 int, e1 int, d0 bigint, d1 bigint"), "json-ranges"))
    states = staged(_before(found, F.when(F.col("open") == 1, F.col("d1")).otherwise(F.col("d0")), "depth").select("f", "b", "open", "depth"), "json-states")

    def elements(batches):
        def out(f, b, rows):
            at, section, text, whole = zip(*rows, strict=True)
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([f] * n, pa.string()), pa.array([b] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(section, pa.string()), pa.array(text, pa.string()), pa.array(whole, pa.bool_())],
                ["f", "b", "at", "section", "text", "whole"],
            )

        for f, b, held in _ranges(batches):
            cutter, first = Cutter(bool(held[0].column(4)[0].as_py()), held[0].column(5)[0].as_py()), b == 0
            for part in held:
                text, first = _text(part, first), False
                if rows := [*cutter.feed(text)]:
                    yield out(f, b, rows)
            if rows := [*cutter.close()]:
                yield out(f, b, rows)

    read = staged(_in_order(cut, states).mapInArrow(elements, f"{PLACE}, at bigint, section string, text string, whole boolean"), "json-elements")
    past = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    ranges = read.groupBy("f", "b").agg((F.max("at") + 1).alias("n"), F.max_by("section", "at").alias("last"))
    before = ranges.select("f", "b", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("first"), F.last("last", ignorenulls=True).over(past).alias("own"))
    # what began before its range belongs to the last element of the ranges before
    named = read.join(before, ["f", "b"]).select("f", "b", (F.col("first") + F.col("at")).alias("no"), F.when(F.col("at") >= 0, F.coalesce("section", "own")).alias("section"), "text", "whole")
    parts = F.array_sort(F.collect_list(F.struct("f", "b", "text")))  # of one element
    crossing = named.where("not whole").groupBy("no").agg(F.max("section").alias("section"), F.array_join(F.transform(parts, lambda x: x.text), "").alias("text"))
    return named.where("whole").select("no", "section", "text").unionByName(crossing.where(F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
