"""Readers: lines, paragraphs, graphs, models, and the tab-separated tables of the learning and evaluation tools."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graph as G
from ..functions.native import parse_graph
from ..functions.store import keep, scratch_path

#: The columns of each table, in order; ``*`` gathers all further columns in an array.
TABLES = {
    "argument_counts": ("string", "lemma", "postag", "count:long"),
    "target_arguments": ("lemma", "count:long"),
    "raw_triples": ("id", "arg1", "rel", "arg2", "_5", "rel_lemma", "_7", "arg1_pos", "rel_pos", "arg2_pos", "_11", "_12", "_13", "count:long", "conf:double", "url", "sentence"),
    "relations": ("relation", "lemmas"),
    "target_extractions": ("rel", "arg1", "arg2", "lemmas", "arg1_text", "rel_text", "arg2_text", "arg1_pos", "rel_pos", "arg2_pos"),
    "seeds": ("rel", "arg1", "arg2", "lemmas"),
    "lemma_grep": ("rel", "arg1", "arg2", "lemmas", "text", "_6", "_7", "_8", "deps"),
    "patterned": ("rel", "arg1", "arg2", "lemmas", "pattern", "text", "deps", "*slots"),
    "histogram": ("rel", "pattern", "count:long", "*slots"),
    "relation_templates": ("rel", "template"),
    "templates": ("template", "pattern", "count:long"),
    "extractions": ("confidence:double", "extraction", "pattern", "text", "deps"),
    "scored": ("score:flag", "confidence:double", "extraction", "*extra"),
    "gold": ("correct:flag", "extraction"),
    "curve": ("confidence:double", "yield:long", "precision:double"),
    "weights": ("name", "weight:double"),
}


def table(spark: SparkSession, path: str | list[str], name: str) -> DataFrame:
    """A header-less tab-separated table; rows with too few fields are skipped, as no quoting is in use.

    A flag is 1, 0 or empty (null); any other flag raises.
    """
    columns = TABLES[name]
    fixed = [c for c in columns if not c.startswith("*")]
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") >= len(fixed))
    out = []
    for i, c in enumerate(columns):
        column, _, kind = c.partition(":")
        value = F.get("p", F.lit(i))
        if column.startswith("*"):
            out.append(F.slice("p", i + 1, F.greatest(F.size("p") - i, F.lit(0))).alias(column[1:]))
        elif kind == "flag":
            bad = F.raise_error(F.concat(F.lit("not a score: "), value)).cast("boolean")
            out.append(F.when(value == "1", True).when(value == "0", False).when(value == "", F.lit(None).cast("boolean")).otherwise(bad).alias(column))
        else:
            out.append((value.cast(kind) if kind else value).alias(column))
    return parts.select(*out)


#: Encodings of two and four bytes a unit, with the order of bytes where the name fixes it.
WIDE = {"UTF16": (2, None), "UTF16LE": (2, "LE"), "UTF16BE": (2, "BE"), "UTF32": (4, None), "UTF32LE": (4, "LE"), "UTF32BE": (4, "BE")}


def lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """sentence, file: one sentence a line, blank lines dropped. Files of any size are split into ranges of lines, in any
    encoding."""
    name = encoding.upper().replace("-", "").replace("_", "")
    if name in WIDE:
        raw = _wide_lines(spark, paths, *WIDE[name])
    elif name == "UTF8":
        raw = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    else:
        # a separator that can't occur in the bytes keeps each line one field
        raw = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").option("escape", "").csv(paths, "value string").select("value", F.col("_metadata.file_path").alias("file"))
    rows = raw.select(F.regexp_replace("value", "\r\\z", "").alias("sentence"), "file")
    return rows.where(F.length("sentence") > 0)


#: Bytes of neighbouring pieces that are one row; a longer piece is one by itself.
ROW_BYTES = 1 << 14


def _gathered(batches, unit: int):
    """Rows of neighbouring pieces of a range, each piece with the byte 10 behind it, and their place in the range."""
    key, inner = None, 0
    for batch in batches:
        file, block, size, pieces = (batch.column(i) for i in range(4))
        n = batch.num_rows
        if n and (file[0], block[0]) == (file[n - 1], block[n - 1]):  # a range's pieces stand together
            cuts = [0, n]
        else:
            keys = list(zip(file.to_pylist(), block.to_pylist(), strict=True))
            cuts = [i for i in range(n) if not i or keys[i] != keys[i - 1]] + [n]
        out = []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            own = (file[start].as_py(), block[start].as_py())
            if own != key:
                key, inner = own, 0
            values = pieces.slice(start, stop - start).to_pylist()
            row = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1) // ROW_BYTES
            edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(values)]
            for i, j in zip(edges, edges[1:], strict=False):
                data = b"\n".join(values[i:j]) + b"\n"
                out.append((*key, size[start].as_py(), inner, len(data), data[:unit], data))
                inner += len(data)
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "block", "bytes", "inner", "n", "head", "data"])


def _split(data: bytes, at: int, size: int, little: bool, unit: int) -> tuple[bytes, bytes, bytes]:
    """What stands before and with the first end of a line, whole lines, and what stands behind the last end; all is in the
    first if no line ends here. ``at`` is the place of data in a file of so many bytes."""
    data = data[: size - at]  # the byte 10 behind the last piece may not be there
    skip = -at % unit
    units = np.frombuffer(data, f"{'<' if little else '>'}u{unit}", max(len(data) - skip, 0) // unit, skip if len(data) > skip else 0)
    ends = np.flatnonzero(units == 10)
    if not len(ends):
        return data, b"", b""
    first, last = (skip + unit * (int(i) + 1) for i in (ends[0], ends[-1]))
    return data[:first], data[first:last], data[last:]


def _decoded(data: bytes, little: bool, unit: int) -> list[str]:
    if not little:
        data = data[: len(data) - len(data) % unit]
    lines = data.decode(f"utf-{8 * unit}-{'le' if little else 'be'}").split("\n")
    return lines if lines[-1] else lines[:-1]


def _rows(batches, make: Callable, schema: list):
    """Record batches of what ``make`` gives for each row, a few thousand rows each."""
    out = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += make(*row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)], [n for n, _ in schema])
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)], [n for n, _ in schema])


def _wide_lines(spark: SparkSession, paths: str | list[str], unit: int, fixed: str | None) -> DataFrame:
    """value, file: lines of files in units of two or four bytes.

    Ranges of a file are cut at every byte 10, which may also be half of another character, and neighbouring pieces are put
    together in rows of ROW_BYTES. A row's place in its file is the sum of the bytes before it, within its range and over the
    ranges before, so that a unit 10 in it is told from other bytes 10; whole lines of a row are decoded together. What
    stands before the first and behind the last end of a line in each row is put together with that of its neighbours. The
    order of bytes is that of a file's mark, and big-endian without one.
    """
    pieces = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("b"))
    rows = keep(pieces.mapInArrow(lambda batches: _gathered(batches, unit), "file string, block long, bytes long, inner long, n long, head binary, data binary"), "pieces")
    # a row for each range that is read
    ranges = Window.partitionBy("file").orderBy("block")
    cells = rows.groupBy("file", "block").agg(F.sum("n").alias("n"), F.min_by("head", "inner").alias("first"))
    head = F.first("first").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    above = F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = {2: ("FFFE", "FEFF"), 4: ("FFFE0000", "0000FEFF")}[unit]
    cells = keep(cells.select("file", "block", above.alias("above"), (F.lit(fixed == "LE") if fixed else F.hex(head) == marks[0]).alias("little")), "ranges")
    rows = rows.join(_sized(cells, cells.rows * 400), ["file", "block"]).select("file", (F.col("above") + F.col("inner")).alias("at"), "bytes", "little", "data")

    def rests(file, at, size, little, data):
        first, whole, last = _split(data, at, size, little, unit)
        ended = len(whole) + len(last) > 0 or _ends(first, at, little, unit)
        found = [(file, at, little, ended, first)] if first else []
        return found + ([(file, at + len(first) + len(whole), little, False, last)] if last else [])

    def inside(file, at, size, little, data):
        return [(x, file) for x in _decoded(_split(data, at, size, little, unit)[1], little, unit)]

    def joined(file, little, parts):
        data = b"".join(x["part"] for x in parts)
        if fixed is None and parts[0]["at"] == 0 and data[:unit].hex().upper() in marks:
            data = data[unit:]
        return [(x, file) for x in _decoded(data, little, unit)]

    text = [("value", pa.string()), ("file", pa.string())]
    kinds = [("file", pa.string()), ("at", pa.int64()), ("little", pa.bool_()), ("ended", pa.bool_()), ("part", pa.binary())]
    whole = rows.mapInArrow(lambda batches: _rows(batches, inside, text), "value string, file string")
    parts = keep(rows.mapInArrow(lambda batches: _rows(batches, rests, kinds), "file string, at long, little boolean, ended boolean, part binary"), "parts-of-lines")
    # which line of its file a part belongs to is told by the ends before it, without the parts themselves
    line = F.coalesce(F.sum(F.col("ended").cast("long")).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.select("file", "at", line.alias("line"))
    lines_ = parts.join(_sized(places, parts.rows * 400), ["file", "at"]).groupBy("file", "line").agg(F.first("little").alias("little"), F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return whole.unionByName(lines_.select("file", "little", "parts").mapInArrow(lambda batches: _rows(batches, joined, text), "value string, file string"))


def _ends(data: bytes, at: int, little: bool, unit: int) -> bool:
    """Whether data ends with the end of a line."""
    return (at + len(data)) % unit == 0 and data[-unit:] == (10).to_bytes(unit, "little" if little else "big")


def _sized(df: DataFrame, size: int, most: int = 32 << 20) -> DataFrame:
    """Sent to all executors if it is small, joined by a shuffle if not."""
    return F.broadcast(df) if size <= most else df


def stdin_lines(spark: SparkSession, stream=None) -> DataFrame:
    """sentence, number: the lines of a console or pipe, spooled to the shared folder as they are read: no more than a part
    of them is held by the process that reads. See streaming.stream.console for an input that goes on."""
    from ..streaming.stream import Spool

    spool = Spool(spark, scratch_path(spark, "console"))
    for line in sys.stdin if stream is None else stream:
        spool.add(line)
    spool.close()
    rows = spark.read.schema("sentence string, number long").json(spool.folder)
    return rows.where(F.trim("sentence") != "")


def split_sentences(text: str) -> Column:
    """Sentences of a paragraph column: behind an end mark, before a capital, digit or quote."""
    return F.filter(F.split(F.regexp_replace(F.trim(F.col(text)), r"(?<=[.!?])\s+(?=[\p{Lu}\d\"'“])", "\n"), "\n"), lambda s: s != "")


def paragraphs(spark: SparkSession, paths: str | list[str], segment: Callable[[str], Column] = split_sentences) -> DataFrame:
    """sentence, file, paragraph, position: paragraphs stand between blank lines, their lines are joined and split into sentences.

    Lines are numbered within ranges of their file, and blank lines are counted over the ranges before: no file is held
    in one row. A paragraph is known by the number of blank lines above it in its file. ``segment`` makes an
    array of sentences from the name of a text column.
    """
    rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blank = F.trim("value") == ""
    cells = rows.groupBy("file", "block").agg(F.sum(blank.cast("long")).alias("n"))  # one row for each range that is read
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("file", "block", F.coalesce(before, F.lit(0)).alias("above"))
    within = F.sum(blank.cast("long")).over(Window.partitionBy("file", "block").orderBy("id"))
    numbered = rows.withColumn("inner", within).join(F.broadcast(cells), ["file", "block"]).where(~blank)
    numbered = numbered.withColumn("paragraph", F.col("inner") + F.col("above"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", F.trim("value").alias("v")))), lambda x: x["v"]), " ")
    flat = numbered.groupBy("file", "paragraph").agg(text.alias("t"))
    return flat.select("file", "paragraph", F.posexplode(segment("t")).alias("position", "sentence")).select("sentence", "file", "paragraph", "position")


def graphs(spark: SparkSession, paths: str | list[str], column: int = -1) -> DataFrame:
    """graph and line: the given tab-separated field (by default the last) of each line; lines without a graph are skipped."""
    parts = F.split("value", "\t", -1)
    field = F.element_at(parts, column if column < 0 else column + 1)
    return spark.read.text(paths).select(F.col("value").alias("line"), field.alias("graph")).where(parse_graph("graph").isNotNull())


def sniff_column(first_line: str) -> int | None:
    """The first field of a file's first line that reads as a graph."""
    for i, field in enumerate(first_line.split("\t")):
        try:
            G.parse(field)
            return i
        except ValueError:
            continue
    return None


def sniffed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """graph, line, file of files whose own first lines tell which of their fields is the graph.

    The first line of every file is found by its range's start and the lowest row in it, all files at once; each line then
    meets its file's column. Lines without a graph there are skipped, files without any row have none; a file whose first
    line has no graph raises.
    """
    rows = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = rows.where("block = 0").groupBy("file").agg(F.min_by("line", "id").alias("first"))
    fields = F.transform(F.split("first", "\t", -1), lambda x, i: F.when(parse_graph(x).isNotNull(), i))
    columns = keep(first.select("file", F.array_min(F.filter(fields, lambda i: i.isNotNull())).alias("column")), "columns")
    rows = rows.join(_sized(columns, columns.rows * 400), "file")
    none = F.raise_error(F.concat(F.lit("no field of the first line is a graph: "), F.col("file"))).cast("int")
    field = F.get(F.split("line", "\t", -1), F.coalesce("column", none))
    return rows.select(field.alias("graph"), "line", "file").where(parse_graph("graph").isNotNull())


def plain_parse(text: str) -> G.Graph:
    """A graph without a grammar: tokens in order with tags guessed from their form, and the first verb between two nouns
    as their predicate. It stands in for a dependency parser, which callers add to PARSERS."""
    words = re.findall(r"\w+(?:['’-]\w+)*|[^\w\s]", text)
    nodes, at = [], 0
    for i, w in enumerate(words):
        at = text.index(w, at)
        nodes.append(G.Node(i, i + 1, w, guessed_tag(w, i), at, G.lemma(w)))
        at += len(w)
    verb = next((i for i, n in enumerate(nodes) if n.postag.startswith("VB") and i), None)
    left = [n for n in nodes[:verb] if n.postag.startswith("NN")] if verb else []
    right = [n for n in nodes[verb + 1 :] if n.postag.startswith("NN")] if verb else []
    if not left or not right:
        raise ValueError(f"no clause in {text[:80]!r}")
    edges = [G.Edge(nodes[verb], left[-1], "nsubj"), G.Edge(nodes[verb], right[0], "dobj")]
    edges += [G.Edge(left[-1], n, "nn") for n in left[:-1]]
    edges += [G.Edge(right[0], n, "det") for n in nodes[verb + 1 : right[0].start] if n.postag == "DT"]
    return G.Graph(nodes, edges)


def guessed_tag(word: str, place: int) -> str:
    low = word.lower()
    if not any(c.isalnum() for c in word):
        return word if word in ".,:" else "SYM"
    if low in ("a", "an", "the", "this", "that", "these", "those"):
        return "DT"
    if low in G.PREPOSITIONS:
        return "IN"
    if low in G.IRREGULAR and G.IRREGULAR[low] != low and word.islower() or low.endswith("ed") and word.islower():
        return "VBD"
    if low.endswith(("ates", "izes", "ifies", "akes", "ows", "ives", "ends", "ints", "irs")) and word.islower():
        return "VBZ"
    if word[:1].isdigit():
        return "CD"
    return "NNP" if word[:1].isupper() and place else "NN"


#: Parsers by name; others (a dependency parser for raw text) are added by the caller: string -> Graph.
PARSERS: dict[str, Callable[[str], G.Graph]] = {"deserialize": G.parse, "plain": plain_parse}


def text_or_graph(raw: str) -> G.Graph:
    """A line that is a graph is read as one, any other is parsed."""
    try:
        return G.parse(raw)
    except ValueError:
        return PARSERS["plain"](raw)


PARSERS["sniff"] = text_or_graph


def word_list(spark: SparkSession, path: str) -> list[str]:
    """A list of words, one a line; lines that begin with # and blank ones don't count. Such lists are small."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.lower(F.trim("value")).alias("w")).distinct()
    return sorted(r["w"] for r in rows.collect())


def categories(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """category, lemma: a word list for each category."""
    out = None
    for name, path in sorted(paths.items()):
        one = spark.read.text(path).where(F.trim("value") != "").select(F.lit(name).alias("category"), F.lower(F.trim("value")).alias("lemma")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def part(column: Column) -> Column:
    """struct(text, s, e, idx, nodes) of ``text ;;; node; node``."""
    halves = F.split(column, r"\s*;;;\s*", 2)
    nodes = F.split(F.get(halves, F.lit(1)), r"\s*;\s+")
    idx = F.array_sort(F.transform(nodes, lambda n: F.regexp_extract(n, r"_(\d+)_-?\d+$", 1).cast("int")))
    return F.struct(F.get(halves, F.lit(0)).alias("text"), F.get(idx, F.lit(0)).alias("s"), (F.element_at(idx, -1) + 1).alias("e"), idx.alias("idx"))


def extractor(fields: Column, at: int) -> Column:
    """struct(kind, template, pattern, confidence) from four fields; only template extractors can be read back."""
    kind = F.get(fields, F.lit(at))
    bad = F.raise_error(F.concat(F.lit("not a template extractor: "), kind)).cast("string")
    return F.struct(F.when(kind == "Template", kind).otherwise(bad).alias("kind"), F.get(fields, F.lit(at + 1)).alias("template"), F.get(fields, F.lit(at + 2)).alias("pattern"), F.get(fields, F.lit(at + 3)).cast("double").alias("confidence"))


def parse_instances(rows: DataFrame, line: str = "line") -> DataFrame:
    """Labelled instances as writers.labelled writes them: score, fact, graph, extractor, parts, contexts, tokens and deps.

    A score that is neither 1 nor 0, or a line that hasn't 13 fields, raises.
    """
    p = F.split(line, "\t", -1)
    field = lambda i: F.get(F.col("p"), F.lit(i))
    whole = F.when(F.size(p) == 13, p).otherwise(F.raise_error(F.concat(F.lit("not an instance: "), F.substring(line, 1, 80))).cast("array<string>"))
    score = F.when(field(0) == "1", True).when(field(0) == "0", False).otherwise(F.raise_error(F.concat(F.lit("bad score: "), field(0))).cast("boolean"))
    e = F.col("extractor")
    words = lambda c, n: F.when(c != "None", F.slice(F.split(c, "_", -1), 1, n))
    said = F.split(field(12), "_", -1)
    place = lambda i: F.when(field(12) != "None", F.get(said, F.lit(i)).cast("int"))
    made = rows.select(whole.alias("p")).withColumn("extractor", extractor(F.col("p"), 3)).withColumn("parsed", parse_graph(F.get("p", F.lit(2))))
    lemmas = F.transform("parsed.tokens", lambda t: F.struct(t["idx"].alias("idx"), t["text"].alias("text"), t["postag"].alias("postag"), F.lower(t["text"]).alias("lemma"), t["offset"].alias("offset")))
    return made.select(
        score.alias("score"), field(1).alias("fact"), field(2).alias("graph"), "extractor", e["template"].alias("template"), e["pattern"].alias("pattern"),
        F.regexp_extract_all(e["pattern"], F.lit(r"[<>](?:\{(\w+):[^{}]*\}|([\w:]+))[<>]"), F.lit(2)).alias("pattern_labels"), e["pattern"].rlike(r"\{rel\d*[^{}]*regex=").alias("semantic"),
        (~F.regexp_extract(e["template"], r" (\w+|\{prep\})$", 1).isin(*G.PREPOSITIONS) & ~e["pattern"].rlike(r"[<>](?:prep_|\{\w+:regex=prep)")).alias("prep_mismatch"),
        part(field(7)).alias("arg1"), part(field(8)).alias("rel"), part(field(9)).alias("arg2"), field(10).cast("double").alias("pattern_confidence"),
        F.array_join(words(field(11), 2), " ").alias("enabler"), F.get(words(field(11), 1), F.lit(0)).alias("enabler_prefix"),
        F.get(words(field(12), 2), F.lit(0)).alias("attrib_arg"), F.get(words(field(12), 2), F.lit(1)).alias("attrib_rel"), place(2).alias("attrib_s"), (place(3) + 1).alias("attrib_e"),
        lemmas.alias("tokens"), F.col("parsed.deps").alias("deps"), F.array_join(F.transform("parsed.tokens", lambda t: t["text"]), " ").alias("text"),
    )


def instances(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_instances(spark.read.text(path).select(F.col("value").alias("line")))


def model_lines(spark: SparkSession, path: str) -> list[str]:
    """A model file; models are small and read whole, in order."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [x for r in rows for x in r["value"].splitlines()]


def weights(spark: SparkSession, path: str) -> dict[str, float]:
    return {r["name"]: r["weight"] for r in table(spark, path, "weights").collect()}
