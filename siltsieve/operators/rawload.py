"""Raw delimited and JSON-line records to loaded rows, with the failing ones set apart and explained.

Method: the text of a batch of records is one array of character classes over which a quote-aware
finite-state tokenizer runs. The array is cut into equal chunks; each chunk's state transition function
(start state -> end state) is computed for all chunks at once, the functions are composed across chunks,
and a second vectorised pass labels every character with its state. Field bounds, field counts and the
offset of the first error follow from the states; a record end resets every state, so records of any
length and any chunk border are treated alike.

Defined edge cases: null or blank text is a blank line, line 1 of csv and tsv is the header (a byte order
mark before it is dropped); a delimited record of a file without header fails as ``columns``; a file of
unknown or null format is read as csv; an empty value passes every pattern; fields without a pattern pass;
repeated records are loaded each time; a trailing carriage return or line feed belongs to the record end.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltsieve.session import BROADCAST_ROWS, dim_join
from siltsieve.sources.records import header_names

START, BARE, QUOTED, CLOSED, BROKEN = range(5)
OTHER, QUOTE, DELIM, END = range(4)
#: next state by [class, state]
TRANSITIONS = np.array([
    [BARE, BARE, QUOTED, BROKEN, BROKEN],
    [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
    [START, START, QUOTED, START, BROKEN],
    [START, START, START, START, START],
], dtype=np.uint8)
CHUNK = 256
MAX_SPECS = 10_000
SCHEMA = "line_id bigint, file_id bigint, line_number int, kind string, reason string, error_offset int, error_field string, fields map<string,string>"


def scan_states(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State before each character, starting in START, by composing the transition functions of chunks."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(rows, chunk)
    maps = np.broadcast_to(np.arange(5, dtype=np.uint8), (rows, 5)).copy()
    for j in range(chunk):  # every chunk's function for every start state, all chunks at once
        maps = TRANSITIONS[grid[:, j][:, None], maps]
    starts = np.zeros(rows, np.uint8)
    for i in range(1, rows):  # composition across chunks
        starts[i] = maps[i - 1, starts[i - 1]]
    states = np.empty((rows, chunk), np.uint8)
    s = starts
    for j in range(chunk):
        states[:, j] = s
        s = TRANSITIONS[grid[:, j], s]
    return states.reshape(-1)[:n]


def tokenize(texts: list[str], delimiter: str) -> list[tuple[list[str] | None, int, list[int]]]:
    """Per record its fields, or None with the offset of the first quoting error; and where each field begins."""
    if not texts:
        return []
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.zeros(len(codes), np.uint8)
    classes[codes == ord('"')] = QUOTE
    classes[codes == ord(delimiter)] = DELIM
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # by length: any character may stand in a text
    classes[ends] = END
    states = scan_states(classes)
    begins = np.concatenate([[0], ends[:-1] + 1])
    cuts = np.flatnonzero((classes == DELIM) & (states != QUOTED) & (states != BROKEN))
    lo, hi = np.searchsorted(cuts, begins), np.searchsorted(cuts, ends)
    broken = np.flatnonzero(states == BROKEN)
    first = np.searchsorted(broken, begins)
    out: list[tuple[list[str] | None, int, list[int]]] = []
    for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        last = states[e]
        if last == BROKEN:
            out.append((None, int(broken[first[i]]) - 1 - b, []))
        elif last == QUOTED:
            out.append((None, e - b, []))
        else:
            marks = [b - 1, *cuts[lo[i] : hi[i]].tolist(), e]
            raw = (joined[x + 1 : y] for x, y in zip(marks, marks[1:], strict=False))
            out.append(([f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in raw], -1, [x + 1 - b for x in marks[:-1]]))
    return out


def _reject(x: str) -> None:
    raise ValueError(x)


def _text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else json.dumps(v)


class _Number(str):
    pass


def parse_object(text: str) -> tuple[dict[str, str] | None, int]:
    """Field texts of exactly one JSON object (number lexemes kept), else None and the offset of the failure."""
    try:
        o = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_reject)
    except json.JSONDecodeError as e:
        return None, e.pos
    except (ValueError, RecursionError):
        return None, 0
    return ({k: _text(v) for k, v in o.items()}, -1) if isinstance(o, dict) else (None, 0)


def bad_value(fields: dict[str, str], patterns: dict[str, re.Pattern], dates: tuple[str, ...] = ()) -> str | None:
    """The first field that does not match its pattern or, named in ``dates``, is no calendar date."""
    for name, v in fields.items():
        if v == "" or (p := patterns.get(name)) is None:
            continue
        if not p.fullmatch(v):
            return name
        if name in dates:
            try:
                datetime.date.fromisoformat(v)
            except ValueError:
                return name
    return None


def _loader(specs: list[tuple[str, str]], dates: tuple[str, ...]):
    arrow = pa.schema([("line_id", pa.int64()), ("file_id", pa.int64()), ("line_number", pa.int32()), ("kind", pa.string()), ("reason", pa.string()), ("error_offset", pa.int32()), ("error_field", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
    clean = lambda s: s.encode("utf-8", "replace").decode()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {n: re.compile(p, re.ASCII) for n, p in specs}
        for batch in batches:
            d = batch.to_pydict()
            n = batch.num_rows
            kind, reason, offset, field, values, places = ["row"] * n, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n
            texts = [(t or "").rstrip("\r\n") for t in d["raw_text"]]
            for delimiter, tsv in ((",", False), ("\t", True)):
                own = [i for i in range(n) if texts[i].strip() and d["file_format"][i] not in ("jsonl", "ndjson") and (d["file_format"][i] == "tsv") == tsv]
                headers = {h: header_names(tokenize([h.lstrip("﻿").rstrip("\r\n")], delimiter)[0][0] or []) for h in {d["header"][i] for i in own} if h}
                own = [i for i in own if d["line_number"][i] != 1]
                for i, (parts, at, begins) in zip(own, tokenize([texts[i] for i in own], delimiter), strict=True):
                    names = headers.get(d["header"][i] or "")
                    if parts is None:
                        reason[i], offset[i] = "quoting", at
                    elif not names or len(parts) != len(names):
                        # the first field too many, or the end of a record with too few
                        n_names = len(names or ())
                        reason[i], offset[i] = "columns", begins[n_names] if len(begins) > n_names else len(texts[i])
                    else:
                        values[i], places[i] = dict(zip(names, parts, strict=True)), dict(zip(names, begins, strict=True))
            for i in range(n):
                json_lines = d["file_format"][i] in ("jsonl", "ndjson")
                if not texts[i].strip():
                    kind[i] = "blank"
                elif json_lines:
                    text = texts[i].lstrip("﻿") if d["line_number"][i] == 1 else texts[i]
                    values[i], at = parse_object(text)
                    if values[i] is None:
                        reason[i], offset[i] = "malformed", at + len(texts[i]) - len(text)
                elif d["line_number"][i] == 1:
                    kind[i] = "header"
                if values[i] is not None and (f := bad_value(values[i], patterns, dates)) is not None:
                    reason[i], field[i], values[i] = "value", f, None
                    offset[i] = places[i][f] if places[i] is not None else max(0, texts[i].find(json.dumps(f, ensure_ascii=False)))
                if reason[i]:
                    kind[i] = "bad"
            maps = [None if v is None else [(clean(k), clean(x)) for k, x in v.items()] for v in values]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip([d["line_id"], d["file_id"], d["line_number"], kind, reason, offset, field, maps], arrow, strict=True)], schema=arrow)

    return load


def load_raw(raw: DataFrame, files: DataFrame, specs: DataFrame, dates: tuple[str, ...] = (), bound: int = BROADCAST_ROWS) -> DataFrame:
    """Every record with its kind (row, bad, blank, header), reason of failure and loaded fields.

    A file's format and header are joined to its records by a size-checked broadcast, else by a salted join.
    ``dates`` names fields whose values must be calendar dates. ``specs`` names fields, so it is as small as a schema (checked against MAX_SPECS).
    """
    patterns = [(r[0], r[1]) for r in specs.select("field_name", "value_pattern").limit(MAX_SPECS + 1).collect() if r[0] is not None and r[1] is not None]
    if len(patterns) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} field patterns")
    head = raw.filter(F.col("line_number") == 1).groupBy("file_id").agg(F.min_by("raw_text", "line_id").alias("header"))
    info = files.select("file_id", F.lower("file_format").alias("file_format")).dropDuplicates(["file_id"]).join(head, "file_id", "full")
    d = dim_join(raw.select("line_id", "file_id", "line_number", "raw_text"), info, ["file_id"], bound=bound)
    return d.mapInArrow(_loader(patterns, dates), SCHEMA)


def typed_rows(loaded: DataFrame, types: dict[str, str]) -> DataFrame:
    """The loaded rows with a typed column per declared field and all other fields in the map ``further``.

    A text a type cannot hold stays in ``further``; an empty one is null.
    """
    text = lambda c: F.when(F.col("fields")[c] != "", F.col("fields")[c])
    typed = {c: text(c).try_cast(t) for c, t in types.items()}
    plain = [c for c, t in types.items() if t == "string"]
    lost = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(text(c).isNotNull() & typed[c].isNull(), F.lit(c)) for c, t in types.items() if t != "string"]))
    d = loaded.filter("kind = 'row'").withColumn("__lost", lost)
    further = F.map_filter("fields", lambda k, v: ~k.isin(*types) | F.array_contains("__lost", k)) if types else F.col("fields")
    return d.select("line_id", "file_id", *[(text(c) if c in plain else typed[c]).alias(c) for c in types], further.alias("further"))


def failed_records(loaded: DataFrame) -> DataFrame:
    return loaded.filter("kind = 'bad'").select("line_id", "reason")


def file_counts(loaded: DataFrame) -> DataFrame:
    """Per file the counts a load report has: rows read, written and failed by reason."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    r = F.col("reason")
    return loaded.groupBy("file_id").agg(
        n(F.col("kind").isin("row", "bad"))("rows_read"), n(F.col("kind") == "row")("rows_written"), n(F.col("kind") == "blank")("blank_lines"),
        n(r == "quoting")("bad_quoting"), n(r == "columns")("bad_columns"), n(r == "malformed")("bad_malformed"), n(r == "value")("bad_values"),
        F.min(F.when(F.col("kind") == "bad", F.struct("line_number", "reason"))).alias("first"),
    ).select("*", F.when(F.col("first").isNotNull(), F.concat(F.lit("record on line "), F.col("first.line_number").cast("string"), F.lit(": "), F.col("first.reason"))).alias("error_message")).drop("first")
