"""Repeated passages by a depth-limited radix sort of suffixes.

Two documents repeat a passage where they have a window of `threshold` bytes in
common.  Suffixes are ordered only through that depth, by digits from the most
significant on; a suffix leaves as soon as no other shares its digits, and what
is equal at the end are the repeated windows.

The first digit of a window is its minimizer, the gram of `gram` bytes in it of
least hash.  Equal windows have equal minimizers, and neighbouring windows
mostly share theirs, so one row stands for all windows of a minimizer: a run of
about (threshold - gram) / 2 suffixes.  The second digit is the hash of all
bytes under the run: rows alike in both digits repeat all their windows at
once.  Digits are hashes: rows meet in them as they would in the leading bytes,
but in no order that means anything, as only equality counts.  Only runs that share the first digit and differ in the second go on to
the last digit, the windows one by one.  Each digit is one shuffle by its hash
and one sort.  Rows of a digit are streamed, and windows of a digit that very
many rows share are counted by window over all tasks; no group is held whole.

A window is repeated if it also starts in a document with a smaller id; every
byte under a repeated window is removed.  Digits are compared by 64-bit hashes,
two of them together (128 bits) for whatever decides a removal.

Defined cases: null text counts as empty; texts shorter than the threshold lose
nothing.  Rows that repeat an id are cut each, and never against each other.  A
null id counts as larger than any other.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import _BYTES, _INVERSE, U64, mix, powers, text_slices, whole_runs
from tablefit.llm.columns import kept
from tablefit.llm.skewed import marked

THRESHOLD = 50
GRAM = 20
CROWD = 50_000
RUN = 64
HELD = 500_000
LAST = (1 << 63) - 1


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all parts, where each begins, and what hashes any stretch of them."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTES[raw] * powers(len(raw)), out=sums[1:])
    return raw, begins, sums, powers(len(raw) + 1, _INVERSE)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def suffix_runs(threshold: int, gram: int):
    """Rows (h, s, at, sub, place): first digit, second digit, document, and first window * RUN + windows - 1.

    Among the rows that a task holds together, those alike in both digits to one
    of a smaller document are decided; their place is inverted, and their first
    digit gives way to a hash that deals them evenly.  So of a passage that many
    documents share a task sends one row to where the others meet.
    """
    width = threshold - gram + 1

    def decided(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, s, at, sub, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, s, h))
        h, s, at, sub, place = (c[order] for c in (h, s, at, sub, place))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
        done = at > at[new][np.cumsum(new) - 1]
        h = np.where(done, mix(at.view("u8") * U64(0x9E3779B97F4A7C15) + place.view("u8")), h)
        place = np.where(done, ~place, place)
        for low in range(0, len(h), 50_000):
            some = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[some]) for c in (h.view("i8"), s.view("i8"), at, sub, place)], ["h", "s", "at", "sub", "place"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                data = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                raw, begins, sums, back = _joined(data)
                if len(raw) < threshold:
                    continue
                grams = mix((sums[gram:] - sums[:-gram]) * back[: len(raw) - gram + 1])
                # low bits tell the place, so that a window's least gram is one place
                marked = (grams & ~U64(RUN - 1)) | (np.arange(len(grams), dtype=U64) & U64(RUN - 1))
                least = _least(marked, width)
                window = np.arange(len(least))
                of = np.searchsorted(begins, window, side="right") - 1
                window = window[window + threshold <= begins[of + 1]]
                if not len(window):
                    continue
                of, least = of[window], least[window]
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])))
                start = np.flatnonzero(new)
                n = np.diff(np.append(start, len(window)))
                first, of = window[start], of[start]
                end = first + n + threshold - 1
                under = mix((sums[end] - sums[first]) * back[first] + n.astype(U64) * U64(0x9E3779B97F4A7C15))
                held.append((
                    least[start] >> U64(6), under, part.column("at").to_numpy()[of], part.column("sub").to_numpy()[of],
                    (first - begins[of]) * RUN + n - 1,
                ))
                rows += len(start)
                if rows > HELD:
                    yield from decided(held)
                    held, rows = [], 0
        if held:
            yield from decided(held)
    return run


RUN_SCHEMA = "h long, s long, at long, sub long, place long"
KIND_SCHEMA = "open boolean, h long, at long, sub long, place long"


def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order (h, s, at): those whose windows all repeat, and those open after two digits.

    Rows that their task had decided pass through.

    A row repeats if (h, s) came with a smaller document.  The first document's
    rows of each (h, s) are open if h comes with more than one s.  Only the last
    key, and the open rows of the first s of the last h, are held.
    """
    h0 = s0 = first0 = None
    only0, held = True, []

    def rows(batch: pa.RecordBatch, open_: bool, chosen: np.ndarray) -> pa.RecordBatch:
        some = batch.take(pa.array(chosen))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(chosen), open_)), *(some.column(c) for c in ("h", "at", "sub", "place"))],
            ["open", "h", "at", "sub", "place"],
        )

    for batch in batches:
        done = batch.column("place").to_numpy() < 0
        if done.any():
            known = rows(batch, False, np.flatnonzero(done))
            yield known.set_column(4, "place", pa.array(~known.column("place").to_numpy()))
            batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        h, s, at = (batch.column(c).to_numpy() for c in ("h", "s", "at"))
        new_h = np.concatenate(([h0 is None or h[0] != h0], h[1:] != h[:-1]))
        new_s = new_h | np.concatenate(([s0 is None or s[0] != s0], s[1:] != s[:-1]))
        key, starts = np.cumsum(new_s), np.flatnonzero(new_s)
        first = np.concatenate(([first0 if first0 is not None else 0], at[starts]))[key]
        is_first_s = np.concatenate(([only0], new_h[starts]))[key]
        repeated = at > first
        run = np.cumsum(new_h)
        several = np.zeros(run[-1] + 1, bool)
        several[run[starts[~new_h[starts]]]] = True
        # a run that went on from the last batch may have had several already
        if not new_h[0] and not only0:
            several[0] = True
        open_ = ~repeated & (~is_first_s | several[run])
        yield rows(batch, False, np.flatnonzero(repeated))
        yield rows(batch, True, np.flatnonzero(open_))
        if held and several[0] and not new_h[0]:
            yield from held
            held = []
        if new_h.any():
            held = []
        waiting = np.flatnonzero(~repeated & ~open_ & (run == run[-1]))
        if len(waiting):
            held.append(rows(batch, True, waiting))
        h0, s0, first0, only0 = h[-1], s[-1], first[-1], bool(is_first_s[-1])


def open_texts(threshold: int):
    """Rows (h, at, sub, start, data, crowded) of open runs with the bytes under them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                spots = batch.column("spots")[i].values
                h, crowded, place = spots.field("h"), spots.field("crowded"), spots.field("place").to_numpy()
                start, n = np.divmod(place, RUN)
                for low in range(0, len(place), 20_000):
                    some = slice(low, low + 20_000)
                    found = [data[b:e] for b, e in zip(start[some].tolist(), (start + n + threshold)[some].tolist())]
                    m = len(found)
                    yield pa.RecordBatch.from_arrays([
                        h.slice(low, m), pa.array([batch.column("at")[i].as_py()] * m, pa.int64()),
                        pa.array([batch.column("sub")[i].as_py()] * m, pa.int64()), pa.array(start[some]),
                        pa.array(found, pa.binary()), crowded.slice(low, m),
                    ], ["h", "at", "sub", "start", "data", "crowded"])
    return run


def _windows(table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row's document, and hash of every window of the rows."""
    data = table.column("data").to_pylist()
    _, begins, sums, back = _joined(data)
    n = np.maximum(0, np.diff(begins) - threshold + 1)
    row = np.repeat(np.arange(len(data)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = begins[row] + step
    return row, table.column("start").to_numpy()[row] + step, mix((sums[place + threshold] - sums[place]) * back[place])


def _places(at: np.ndarray, sub: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Windows, ordered within their documents' rows, as (at, sub, place) with neighbours together."""
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["at", "sub", "place"])
    apart = (at[1:] != at[:-1]) | (sub[1:] != sub[:-1]) | (place[1:] != place[:-1] + 1)
    new = np.concatenate(([True], apart))
    # no more than RUN windows together
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    start = np.flatnonzero(new | (rank % RUN == 0))
    n = np.diff(np.append(start, len(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(at[start]), pa.array(sub[start]), pa.array(place[start] * RUN + n - 1)], ["at", "sub", "place"]
    )


def compare_windows(threshold: int):
    """Repeated windows among the rows of each first digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_runs(batches, ("h",)):
            row, place, digit = _windows(table, threshold)
            if not len(row):
                continue
            h, at, sub = (table.column(c).to_numpy()[row] for c in ("h", "at", "sub"))
            order = np.lexsort((at, digit, h))
            new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (digit[order][1:] != digit[order][:-1])))
            first = at[order][new][np.cumsum(new) - 1]
            repeated = np.sort(order[at[order] > first])
            yield _places(at[repeated], sub[repeated], place[repeated])
    return run


def each_window(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 5000):
                table = pa.Table.from_batches([batch.slice(low, 5000)])
                row, place, digit = _windows(table, threshold)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(table.column(c).to_numpy()[row]) for c in ("h", "at", "sub")),
                    pa.array(place * RUN), pa.array(digit.view("i8")),
                ], ["h", "at", "sub", "place", "digit"])
    return run


CUT_SCHEMA = "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def cut(threshold: int):
    """Per document its bytes, the removed spans, and the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in text_slices(batch, "text"):
                sizes, spans, left = [], [], []
                for text, places in zip(part.column("text").to_pylist(), part.column("places")):
                    data = text.encode("utf-8", "surrogatepass")
                    sizes.append(len(data))
                    if not places.is_valid:
                        spans.append([])
                        left.append(data)
                        continue
                    start, n = np.divmod(places.values.to_numpy(), RUN)
                    change = np.zeros(len(data) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + threshold, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).tolist()
                    spans.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
                    left.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(left, pa.binary()),
                ], ["id", "n_bytes", "spans", "kept"])
    return run


def repeated_places(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(at, sub, place) of the windows of documents (at, sub, text) that repeat one of a smaller `at`."""
    runs = docs.mapInArrow(suffix_runs(threshold, gram), RUN_SCHEMA)
    compared = kept(
        runs.repartition("h").sortWithinPartitions("h", "s", "at").mapInArrow(compare_runs, KIND_SCHEMA), "suffix-runs"
    )
    open_ = compared.where("open").select("h", "at", "sub", "place")
    crowds = kept(open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "suffix-crowds")
    parted = marked(open_, crowds, ["h"], "n", open_.count(), "crowded")
    # equal rows have equal places; a document's own are bounded by its length
    spots = parted.groupBy("at", "sub").agg(F.collect_set(F.struct("h", "place", "crowded")).alias("spots"))
    under = kept(
        docs.join(spots, ["at", "sub"]).select("at", "sub", "text", "spots")
        .mapInArrow(open_texts(threshold), "h long, at long, sub long, start long, data binary, crowded boolean"),
        "suffix-texts",
    )
    few = under.where("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h").mapInArrow(
        compare_windows(threshold), "at long, sub long, place long"
    )
    windows = under.where("crowded").mapInArrow(
        each_window(threshold), "h long, at long, sub long, place long, digit long"
    )
    least = windows.groupBy("h", "digit").agg(F.min("at").alias("least"))
    many = windows.join(least, ["h", "digit"]).where("at > least").select("at", "sub", "place")
    return kept(compared.where("not open").select("at", "sub", "place").union(few).union(many), "repeated-places")


def _grams(threshold: int, gram: int | None) -> int:
    gram = gram or max(threshold * 2 // 5, threshold - RUN + 1, 1)
    if not 0 < gram <= threshold or threshold - gram + 1 > RUN:
        raise ValueError(f"a window of {threshold} bytes cannot have grams of {gram}")
    return gram


def _with_places(docs: DataFrame, id_col: str, text_col: str, threshold: int, gram: int | None) -> DataFrame:
    """(row, text, places): the other columns as a struct, the text, and the places of its repeated windows."""
    others = [F.col(c) for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = _told_apart(docs.select(
        F.struct(*others).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("at"), text.alias("text")
    ))
    places = repeated_places(own.select("at", "sub", "text"), threshold, _grams(threshold, gram))
    places = places.groupBy("at", "sub").agg(F.collect_set("place").alias("places"))
    return own.join(places, ["at", "sub"], "left").select("row", "text", "places")


def _told_apart(own: DataFrame) -> DataFrame:
    """Rows (row, at, text) with `sub`, a number that different texts of one id do not share.

    Where no id repeats there is nothing to tell apart.  Else distinct pairs of
    id and text, known by 128 bits of hash, are numbered in a written table.
    """
    if own.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own.withColumn("sub", F.lit(0).cast("long"))
    keys = [F.xxhash64(F.lit(i), "text").alias(f"text{i}") for i in (1, 2)]
    own = own.select("*", *keys)
    numbers = kept(
        own.select("at", "text1", "text2").distinct().withColumn("sub", F.monotonically_increasing_id()), "text-numbers"
    )
    return own.join(numbers, ["at", "text1", "text2"]).drop("text1", "text2")


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int | None = None
) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed, as byte places) and kept (the bytes left)."""
    placed = _with_places(docs.select(id_col, text_col), id_col, text_col, threshold, gram)
    found = placed.select(F.col("row")[id_col].cast("long").alias("id"), "text", "places")
    return found.mapInArrow(cut(threshold), CUT_SCHEMA).withColumnRenamed("id", id_col)


def strip_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int | None = None
) -> DataFrame:
    """The documents, all their columns, with the text that is left; a character cut in two goes whole."""
    placed = _with_places(docs, id_col, text_col, threshold, gram)
    schema = placed.select("row", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_batch = cut(threshold)
        for batch in batches:
            for part in text_slices(batch, "text"):
                numbered = pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(part.num_rows)), part.column("text"), part.column("places")], ["id", "text", "places"]
                )
                left = [b.decode("utf-8", "ignore") for out in cut_batch(iter([numbered])) for b in out.column("kept").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(left, pa.string())], ["row", "text"])

    left = placed.mapInArrow(run, schema)
    return left.select(*(F.col("text").alias(text_col) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
