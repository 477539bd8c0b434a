"""Images worked on whole: the pixels (keys, y, x) of each come to one task in order, those of many images at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .lineage import found_by_workers

#: Rows of whole images that are worked on at once; a larger image is worked on alone.
ROWS = 1 << 18
#: What is larger than any label.
NO_LABEL = 1 << 62


def by_image(pixels: DataFrame, keys: Sequence[str], columns: Sequence[str], made: dict[str, DataType], work: Callable) -> DataFrame:
    """(keys, made): what ``work`` makes of the images' numbers and ``columns``, arrays sorted by image, y and x.

    ``work`` gives the number of the image that each of its rows is of, and the columns of these
    rows. A task holds as many whole images as have ROWS pixels, one at least.
    """
    found_by_workers(pixels.sparkSession)
    schema = StructType([*(pixels.schema[k] for k in keys), *(StructField(n, kind) for n, kind in made.items())])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x"))
    rows = pixels.select(*keys, *columns).withColumn("__k", place).sortWithinPartitions(*keys, "y", "x")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def worked(table):
            starts = table["__k"].to_numpy() == 1
            image, out = work(np.cumsum(starts) - 1, *(table[c].to_numpy() for c in columns))
            whose = pa.array(np.flatnonzero(starts)[image])
            named = {k: table[k].take(whose) for k in keys} | dict(zip(made, out, strict=True))
            done = pa.table([named[f.name] if f.name in keys else pa.array(named[f.name]).cast(f.type) for f in kinds], names=kinds.names).cast(kinds)
            yield from done.combine_chunks().to_batches(max_chunksize=ROWS)

        held, n, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                table = pa.Table.from_batches(held)
                last = int(np.flatnonzero(table["__k"].to_numpy() == 1)[-1])
                if last:
                    yield from worked(table.slice(0, last))
                held, n = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
                enough = max(ROWS, 2 * n)
        if n:
            yield from worked(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def row_runs(image, y, x):
    """(image, y, s, e) of the runs of pixels of each row."""
    beside = (image[1:] == image[:-1]) & (y[1:] == y[:-1])
    new = np.concatenate([[True], ~(beside & (x[1:] - x[:-1] <= 1))])  # a pixel that comes twice changes nothing
    first = np.flatnonzero(new)
    return image[first], y[first], x[first], x[np.append(first[1:], len(x)) - 1]


def _rows(image, y):
    """The number of each run's row, and whether the next row is that of the line below."""
    new = np.concatenate([[True], (image[1:] != image[:-1]) | (y[1:] != y[:-1])])
    first = np.flatnonzero(new)
    below = np.append((image[first[1:]] == image[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1), False)
    return np.cumsum(new) - 1, below


def touching(image, y, s, e, reach):
    """Pairs (a, b) of runs, sorted, of which b lies in the row below and overlaps, or with a ``reach`` of 1 touches by a corner."""
    row, below = _rows(image, y)
    low, width = s.min() - 1, int(e.max()) - int(s.min()) + 3
    at = row.astype(np.int64) * width
    a = np.flatnonzero(below[row])
    lo = np.searchsorted(at + (e - low), at[a] + width + (s[a] - reach - low), "left")
    hi = np.searchsorted(at + (s - low), at[a] + width + (e[a] + reach - low), "right")
    n = np.maximum(hi - lo, 0)
    return np.repeat(a, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def least_reached(n, a, b):
    """The smallest of n nodes that each reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return label
        m = np.minimum(p, q)
        np.minimum.at(label, p, m)
        np.minimum.at(label, q, m)
        while ((up := label[label]) != label).any():
            label = up


def numbered(image, label):
    """Parts by the first of their runs, counted from 0 in each image."""
    roots = np.flatnonzero(label == np.arange(len(label)))
    return np.searchsorted(roots, label) - np.searchsorted(image[roots], image)


def labelled(image, y, x):
    """The runs of each image with the numbers of the blobs that touch by sides or corners."""
    image, y, s, e = row_runs(image, y, x)
    a, b = touching(image, y, s, e, 1)
    return image, (numbered(image, least_reached(len(y), a, b)), y, s, e)


def without_holes(image, y, s, e):
    """Runs with the background between them that sides do not join to the outside."""
    row, below = _rows(image, y)
    left = np.flatnonzero(row[1:] == row[:-1])  # the gap after this run
    if not len(left):
        return image, y, s, e
    gs, ge, r = e[left] + 1, s[left + 1] - 1, row[left]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    lo, hi = s[first], e[np.append(first[1:], len(s)) - 1]
    above = np.concatenate([[False], below[:-1]])
    up, down = np.maximum(r - 1, 0), np.minimum(r + 1, len(lo) - 1)
    leaks = ~above[r] | (gs < lo[up]) | (ge > hi[up]) | ~below[r] | (gs < lo[down]) | (ge > hi[down])
    part = least_reached(len(left), *touching(image[left], y[left], gs, ge, 0))
    open_part = np.zeros(len(left), bool)
    np.logical_or.at(open_part, part, leaks)
    joined = np.zeros(len(s), bool)
    joined[left[~open_part[part]] + 1] = True
    starts = np.flatnonzero(~joined)
    return image[starts], y[starts], s[starts], e[np.append(starts[1:], len(s)) - 1]


def contours(image, y, x, least, fill=True):
    """The runs of blobs, with ``fill`` filled ones, whose contour area is over ``least``, with their blobs' numbers and areas.

    Two runs of neighbouring rows have a whole square between each two columns that they share,
    and half of one where one run goes on at an end of the other.
    """
    image, y, s, e = row_runs(image, y, x)
    if fill:
        image, y, s, e = without_holes(image, y, s, e)
    a, b = touching(image, y, s, e, 1)
    label = least_reached(len(y), a, b)
    halves = sum(((s[p] <= e[q]) & (e[q] < e[p])).astype(np.int64) + ((s[p] < s[q]) & (s[q] <= e[p])) for p, q in ((a, b), (b, a)))
    squares = np.maximum(np.minimum(e[a], e[b]) - np.maximum(s[a], s[b]), 0) + 0.5 * halves
    area = np.bincount(label[a], weights=squares, minlength=len(label))[label]
    large = area > least
    return image[large], tuple(c[large] for c in (numbered(image, label), y, s, e, area))


def flood(image, y, x, label):
    """Pixels with the label that reaches them first, in steps to sides and corners; of labels that arrive together the smallest."""
    height, width = int(y.max()) - int(y.min()) + 3, int(x.max()) - int(x.min()) + 3
    code = (image.astype(np.int64) * height + (y - y.min() + 1)) * width + (x - x.min() + 1)
    near = []
    for step in (d * width + k for d in (-1, 0, 1) for k in (-1, 0, 1) if d or k):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        near.append(np.where(code[at] == code + step, at, len(code)))
    near, label = np.array(near), np.append(label, NO_LABEL)
    todo = np.flatnonzero(label[:-1] == NO_LABEL)
    while len(todo):
        got = label[near[:, todo]].min(axis=0)
        new = got < NO_LABEL
        if not new.any():
            break
        label[todo[new]] = got[new]
        todo = todo[~new]
    done = label[:-1] < NO_LABEL
    return image[done], (y[done], x[done], label[:-1][done])
