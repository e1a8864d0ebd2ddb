"""Tables of whole pages, many pages at a time: what :func:`quarry.operators.layout.rebuild_tables` does, on sorted arrays.

Rows come sorted by page. Runs of rows are numbered in their sorted order, and each step works on the arrays of all pages at hand, so that a page costs
no call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are rebuilt at once; a page of more is passed over.
ROWS = 100_000
#: Cells of a page, and pairs of a cell and a character whose heights meet, for each of its elements; a page of more is passed over.
CELLS, PAIRS = 16, 64
NAMES = ("doc_id", "page", "table", "row", "col", "x", "y", "width", "height", "is_filled", "text")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    first = np.ones(len(keys[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _numbered(first: np.ndarray, new: np.ndarray) -> np.ndarray:
    """From 1 for each run of rows that begins at ``first``: how many rows were new so far."""
    total = np.cumsum(new & ~first)
    return total - total[np.flatnonzero(first)][np.cumsum(first) - 1] + 1


def _largest_before(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The largest of a run's earlier values; -inf at its first row. Values are compared by rank, so that one accumulation serves all runs."""
    if not len(values):
        return values
    levels, rank = np.unique(values, return_inverse=True)
    run = np.cumsum(first) - 1
    best = np.maximum.accumulate(run * len(levels) + rank) - run * len(levels)
    before = np.full(len(values), -np.inf)
    before[1:] = levels[best[:-1]]
    before[first] = -np.inf
    return before


def _islands(keys: list[np.ndarray], value: np.ndarray, tolerance: float) -> np.ndarray:
    """As :func:`quarry.operators.layout.islands`, for each row."""
    sort = np.lexsort((value, *reversed(keys)))
    ordered = value[sort]
    new = np.concatenate([[False], ordered[1:] - ordered[:-1] > tolerance])[: len(value)]
    out = np.empty(len(value), np.int64)
    out[sort] = _numbered(_starts(*(k[sort] for k in keys)), new)
    return out


def _extreme(ufunc: np.ufunc, start: float, size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(size, start)
    ufunc.at(out, at, values)
    return out


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number as often as its count says, and the place among its repetitions."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _rebuilt(held: pa.Table, page: np.ndarray, tolerance: float, table_gap: float, least_cells: int) -> Iterator[pa.RecordBatch]:
    """The filled cells of these pages, numbered from 0; and for each page that is passed over a row without a table."""
    pages = int(page[-1]) + 1
    x, y, w, h = (np.asarray(held[c].fill_null(np.nan)) for c in ("x", "y", "width", "height"))
    rect = np.asarray(held["is_rect"])
    size = np.bincount(page, minlength=pages)
    odd = np.bincount(page, ~np.isfinite(x + y + w + h), pages) > 0
    boxes = np.flatnonzero(rect & ~odd[page])

    # tables, rows and columns
    boxes = boxes[np.lexsort((x[boxes], y[boxes], page[boxes]))]
    bp, bx, by, bw, bh = (v[boxes] for v in (page, x, y, w, h))
    first = _starts(bp) if len(bp) else np.zeros(0, bool)
    table = _numbered(first, by - _largest_before(first, by + bh) > table_gap) if len(bp) else np.zeros(0, np.int64)
    row, col = (_islands([bp, table], v, tolerance) if len(bp) else table for v in (by, bx))
    # tables of all pages in one numbering
    of = np.cumsum(_starts(bp, table)) - 1 if len(bp) else table
    tables = int(of[-1]) + 1 if len(of) else 0
    rows, cols = (_extreme(np.maximum, 0, tables, of, v).astype(np.int64) for v in (row, col))
    table_page = _extreme(np.maximum, 0, tables, of, bp).astype(np.int64)
    cells = np.where(rows * cols >= least_cells, rows * cols, 0)
    odd |= np.bincount(table_page, cells, pages) > CELLS * size
    cells[odd[table_page]] = 0

    # every row and column of a table, with the edges of the rectangles there
    row0, col0, cell0 = (np.cumsum(n) - n for n in (rows, cols, cells))
    row_at, col_at = row0[of] + row - 1, col0[of] + col - 1
    row_y, row_h = _extreme(np.minimum, np.inf, rows.sum(), row_at, by), _extreme(np.maximum, -np.inf, rows.sum(), row_at, bh)
    col_x, col_w = _extreme(np.minimum, np.inf, cols.sum(), col_at, bx), _extreme(np.maximum, -np.inf, cols.sum(), col_at, bw)
    cell_of, place = _expanded(cells)
    cell_row, cell_col = place // np.maximum(cols, 1)[cell_of], place % np.maximum(cols, 1)[cell_of]
    some = cells[of] > 0
    at, total = (cell0[of] + (row - 1) * cols[of] + col - 1)[some], len(cell_of)
    cx, cy = _extreme(np.minimum, np.inf, total, at, bx[some]), _extreme(np.minimum, np.inf, total, at, by[some])
    cw, ch = _extreme(np.maximum, -np.inf, total, at, bw[some]), _extreme(np.maximum, -np.inf, total, at, bh[some])
    filled = np.isinf(cx)
    cx, cw = np.where(filled, col_x[col0[cell_of] + cell_col], cx), np.where(filled, col_w[col0[cell_of] + cell_col], cw)
    cy, ch = np.where(filled, row_y[row0[cell_of] + cell_row], cy), np.where(filled, row_h[row0[cell_of] + cell_row], ch)

    # characters meet the cells of their page that begin no further above their middle than the page's highest cell is high
    cell_page = table_page[cell_of]
    chars = np.flatnonzero(~rect & ~odd[page])
    tp, tx, ty = page[chars], x[chars] + w[chars] / 2, y[chars] + h[chars] / 2
    highest = _extreme(np.maximum, -np.inf, pages, cell_page, ch)
    reach = np.where(np.isfinite(highest), highest, 0.0)[tp]
    reach = np.maximum(reach, 0.0) + 1e-9 * (1 + np.abs(ty) + np.abs(reach))
    by_y = np.lexsort((cy, cell_page))

    def before(value: np.ndarray, last: bool) -> np.ndarray:
        """How many cells come before a value in order of page and y, equal ones among them if they are asked for."""
        kind = np.concatenate([np.ones(total, np.int8), np.full(len(value), 2 if last else 0, np.int8)])
        merged = np.lexsort((kind, np.concatenate([cy, value]), np.concatenate([cell_page, tp])))
        counts = np.cumsum(merged < total)
        out = np.empty(len(value), np.int64)
        out[merged[merged >= total] - total] = counts[merged >= total]
        return out

    low = before(ty - reach, False)
    meets = np.maximum(before(ty, True) - low, 0)
    many = np.bincount(tp, meets, pages) > PAIRS * size
    odd |= many
    meets[many[tp]] = 0
    char, place = _expanded(meets)
    cell = by_y[low[char] + place]
    inside = (tx[char] >= cx[cell]) & (tx[char] < cx[cell] + cw[cell]) & (ty[char] >= cy[cell]) & (ty[char] < cy[cell] + ch[cell])
    cell, char = cell[inside], chars[char[inside]]

    # texts in order of line, x and text
    line = _islands([cell], y[char], tolerance) if len(cell) else cell
    text = held["text"].combine_chunks().take(pa.array(char))
    spoken = np.asarray(text.is_valid())
    cell, char, line, text = cell[spoken], char[spoken], line[spoken], text.filter(pa.array(spoken))
    left = x[char]
    sort = np.lexsort((left, line, cell))
    if len(sort) > 1 and ((cell[sort][1:] == cell[sort][:-1]) & (line[sort][1:] == line[sort][:-1]) & (left[sort][1:] == left[sort][:-1])).any():
        rank = np.empty(len(sort), np.int64)
        rank[np.asarray(pc.sort_indices(text))] = np.arange(len(sort))
        sort = np.lexsort((rank, left, line, cell))
    ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=total))])
    words = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), text.take(pa.array(sort))), "")

    good = np.flatnonzero(~odd[cell_page])
    heads = np.flatnonzero(_starts(page))
    where = pa.array(heads[cell_page[good]])
    table_no = _extreme(np.maximum, 0, tables, of, table).astype(np.int64)
    numbers = (table_no[cell_of], cell_row + 1, cell_col + 1, cx, cy, cw, ch, filled)
    keys = [held[c].combine_chunks() for c in NAMES[:2]]
    yield pa.RecordBatch.from_arrays([*(k.take(where) for k in keys), *(pa.array(v[good]) for v in numbers), words.take(pa.array(good))], NAMES)
    yield _passed_over(keys, heads[odd])


def _passed_over(keys: list[pa.Array], at: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4 + [pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([*(k.take(pa.array(at)) for k in keys), *(pa.nulls(len(at), t) for t in kinds)], NAMES)


def page_rebuilder(tolerance: float, table_gap: float, least_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows sorted by page to cells; pages are held together over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False

        def numbered(rows: pa.Table) -> np.ndarray:
            keys = [rows[c].combine_chunks() for c in NAMES[:2]]
            new = np.logical_or.reduce([np.asarray(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1))) for k in keys])
            return np.concatenate([[0], np.cumsum(new)])

        def done(rows: pa.Table, page: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``over``: the first page's earlier rows were let go, so it is passed over."""
            if over:
                yield _passed_over([rows[c].combine_chunks() for c in NAMES[:2]], np.zeros(1, np.int64))
                rest = int(np.searchsorted(page, 1))
                rows, page = rows.slice(rest), page[rest:] - 1
            if len(page):
                yield from _rebuilt(rows, page, tolerance, table_gap, least_cells)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < ROWS:
                continue
            page = numbered(held)
            whole = int(np.searchsorted(page, page[-1]))
            if whole:
                yield from done(held.slice(0, whole), page[:whole])
                held, over = held.slice(whole), False
            else:
                # a page that is too large: one row stands for it
                held, over = held.slice(0, 1), True
        if held is not None:
            yield from done(held, numbered(held))

    return run
